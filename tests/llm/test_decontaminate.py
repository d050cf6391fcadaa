"""Contamination against plain window sets."""

import random
import re

from tests.llm.frames import PASSAGE, docs_frame, odd_docs, with_odd_names
from tidepanel.llm import decontaminate


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item) if item is not None else "null")
    found = []
    for doc_id, text in docs:
        w, hit, named = words_of(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    named |= own
        found.append((doc_id, len(w), len(hit), tuple(sorted(named))))
    return sorted(found, key=str)


def check(spark, docs, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    got = [
        (x.doc_id, x.n_words, sum(s.end - s.first for s in x.spans), tuple(sorted(x["items"])))
        for x in decontaminate.contamination(docs, benchmark).collect()
    ]
    assert sorted(got, key=str) == brute(rows, items)


def case(seed):
    r = random.Random(seed)
    vocabulary = ["a", "b", "c", "d"]
    text = lambda low, high: " ".join(r.choices(vocabulary, k=r.randint(low, high)))
    items = [(k, text(0, 25)) for k in range(12)] + [(20, "Z é!"), (21, None), (22, "..."), (23, "z É é"), (24, text(3, 5))]
    items += [(30, items[0][1]), (None, "lonely words here")]
    texts = [text(0, 120) for _ in range(30)] + [f"{text(2, 5)} {items[3][1]} {text(2, 5)}", "z é z É", "lonely words here"]
    return texts, items


def test_hits_equal_brute_force(spark):
    for seed in range(4):
        texts, items = case(seed)
        check(spark, docs_frame(spark, texts), items)


def test_several_automata_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", 60)
    texts, items = case(9)
    assert decontaminate.shard_count(spark.createDataFrame(items, "item_id long, text string")) > 1
    check(spark, docs_frame(spark, texts), items)


def test_odd_documents_and_empty_benchmark(spark):
    check(spark, odd_docs(spark), [(1, PASSAGE), (2, "four"), (3, None)])
    check(spark, odd_docs(spark), [(1, None)])
    assert decontaminate.contamination(odd_docs(spark).limit(0), spark.createDataFrame([(1, "x")], "item_id long, text string")).count() == 0


def test_spans_are_cut_and_documents_dropped(spark):
    benchmark = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    filler = "other words " * 40
    docs = docs_frame(spark, [f"{filler}<{PASSAGE}>, {filler}", PASSAGE, "clean text", None])
    got = {x.doc_id: x.text for x in decontaminate.decontaminate(docs, benchmark).collect()}
    assert got == {0: f"{filler}<>, {filler}", 2: "clean text", 3: None}
    strict = decontaminate.decontaminate(docs, benchmark, max_coverage=0.0)
    assert strict.columns == docs.columns and sorted(x.doc_id for x in strict.collect()) == [2, 3]


def test_several_automata_leave_columns_of_any_name_alone(spark, monkeypatch):
    docs = with_odd_names(odd_docs(spark))
    items = spark.createDataFrame([("a", PASSAGE), ("b", "one two three four"), ("c", None)], "item_id string, text string")
    whole = decontaminate.decontaminate(docs, items, max_coverage=0.5).collect()
    monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", 16)
    assert decontaminate.shard_count(items) > 1
    parts = decontaminate.decontaminate(docs, items, max_coverage=0.5)
    assert parts.columns == docs.columns and sorted(parts.collect(), key=str) == sorted(whole, key=str)
    assert 0 < len(whole) < docs.count()


def test_kept_texts_are_sent_to_the_workers_once(spark):
    docs = docs_frame(spark, ["clean text", PASSAGE])
    found, _ = decontaminate.with_hits(docs, spark.createDataFrame([(1, PASSAGE)], "item_id long, text string"), docs.columns)
    plan = found._jdf.queryExecution().analyzed().toString()
    sent = plan[plan.index("MapInArrow") :].split("\n")[1]
    assert sent.count("text#") == 1 and "_text" not in sent
    assert sorted((x.doc_id, x.text, len(x[-1])) for x in found.collect()) == [(0, "clean text", 0), (1, PASSAGE, 1)]
