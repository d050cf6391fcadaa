"""Min-max hashing against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.frames import docs_frame, odd_docs
from tidepanel.llm import minmax
from tidepanel.llm.exact_dedup import among


def shingles(text, k=5):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, threshold=85):
    """(doc_id, size, component, kept) of rows with ids of their own."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in ids)


def near_texts(r, groups, copies, words=120):
    """Groups of texts with one to eight words changed: similarities on both sides of 0.85."""
    texts = []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(words)]
        texts.append(" ".join(base))
        for _ in range(copies):
            own = list(base)
            for k in r.sample(range(words), r.randint(1, 8)):
                own[k] = f"x{r.random()}"
            texts.append(" ".join(own))
    r.shuffle(texts)
    return texts


def check(spark, texts, **options):
    docs = docs_frame(spark, texts).repartition(3)
    got = sorted(tuple(x) for x in minmax.near_duplicates(docs, **options).collect())
    assert got == brute(list(enumerate(texts)), options.get("threshold", 85))


def test_components_equal_all_pairs(spark):
    check(spark, near_texts(random.Random(1), 6, 14) + ["one two", "One  TWO", "one two three four five", "", None])


@pytest.mark.parametrize("rounds", [0, 1])
def test_rest_of_buckets_in_parts_and_chunks(spark, monkeypatch, rounds):
    monkeypatch.setattr(minmax, "ROUNDS", rounds)
    monkeypatch.setattr(minmax, "PART_ROWS", 5)
    check(spark, near_texts(random.Random(2), 2, 22))


def test_other_threshold_and_copies(spark):
    r = random.Random(3)
    texts = near_texts(r, 3, 8, 60)
    check(spark, texts + [texts[0]] * 40, threshold=70, bands=60, rows=4)


def test_odd_documents(spark):
    docs = odd_docs(spark)
    rows = [(x.doc_id, x.text) for x in docs.where("doc_id IS NOT NULL").select("doc_id", "text").distinct().collect()]
    want = {d: (n, c, k) for d, n, c, k in brute(rows)}
    got = minmax.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for x in got:
        if x.doc_id is None:
            assert (x.component_id, x.kept) == (None, False)
        else:
            assert (x.n_shingles, x.component_id, x.kept) == want[x.doc_id]
    assert minmax.near_duplicates(docs.limit(0)).count() == 0


def test_one_id_for_several_texts(spark):
    """Texts are told apart by their sets, not by ids."""
    texts = [" ".join(f"t{k}w{i}" for i in range(30)) for k in range(3)]
    docs = spark.createDataFrame([(5, texts[0]), (5, texts[1]), (2, texts[1]), (None, texts[2]), (None, texts[0])], "doc_id long, text string")
    got = sorted(((x.doc_id, x.component_id) for x in minmax.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 5), (5, 2), (2, 2), (None, None), (None, 5)], key=str)


def test_agreement_of_signatures_estimates_similarity():
    r = np.random.default_rng(4)
    by = minmax.multipliers(2000)
    values = np.unique(r.integers(0, 1 << 63, 1000).astype(np.uint64))
    a, b = values[:800], values[200:]
    agree = minmax.signature(a, by) == minmax.signature(b, by)
    assert abs(agree.mean() - 0.6) < 0.03
    assert abs(agree[:2000].mean() - 0.6) < 0.05 and abs(agree[2000:].mean() - 0.6) < 0.05


def test_texts_of_sets_are_not_shuffled(spark):
    """Sets are taken where texts are read, by few texts besides the wanted ones."""
    texts = near_texts(random.Random(4), 3, 2) + [f"alone {k} one two three four" for k in range(400)] + [None]
    docs = docs_frame(spark, texts)
    wanted = spark.createDataFrame([(3,), (5,), (None,)], "least long")
    some = among(docs.select("doc_id", "text"), "doc_id", wanted).collect()
    assert {3, 5} <= {r.doc_id for r in some} and len(some) < 10 and all(r.text == texts[r.doc_id] for r in some)
    digests = {k: minmax._digest(minmax._sets(pa.RecordBatch.from_pydict({"text": [t]}), 0, 5)[0]) for k, t in enumerate(texts[:9])}
    nodes = spark.createDataFrame([(50 + k, *digests[k], k) for k in (0, 4)], "node long, hi long, lo long, least long")
    sets = minmax.sets_of(docs.unionByName(docs), nodes, 5, "doc_id", "text")
    assert {r.node: r.n for r in sets.collect()} == {50 + k: len(shingles(texts[k])) for k in (0, 4)} and sets.count() == 2
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "text" in line]
