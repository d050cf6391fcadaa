"""Runs of words against a quadratic search."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.frames import docs_frame, odd_docs
from tidepanel.llm import periodic
from tidepanel.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def brute(words, min_length=12):
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            run = words[at : end + q]
            if len(run) >= max(min_length, 2 * q) and not any(run[p:] == run[:-p] for p in range(1, q)):
                found.append((at, len(run), q))
            at = end
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def words_with_runs(r):
    n, k = r.randint(0, 150), r.choice([1, 2, 3, 5, 60])
    words = [r.randrange(k) for _ in range(n)]
    if n > 10 and r.random() < 0.6:
        a = r.randrange(n)
        p = 1 + (n - a) // r.randint(2, 9)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


@pytest.mark.parametrize("portion", [1, 5, 64, 1000])
def test_any_portions_give_all_runs(portion):
    r = random.Random(portion)
    for _ in range(150):
        words = words_with_runs(r)
        catcher = periodic.SquareCatcher()
        for at in range(0, len(words), portion):
            catcher.append(np.array(words[at : at + portion], np.int64))
        assert catcher.runs() == brute(words)


def test_runs_are_known_as_soon_as_their_words_are():
    words = [0, 1, 2] * 5 + [9, 8]
    catcher = periodic.SquareCatcher()
    for k, w in enumerate(words, 1):
        catcher.append(np.array([w]))
        assert catcher.runs() == brute(words[:k])


def test_words_with_many_or_no_squares():
    thue_morse = [bin(i).count("1") & 1 for i in range(400)]
    short, fibonacci = [0], [0, 1]
    while len(fibonacci) < 400:
        short, fibonacci = fibonacci, fibonacci + short
    square_free = [sum(1 for _ in g) for g in re.findall("01*", "".join(map(str, thue_morse)))]
    for words in (thue_morse, fibonacci[:400], [3] * 400, ([0, 1] * 8 + [2]) * 20, square_free):
        for least in (5, 12):
            catcher = periodic.SquareCatcher(least)
            catcher.append(np.array(words, np.int64))
            assert catcher.runs() == brute(words, least)


def test_texts_in_one_stream_do_not_touch(monkeypatch):
    r = random.Random(8)
    texts = [[b"%d" % w for w in words_with_runs(r)] for _ in range(120)] + [[b"a"] * 20] * 5
    want = [brute(t) for t in texts]
    assert periodic.runs_of_texts(texts) == want
    monkeypatch.setattr(periodic, "PORTION", 37)
    assert periodic.runs_of_texts(texts) == want
    assert [periodic.collapsed(t, w) for t, w in zip(texts, want, strict=True)] == [b" ".join(kept(t, w)) for t, w in zip(texts, want, strict=True)]
    assert periodic.runs_of_texts([]) == [] and periodic.runs_of_texts([[], []]) == [[], []]


def test_long_periodic_texts_stay_linear():
    """A quadratic search would not end here."""
    words = [b"a"] * 300_000
    assert periodic.runs_of_texts([words]) == [[(0, 300_000, 1)]]
    nested = ([b"a", b"b", b"c", b"d"] * 7 + [b"x"]) * 4_000
    assert len(periodic.runs_of_texts([nested])[0]) == 4_001


def test_odd_documents(spark):
    docs = odd_docs(spark).unionByName(docs_frame(spark, ["so it goes on " * 9, "A b " * 5, "x y z " * 3 + "x y z"], 500))
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    want = []
    for doc_id, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        runs = [(0, len(words), 1)] if len(words) > 1000 and len(set(words)) == 1 else brute(words)
        want.append((doc_id, len(words), runs, " ".join(kept(words, runs))))
    got = [(x.doc_id, x.n_words, [tuple(r) for r in x.runs], x.collapsed) for x in periodic.periodic_runs(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    """The registered query over a whole table, planted periods included."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for doc_id, text in docs:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        codes = {w: k for k, w in enumerate(dict.fromkeys(words))}
        runs = brute([codes[w] for w in words]) if n < 3000 else periodic.runs_of_texts([[w.encode() for w in words]])[0]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        lines = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
        want.append((doc_id, len(runs), *best, milli, sha(lines), sha(" ".join(kept(words, runs)))))
    got = [tuple(x) for x in QUERIES["op13_periodic"](spark, SMALL).collect()]
    assert sorted(got) == sorted(want)
    assert sum(1 for x in want if x[1]) > len(want) // 20
