"""Importance resampling against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.frames import docs_frame, odd_docs
from tidepanel.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def brute(docs, targets, percent=25, min_words=20, seed=7, buckets=10_000):
    source, target = (Counter(bucket(f, buckets) for t in texts for f in features(t)[1]) for texts in ([t for _, t in docs], targets))
    n_source, n_target = sum(source.values()), sum(target.values())
    gain = lambda b: math.floor(1000 * math.log((target[b] + 1) * (n_source + buckets) / ((source[b] + 1) * (n_target + buckets))))
    rows = []
    for doc_id, text in docs:
        words, own = features(text)
        weight = sum(gain(bucket(f, buckets)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(words), len(own), weight, score])
    fit = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0], r[2], r[1]))
    rank = {}
    for k, r in enumerate(fit[: len(fit) * percent // 100], 1):
        rank.setdefault(tuple(r), []).append(k)
    return sorted(((*r, rank[tuple(r)].pop() if rank.get(tuple(r)) else None) for r in rows), key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)


def case(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["É", "straße", "日本", "x" * 60]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    text = lambda n: " ".join(r.choices(vocabulary, weights, k=n))
    return [text(r.randint(0, 90)) for _ in range(120)], [text(30) for _ in range(9)] + [None, ""]


@pytest.mark.parametrize("head", [40, 1 << 16])
def test_equals_plain_loops(spark, head):
    texts, targets = case(head)
    docs, target = docs_frame(spark, texts).repartition(5), spark.createDataFrame([(t,) for t in targets], "text string")
    got = importance.resample(docs, target, head_words=head)
    assert result(got) == brute(list(enumerate(texts)), targets)


def test_other_parameters_and_hot_copies(spark):
    texts, targets = case(3)
    texts += [texts[5] + " " + texts[6]] * 200
    docs, target = docs_frame(spark, texts), spark.createDataFrame([(t,) for t in targets], "text string")
    got = importance.resample(docs, target, percent=60, min_words=5, seed=11, buckets=500)
    assert result(got) == brute(list(enumerate(texts)), targets, 60, 5, 11, 500)
    drawn = importance.drawn_documents(docs, target, percent=60)
    assert drawn.columns == docs.columns and 0 < drawn.count() < docs.count()


def test_head_words_pairs_and_tail_have_the_same_buckets():
    r = random.Random(1)
    words = [bytes(r.choices(range(97, 123), k=r.randint(1, 48))) for _ in range(60)]
    docs = [r.choices(words, k=80), [], [words[0]], r.choices(words, k=2)]
    want = None
    for n, square in ((0, 0), (10, 4), (60, 60), (60, 7)):
        got = [x.tolist() for x in importance.Head(words[:n], 997, square).features(docs)]
        want = want or got
        assert got == want
    assert want[0][:80] == [zlib.crc32(w) % 997 for w in docs[0]]
    assert want[2][:79] == [zlib.crc32(a + b" " + b) % 997 for a, b in zip(docs[0], docs[0][1:], strict=False)]


def test_odd_documents_and_empty_tables(spark):
    docs = odd_docs(spark)
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    for targets in ([], ["alpha beta gamma"]):
        target = spark.createDataFrame([(t,) for t in targets], "text string")
        assert result(importance.resample(docs, target, min_words=1, percent=50)) == brute(rows, targets, 50, 1)
        assert importance.resample(docs.limit(0), target).count() == 0


def test_gains_fall_where_the_documents_have_more():
    got = importance.gains_of(np.array([0, 5, 50]), np.array([10, 10, 10]))
    assert got[0] > got[1] > got[2]
