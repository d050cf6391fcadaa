"""Exact and near-duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash

from tests.llm.frames import docs_frame, odd_docs
from tidepanel.llm import exact_dedup, simhash
from tidepanel.llm.components import components
from tidepanel.llm.quotient import CountingQuotientFilter


def test_filters_merge_without_loss():
    r = np.random.default_rng(1)
    parts = [r.integers(0, 1 << 20, 700).astype(np.uint64) << np.uint64(39) for _ in range(5)]
    merged = None
    for part in parts:
        f = CountingQuotientFilter.from_bytes(CountingQuotientFilter.build(part, 60, 8).to_bytes())
        merged = f if merged is None else merged.merge(f)
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    got = merged.entries()
    assert (got[0] == values).all() and (got[1] == counts).all()
    empty = CountingQuotientFilter.build(np.empty(0, np.uint64), 60, 8)
    assert len(CountingQuotientFilter.from_bytes(empty.to_bytes()).entries()[0]) == 0


def brute_exact(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", text or ""), []).append((doc_id, text or ""))
    found = []
    for normal, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        sha = hashlib.sha256(normal.encode()).hexdigest()
        found += [(d, keep, len(own), d == keep, sha) for d, _ in own]
    return sorted(found, key=str)


def test_exact_duplicates(spark):
    r = random.Random(2)
    texts = [" ".join(r.choices(["a", "b", "  c\n"], k=r.randint(0, 3))) for _ in range(300)] + ["hot text"] * 200
    for df in (odd_docs(spark), docs_frame(spark, texts).repartition(7)):
        rows = [(x.doc_id, x.text) for x in df.select("doc_id", "text").collect()]
        got = [tuple(x) for x in exact_dedup.exact_duplicates(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
        assert sorted(got, key=str) == brute_exact(rows)
        kept = exact_dedup.drop_duplicates(df)
        assert kept.columns == df.columns
        assert {x.doc_id for x in kept.collect()} == {x[1] for x in got}


def test_full_route_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "route_bitmap", lambda repeated, n: (16, np.full(1 << 13, 255, np.uint8)))
    test_exact_duplicates(spark)


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark):
    r = random.Random(4)
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(base[:k] + [f"x{r.random()}"] + base[k + 1 :]) for k in r.sample(range(400), 60)]
    df = odd_docs(spark).unionByName(docs_frame(spark, texts, 1000))
    rows = [(x.doc_id, x.text) for x in df.where("doc_id IS NOT NULL").select("doc_id", "text").distinct().collect()]
    fps = {i: brute_fingerprint(t) for i, t in rows}
    want = brute_components(sorted(fps), fps)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == df.count()
    for x in got:
        if x.doc_id is not None:
            assert (x.fingerprint, x.component_id) == (f"{fps[x.doc_id]:016x}", want[x.doc_id])
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert {x.doc_id for x in kept.collect()} - {None} == set(want.values())


def cloud(n, seed):
    """Fingerprints in and around dense clusters."""
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(12)]
    found = set()
    while len(found) < n:
        x = r.choice(centres)
        for b in r.sample(range(64), r.randint(0, 6)):
            x ^= 1 << b
        found.add(x)
    return sorted(found)


def check_links(spark, n):
    fps = dict(enumerate(cloud(n, n)))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in fps.items()], "fp long, id long")
    links = simhash.near_links(nodes)
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in links.collect())
    want = brute_components(sorted(fps), fps)
    got = {x.node: x.component for x in components(links).collect()}
    assert {i: got.get(i, i) for i in fps} == want


def test_links_of_dense_clusters(spark):
    check_links(spark, 900)


def test_links_when_parts_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART_ROWS", 20)
    monkeypatch.setattr(simhash, "SWEEP", 6)
    check_links(spark, 500)


def test_components_of_long_chains(spark):
    links = [(k, k + 1) for k in range(200) if k % 50 != 49] + [(7, 3), (5, 5)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: k // 50 * 50 for k in range(201) if k != 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    """Repeated, hot and missing ids: no text may be lost, and none may stay twice."""
    texts = {k: " ".join(f"{w}{k}" for w in ("red", "blue", "green", "grey", "pink")) for k in range(9)}
    ids = [(1, 0), (2, 0), (2, 1), (2, 2), (2, 2), (7, 3), (7, 4), (7, 5), (3, 3), (None, 6), (None, 6), (None, 7), (None, 1), (8, 8), (8, 8)]
    docs = spark.createDataFrame([(d, texts[t], d) for d, t in ids], "doc_id long, text string, _row long").repartition(3)
    want = sorted([(1, 0), (2, 1), (2, 2), (3, 3), (7, 4), (7, 5), (-1, 6), (-1, 7), (8, 8)])
    named = {t: k for k, t in texts.items()}
    for drop in (exact_dedup.drop_duplicates, simhash.drop_near_duplicates):
        kept = drop(docs)
        assert kept.columns == docs.columns
        assert sorted((-1 if x.doc_id is None else x.doc_id, named[x.text]) for x in kept.collect()) == want, drop


def test_rows_that_stay_are_not_moved(spark):
    rows = spark.range(4000).selectExpr("id AS r", "concat('text ', id) AS text")
    gone = spark.range(0, 4000, 40).selectExpr("id AS r")
    left = exact_dedup.without(rows, "r", gone)
    assert sorted(x.r for x in left.collect()) == [k for k in range(4000) if k % 40]
    assert all(x.text == f"text {x.r}" for x in left.collect())
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")  # the join has its own branch, of the rows that may go
    assert exact_dedup.without(rows, "r", gone.where("r < 0")).count() == 4000


def test_empty_tables(spark):
    none = docs_frame(spark, ["x"]).where("doc_id < 0")
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
