"""The pipeline against a brute-force version, stage by stage."""

import re

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.frames import odd_docs, with_odd_names
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_duplicates import brute_components, brute_fingerprint
from tests.llm.test_tokens_packing import WORD, library
from tidepanel.llm import language
from tidepanel.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def brute_kept(spark, docs, benchmark):
    """Ids and texts that should be packed."""
    model = language.fit(docs, language.learnable())
    rows = sorted((r.doc_id, r.text or "") for r in docs.where("doc_id IS NOT NULL").distinct().collect())
    _, _, rejected = model.predict([t for _, t in rows])
    rows = [r for r, gone in zip(rows, rejected, strict=True) if not gone]
    best = {}
    for doc_id, text in rows:
        key = re.sub("[\x20\x09-\x0d]", "", text)
        best[key] = min(best.get(key, (0, doc_id, "")), (-len(text), doc_id, text))
    rows = sorted((d, t) for _, d, t in best.values())
    fps = {d: brute_fingerprint(t) for d, t in rows}
    smallest = brute_components(sorted(fps), fps)
    rows = [(d, t) for d, t in rows if smallest[d] == d]
    hit = {d for d, _, n, _ in contaminated(rows, benchmark) if n}
    return {d: t for d, t in rows if d not in hit}


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    benchmark = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute_kept(spark, docs, benchmark)
    t = library(WORD)
    lengths = {d: len(t.encode(x, add_special_tokens=False).ids) + 1 for d, x in want.items()}
    got = corpus_pipeline.run(spark, SMALL).groupBy("doc_id").agg(F.sum("length")).collect()
    assert dict(map(tuple, got)) == lengths
    assert len(want) < docs.count()


def test_stages_take_odd_documents(spark):
    docs = odd_docs(spark)
    for _, step in corpus_pipeline.STAGES[:-1]:
        found = step(spark, docs, SMALL)
        assert found.columns == docs.columns and found.dtypes == docs.dtypes
        assert step(spark, docs.limit(0), SMALL).count() == 0
        docs = found
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() > 0


def test_stages_take_columns_named_like_their_own(spark):
    plain = docs = odd_docs(spark)
    docs = with_odd_names(docs)
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs, plain = step(spark, docs, SMALL), step(spark, plain, SMALL)
        assert docs.columns[len(plain.columns) :] == with_odd_names(plain).columns[len(plain.columns) :]
        assert docs.select("_row", "_lang", "_rejected", "_spans").distinct().collect() == [(0, 5, 7, 3)]
        assert sorted(docs.select(plain.columns).collect(), key=str) == sorted(plain.collect(), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    got = QUERIES[name](spark, SMALL).select([c[0] for c in want.description])
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)


@pytest.mark.parametrize(("before", "after"), [("10000", "1024"), ("0", "1024"), ("100", "100")])
def test_stages_hand_over_small_batches(spark, before, after):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    try:
        for k, (_, step) in enumerate(corpus_pipeline.STAGES):
            spark.conf.set(name, before)
            with pytest.raises(AttributeError):  # no documents: the step fails once it has set up its session
                step(spark, None, SMALL)
            assert spark.conf.get(name) == after, k
    finally:
        spark.conf.set(name, old)
