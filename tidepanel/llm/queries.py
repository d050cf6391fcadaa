"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import (
    decontaminate,
    exact_dedup,
    extraction,
    importance,
    language,
    minmax,
    packing,
    periodic,
    pii,
    quality,
    simhash,
    tokenfile,
    toxicity,
)
from tidepanel.llm.common import crc_of_id, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(crc_of_id("doc_id"), F.lit(5)) == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query(
    "op3_exact_dedup",
    r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
       doc_id = first_value(doc_id) OVER best AS kept, sha AS text_sha256
FROM n WINDOW best AS (PARTITION BY sha ORDER BY chars DESC, doc_id)
""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op4_decontamination",
    r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)
), doc_windows AS (
  SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM item_windows) WHERE len(w) >= k)
), found AS (
  SELECT doc_id, doc_windows.k, p, item_id FROM doc_windows JOIN item_windows ON doc_windows.k = item_windows.k AND doc_windows.win = item_windows.win
), words AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS word FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hit_words("spans")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query("op5_personal_data")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[number(k) for k in pii.BASE_KINDS],
        F.sha2(pii.written(base), 256).alias("base_sha256"),
        pii.written("spans").alias("spans"),
        pii.written_scores("spans").alias("scores"),
    )


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(crc_of_id("doc_id"), F.lit(3)) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query("op8_main_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfile.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return tokenfile.read_token_files(files)


@query("op10_language")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = language.fit(rows, language.learnable())
    return language.identify(rows, model, ["doc_id"]).select(
        "doc_id", (~language.learnable()).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score")
    )


@query(
    "op11_importance",
    r"""
WITH RECURSIVE crc_steps AS (
  SELECT i AS b, i::BIGINT AS x, 0 AS step FROM range(256) t(i)
  UNION ALL
  SELECT b, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, step + 1 FROM crc_steps WHERE step < 8
), crc_table AS (
  SELECT list(x ORDER BY b) AS t FROM crc_steps WHERE step = 8
), texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark
), words AS (
  SELECT side, id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts
), runs AS (
  SELECT side, id, unnest(w) AS f FROM words
  UNION ALL
  SELECT side, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
), feature_bytes AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM runs)
), buckets AS (
  SELECT f, xor(list_reduce(
      list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT),
      lambda c, v: xor(c >> 8, t[(xor(c & 255, v) + 1)::INT]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket
  FROM feature_bytes, crc_table
), totals AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM runs JOIN buckets USING (f) GROUP BY bucket
), sums AS (
  SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM totals
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (all_s + 10000))::DOUBLE / ((s + 1) * (all_t + 10000))::DOUBLE))::BIGINT AS gain FROM totals, sums
), means AS (
  SELECT id AS doc_id, floor(sum(gain) / count(*))::BIGINT AS weight FROM runs JOIN buckets USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
  SELECT id AS doc_id, len(w) AS n, (len(w) + greatest(len(w) - 1, 0))::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || id::VARCHAR)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN means ON words.id = means.doc_id WHERE side = 'd'
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS fit FROM scored WHERE n >= 20
)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN place <= fit * 25 // 100 THEN place END AS rank
FROM scored LEFT JOIN placed ON scored.doc_id = placed.doc_id
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


@query(
    "op12_minmax",
    r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * met.n >= 85 * (x.n + y.n - met.n)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(node, other) AS (
  SELECT doc_id, doc_id FROM words UNION SELECT node, b FROM reach JOIN both_ways ON other = a
), named AS (
  SELECT node AS doc_id, min(other) AS component_id FROM reach GROUP BY node
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM named LEFT JOIN sizes USING (doc_id)
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"))


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the texts of one id in ten (by crc32) repeat a stretch up to their end."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), h.alias("h"), g.alias("g"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = rows.where("h % 10 = 0 AND text IS NOT NULL").withColumn("w", words).withColumn("n", F.size("w"))
    start = F.when(F.col("n") > 0, F.expr("int(g % n)")).otherwise(0)
    placed = chosen.withColumn("a", start).withColumn("p", F.expr("1 + int(floor((n - a) / (3 + g % 8)))"))
    again = F.expr("transform(w, (x, i) -> if(i >= a, w[a + (i - a) % p], x))")
    rest = rows.where("h IS NULL OR h % 10 <> 0 OR text IS NULL")
    return placed.select("doc_id", F.array_join(again, " ").alias("text")).unionByName(rest.select("doc_id", "text"))


@query("op13_periodic")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("a"), (-r["period"]).alias("q"))))
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.a")).alias("start"),
        F.col("best.n").alias("length"),
        (-F.col("best.q")).alias("period"),
        F.floor(1000 * F.col("best.n") / -F.col("best.q")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
