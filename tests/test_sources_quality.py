import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import drift as D
from tidepanel.operators import quality as Q
from tidepanel.session import fresh_path
from tidepanel.sources import files as S

HEAD = "`Date` STRING, `Price` STRING, `Vol.` STRING, `Change %` STRING, ingest_seq BIGINT, asset STRING"


def test_vendor_text_is_cleaned(spark):
    rows = [
        ("01/02/2020", "51,760.97", "637.54M", "-1.19%", 1, "A"),
        ("01/03/2020", "10", "-", "0.5%", 1, "A"),
        ("01/04/2020", "10", "3.2K", "x", 1, "A"),
        ("99/99/2020", "10", "1M", "1%", 1, "A"),
        ("01/05/2030", "10", "1M", "1%", 1, "A"),
    ]
    out = S.clean_prices(spark.createDataFrame(rows, HEAD), "2020-01-01", "2020-12-31").orderBy("date").collect()
    assert [r["price"] for r in out] == [51760.97, 10, 10]
    assert [r["vol"] for r in out] == [637.54, None, None]
    assert [r["change_pct"] for r in out] == [-1.19, 0.5, None]
    aware = S.clean_prices(spark.createDataFrame(rows, HEAD), "2020-01-01", "2020-12-31", unit_aware=True).orderBy("date").collect()
    assert aware[2]["vol"] == pytest.approx(0.0032)


def test_newest_restatement_wins(spark):
    rows = [("A", dt.date(2020, 1, 1), 1.0, 1), ("A", dt.date(2020, 1, 1), 2.0, 3), ("A", dt.date(2020, 1, 1), 9.0, 2), ("A", None, 5.0, 9), ("A", dt.date(2020, 1, 2), None, 1)]
    out = S.normalise_frame(spark.createDataFrame(rows, "asset STRING, date DATE, price DOUBLE, ingest_seq BIGINT")).collect()
    assert [(r["date"], r["price"]) for r in out] == [(dt.date(2020, 1, 1), 2.0)]
    with pytest.raises(ValueError):
        S.normalise_frame(spark.createDataFrame([("A", 1.0)], "asset STRING, price DOUBLE"))


def test_flags_count_missing_returns_as_zero(spark):
    day = dt.date(2020, 1, 1)
    rows = [("A", day, None), ("A", day + dt.timedelta(1), 0.0), ("A", day + dt.timedelta(50), 0.1), ("A", day + dt.timedelta(50), 0.2)]
    x = spark.createDataFrame(rows, "asset STRING, date DATE, ret DOUBLE")
    f = Q.quality_flags(x).first()
    assert (f["max_gap_days"], f["duplicate_timestamps"], f["stale_series_flag"]) == (49, 1, True)
    assert f["zero_return_pct"] == 0.5
    assert Q.summarise(x).first()["zero_pct"] == pytest.approx(1 / 3)


def test_sections_not_in_the_run_are_kept(spark):
    path = fresh_path(spark, "test-sections")
    S.save_sections(spark.createDataFrame([("a", 1), ("b", 1)], "section STRING, v INT"), path)
    S.save_sections(spark.createDataFrame([("b", 2)], "section STRING, v INT"), path)
    assert {(r["section"], r["v"]) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 2)}


def test_report_rows_have_no_nan(spark):
    df = spark.createDataFrame([(float("nan"), float("inf"), 1.5)], "a DOUBLE, b DOUBLE, c DOUBLE")
    assert S.report_rows(df).first()["document"] == '{"a":null,"b":null,"c":1.5}'


def constant(panel, value):
    return panel({"R": [value] * 100, "X": [value] * 100}, name="ret")


def test_drift_statuses(spark, panel):
    now, then = D.fingerprint(constant(panel, 0.002), "R"), D.fingerprint(constant(panel, 0.0005), "R")
    assert D.status(D.violations(now, then), then).first()["status"] == "alert"
    assert D.status(D.violations(now, now), now).first()["status"] == "ok"
    none = S.read_fingerprint(spark, "/tmp/no-such-baseline")
    assert D.status(D.violations(now, none), none).first()["status"] == "no_baseline"
    zero = then.withColumn("mean_ann", F.lit(0.0))
    assert D.violations(now, zero).filter("type = 'mean_shift'").count() == 0


def test_baseline_roundtrip_and_garbage(spark, panel):
    fp = D.fingerprint(constant(panel, 0.002), "R")
    path = fresh_path(spark, "test-baseline")
    D.write_fingerprint(fp, path, "2020-01-01")
    assert {tuple(r) for r in S.read_fingerprint(spark, path).collect()} == {tuple(r) for r in fp.collect()}
    bad = fresh_path(spark, "test-garbage")
    spark.createDataFrame([("{not json",)], "v STRING").write.text(bad)
    assert S.read_fingerprint(spark, bad).count() == 0


def test_rows_without_order_survive(spark, tmp_path):
    """Vendor files have seven columns and no ingest number: of a day that comes twice the
    later line stays, of two files the later one, and nothing is lost."""
    head = '"Date","Price","Open","High","Low","Vol.","Change %"\n'
    line = lambda day, price: f'"{day}","{price}","1","1","1","2.5M","0.1%"\n'
    folder = tmp_path / "gold"
    folder.mkdir()
    (folder / "a.csv").write_text(head + line("01/03/2020", "1,000.5") + line("01/04/2020", "7") + line("01/03/2020", "1,001.5"))
    catalog = spark.createDataFrame([("gold", "Gold")], "folder STRING, asset STRING")
    raw = S.scan_asset_files(spark, str(tmp_path), catalog)
    clean = S.clean_prices(raw, "2000-01-01", "2030-01-01")
    got = {str(r.date): r.price for r in S.normalise_frame(clean.select("asset", "date", "price", "vol", "ingest_seq", "read_order")).collect()}
    assert got == {"2020-01-03": 1001.5, "2020-01-04": 7.0}
    tied = spark.createDataFrame([("A", "2020-01-03", 2.0, None), ("A", "2020-01-03", 1.0, None), ("A", "2020-01-03", None, 1)], "asset STRING, date STRING, price DOUBLE, ingest_seq BIGINT")
    tied = tied.withColumn("date", tied["date"].cast("date"))
    assert S.normalise_frame(tied).collect() == []
    assert [r.price for r in S.normalise_frame(tied.where("ingest_seq IS NULL").repartition(3)).collect()] == [2.0]


def test_nested_numbers_are_json_safe(spark):
    df = spark.sql("SELECT array(double('NaN'), 1D) AS a, named_struct('x', double('inf'), 'y', 'k') AS s, map('m', double('-inf')) AS m, 2 AS n")
    assert S.report_rows(df).first().document == '{"a":[null,1.0],"s":{"x":null,"y":"k"},"m":{"m":null},"n":2}'
