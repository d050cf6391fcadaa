import contextlib
import io
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tools.check_oracle import key, norm

# One query per family on the smallest tables; tools/check_oracle.py runs them all.
SAMPLE = [
    "flagship_monthly_report", "src_03_clean_price_text", "src_05_normalise_frame", "prj_09_split_adjustment", "jn_01_union_calendar",
    "jn_10_log_interpolation", "jn_19_mandate_check", "ag_02_quality_flags", "ag_10_risk_pack", "ag_20_drift_violations",
    "win_06_macd", "win_16_regime", "win_all_technical_features", "top_03_downsample", "set_01_concat_keep_last",
    "scl_07_tactical_decision", "scl_18_enforce_bounds", "opt_03_max_sharpe", "opt_10_efficient_frontier", "ml_03_ridge_single_feature",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=key)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=key)
    assert got == want


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["book", "month_end", "n_days", "month_return", "cum", "drawdown"] and df.count() > 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


# Range joins of the calendar with the quarter table are the only nested loops.
ALLOWED_NESTED = {"jn_12", "jn_13", "jn_14", "win_20", "win_21", "win_22", "ag_18", "scl_08", "wf_walk"}
PLANNED = [
    "win_all_technical_features", "jn_01_union_calendar", "jn_02_strict_overlap", "ag_04_pairwise_covariance", "ag_09_performance_metrics",
    "ag_10_risk_pack", "opt_03_max_sharpe", "rsm_01_block_bootstrap", "scl_07_tactical_decision", "top_02_pareto_filter",
]


@pytest.mark.parametrize("name", PLANNED)
def test_no_products_in_plans(spark, name):
    plan = plan_of(entry.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_date_slice_reaches_the_scan(spark):
    plan = plan_of(entry.queries()["prj_01_date_slice"](spark, SMALL))
    line = next(x for x in plan.splitlines() if "PushedFilters" in x)
    assert "o_orderdate" in line and "GreaterThanOrEqual" in line
    schema = next(x for x in plan.splitlines() if x.startswith("ReadSchema"))
    assert "o_custkey" not in schema


def test_features_shuffle_once_per_aggregate_and_window(spark):
    plan = plan_of(entry.queries()["win_all_technical_features"](spark, SMALL))
    tree = plan.split("\n\n")[0]
    # One exchange for the daily aggregate, one for all windows together.
    assert tree.count("Exchange") <= 2
