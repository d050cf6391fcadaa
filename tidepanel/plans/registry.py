"""Named queries with, where SQL can say the same, the matching ANSI SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.session import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_RUN: dict[tuple[str, str], DataFrame] = {}


def once(name: str, sf_dir: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table several steps of the running query read, built and staged a single time,
    so that the raw tables are scanned once however often the panel is used."""
    if (name, sf_dir) not in _RUN:
        _RUN[name, sf_dir] = stage(build(), name)
    return _RUN[name, sf_dir]


def _portable(df: DataFrame) -> DataFrame:
    """Dates leave as ISO text, so both engines hand over the same value type."""
    return df.select(
        *[
            F.col(f"`{n}`").cast("string").alias(n) if t == "date" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def run_query(fn, spark: SparkSession, sf_dir: str) -> DataFrame:
    _RUN.clear()
    return _portable(fn(spark, sf_dir))


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run_query(fn, spark, sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# --- SQL building blocks (DuckDB dialect) -----------------------------------

W = "PARTITION BY asset ORDER BY date"


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def d(col: str = "date") -> str:
    return f"CAST({col} AS VARCHAR)"


def ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n"


PRICES = f"""
p0 AS (SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS p0
       FROM orders GROUP BY 1, 2),
prices AS (SELECT asset, date, avg(p0) OVER ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS price FROM p0)
"""
STAGGERED = PRICES + """,
stag AS (SELECT * FROM prices
         WHERE NOT (asset = '5-LOW' AND date < DATE '1999-01-01')
           AND NOT (asset = '4-NOT SPECIFIED' AND date > DATE '1999-06-30'))
"""


def returns_cte(src: str = "prices", name: str = "rets") -> str:
    return f"{name} AS (SELECT asset, date, price, price / lag(price) OVER ({W}) - 1 AS ret FROM {src})"


RETS = PRICES + ", " + returns_cte()
SRETS = STAGGERED + ", " + returns_cte("stag", "srets")
INSTRUMENTS = f"""
i0 AS (SELECT p_brand AS asset, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS p0
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
iprices AS (SELECT asset, date, avg(p0) OVER ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS price FROM i0)
"""
BOOKS = """
held AS (SELECT c_mktsegment AS book, o_orderpriority AS asset, sum(o_totalprice) AS v
         FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
books AS (SELECT book, asset, v / sum(v) OVER (PARTITION BY book) AS w FROM held)
"""


def values(name: str, cols: str, rows) -> str:
    """A literal parameter table as a CTE; floats are written as DOUBLE."""

    def lit(x):
        if isinstance(x, str):
            return f"DATE '{x[5:]}'" if x.startswith("date:") else "'" + x.replace("'", "''") + "'"
        if isinstance(x, float):
            return f"CAST({x!r} AS DOUBLE)"
        return "NULL" if x is None else str(x)

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"{name}({cols}) AS (VALUES {body})"
