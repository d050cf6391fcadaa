"""Reproducible draws as plain integer arithmetic on row identifiers.

A draw depends only on the ids it is asked for, never on partitioning or row order,
so a recomputed task yields the same numbers, and any SQL engine can repeat them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODULUS = 2147483647  # 2^31 - 1
MULTIPLIERS = (48271, 69621, 16807, 39373)
ROUNDS = ((40692, 1), (630360016, 7), (742938285, 11))


def _seeded(*ids: Column | int) -> Column:
    h = F.lit(0).cast("long")
    for k, x in zip(MULTIPLIERS, ids):
        x = F.lit(x) if isinstance(x, int) else x
        h = h + x.cast("long") * F.lit(k).cast("long")
    return h % MODULUS


def mix(*ids: Column | int) -> Column:
    """Hash of up to four ids in [0, 2^31 - 1); squaring keeps 64-bit range."""
    h = _seeded(*ids)
    for a, b in ROUNDS:
        h = (h * (h + F.lit(a).cast("long")) + b) % MODULUS
    return h


def uniform(*ids: Column | int) -> Column:
    """In the open interval (0, 1)."""
    return (mix(*ids) + 0.5) / float(MODULUS)


def with_uniforms(df: DataFrame, draws: dict[str, tuple[Column | int, ...]]) -> DataFrame:
    """Add several uniform columns at once.

    Each mixing round is its own one-row ``inline``: the optimiser does not push
    filters or inline projections through a generator, so a round's result is
    computed once instead of being copied into every later use.
    """
    start = {n: _seeded(*ids) for n, ids in draws.items()}
    df = _fixed(df, start)
    for a, b in ROUNDS:
        step = {n: (F.col(n) * (F.col(n) + F.lit(a).cast("long")) + b) % MODULUS for n in draws}
        df = _fixed(df, step)
    return _fixed(df, {n: (F.col(n) + 0.5) / float(MODULUS) for n in draws})


def _fixed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    kept = [F.col(n) for n in df.columns if n not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[x.alias(n) for n, x in columns.items()]))))


def box_muller(u: Column, v: Column) -> Column:
    """Standard normal from two uniforms."""
    return F.sqrt(-2.0 * F.log(u)) * F.cos(v * (2.0 * math.pi))


def mix_sql(*ids: str) -> str:
    h = "(" + " + ".join(f"CAST({x} AS BIGINT) * {k}" for k, x in zip(MULTIPLIERS, ids)) + f") % {MODULUS}"
    for a, b in ROUNDS:
        h = f"list_transform([{h}], lambda h: (h * h + h * {a} + {b}) % {MODULUS})[1]"
    return h


def uniform_sql(*ids: str) -> str:
    return f"(({mix_sql(*ids)}) + 0.5) / CAST({MODULUS} AS DOUBLE)"


def mix_lambda(*ids: str | int) -> str:
    """``mix`` as text for Spark's higher-order functions, each round worked out once."""
    h = "(" + " + ".join(f"CAST({x} AS BIGINT) * {k}" for k, x in zip(MULTIPLIERS, ids)) + f") % {MODULUS}"
    for a, b in ROUNDS:
        h = f"transform(array({h}), h -> (h * (h + {a}) + {b}) % {MODULUS})[0]"
    return h
