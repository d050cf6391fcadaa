"""Connected components of a large graph by alternating star contraction.

Every round replaces edges by edges to smaller neighbours, until each node hangs on the
smallest node of its component. Rounds grow with the logarithm of the longest chain. Each
round is a written table in the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    both = both.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    # written, so that the join below reads it as a plain table and a node with very many
    # neighbours can be split over tasks
    least = stage(both.groupBy("u").agg(F.min("v").alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.least("m", "u").alias("lo"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them."""
    edges = stage(edges, "large-star")
    least = stage(edges.groupBy("hi").agg(F.min("lo").alias("m")), "least")
    joined = edges.join(least, "hi")
    return (
        joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        .unionByName(joined.select("hi", F.col("m").alias("lo")))
        .where("hi > lo")
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node with a link; a component's name is its smallest
    node. ``links`` has two columns of the same ordered type; repeats do no harm."""
    a, b = links.columns
    edges = stage(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "links"
    )
    before = _state(edges)
    while before[0]:
        edges = stage(_small_star(_large_star(edges)), "stars")
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
