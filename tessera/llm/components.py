"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    near = both if large else both.filter("v < u")
    low = near.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    joined = near.join(low, "u")
    moved = joined.filter("v > u").select("low", "v") if large else joined.select("low", "v").unionByName(low.select("low", F.col("u").alias("v")))
    return moved.filter("low <> v").select(F.col("low").alias("a"), F.col("v").alias("b")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, component): each node of ``edges`` (columns a, b of one type with an order) with the smallest node it can reach.

    Rows with a null end or equal ends are ignored, repeated and reversed rows
    count once, and no edges give no rows.  Each round costs a few shuffles of
    the edges and writes them to the shared folder; the number of rounds grows
    with the logarithm of the longest chain, and ``most_rounds`` is far beyond
    what any table needs; if it is met, an error says so.
    """
    clean = edges.filter("a is not null and b is not null and a <> b")
    edges = materialise(clean.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        edges = materialise(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == mark:
            roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
        mark = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
