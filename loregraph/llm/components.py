"""Connected components of a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.store import materialize


def _hash(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """Link the larger (large) or the smaller neighbours of each node, and itself, to the smallest of all of them."""
    e = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = materialize(e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), rows)
    e = e.join(low, "u")
    linked = e.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else e.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return materialize(linked.where("u <> v").distinct(), rows)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of each node that has an edge to another in ``edges`` (u, v); root is the smallest node reachable."""
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _hash(edges)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        edges = _star(_star(edges, True, seen[0]), False, seen[0])
        now = _hash(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
