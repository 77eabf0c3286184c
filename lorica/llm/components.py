"""Connected components of an edge table by alternating large-star and small-star steps, each step one aggregation
and one join; nothing is collected but the number of edges and a checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _star(links: DataFrame, large: bool) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = links.join(least, links["u"] == least["w"])
    out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges: (a, b), any order, repeats and loops allowed. Returns (id, component_id): each id with an edge to another
    id, and the smallest id reachable from it."""
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(most):
        large = _star(_both(now), True)
        small = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        now = keep(_star(small, False))
        seen = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0)).alias("s")).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
