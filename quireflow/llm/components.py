"""Connected components of a graph held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.store import dropped, written


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links between values of one orderable type -> (node, root), root the smallest node reachable.

    Alternates large-star and small-star steps until nothing changes; the number of
    rounds grows with the logarithm of the diameter. Each round is written to the shared
    folder. A node's links are reduced to their minimum map-side; the join back to the
    links of a node with very many is split by Spark's skew handling. Loops, repeated
    links and nulls are dropped; an empty table gives an empty one.
    """
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = _signature(e)
    while seen[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, written(small.union(floor.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        dropped(old)
        now = _signature(e)
        if now == seen:
            break
        seen = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(e.select("v", "v").distinct())
