"""Connected components of an edge table by alternating large-star and small-star steps.

Nothing is collected; each step is aggregates and joins on node keys, written to the shared work folder. A hub's
minimum comes from a partial aggregate, and the joins have plain exchanges on both sides, so that adaptive execution
may split a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, put, work_dir


def connected(edges: DataFrame) -> DataFrame:
    """edges (a long, b long; either order, loops and repeats allowed) -> (id, component): the smallest id reachable.

    Ids without an edge to another id are left out. An empty table gives an empty result.
    """
    spark = edges.sparkSession
    base = work_dir(spark, "components")
    e = put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{base}/0")
    before = _signature(e)
    turn = 0
    while True:
        at = f"{base}/{turn + 1}"
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = put(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{at}-large-min")
        large = put(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{at}-large")
        least2 = put(large.groupBy("u").agg(F.min("v").alias("m")), f"{at}-small-min")
        moved = large.join(least2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = put(moved.unionByName(least2.select("u", F.col("m").alias("v"))).distinct(), at)
        discard(spark, f"{base}/{turn}", f"{at}-large-min", f"{at}-large", f"{at}-small-min")
        after = _signature(new)
        if after == before:
            return new.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(new.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        e, before, turn = new, after, turn + 1


def _signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
