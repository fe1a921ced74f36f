"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

Each round lets go of the files of the round before: a shuffle takes three files in each task, however few its rows are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import cut, release


def _mark(edges: DataFrame) -> tuple:
    """A digest of an edge table that does not depend on its order: one row comes to the driver."""
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def components(edges: DataFrame) -> DataFrame:
    """u, v: each node but a component's least with the component's least node. edges: u, v (longs), in any direction."""
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).distinct()
        now, before = cut(small), mark
        del both, least, large, low, small
        release(edges.sparkSession)
        mark = _mark(now)
        if mark == before:
            break
    return now
