"""Exact percentiles, with linear interpolation, of groups of any size.

Spark's own percentile keeps all distinct values of a group in one buffer. That is the quickest way for groups that fit; for
larger ones a mergeable sketch brackets each rank, the values below a bracket are counted, and only the values inside it, some
6 in 10,000, are put in order. Both ways give the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrylens.operators.series import estimated_bytes

#: Rows of the largest group up to which its distinct values are kept in one buffer, groups that may be broadcast for a join.
BUFFER_ROWS, BROADCAST_GROUPS = 20_000_000, 100_000
ACCURACY, MARGIN = 10_000, 3
#: Groups of fewer rows are their own bracket.
LEAST_ROWS = 4 * ACCURACY


def grouped(df: DataFrame, keys: list[str], value: Column, percentiles: list[float], aggregates: list[Column], buffer_rows: int = BUFFER_ROWS) -> DataFrame:
    """keys, the aggregates, and _p: the percentiles (0 to 1) of the value, in their order; null for groups without a value.

    Rows are counted only if the plan's own estimate of its size leaves it open that a group is large.
    """
    large = estimated_bytes(df) > buffer_rows and df.count() > buffer_rows and (df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > buffer_rows
    if not large:
        return df.groupBy(*keys).agg(*aggregates, F.percentile(value, F.array(*map(F.lit, percentiles))).alias("_p"))
    found = refined(df, keys, value, percentiles)
    if not keys:
        return df.agg(F.count("*").alias("_all"), *aggregates).drop("_all").join(F.broadcast(found), F.lit(True), "left")  # one row
    made = (df.groupBy(*keys).agg(*aggregates) if aggregates else df.select(*keys).distinct()).alias("_a")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_a.{k}").eqNullSafe(F.col(f"_f.{k}"))
    return made.join(found.alias("_f"), same, "left").select("_a.*", "_f._p")


def at_levels(df: DataFrame, levels: list[list[str]], value: Column, percentiles: list[float], aggregates: list[Column], buffer_rows: int = BUFFER_ROWS) -> DataFrame:
    """`grouped` for several sets of keys in one pass over df: all keys (null where a level has them not), _level (its place in
    `levels`), the aggregates, _p. The aggregates and the value must not use the keys."""
    keys = list(dict.fromkeys(k for level in levels for k in level))
    rows = df.withColumn("_level", F.explode(F.array(*(F.lit(n) for n in range(len(levels))))))
    rows = rows.withColumns({k: F.when(F.col("_level").isin([n for n, level in enumerate(levels) if k in level]), F.col(k)) for k in keys})
    return grouped(rows, [*keys, "_level"], value, percentiles, aggregates, buffer_rows)


def refined(df: DataFrame, keys: list[str], value: Column, percentiles: list[float]) -> DataFrame:
    """keys, _p, by brackets."""
    rows = df.where(value.isNotNull()).select(*keys, value.cast("double").alias("_v"))
    d = MARGIN / ACCURACY
    ends = [e for q in percentiles for e in (max(q - d, 0.0), min(q + d, 1.0))]
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.percentile_approx("_v", F.array(*map(F.lit, ends)), F.lit(ACCURACY)).alias("_e"))
    wide = F.col("_n") < LEAST_ROWS

    def bracket(k: int, q: float) -> Column:
        low = F.when(wide | F.lit(q <= d), F.col("_lo")).otherwise(F.col("_e")[2 * k])
        high = F.when(wide | F.lit(q >= 1 - d), F.col("_hi")).otherwise(F.col("_e")[2 * k + 1])
        return F.struct(F.lit(k).alias("k"), low.alias("low"), high.alias("high"), (F.lit(q) * (F.col("_n") - 1)).alias("at"))

    brackets = sketch.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.array(*(bracket(k, q) for k, q in enumerate(percentiles))).alias("_b"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    few = not keys or brackets.count() <= BROADCAST_GROUPS
    joined = rows.join(F.broadcast(brackets) if few else brackets, same).select(*keys, "_v", "_b")
    # The value itself inside a bracket; below one, only that it is.
    met = F.filter(F.transform("_b", lambda b: F.struct(b["k"].alias("k"), b["at"].alias("at"), F.when(F.col("_v") >= b["low"], F.col("_v")).alias("v"), (F.col("_v") <= b["high"]).alias("inside"))), lambda x: x["inside"])
    counted = joined.select(*keys, "_v", F.explode(met).alias("_x")).groupBy(*keys, "_x.k", "_x.at", "_x.v").agg(F.count("*").alias("_c"))
    order = W.partitionBy(*keys, "k").orderBy(F.col("v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    upto = counted.withColumn("_upto", F.sum("_c").over(order))
    low, high = F.floor("at"), F.ceil("at")
    pair = upto.groupBy(*keys, "k").agg(F.min("at").alias("at"), F.min(F.when(F.col("_upto") > low, F.col("v"))).alias("_a"), F.min(F.when(F.col("_upto") > high, F.col("v"))).alias("_z"))
    number = F.when(low == high, F.col("_a")).otherwise((high - F.col("at")) * F.col("_a") + (F.col("at") - low) * F.col("_z"))
    found = pair.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", number.alias("p")))), lambda x: x["p"]).alias("_p"))
    return found.where(F.size("_p") > 0)  # without keys, no value at all is a row too
