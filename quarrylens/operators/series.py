"""Places of rows in long series, without one task for a series."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Estimated bytes of a frame up to which a series is put in order by one window, and parts of the range of longer ones.
ORDERED_BYTES, PARTS = 64_000_000, 4_000
#: Rows of a long series that are looked at in order in one task.
STRETCH = 200_000


def estimated_bytes(df: DataFrame) -> int:
    """What the optimiser takes the size of df for; no job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def numbered(df: DataFrame, keys: list[str], order: str, name: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with the place (from 0) of each row in its series, in the order of a number or a time, then of `ties`; null comes first.

    A long series is cut into parts of its range; rows are numbered within each part, from the number of rows in parts before.
    """
    kind = dict(df.dtypes)[order]
    known = kind.startswith(("timestamp", "date", "decimal")) or kind in ("tinyint", "smallint", "int", "bigint", "float", "double")
    if not known or estimated_bytes(df) <= ORDERED_BYTES:
        return df.withColumn(name, (F.row_number().over(W.partitionBy(*keys).orderBy(order, *ties)) - 1).cast("long"))
    x = (F.unix_micros(F.col(order).cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.col(order)).cast("double")
    ends = df.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi")).select(*(F.col(k).alias(f"_key_{k}") for k in keys), "_lo", "_hi")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    part = F.coalesce(F.floor(F.try_divide(x - F.col("_lo"), F.col("_hi") - F.col("_lo")) * PARTS), F.when(x.isNull(), -1).otherwise(0))
    cut = df.join(ends, same).withColumn("_part", part.cast("long")).drop("_lo", "_hi", *(f"_key_{k}" for k in keys))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = cut.groupBy(*keys, "_part").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    counts = counts.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_part").alias("_of"), "_before")
    placed = cut.withColumn(name, F.row_number().over(W.partitionBy(*keys, "_part").orderBy(order, *ties)) - 1)
    done = placed.join(counts, same & (F.col("_part") == F.col("_of"))).withColumn(name, (F.col(name) + F.col("_before")).cast("long"))
    return done.drop("_part", "_of", "_before", *(f"_key_{k}" for k in keys))


def with_totals(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """df with aggregates of each row's series. Those of long series are joined rather than gathered by a window."""
    if estimated_bytes(df) <= ORDERED_BYTES:
        return df.withColumns({name: a.over(W.partitionBy(*keys)) for name, a in aggregates.items()})
    return matched(df, df.groupBy(*keys).agg(*(a.alias(name) for name, a in aggregates.items())), keys)


def with_previous(df: DataFrame, keys: list[str], order: str, value: str, name: str, stretch: int = STRETCH, whole: bool | None = None) -> DataFrame:
    """df with the value of the row before in its series. A long series is cut in stretches, which also get the row before them."""
    if whole is None:
        whole = estimated_bytes(df) <= ORDERED_BYTES
    if whole:
        return df.withColumn(name, F.lag(value).over(W.partitionBy(*keys).orderBy(order)))
    of = F.floor(F.col("_place") / stretch)
    rows = numbered(df, keys, order, "_place").withColumn("_stretch", F.explode(F.sequence(of, F.floor((F.col("_place") + 1) / stretch))))
    before = F.lag(value).over(W.partitionBy(*keys, "_stretch").orderBy("_place"))
    return rows.withColumn(name, before).where(F.col("_stretch") == of).drop("_place", "_stretch")


def matched(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """df beside the row of `other` with the same keys; null keys match, and one row stands beside one if there are no keys."""
    names = {k: f"_key_{k}" for k in keys}
    other = other.select(*(F.col(k).alias(n) for k, n in names.items()), *(c for c in other.columns if c not in keys))
    same = F.lit(True)
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    return df.join(other, same).drop(*names.values())


def _checkpoint_dir(df: DataFrame) -> str:
    """The shared checkpoint folder; only a local session without one gets its own."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarrylens-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared checkpoint folder, its partitions and their order kept."""
    _checkpoint_dir(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared checkpoint folder, in any order. Its size is that of the files: a checkpoint keeps the size that
    was estimated for its plan, a product for a join, which in a loop takes more digits from round to round."""
    path = f"{_checkpoint_dir(df)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
