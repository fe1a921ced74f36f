"""Where windows start that are anchored at the data: at a series' first time, then at the first time past the window before.

Each start depends on all before it. A series in order is walked in one stream, which carries the last start and holds no series.
Long series are walked in stretches of rows at once. For that, the window before a stretch must be known: each time at which a
window could first start in a stretch is followed, within the stretch, to the end of its last window there; these ends are linked
to the times they lead to in later stretches, and the links that a series really takes are found by pointer jumping.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarrylens.operators.series import ORDERED_BYTES, estimated_bytes, matched, numbered, settled

#: Distinct times of a series that one task walks.
STRETCH = 200_000


def _walk(size: int):
    """Arrow batches in the order of _g (the stretch as text) and _t, with _carry (the last start before a stretch or null), to the
    same rows with _start."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        stretch = at = None  # of the row before
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            g, t = batch.column("_g"), batch.column("_t").to_numpy()
            carry = batch.column("_carry")
            cuts = np.flatnonzero(pc.not_equal(g.slice(1), g.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1
            out = np.empty(n, dtype="int64")
            ends = [*cuts.tolist(), n]
            first = 0
            for end in ends:
                if g[first].as_py() != stretch:
                    stretch, at = g[first].as_py(), carry[first].as_py()
                if at is None:
                    at = int(t[first])
                place = first
                while True:
                    upto = place + int(np.searchsorted(t[place:end], at + size))
                    out[place:upto] = at
                    if upto == end:
                        break
                    place, at = upto, int(t[upto])
                first = end
            yield pa.RecordBatch.from_arrays([*(c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name not in ("_g", "_carry")), pa.array(out)], [*(name for name in batch.schema.names if name not in ("_g", "_carry")), "_start"])

    return run


def _exits(keys: list[str], size: int):
    """The times of one stretch to those at which its first window may start (_t), with the end of the last window then (_exit)."""

    def run(rows):
        import numpy as np

        rows = rows.sort_values("_t", kind="stable", ignore_index=True)
        t = rows["_t"].to_numpy()
        n = len(t)
        after = np.searchsorted(t, t + size)
        last = np.where(after < n, after, np.arange(n))
        while True:  # doubles the windows followed
            further = last[last]
            if (further == last).all():
                break
            last = further
        # A window before the stretch ends at most a size past its first time.
        some = rows.iloc[: int(after[0]) + 1].copy()
        some["_exit"] = t[last[: len(some)]] + size
        return some[[*keys, "_at", "_t", "_exit"]]

    return run


def _linked(nodes: DataFrame, keys: list[str], size: int) -> DataFrame:
    """nodes with _to: the first node at or after _exit, found in the bucket of a window's length or else in the next one in use."""
    bucket = F.floor(F.col("_x") / size).alias("_bucket")
    goals = nodes.select(*keys, F.col("_t").alias("_x"), F.col("_t").alias("_goal"), F.lit(None).cast("long").alias("_from"))
    asked = nodes.select(*keys, F.col("_exit").alias("_x"), F.lit(None).cast("long").alias("_goal"), F.col("_t").alias("_from"))
    both = goals.unionByName(asked).select("*", bucket)
    down = W.partitionBy(*keys, "_bucket").orderBy(F.col("_x").desc(), F.col("_goal").isNull()).rowsBetween(W.unboundedPreceding, 0)
    near = both.withColumn("_near", F.last("_goal", ignorenulls=True).over(down)).where("_from is not null")
    later = W.partitionBy(*keys).orderBy(F.col("_bucket").desc()).rowsBetween(W.unboundedPreceding, -1)
    far = both.groupBy(*keys, "_bucket").agg(F.min("_goal").alias("_first")).withColumn("_far", F.last("_first", ignorenulls=True).over(later)).drop("_first")
    found = matched(near, far, [*keys, "_bucket"]).select(*keys, F.col("_from").alias("_t"), F.coalesce("_near", "_far").alias("_to"))
    return matched(nodes, found, [*keys, "_t"])


def _carries(placed: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys, _at, _carry: the start of the last window that starts before each stretch."""
    types = StructType([*placed.select(*keys, "_at", "_t").schema.fields, StructField("_exit", LongType())])
    nodes = settled(placed.select(*keys, "_at", "_t").groupBy(*keys, "_at").applyInPandas(_exits(keys, size), types))
    nodes = settled(_linked(nodes, keys, size))
    stretches = (nodes.agg(F.max("_at")).first()[0] or 0) + 1
    taken = nodes.groupBy(*keys).agg(F.min("_t").alias("_t"))
    jumps = nodes.where("_to is not null").select(*keys, "_t", "_to")
    # A series enters a stretch at most once, so its way has no more links than stretches.
    for _ in range(math.ceil(math.log2(stretches))):
        taken = settled(taken.unionByName(matched(taken, jumps, [*keys, "_t"]).select(*keys, F.col("_to").alias("_t"))).distinct())
        jumps = settled(matched(jumps.withColumnRenamed("_t", "_from").withColumnRenamed("_to", "_t"), jumps, [*keys, "_t"]).select(*keys, F.col("_from").alias("_t"), "_to"))
    entered = matched(taken, nodes.select(*keys, "_at", "_t", "_exit"), [*keys, "_t"]).select(*keys, "_at", (F.col("_exit") - size).alias("_last"))
    each = nodes.select(*keys, "_at", F.lit(None).cast("long").alias("_last")).distinct().unionByName(entered).groupBy(*keys, "_at").agg(F.max("_last").alias("_last"))
    before = W.partitionBy(*keys).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    return each.select(*keys, "_at", F.last("_last", ignorenulls=True).over(before).alias("_carry"))


def with_starts(rows: DataFrame, keys: list[str], size: int, stretch: int = STRETCH, whole: bool | None = None) -> DataFrame:
    """rows (keys, _t in microseconds, more) with _start, that of the row's window of `size` microseconds.

    Inputs small by the optimiser's estimate are walked series by series. Else the rows of a series must differ in _t.
    """
    if whole is None:
        whole = estimated_bytes(rows) <= ORDERED_BYTES
    if whole:
        placed = rows.withColumn("_at", F.lit(0).cast("long")).withColumn("_carry", F.lit(None).cast("long"))
    else:
        placed = numbered(rows, keys, "_t", "_place").withColumn("_at", F.floor(F.col("_place") / stretch).cast("long")).drop("_place")
        placed = matched(placed, _carries(placed, keys, size), [*keys, "_at"])
    ordered = placed.withColumn("_g", F.to_json(F.struct(*keys, "_at"))).repartition(*keys, "_at").sortWithinPartitions(*keys, "_at", "_t")
    kept = ordered.drop("_g", "_carry")
    return ordered.mapInArrow(_walk(size), StructType([*kept.schema.fields, StructField("_start", LongType())])).drop("_at")
