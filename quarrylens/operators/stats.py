"""Distribution statistics and windows over time. Percentiles are exact, with linear interpolation; sigma is the population's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.functions.numeric import change_percent_signed, messages, none_if_zero, ratio
from quarrylens.operators.anchored import STRETCH, with_starts
from quarrylens.operators.quantiles import grouped
from quarrylens.operators.series import ORDERED_BYTES, estimated_bytes, numbered, with_totals

PERCENTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
BUCKETS = (10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)
APDEX_T = 500.0
RATINGS = ((0.94, "Excellent"), (0.85, "Good"), (0.70, "Fair"), (0.50, "Poor"))


def summary(df: DataFrame, keys: list[str], value: str = "value", *more: Column) -> DataFrame:
    """sample_count, min, max, mean, std_dev, more, and _p: one array of all percentiles (a single pass over groups that fit)."""
    v = F.col(value).cast("double")
    each = [F.count(v).alias("sample_count"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std_dev"), *more]
    return grouped(df.where(F.col(value).isNotNull()), keys, v, list(PERCENTILES.values()), each)


def with_percentiles(df: DataFrame) -> DataFrame:
    for k, name in enumerate(PERCENTILES):
        df = df.withColumn(name, F.col("_p")[k])
    return df.withColumn("median", F.col("p50")).drop("_p")


def percentile_summary(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """A1: count, min, max, mean, median, sigma and percentiles of each group. Null values do not count; empty groups have no row."""
    return with_percentiles(summary(df, keys, value))


def single_percentile(df: DataFrame, keys: list[str], percentile: float, value: str = "value") -> DataFrame:
    """A2."""
    if not 0 <= percentile <= 100:
        raise ValueError(f"a percentile lies between 0 and 100: {percentile}")
    return grouped(df, keys, F.col(value).cast("double"), [percentile / 100], []).select(*keys, F.col("_p")[0].alias("percentile_value"))


def custom_percentiles(df: DataFrame, keys: list[str], percentiles: list[float], value: str = "value") -> DataFrame:
    """A3, in long form: percentile, percentile_value."""
    names = F.array(*(F.lit(float(p)) for p in percentiles))
    got = grouped(df, keys, F.col(value).cast("double"), [p / 100 for p in percentiles], [])
    return got.select(*keys, F.explode(F.arrays_zip(names.alias("percentile"), F.col("_p").alias("percentile_value"))).alias("_x")).select(*keys, "_x.*")


def bucket_labels(buckets=BUCKETS) -> list[str]:
    b = sorted(buckets)
    return [f"<={b[0]}", *(f"{x}-{y}" for x, y in zip(b, b[1:], strict=False)), f">{b[-1]}"]


def histogram(df: DataFrame, keys: list[str], value: str = "value", buckets=BUCKETS) -> DataFrame:
    """A4: counts of all buckets of each group, also of empty ones. Upper bounds belong to their bucket."""
    b, labels = sorted(buckets), bucket_labels(buckets)
    place = F.coalesce(*(F.when(F.col(value) <= x, F.lit(k)) for k, x in enumerate(b)), F.lit(len(b)))
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(*(F.count_if(place == k).alias(f"_{k}") for k in range(len(labels))))  # one pass, no join
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("bucket"), F.lit(x).alias("label"), F.col(f"_{k}").alias("n")) for k, x in enumerate(labels))))
    return counted.select(*keys, each.alias("_x")).select(*keys, "_x.*")


def apdex_rating(score: Column) -> Column:
    """A6."""
    out = None
    for bound, label in RATINGS:
        out = F.when(score >= bound, label) if out is None else out.when(score >= bound, label)
    return out.otherwise("Unacceptable")


def apdex_columns(value: str = "value", threshold: float = APDEX_T, multiplier: float = 4.0) -> list[Column]:
    v = F.col(value)
    return [
        F.count_if(v <= threshold).alias("satisfied_count"),
        F.count_if((v > threshold) & (v <= threshold * multiplier)).alias("tolerating_count"),
        F.count_if(v > threshold * multiplier).alias("frustrated_count"),
    ]


def with_apdex(df: DataFrame) -> DataFrame:
    total = F.col("satisfied_count") + F.col("tolerating_count") + F.col("frustrated_count")
    raw = (F.col("satisfied_count") + F.col("tolerating_count") * 0.5) / total
    return df.withColumn("total_count", total).withColumn("score", raw).withColumn("rating", apdex_rating(F.col("score")))


def apdex(df: DataFrame, keys: list[str], value: str = "value", threshold: float = APDEX_T, multiplier: float = 4.0) -> DataFrame:
    """A5. The score is not rounded."""
    return with_apdex(df.where(F.col(value).isNotNull()).groupBy(*keys).agg(*apdex_columns(value, threshold, multiplier)))


def weighted_apdex(df: DataFrame, keys: list[str], value: str, weight: str, threshold: float = APDEX_T, multiplier: float = 4.0) -> DataFrame:
    """Counts without weights, score with them."""
    v, w = F.col(value), F.col(weight)
    made = df.where(v.isNotNull() & w.isNotNull()).groupBy(*keys).agg(
        *apdex_columns(value, threshold, multiplier), F.count("*").alias("total_count"),
        F.sum(F.when(v <= threshold, w).when(v <= threshold * multiplier, w * 0.5).otherwise(0.0)).alias("_good"), F.sum(w).alias("_all"),
    )
    return made.withColumn("score", F.try_divide("_good", "_all")).withColumn("rating", apdex_rating(F.col("score"))).drop("_good", "_all")


def recommended_threshold(df: DataFrame, keys: list[str], value: str = "value", target: float = 0.85) -> DataFrame:
    """The value at place int(target n) in order. It comes from value counts, so equal values cost one row."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    group = W.partitionBy(*keys)
    placed = counted.withColumn("_upto", F.sum("_n").over(group.orderBy(value))).withColumn("_total", F.sum("_n").over(group))
    at = F.least(F.floor(F.lit(target) * F.col("_total")), F.col("_total") - 1) + 1
    return placed.where(F.col("_upto") >= at).groupBy(*keys).agg(F.min(value).alias("recommended_threshold"))


def sla_check(
    df: DataFrame, keys: list[str], value: str = "value", is_error: Column | None = None, threshold: float = 500.0, percentile: float = 95.0,
    warning: float = 90.0, error_rate_limit: float = 1.0, availability_target: float = 99.9, downtime: Column | None = None, total_seconds: float | None = None,
) -> DataFrame:
    """Percentile against threshold, availability and error rate of each group; status and the kinds of violation."""
    v = F.col(value).cast("double")
    counts = [F.count("*").alias("total_requests"), (F.count_if(is_error) if is_error is not None else F.lit(0).cast("long")).alias("error_count"), (F.sum(downtime) if downtime is not None else F.lit(0)).alias("_down")]
    made = grouped(df.where(v.isNotNull()), keys, v, [percentile / 100], counts).withColumn("percentile_value", F.col("_p")[0]).drop("_p")
    available = F.lit(100.0) * (total_seconds - F.col("_down")) / total_seconds if total_seconds else F.lit(None).cast("double")
    made = made.withColumn("margin_percent", (F.lit(threshold) - F.col("percentile_value")) / threshold * 100).withColumn("availability", available).withColumn("error_rate", ratio(100 * F.col("error_count"), "total_requests", None))
    slow, down, wrong = F.col("percentile_value") > threshold, F.coalesce(F.col("availability") < availability_target, F.lit(False)), F.coalesce(F.col("error_rate") > error_rate_limit, F.lit(False))
    status = F.when(slow | down | wrong, "breached").when(F.col("margin_percent") < 100 - warning, "warning").otherwise("compliant")
    made = made.withColumn("status", status).withColumn("violations", F.array_join(messages((slow, "percentile"), (down, "availability"), (wrong, "error_rate")), ","))
    return made.withColumn("availability", none_if_zero("availability")).withColumn("error_rate", none_if_zero("error_rate")).drop("_down")


def compliance_rate(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Share of compliant results in percent; without any result 100."""
    share = F.coalesce(F.avg(F.when(F.col("status") == "compliant", 100.0).otherwise(0.0)), F.lit(100.0))
    return results.groupBy(*(keys or [])).agg(share.alias("compliance_rate"), F.count("*").alias("n_results"))


def window_aggregate(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", seconds: int = 60) -> DataFrame:
    """A12 over windows that start at multiples of their length: count, sum, mean, min, max, percentiles, throughput."""
    placed = df.withColumn("window_start", F.window(F.col(ts).cast("timestamp"), f"{seconds} seconds")["start"].cast("timestamp_ntz"))
    return with_percentiles(summary(placed, [*keys, "window_start"], value, F.sum(value).alias("sum_value"))).withColumn("throughput", F.col("sample_count") / F.lit(float(seconds)))


def anchored_windows(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", seconds: int = 60, stretch: int = STRETCH, whole: bool | None = None) -> DataFrame:
    """Windows that start at a group's first sample, and after that at the first sample past the window's end.

    Series are streamed in order, long ones in stretches at once (see anchored.py); no task holds a series. Rows without a value
    or a time do not count.
    """
    t = F.unix_micros(F.col(ts).cast("timestamp")).alias("_t")
    v = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull() & F.col(ts).isNotNull())
    if whole is None:
        whole = estimated_bytes(rows) <= ORDERED_BYTES
    if whole:
        rows = rows.select(*keys, t, F.lit(1).cast("long").alias("_n"), v.alias("_sum"), v.alias("_min"), v.alias("_max"))
    else:  # one row for each time
        rows = rows.select(*keys, t, v.alias("_v")).groupBy(*keys, "_t").agg(F.count("*").alias("_n"), F.sum("_v").alias("_sum"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    placed = with_starts(rows, keys, seconds * 1_000_000, stretch, whole)
    made = placed.groupBy(*keys, "_start").agg(F.sum("_n").alias("sample_count"), F.sum("_sum").alias("sum_value"), F.min("_min").alias("min_value"), F.max("_max").alias("max_value"))
    made = made.select(*keys, "sample_count", "sum_value", (F.col("sum_value") / F.col("sample_count")).alias("mean"), "min_value", "max_value", F.timestamp_micros("_start").cast("timestamp_ntz").alias("window_start"))
    return made.withColumn("throughput", F.col("sample_count") / F.lit(float(seconds)))


def throughput(count: Column, seconds: Column) -> Column:
    """A14."""
    return ratio(count, seconds)


def rate(count: Column, total: Column) -> Column:
    """A14, in percent."""
    return ratio(100 * count, total)


def guarded_r2(y: str, x: str) -> Column:
    """R squared as an aggregate; 0 for a constant series."""
    return F.when(F.coalesce(F.var_pop(y), F.lit(0.0)) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.coalesce(F.regr_r2(y, x), F.lit(0.0))))


def index_trend(df: DataFrame, keys: list[str], order: str, value: str = "value", lower_is_better: bool = True, stability: float = 0.05, confidence: float = 0.7) -> DataFrame:
    """Least squares on the index of each value in order, change from first to last, direction, values beyond 2 sigma."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(order).alias("_o"), F.col(value).cast("double").alias("_y"))
    rows = numbered(with_totals(rows, keys, _m=F.avg("_y"), _s=F.stddev_pop("_y")), keys, "_o", "_x").withColumn("_x", F.col("_x").cast("double"))
    far = F.when(F.col("_s") > 0, F.abs((F.col("_y") - F.col("_m")) / F.col("_s")) > 2.0).otherwise(False)
    made = rows.groupBy(*keys).agg(
        F.count("*").alias("data_points"), F.coalesce(F.regr_slope("_y", "_x"), F.lit(0.0)).alias("slope"), guarded_r2("_y", "_x").alias("confidence"),
        F.min_by("_y", "_x").alias("baseline_value"), F.max_by("_y", "_x").alias("current_value"), F.count_if(far).alias("_far"),
    ).where("data_points >= 2")
    made = made.withColumn("change_percent", change_percent_signed("baseline_value", "current_value")).withColumn("anomalies_detected", F.when(F.col("data_points") >= 3, F.col("_far")).otherwise(0))
    better = F.col("slope") < 0 if lower_is_better else F.col("slope") > 0
    steady = (F.abs("change_percent") < stability * 100) | (F.col("confidence") < confidence)
    return made.withColumn("direction", F.when(steady, "stable").when(better, "improving").otherwise("degrading")).drop("_far")


def compare_periods(df: DataFrame, keys: list[str], value: str, is_current: Column, lower_is_better: bool = True, stability: float = 0.05) -> DataFrame:
    """Means of two periods."""
    made = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.avg(F.when(~is_current, F.col(value))).alias("baseline_value"), F.avg(F.when(is_current, F.col(value))).alias("current_value"), F.count("*").alias("data_points")
    )
    made = made.withColumn("change_percent", change_percent_signed("baseline_value", "current_value"))
    better = F.col("change_percent") < 0 if lower_is_better else F.col("change_percent") > 0
    return made.withColumn("direction", F.when(F.abs("change_percent") < stability * 100, "stable").when(better, "improving").otherwise("degrading"))
