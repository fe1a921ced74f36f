"""Anomalies, baselines and regressions of metric series. A series is the rows that share the keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quarrylens.functions.numeric import change_percent_abs, nonzero_ratio, steps
from quarrylens.operators.quantiles import grouped
from quarrylens.operators.series import numbered, with_totals

Z, IQR, MIN_SAMPLES = 3.0, 1.5, 10
SIGNIFICANT, HIGH, CRITICAL, COMPARE_Z = 10.0, 25.0, 50.0, 2.0


def severity_from_z(z: Column) -> Column:
    """N4."""
    return steps(F.abs(z), [(5, "critical"), (4, "high"), (3, "medium"), (2, "low")], "info")


def severity_from_distance(distance: Column) -> Column:
    return steps(distance, [(3, "critical"), (2, "high"), (1.5, "medium"), (1, "low")], "info")


def confidence_from_z(z: Column) -> Column:
    return F.least(F.lit(0.99), 1 - F.exp(-0.5 * F.abs(z)))


def severity_from_change(change: Column) -> Column:
    return steps(F.abs(change), [(CRITICAL, "critical"), (HIGH, "high"), (SIGNIFICANT, "medium"), (SIGNIFICANT / 2, "low")], "info")


def _stats(df: DataFrame, keys: list[str], value: str, *aggregates: Column, percentiles: tuple[float, ...] = ()) -> DataFrame:
    """The aggregates, and _p if percentiles are asked for."""
    rows = df.where(F.col(value).isNotNull())
    return grouped(rows, keys, F.col(value).cast("double"), list(percentiles), list(aggregates)) if percentiles else rows.groupBy(*keys).agg(*aggregates)


def _found(df: DataFrame, keys: list[str], ts: str, seq: str, value: str, expected: str, method: str, kind: Column, severity: Column, confidence: Column, z: Column) -> DataFrame:
    deviation = F.abs(F.col(value) - F.col(expected))
    return df.select(
        *keys, ts, seq, F.lit(method).alias("method"), kind.alias("anomaly_type"), severity.alias("severity"), F.col(value).cast("double").alias("actual_value"), F.col(expected).alias("expected_value"),
        deviation.alias("deviation"), nonzero_ratio(100 * deviation, expected).alias("deviation_percent"), z.cast("double").alias("z_score"), confidence.alias("confidence"),
    )


def detect_zscore(df: DataFrame, keys: list[str], ts: str, seq: str, value: str = "value", z: float = Z, least: int = MIN_SAMPLES) -> DataFrame:
    """N2. The series statistics are aggregated and joined back, so a long series needs no sort."""
    stats = _stats(df, keys, value, F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count("*").alias("_n")).where((F.col("_n") >= least) & (F.col("_s") > 0))
    score = (F.col(value) - F.col("_m")) / F.col("_s")
    far = df.join(stats, keys).where(F.abs(score) >= z)
    return _found(far, keys, ts, seq, value, "_m", "zscore", F.when(score > 0, "spike").otherwise("drop"), severity_from_z(score), confidence_from_z(score), score)


def detect_iqr(df: DataFrame, keys: list[str], ts: str, seq: str, value: str = "value", multiplier: float = IQR, least: int = MIN_SAMPLES) -> DataFrame:
    """N3."""
    stats = _stats(df, keys, value, F.count("*").alias("_n"), percentiles=(0.25, 0.5, 0.75)).where(F.col("_n") >= least)
    stats = stats.select(*keys, F.col("_p")[1].alias("_median"), (F.col("_p")[2] - F.col("_p")[0]).alias("_iqr"), F.col("_p")[0].alias("_q1"), F.col("_p")[2].alias("_q3"))
    stats = stats.withColumn("_lo", F.col("_q1") - multiplier * F.col("_iqr")).withColumn("_hi", F.col("_q3") + multiplier * F.col("_iqr"))
    v = F.col(value)
    out = df.join(stats, keys).where((v < F.col("_lo")) | (v > F.col("_hi")))
    distance = F.when(F.col("_iqr") > 0, F.when(v > F.col("_hi"), v - F.col("_hi")).otherwise(F.col("_lo") - v) / F.col("_iqr")).otherwise(0.0)
    return _found(out, keys, ts, seq, value, "_median", "iqr", F.when(v > F.col("_hi"), "spike").otherwise("drop"), severity_from_distance(distance), F.least(F.lit(0.99), 0.5 + distance * 0.1), F.lit(None))


def detect(df: DataFrame, keys: list[str], ts: str, seq: str, value: str = "value") -> DataFrame:
    """Both detectors; the first finding of each timestamp counts, z-score before fences."""
    both = detect_zscore(df, keys, ts, seq, value).unionByName(detect_iqr(df, keys, ts, seq, value))
    first = W.partitionBy(*keys, ts).orderBy(F.col("method").desc(), seq)
    return both.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


#: Rows of a series whose windows are made in one task.
STRETCH = 200_000
BASELINE = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def baseline(df: DataFrame, keys: list[str], value: str = "value", multiplier: float = IQR) -> DataFrame:
    """N5, N6."""
    v = F.col(value).cast("double")
    made = _stats(df, keys, value, F.count("*").alias("sample_count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std_dev"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), percentiles=tuple(BASELINE.values()))
    for k, name in enumerate(BASELINE):
        made = made.withColumn(name, F.col("_p")[k])
    made = made.withColumn("iqr", F.col("p75") - F.col("p25")).drop("_p")
    made = made.withColumn("lower_fence", F.col("p25") - multiplier * F.col("iqr")).withColumn("upper_fence", F.col("p75") + multiplier * F.col("iqr"))
    return made.withColumn("is_valid", (F.col("sample_count") >= MIN_SAMPLES) & (F.col("std_dev") > 0))


def _with_baseline(df: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their series' baseline in columns b_*; series without one drop out."""
    return df.join(base.select(*keys, *(F.col(c).alias(f"b_{c}") for c in base.columns if c not in keys)), keys)


def _z_against(value: str) -> Column:
    return F.when(F.col("b_std_dev") > 0, (F.col(value) - F.col("b_mean")) / F.col("b_std_dev")).otherwise(0.0)


def _outside(value: str) -> Column:
    return (F.col(value) < F.col("b_lower_fence")) | (F.col(value) > F.col("b_upper_fence"))


def detect_with_baseline(df: DataFrame, base: DataFrame, keys: list[str], ts: str, seq: str, value: str = "value", z: float = Z, ranked: bool = False) -> DataFrame:
    """N7. Of two severities the greater string counts (medium > low > info > high > critical); ranked=True takes the graver."""
    rows = _with_baseline(df, base, keys).where("b_is_valid")
    score = _z_against(value)
    distance = F.when(F.col("b_iqr") > 0, F.abs(F.col(value) - F.col("b_median")) / F.col("b_iqr")).otherwise(0.0)
    one, two = severity_from_z(score), severity_from_distance(distance)
    rank = F.create_map(*(x for k, s in enumerate(("info", "low", "medium", "high", "critical")) for x in (F.lit(s), F.lit(k))))
    severity = F.when(rank[one] >= rank[two], one).otherwise(two) if ranked else F.greatest(one, two)
    hit = rows.where((F.abs(score) >= z) | _outside(value))
    return _found(hit, keys, ts, seq, value, "b_mean", "baseline", F.when(F.col(value) > F.col("b_mean"), "spike").otherwise("drop"), severity, confidence_from_z(score), score)


def change_points(df: DataFrame, keys: list[str], order: str, value: str = "value", window: int = 10, threshold: float = Z) -> DataFrame:
    """Places where the means of the windows before and after differ by the threshold in pooled sigmas."""
    v = F.col(value).cast("double")
    rows = with_totals(df.where(v.isNotNull()).select(*keys, order, v.alias("_v")), keys, _n=F.count("*"))
    rows = numbered(rows, keys, order, "index")
    # Windows reach over the ends of a stretch of rows, so each stretch also gets the rows next to it.
    of = lambda c: F.floor(c / STRETCH)
    index = F.col("index")
    rows = rows.withColumn("_stretch", F.explode(F.sequence(of(F.greatest(index - window + 1, F.lit(0))), of(index + window))))
    series = W.partitionBy(*keys, "_stretch").orderBy("index")
    before, after = series.rowsBetween(-window, -1), series.rowsBetween(0, window - 1)
    rows = rows.select(*keys, order, "index", "_n", "_stretch", F.avg("_v").over(before).alias("_mb"), F.avg("_v").over(after).alias("_ma"), F.var_pop("_v").over(before).alias("_vb"), F.var_pop("_v").over(after).alias("_va"))
    rows = rows.where(F.col("_stretch") == of(index)).drop("_stretch")
    pooled = F.sqrt((F.col("_vb") + F.col("_va")) / 2)
    inside = rows.where((F.col("index") >= window) & (F.col("index") < F.col("_n") - window) & (F.col("_n") >= 2 * window)).withColumn("magnitude", F.when(pooled > 0, F.abs(F.col("_ma") - F.col("_mb")) / pooled))
    return inside.where(F.col("magnitude") >= threshold).select(*keys, order, "index", "magnitude")


def baseline_anomalies(df: DataFrame, base: DataFrame, keys: list[str], ts: str, seq: str, value: str = "value", z: float = COMPARE_Z) -> DataFrame:
    """N12."""
    rows = _with_baseline(df, base, keys).where("b_is_valid")
    score, change = _z_against(value), change_percent_abs("b_mean", value)
    hit = rows.where((F.abs(score) >= z) | _outside(value))
    kind = F.when(F.col(value) > F.col("b_mean"), "spike").otherwise("drop")
    made = _found(hit, keys, ts, seq, value, "b_mean", "comparison", kind, severity_from_change(change), F.least(F.lit(0.99), F.abs(score) / 5), score)
    return made.withColumn("deviation_percent", F.abs(change_percent_abs("expected_value", "actual_value")))


def comparison_status(mean_change: Column, p99_change: Column, anomaly_rate: Column) -> Column:
    """N11."""
    most = F.greatest(F.abs(mean_change), F.abs(p99_change))
    return F.when((most >= CRITICAL) | (anomaly_rate > 0.25), "critical").when((most >= HIGH) | (anomaly_rate > 0.1), "degraded").when(most >= SIGNIFICANT, "changed").otherwise("normal")


def compare_to_baseline(df: DataFrame, base: DataFrame, keys: list[str], value: str = "value", z: float = COMPARE_Z) -> DataFrame:
    """A row for each baseline; one without current values has the status no_data."""
    rows = _with_baseline(df.where(F.col(value).isNotNull()), base, keys)
    odd = F.col("b_is_valid") & ((F.abs(_z_against(value)) >= z) | _outside(value))
    now = grouped(rows, keys, F.col(value).cast("double"), [0.5, 0.99], [F.avg(value).alias("current_mean"), F.count("*").alias("_n"), F.count_if(odd).alias("_odd")])
    made = base.select(*keys, "mean", "median", "p99").join(now, keys, "left")
    made = made.withColumn("current_median", F.col("_p")[0]).withColumn("current_p99", F.col("_p")[1])
    made = made.select(
        *keys, "current_mean", "current_median", "current_p99", F.coalesce("_n", F.lit(0)).alias("sample_count"), F.coalesce("_odd", F.lit(0)).alias("anomaly_count"),
        change_percent_abs("mean", "current_mean").alias("mean_change_percent"), change_percent_abs("median", "current_median").alias("median_change_percent"), change_percent_abs("p99", "current_p99").alias("p99_change_percent"),
    )
    none = F.col("sample_count") == 0
    significant = (F.abs("mean_change_percent") >= SIGNIFICANT) | (F.abs("p99_change_percent") >= SIGNIFICANT) | (F.col("anomaly_count") > F.col("sample_count") * 0.1)
    status = comparison_status(F.col("mean_change_percent"), F.col("p99_change_percent"), F.try_divide("anomaly_count", "sample_count"))
    made = made.withColumn("is_significant", F.when(none, False).otherwise(significant)).withColumn("overall_status", F.when(none, "no_data").otherwise(status))
    for c in ("mean_change_percent", "median_change_percent", "p99_change_percent"):
        made = made.withColumn(c, F.when(none, 0.0).otherwise(F.col(c)))
    return made


def deviation_scores(df: DataFrame, base: DataFrame, keys: list[str], value: str = "value", tolerance: float = 1.0) -> DataFrame:
    """deviation_score and within_baseline beside each row."""
    rows = _with_baseline(df, base, keys)
    v, size = F.col(value), F.abs(_z_against(value))
    fence = F.when(F.col("b_iqr") > 0, F.when(v < F.col("b_lower_fence"), (F.col("b_lower_fence") - v) / F.col("b_iqr")).when(v > F.col("b_upper_fence"), (v - F.col("b_upper_fence")) / F.col("b_iqr")).otherwise(0.0)).otherwise(0.0)
    score = F.when(F.col("b_is_valid"), 0.6 * size + 0.4 * fence).otherwise(0.0)
    near = (size <= tolerance * COMPARE_Z) & (v >= F.col("b_p25") - tolerance * F.col("b_iqr")) & (v <= F.col("b_p75") + tolerance * F.col("b_iqr"))
    return rows.select(*df.columns, score.alias("deviation_score"), (~F.col("b_is_valid") | near).alias("within_baseline"))


def baseline_drift(history: DataFrame, keys: list[str], at: str) -> DataFrame:
    """First against last baseline of each series."""
    x = F.struct("mean", "std_dev", "p99")
    made = history.groupBy(*keys).agg(F.min_by(x, at).alias("a"), F.max_by(x, at).alias("z"), F.count("*").alias("_n"))
    drift = lambda c: F.when(F.col("_n") < 2, 0.0).otherwise(change_percent_abs(F.col(f"a.{c}"), F.col(f"z.{c}")))
    made = made.select(*keys, drift("mean").alias("mean_drift_percent"), drift("std_dev").alias("std_drift_percent"), drift("p99").alias("p99_drift_percent"))
    return made.withColumn("is_drifting", (F.abs("mean_drift_percent") >= SIGNIFICANT) | (F.abs("p99_drift_percent") >= SIGNIFICANT))


@F.pandas_udf(DoubleType())
def t_p_value(t, df):
    """Two-sided p of a t statistic. Over 30 degrees of freedom it is the normal distribution's; below, the regularised incomplete beta function by a midpoint rule of 100 steps."""
    import numpy as np
    import pandas as pd

    def one(x: float, d: float) -> float:
        if not d > 0:
            return 1.0
        if d > 30:
            return math.erfc(abs(x) / math.sqrt(2))
        a, upper = d / 2, d / (d + x * x)
        if upper <= 0 or upper >= 1:
            return float(upper >= 1)
        at = (np.arange(100) + 0.5) * (upper / 100)
        area = float((at ** (a - 1) / np.sqrt(1 - at)).sum()) * upper / 100
        return min(1.0, area / math.exp(math.lgamma(a) + math.lgamma(0.5) - math.lgamma(a + 0.5)))

    return pd.Series([None if pd.isna(x) or pd.isna(d) else one(x, d) for x, d in zip(t, df, strict=True)], dtype="float64")


def distributions(df: DataFrame, keys: list[str], value: str, is_after: Column) -> DataFrame:
    """Both periods' mean, sample sigma, percentiles and range; series with both periods only."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & is_after.isNotNull()).select(*keys, is_after.alias("_late"), v.alias("_v"))
    each = grouped(rows, [*keys, "_late"], F.col("_v"), [0.5, 0.9, 0.99], [F.count("*").alias("n"), F.avg("_v").alias("mean"), F.coalesce(F.stddev_samp("_v"), F.lit(0.0)).alias("std"), F.min("_v").alias("min"), F.max("_v").alias("max")])
    figure = F.struct("n", "mean", "std", "min", "max", "_p")
    made = each.groupBy(*keys).agg(F.max(F.when(~F.col("_late"), figure)).alias("before"), F.max(F.when(F.col("_late"), figure)).alias("after")).where("before is not null and after is not null")
    for name in ("before", "after"):
        made = made.withColumns({f"{name}_{c}": F.col(name)[c] for c in ("n", "mean", "std", "min", "max")} | {f"{name}_{p}": F.col(name)["_p"][k] for k, p in enumerate(("p50", "p90", "p99"))})
    return made.drop("before", "after").withColumn("mean_change_percent", change_percent_abs("before_mean", "after_mean")).withColumn("std_change_percent", change_percent_abs("before_std", "after_std"))


def regressions(df: DataFrame, keys: list[str], value: str, is_after: Column, alpha: float = 0.05, least_effect: float = 0.2, limit: float = SIGNIFICANT, critical: float = CRITICAL) -> DataFrame:
    """Welch's t, its p value, Cohen's d, and the verdict on each series."""
    made = distributions(df, keys, value, is_after).withColumn("p99_change_percent", change_percent_abs("before_p99", "after_p99"))
    n1, n2, s1, s2 = F.col("before_n"), F.col("after_n"), F.col("before_std"), F.col("after_std")
    e1, e2, step = s1 * s1 / n1, s2 * s2 / n2, F.col("after_mean") - F.col("before_mean")
    few, flat = (n1 < 2) | (n2 < 2), (s1 == 0) & (s2 == 0)
    t = F.when(few | flat, 0.0).otherwise(step / F.sqrt(F.when(e1 + e2 > 0, e1 + e2)))
    welch = F.when((e1 == 0) | (e2 == 0), (n1 + n2 - 2).cast("double")).otherwise((e1 + e2) * (e1 + e2) / (e1 * e1 / F.when(n1 > 1, n1 - 1) + e2 * e2 / F.when(n2 > 1, n2 - 1)))
    made = made.withColumn("t_statistic", F.coalesce(t, F.lit(0.0))).withColumn("degrees", welch)
    p = F.when(few, 1.0).when(flat, F.when(step == 0, 1.0).otherwise(0.0)).otherwise(t_p_value(F.abs("t_statistic"), F.col("degrees")))
    pooled = F.sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / F.when(n1 + n2 > 2, n1 + n2 - 2))
    made = made.withColumn("p_value", p).withColumn("effect_size", F.when(few, 0.0).otherwise(F.coalesce(step / F.when(pooled > 0, pooled), F.lit(0.0))))
    sure, large = F.col("p_value") < alpha, F.abs("effect_size") >= least_effect
    made = made.withColumn("is_regression", sure & large & (step > 0) & (F.col("mean_change_percent") >= limit))
    most, d = F.greatest(F.abs("mean_change_percent"), F.abs("p99_change_percent")), F.abs("effect_size")
    grave = F.when((most >= critical) | (d >= 1.2), "critical").when((most >= critical / 2) | (d >= 0.8), "high").when((most >= limit) | (d >= 0.5), "medium").otherwise("low")
    made = made.withColumn("severity", F.when(F.col("is_regression"), grave).otherwise("info"))
    made = made.withColumn("confidence", F.when(sure, 0.6 * (1 - F.col("p_value")) + 0.4 * F.least(F.lit(1.0), d / 0.8)).otherwise(0.0))
    quick = F.when(F.col("before_mean") == 0, F.col("after_mean") > 0).otherwise(F.col("mean_change_percent") >= limit)
    return made.withColumn("quick_check", quick)


#: Rows whose resampling counts are drawn together, and states of series a task holds before it hands them on.
DRAW_ROWS, HELD_SERIES = 1_000, 2_000


def _resampled(keys: list[str], iterations: int):
    """Arrow batches of keys, _g (the keys as text), _k (the row's hash), _c, _v, _after to one row for each series and task: for
    each iteration the drawn counts and the sums of counts times values, of both periods."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: dict = {}

        def drawn(marks, counts):
            # The stream depends on the row's hash alone; of a row that stands c times a Poisson variable of mean c is drawn.
            return np.stack([np.random.Generator(np.random.Philox(key=int(k))).poisson(c, iterations) for k, c in zip(marks, counts, strict=True)]).astype("float64")

        def out(schema):
            names, series = list(held), list(held.values())
            held.clear()
            columns = [pa.array([n[j] for n in names], schema.field(key).type) for j, key in enumerate(keys)]
            offsets = pa.array(np.arange(len(series) + 1, dtype="int32") * iterations)
            columns += [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[j] for x in series]))) for j in range(4)]
            return pa.RecordBatch.from_arrays(columns, [*keys, "_cb", "_sb", "_ca", "_sa"])

        schema = None
        for batch in batches:
            schema = batch.schema
            for start in range(0, batch.num_rows, DRAW_ROWS):
                part = batch.slice(start, DRAW_ROWS)
                code = part.column(schema.get_field_index("_g")).dictionary_encode().indices.to_numpy()
                order = np.argsort(code, kind="stable")
                _, at = np.unique(code[order], return_index=True)
                mark, count, value, after = (part.column(schema.get_field_index(c)).to_numpy(zero_copy_only=False)[order] for c in ("_k", "_c", "_v", "_after"))
                times = drawn(mark.view("uint64"), count)
                value, after = value[:, None], after.astype("float64")[:, None]
                sums = [np.add.reduceat(times * x, at) for x in (1 - after, (1 - after) * value, after, after * value)]
                names = zip(*(part.column(schema.get_field_index(k)).take(pa.array(order[at])).to_pylist() for k in keys)) if keys else [()]
                for n, name in enumerate(names):
                    new = np.stack([x[n] for x in sums])
                    held[name] = held[name] + new if name in held else new
                if len(held) >= HELD_SERIES:
                    yield out(schema)
        if held:
            yield out(schema)

    return run


def bootstrap(df: DataFrame, keys: list[str], value: str, is_after: Column, iterations: int = 1000, seed: int = 7, identity: list[str] | None = None) -> DataFrame:
    """Confidence interval of the difference of means. Poisson resampling: each row counts as often as a seeded Poisson variable says.

    What a row draws depends on the seed and on what the row holds, not on where it lies, so reruns agree whatever the partitions
    (but for the order in which doubles are added). `identity` names columns that tell all rows apart, such as a primary key: rows
    then stay where they are, each task adds up one matrix (series x iterations) and only these are shuffled. Without it, rows equal
    in keys, period and value are first counted, which shuffles the distinct ones, and such a group draws for all its rows at once.
    Null and NaN values and null periods do not count; a series without rows of one period has no row; iterations in which one
    period drew nothing are left out.
    """
    after, v = is_after, F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & after.isNotNull())
    if identity:
        rows = rows.select(*keys, F.xxhash64(*identity, F.lit(seed)).alias("_k"), F.lit(1).cast("long").alias("_c"), v.alias("_v"), after.alias("_after"))
    else:
        rows = rows.select(*keys, v.alias("_v"), after.alias("_after")).groupBy(*keys, "_v", "_after").agg(F.count("*").alias("_c")).withColumn("_k", F.xxhash64(*keys, "_v", "_after", F.lit(seed)))
    rows = rows.withColumn("_g", F.to_json(F.struct(*keys)) if keys else F.lit(""))
    states = ("_cb", "_sb", "_ca", "_sa")
    types = StructType([*rows.select(*keys).schema.fields, *(StructField(c, ArrayType(DoubleType())) for c in states)])
    merged = rows.mapInArrow(_resampled(keys, iterations), types).select(*keys, F.posexplode(F.arrays_zip(*states)).alias("_i", "_s")).groupBy(*keys, "_i").agg(*(F.sum(F.col("_s")[c]).alias(c) for c in states))
    # At most `iterations` differences are left of a series.
    d = F.try_divide("_sa", "_ca") - F.try_divide("_sb", "_cb")
    q = [F.percentile(d, F.lit(x)).alias(n) for n, x in (("ci_lower_95", 0.025), ("ci_upper_95", 0.975), ("ci_lower_99", 0.005), ("ci_upper_99", 0.995))]
    return merged.where(d.isNotNull()).groupBy(*keys).agg(F.avg(d).alias("mean_difference"), *q, F.avg((d > 0).cast("double")).alias("probability_regression"))
