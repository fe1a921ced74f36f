"""Trends over time and forecasts. A series is the rows that share the keys, ordered by ts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.functions.numeric import change_percent_start, messages, nonzero_ratio
from quarrylens.operators.anomaly import change_points
from quarrylens.operators.quantiles import grouped
from quarrylens.operators.series import ORDERED_BYTES, estimated_bytes, matched, numbered, with_previous
from quarrylens.operators.stats import guarded_r2

LATENCY_WORDS = "latency|duration|time|delay|response"
DAY = 86400.0


def seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def direction(slope: Column, change: Column, r2: Column, metric: Column, r2_limit: float = 0.3, significant: float = 5.0) -> Column:
    """T3. Whether a rise is good depends on words in the metric's name ("time" also in "uptime")."""
    latency = F.lower(metric).rlike(LATENCY_WORDS)
    up = slope > 0
    return F.when(F.abs(change) < significant, "stable").when(r2 < r2_limit, "unknown").when(latency, F.when(up, "degrading").otherwise("improving")).otherwise(F.when(up, "improving").otherwise("degrading"))


def time_trend(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", metric: str | None = None, least: int = 5, significant: float = 5.0, r2_limit: float = 0.3) -> DataFrame:
    """Least squares on seconds since the first point. One aggregation; series of fewer than `least` points have no row."""
    rows = df.where(F.col(value).isNotNull() & F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("_ts"), seconds(ts).alias("_s"), F.col(value).cast("double").alias("_y"))
    # Shifting by a constant of the whole table keeps the sums small without a pass for each series' start; the slope is the same.
    rows = rows.withColumn("_x", F.col("_s") - 1.6e9)
    made = rows.groupBy(*keys).agg(
        F.count("*").alias("data_points"), F.min("_ts").alias("period_start"), F.max("_ts").alias("period_end"), F.coalesce(F.regr_slope("_y", "_x"), F.lit(0.0)).alias("slope"),
        guarded_r2("_y", "_x").alias("r_squared"), F.avg("_y").alias("mean"), F.stddev_pop("_y").alias("std_dev"), F.min_by("_y", "_x").alias("start_value"), F.max_by("_y", "_x").alias("end_value"),
        F.var_pop("_x").alias("_vx"),
    ).where(F.col("data_points") >= least)
    name = F.col(metric) if metric else (F.concat_ws(" ", *keys) if keys else F.lit("metric"))
    made = made.withColumn("r_squared", F.when(F.col("_vx") == 0, 0.0).otherwise(F.col("r_squared"))).drop("_vx")
    made = made.withColumn("slope_per_day", F.col("slope") * DAY).withColumn("volatility", nonzero_ratio("std_dev", "mean")).withColumn("change_absolute", F.col("end_value") - F.col("start_value")).withColumn("change_percent", change_percent_start("start_value", "end_value"))
    return (
        made.withColumn("direction", direction(F.col("slope"), F.col("change_percent"), F.col("r_squared"), name, r2_limit, significant))
        .withColumn("confidence", 0.7 * F.col("r_squared") + 0.3 * F.least(F.lit(1.0), F.col("data_points") / 30))
        .withColumn("is_significant", (F.abs("change_percent") >= significant) & (F.col("r_squared") >= r2_limit))
    )


def with_synthetic_time(df: DataFrame, keys: list[str], order: str, start: str, interval_seconds: float = 60.0) -> DataFrame:
    """T5: ts for values that only have an order."""
    n = F.col("_place")
    return numbered(df, keys, order, "_place").withColumn("ts", F.timestamp_micros((F.unix_micros(F.lit(start).cast("timestamp")) + n * int(interval_seconds * 1e6)).cast("long")).cast("timestamp_ntz")).drop("_place")


def time_change_points(df: DataFrame, keys: list[str], ts: str, value: str = "value", window: int = 10, threshold: float = 2.0) -> DataFrame:
    """T6."""
    return change_points(df, keys, ts, value, window, threshold)


def trend_report(trends: DataFrame, metric: str) -> DataFrame:
    """One row over all series of time_trend: how many go which way, overall health, the worst and the volatile ones."""
    n = lambda d: F.count_if(F.col("direction") == d)
    worse = F.when(F.col("direction") == "degrading", F.struct(F.abs("change_percent").alias("size"), F.col(metric).alias("name")))
    made = trends.agg(
        F.count("*").alias("metrics_analyzed"), n("improving").alias("improving"), n("degrading").alias("degrading"), F.count_if(~F.col("direction").isin("improving", "degrading")).alias("stable"),
        F.max(worse)["name"].alias("worst_metric"), F.count_if(F.col("is_significant") & (F.col("direction") == "degrading")).alias("significant_degradations"), F.count_if(F.col("volatility") > 0.5).alias("volatile_metrics"),
    )
    return made.withColumn("overall_health", F.when(F.col("degrading") > F.col("improving"), "degrading").when(F.col("improving") > F.col("degrading"), "improving").otherwise("stable"))


def intervals(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Median of the positive gaps, a day if there is none."""
    rows = with_previous(df.select(*keys, F.col(ts).alias("_ts")), keys, "_ts", "_ts", "_was").withColumn("_gap", seconds("_ts") - seconds("_was"))
    made = grouped(rows, keys, F.when(F.col("_gap") > 0, F.col("_gap")), [0.5], [])
    return made.select(*keys, F.coalesce(F.col("_p")[0], F.lit(DAY)).alias("interval_seconds"))


def _t_value(confidence: float) -> float:
    return 1.96 if confidence == 0.95 else 2.576


def _points(made: DataFrame, keys: list[str], periods: int, predicted: Column, width: Column) -> DataFrame:
    at = F.timestamp_micros((F.col("last_us") + F.col("step") * F.col("interval_seconds") * 1e6).cast("long")).cast("timestamp_ntz")
    each = made.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods)))).withColumn("predicted_value", predicted).withColumn("_w", width)
    return each.select(*keys, "step", at.alias("forecast_at"), "predicted_value", (F.col("predicted_value") - F.col("_w")).alias("lower_bound"), (F.col("predicted_value") + F.col("_w")).alias("upper_bound"), "model_fit", "training_points", "last_value", "volatility")


def _training(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull() & F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("_ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), F.col(value).cast("double").alias("_y"))


def _common(y: str = "_y") -> list[Column]:
    return [F.count("*").alias("training_points"), F.max("_us").alias("last_us"), F.max_by(y, "_us").alias("last_value"), nonzero_ratio(F.stddev_pop(y), F.avg(y)).alias("volatility")]


def linear_forecast(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", periods: int = 7, confidence: float = 0.95, least: int = 10) -> DataFrame:
    """Least squares carried on, with prediction intervals."""
    rows = _training(df, keys, ts, value).withColumn("_x", F.col("_us") / 1e6 - 1.6e9)
    made = rows.groupBy(*keys).agg(
        *_common(), F.coalesce(F.regr_slope("_y", "_x"), F.lit(0.0)).alias("_b"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"), (F.var_pop("_x") * F.count("*")).alias("_sxx"),
        (F.var_pop("_y") * F.count("*")).alias("_syy"), guarded_r2("_y", "_x").alias("model_fit"), F.max("_x").alias("_lx"),
    ).where(F.col("training_points") >= least).join(intervals(df, keys, ts), keys)
    n = F.col("training_points")
    error = F.sqrt(F.greatest(F.lit(0.0), (F.col("_syy") - F.col("_b") * F.col("_b") * F.col("_sxx")) / (n - 2)))
    x = F.col("_lx") + F.col("step") * F.col("interval_seconds")
    far = F.when(F.col("_sxx") > 0, F.sqrt(1 + 1 / n + F.pow(x - F.col("_mx"), 2) / F.col("_sxx"))).otherwise(1.0)
    return _points(made, keys, periods, F.col("_my") + F.col("_b") * (x - F.col("_mx")), _t_value(confidence) * error * far)


#: Points of a stretch that one task smooths, and stretches whose effects are composed at a time.
STRETCH, FAN = 10_000, 1_000


def _affine(alpha: float, beta: float, base: Column, values: Column) -> Column:
    """What Holt smoothing of an array of values does to any start (level, trend) = base + d: the end is M d + (v0, v1), the squared
    misses add up to q + b . d + d . C d. The values of M, v, b and C are plain columns of one struct, so effects compose.

    The base lies on the series, so that little is lost when the squares of far starts cancel.
    """
    a, c, g = 1 - alpha, alpha, alpha * beta
    level, trend = base["level"], base["trend"]
    zero = F.lit(0.0)
    start = F.struct(F.lit(1.0).alias("m00"), zero.alias("m01"), zero.alias("m10"), F.lit(1.0).alias("m11"), level.alias("v0"), trend.alias("v1"), zero.alias("q"), zero.alias("b0"), zero.alias("b1"), zero.alias("c00"), zero.alias("c01"), zero.alias("c11"))

    def step(s: Column, y: Column) -> Column:
        v0 = c * y + a * (s["v0"] + s["v1"])
        v1 = beta * (v0 - s["v0"]) + (1 - beta) * s["v1"]
        m00, m01 = a * (s["m00"] + s["m10"]), a * (s["m01"] + s["m11"])
        m10, m11 = -g * s["m00"] + (1 - g) * s["m10"], -g * s["m01"] + (1 - g) * s["m11"]
        miss, u0, u1 = y - (v0 + v1), m00 + m10, m01 + m11  # miss - (u0, u1) . d
        return F.struct(
            m00.alias("m00"), m01.alias("m01"), m10.alias("m10"), m11.alias("m11"), v0.alias("v0"), v1.alias("v1"), (s["q"] + miss * miss).alias("q"),
            (s["b0"] - 2 * miss * u0).alias("b0"), (s["b1"] - 2 * miss * u1).alias("b1"), (s["c00"] + u0 * u0).alias("c00"), (s["c01"] + u0 * u1).alias("c01"), (s["c11"] + u1 * u1).alias("c11"),
        )

    return F.aggregate(values, start, step)


def _composed(first: Column, second: Column) -> Column:
    """The effect of two stretches in turn; each is a struct of its base (level, trend) and its effect f."""
    f, s = first["f"], second["f"]
    # A start d off the first base is (n00 n01, n10 n11) d + g off the second one.
    g0, g1 = f["v0"] - second["level"], f["v1"] - second["trend"]
    m = {k: f[k] for k in ("m00", "m01", "m10", "m11")}
    # C g and C M of the second stretch.
    h0, h1 = s["c00"] * g0 + s["c01"] * g1, s["c01"] * g0 + s["c11"] * g1
    k00, k01 = s["c00"] * m["m00"] + s["c01"] * m["m10"], s["c00"] * m["m01"] + s["c01"] * m["m11"]
    k10, k11 = s["c01"] * m["m00"] + s["c11"] * m["m10"], s["c01"] * m["m01"] + s["c11"] * m["m11"]
    e0, e1 = s["b0"] + 2 * h0, s["b1"] + 2 * h1
    made = F.struct(
        (s["m00"] * m["m00"] + s["m01"] * m["m10"]).alias("m00"), (s["m00"] * m["m01"] + s["m01"] * m["m11"]).alias("m01"),
        (s["m10"] * m["m00"] + s["m11"] * m["m10"]).alias("m10"), (s["m10"] * m["m01"] + s["m11"] * m["m11"]).alias("m11"),
        (s["m00"] * g0 + s["m01"] * g1 + s["v0"]).alias("v0"), (s["m10"] * g0 + s["m11"] * g1 + s["v1"]).alias("v1"),
        (f["q"] + s["q"] + s["b0"] * g0 + s["b1"] * g1 + g0 * h0 + g1 * h1).alias("q"),
        (f["b0"] + m["m00"] * e0 + m["m10"] * e1).alias("b0"), (f["b1"] + m["m01"] * e0 + m["m11"] * e1).alias("b1"),
        (f["c00"] + m["m00"] * k00 + m["m10"] * k10).alias("c00"), (f["c01"] + m["m00"] * k01 + m["m10"] * k11).alias("c01"), (f["c11"] + m["m01"] * k01 + m["m11"] * k11).alias("c11"),
    )
    return F.struct(first["level"].alias("level"), first["trend"].alias("trend"), made.alias("f"))


def smoothed(rows: DataFrame, keys: list[str], alpha: float, beta: float, stretch: int = STRETCH, fan: int = FAN, whole: bool | None = None) -> DataFrame:
    """keys, level, trend, ss: Holt smoothing of each series of (keys, _us, _y), from its first value and the mean step to its last,
    over all values but the first; ss adds up the squared misses.

    Smoothing is a recurrence, but the effect of a stretch of points on any start is an affine map, and the squared misses are a
    quadratic form of the start; both compose (a parallel scan). So a long series is cut in stretches of rows, which are smoothed
    independently, and their effects, 14 numbers each, are composed level by level, `fan` at a time. A series of 10^10 points takes
    two levels; no task holds more than `stretch` values or `fan` effects. Inputs small by the optimiser's estimate are one stretch.
    """
    if whole is None:
        whole = estimated_bytes(rows) <= ORDERED_BYTES
    if whole:
        made = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_us", "_y"))).alias("_rows"))
        values = F.transform(F.col("_rows"), lambda r: r["_y"])
        n = F.size("_rows")
        made = made.select(*keys, values.alias("_ys"), n.alias("_n")).withColumn("_base", F.struct(F.col("_ys")[0].alias("level"), ((F.element_at("_ys", -1) - F.col("_ys")[0]) / F.col("_n")).alias("trend")))
        made = made.withColumn("f", _affine(alpha, beta, F.col("_base"), F.slice("_ys", 2, F.greatest(F.col("_n") - 1, F.lit(1)))))
        return made.select(*keys, F.col("f.v0").alias("level"), F.col("f.v1").alias("trend"), F.col("f.q").alias("ss"))
    placed = numbered(rows, keys, "_us", "_place", ties=("_y",))
    made = placed.groupBy(*keys, F.floor(F.col("_place") / stretch).alias("_at")).agg(F.array_sort(F.collect_list(F.struct("_place", "_y"))).alias("_rows"))
    values = F.transform(F.col("_rows"), lambda r: r["_y"])
    made = made.select(*keys, "_at", values.alias("_ys"))
    # The first value of a series is where smoothing starts; it is not smoothed itself.
    base = F.struct(F.col("_ys")[0].alias("level"), F.lit(0.0).alias("trend"))
    rest = F.when(F.col("_at") == 0, F.slice("_ys", 2, F.greatest(F.size("_ys") - 1, F.lit(1)))).otherwise(F.col("_ys"))
    made = made.withColumn("_e", F.struct(F.col("_ys")[0].alias("level"), F.lit(0.0).alias("trend"), _affine(alpha, beta, base, rest).alias("f"))).select(*keys, "_at", "_e", F.element_at("_ys", -1).alias("_last"), F.size("_ys").cast("long").alias("_n"))

    def composed(frame: DataFrame, by: list) -> DataFrame:
        got = frame.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_at", "_e"))).alias("_es"), F.max_by("_last", "_at").alias("_last"), F.sum("_n").alias("_n"))
        effects = F.transform("_es", lambda x: x["_e"])
        return got.withColumn("_e", F.reduce(F.slice(effects, 2, F.greatest(F.size("_es") - 1, F.lit(1))), F.element_at(effects, 1), _composed))

    for _ in range(2):
        made = composed(made, [*keys, F.floor(F.col("_at") / fan).alias("_up")]).select(*keys, F.col("_up").alias("_at"), "_e", "_last", "_n")
    made = composed(made, keys)
    # The true start has the first level; its trend is off the base by the mean step.
    f, d = F.col("_e.f"), (F.col("_last") - F.col("_e.level")) / F.col("_n")
    return made.select(*keys, (f["v0"] + f["m01"] * d).alias("level"), (f["v1"] + f["m11"] * d).alias("trend"), F.greatest(F.lit(0.0), f["q"] + f["b1"] * d + f["c11"] * d * d).alias("ss"))


def holt_forecast(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", periods: int = 7, confidence: float = 0.95, least: int = 10, alpha: float = 0.3, beta: float = 0.1) -> DataFrame:
    """Double exponential smoothing, carried on along its last trend. Points of one time come in the order of their values."""
    rows = _training(df, keys, ts, value)
    made = rows.groupBy(*keys).agg(*_common(), F.var_pop("_y").alias("_vy")).where(F.col("training_points") >= least)
    made = matched(matched(made, smoothed(rows, keys, alpha, beta), keys), intervals(df, keys, ts), keys)
    total = F.col("_vy") * F.col("training_points")
    made = made.withColumn("model_fit", F.when(total > 0, F.greatest(F.lit(0.0), 1 - F.col("ss") / total)).otherwise(0.0))
    error = F.sqrt(F.col("ss") / F.col("training_points"))
    return _points(made, keys, periods, F.col("level") + F.col("step") * F.col("trend"), _t_value(confidence) * error * F.sqrt(1 + F.col("step") * 0.1))


def moving_average_forecast(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", periods: int = 7, confidence: float = 0.95, least: int = 10, window: int = 7) -> DataFrame:
    """The mean of the last points, flat."""
    rows = _training(df, keys, ts, value)
    recent = rows.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("_us").desc()))).where(F.col("_rank") <= window)  # partitions keep their last rows only, before they are shuffled
    last = recent.groupBy(*keys).agg(F.avg("_y").alias("_avg"), F.stddev_pop("_y").alias("_sd"))
    made = rows.groupBy(*keys).agg(*_common(), F.avg("_y").alias("_my"), F.var_pop("_y").alias("_vy")).where(F.col("training_points") >= least).join(last, keys).join(intervals(df, keys, ts), keys)
    around = F.col("_vy") + F.pow(F.col("_my") - F.col("_avg"), 2)
    made = made.withColumn("model_fit", F.when(around > 0, F.greatest(F.lit(0.0), 1 - F.col("_sd") * F.col("_sd") / around)).otherwise(0.0))
    return _points(made, keys, periods, F.col("_avg"), _t_value(confidence) * F.col("_sd") * F.sqrt(1 + F.col("step") * 0.05))


def forecast_summary(points: DataFrame, keys: list[str]) -> DataFrame:
    """Direction (a rise is degrading), expected change and warnings of each forecast. The slope is over `periods`, not periods - 1."""
    made = points.groupBy(*keys).agg(
        F.count("*").alias("periods"), F.min_by("predicted_value", "step").alias("_a"), F.max_by("predicted_value", "step").alias("expected_value_at_end"), F.min("lower_bound").alias("_low"),
        F.first("last_value").alias("last_value"), F.first("model_fit").alias("model_fit"), F.first("training_points").alias("training_points"), F.first("volatility").alias("volatility"),
    )
    slope = (F.col("expected_value_at_end") - F.col("_a")) / F.col("periods")
    made = made.withColumn("trend_direction", F.when(F.col("periods") < 2, "unknown").when(slope > 0, "degrading").when(slope < 0, "improving").otherwise("stable")).withColumn("expected_change_percent", change_percent_start("last_value", "expected_value_at_end"))
    warnings = messages((F.col("model_fit") < 0.3, "low model fit"), (F.col("training_points") < 30, "limited history"), (F.col("volatility") > 0.5, "high volatility"), (F.col("_low") < 0, "negative bounds"))
    return made.withColumn("warnings", F.array_join(warnings, ",")).drop("_a", "_low")
