"""Queries of anomalies, baselines and regressions over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import anomaly as an
from quarrylens.plans.common import rounded, rounded_sql, t

SPLIT = "2024-01-11"


def _old(s, d):
    return t(s, d, "events").where(F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz"))


def _new(s, d):
    return t(s, d, "events").where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz"))


def _base(s, d):
    return an.baseline(_old(s, d), ["event_type"])


def _after():
    return F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")


def n25(s, d):
    return rounded(an.bootstrap(t(s, d, "orders"), ["o_orderpriority"], "o_totalprice", _after(), iterations=100, identity=["o_orderkey"]))


FOUND = "deviation, CASE WHEN expected_value <> 0 THEN 100 * deviation / expected_value ELSE 0.0 END AS deviation_percent"
F_COLS = ("actual_value", "expected_value", "deviation", "deviation_percent", "z_score", "confidence")
Z_SEV = "CASE WHEN abs({z}) >= 5 THEN 'critical' WHEN abs({z}) >= 4 THEN 'high' WHEN abs({z}) >= 3 THEN 'medium' WHEN abs({z}) >= 2 THEN 'low' ELSE 'info' END"
D_SEV = "CASE WHEN {x} >= 3 THEN 'critical' WHEN {x} >= 2 THEN 'high' WHEN {x} >= 1.5 THEN 'medium' WHEN {x} >= 1 THEN 'low' ELSE 'info' END"
ZSCORE = f"""SELECT event_type, ts, event_id, 'zscore' AS method, CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END AS anomaly_type, {Z_SEV.format(z="z")} AS severity, value AS actual_value, m AS expected_value,
  abs(value - m) AS deviation, CASE WHEN m <> 0 THEN 100 * abs(value - m) / m ELSE 0.0 END AS deviation_percent, z AS z_score, least(0.99, 1 - exp(-0.5 * abs(z))) AS confidence
  FROM (SELECT *, (value - m) / s AS z FROM events JOIN (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s, count(value) AS n FROM events GROUP BY 1) USING (event_type) WHERE n >= 10 AND s > 0) WHERE abs(z) >= 3"""
IQR = f"""SELECT event_type, ts, event_id, 'iqr' AS method, CASE WHEN value > hi THEN 'spike' ELSE 'drop' END AS anomaly_type, {D_SEV.format(x="x")} AS severity, value AS actual_value, q2 AS expected_value,
  abs(value - q2) AS deviation, CASE WHEN q2 <> 0 THEN 100 * abs(value - q2) / q2 ELSE 0.0 END AS deviation_percent, NULL::DOUBLE AS z_score, least(0.99, 0.5 + x * 0.1) AS confidence
  FROM (SELECT *, CASE WHEN iqr > 0 THEN (CASE WHEN value > hi THEN value - hi ELSE lo - value END) / iqr ELSE 0.0 END AS x FROM (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM events
  JOIN (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3, count(value) AS n FROM events GROUP BY 1) USING (event_type) WHERE n >= 10) WHERE value < lo OR value > hi)"""
BASE = """SELECT *, sample_count >= 10 AND std_dev > 0 AS is_valid FROM (SELECT *, p25 - 1.5 * iqr AS lower_fence, p75 + 1.5 * iqr AS upper_fence FROM (SELECT *, p75 - p25 AS iqr FROM (
  SELECT event_type, count(value) AS sample_count, avg(value) AS mean, stddev_pop(value) AS std_dev, min(value) AS min_value, max(value) AS max_value, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.25) AS p25,
  quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM {src} GROUP BY 1)))"""
OLD, NEW = f"(SELECT * FROM events WHERE ts < TIMESTAMP '{SPLIT}')", "(SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-20')"
B_COLS = ("mean", "std_dev", "min_value", "max_value", "p5", "p25", "median", "p75", "p95", "p99", "iqr", "lower_fence", "upper_fence")
JOINED = f"(SELECT e.*, b.* EXCLUDE (event_type), (value - mean) / std_dev AS z, value < lower_fence OR value > upper_fence AS outside FROM {NEW} e JOIN ({BASE.format(src=OLD)}) b USING (event_type))"
CHANGE = "CASE WHEN {b} = 0 THEN CASE WHEN {n} = 0 THEN 0.0 ELSE 100.0 END ELSE ({n} - {b}) / abs({b}) * 100 END"
DIST = f"""SELECT *, {CHANGE.format(b="before_mean", n="after_mean")} AS mean_change_percent, {CHANGE.format(b="before_std", n="after_std")} AS std_change_percent FROM (SELECT o_orderpriority, """ + ", ".join(
    f"count(o_totalprice) FILTER ({w}) AS {x}_n, avg(o_totalprice) FILTER ({w}) AS {x}_mean, coalesce(stddev_samp(o_totalprice) FILTER ({w}), 0.0) AS {x}_std, min(o_totalprice) FILTER ({w}) AS {x}_min, max(o_totalprice) FILTER ({w}) AS {x}_max, "
    + ", ".join(f"quantile_cont(o_totalprice, 0.{p}) FILTER ({w}) AS {x}_p{p}" for p in ("50", "90", "99"))
    for x, w in (("before", "WHERE NOT o_orderdate >= TIMESTAMP '1996-01-01'"), ("after", "WHERE o_orderdate >= TIMESTAMP '1996-01-01'"))
) + " FROM orders GROUP BY 1) WHERE before_n > 0 AND after_n > 0"
DIST_COLS = tuple(f"{x}_{c}" for x in ("before", "after") for c in ("mean", "std", "min", "max", "p50", "p90", "p99")) + ("mean_change_percent", "std_change_percent")
DAY_SERIES = "(SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, avg(value) AS value FROM events GROUP BY ALL)"


def _days(s, d):
    return t(s, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.avg("value").alias("value"))


def n17(s, d):
    made = an.regressions(t(s, d, "orders"), ["o_orderpriority"], "o_totalprice", _after(), limit=0.1)
    return rounded(made.select("o_orderpriority", "t_statistic", "degrees", "effect_size", "p99_change_percent", "quick_check", (F.col("p_value") < 0.05).alias("significant")), 5)


QUERIES = {
    "n01_combined": lambda s, d: rounded(an.detect(t(s, d, "events"), ["event_type"], "ts", "event_id")),
    "n02_zscore": lambda s, d: rounded(an.detect_zscore(t(s, d, "events"), ["event_type"], "ts", "event_id")),
    "n03_iqr": lambda s, d: rounded(an.detect_iqr(t(s, d, "events"), ["event_type"], "ts", "event_id")),
    "n05_baseline": lambda s, d: rounded(_base(s, d)),
    "n07_detect_with_baseline": lambda s, d: rounded(an.detect_with_baseline(_new(s, d), _base(s, d), ["event_type"], "ts", "event_id")),
    "n08_change_points": lambda s, d: rounded(an.change_points(_days(s, d), ["event_type"], "day", window=5, threshold=1.0)),
    "n10_compare_baseline": lambda s, d: rounded(an.compare_to_baseline(_new(s, d), _base(s, d), ["event_type"])),
    "n12_baseline_anomalies": lambda s, d: rounded(an.baseline_anomalies(_new(s, d), _base(s, d), ["event_type"], "ts", "event_id")),
    "n14_deviation_within": lambda s, d: rounded(an.deviation_scores(_new(s, d).select("event_id", "event_type", "value"), _base(s, d), ["event_type"])),
    "n16_drift": lambda s, d: rounded(an.baseline_drift(an.baseline(t(s, d, "events").withColumn("week", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")), ["event_type", "week"]), ["event_type"], "week")),
    "n17_regression": n17,
    "n24_distributions": lambda s, d: rounded(an.distributions(t(s, d, "orders"), ["o_orderpriority"], "o_totalprice", _after())),
    "n25_bootstrap": n25,
}

ORACLES = {
    "n01_combined": rounded_sql(f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY event_type, ts ORDER BY method DESC, event_id) AS rn FROM ({ZSCORE} UNION ALL {IQR})) WHERE rn = 1", *F_COLS),
    "n02_zscore": rounded_sql(ZSCORE, *F_COLS),
    "n03_iqr": rounded_sql(IQR, *F_COLS),
    "n05_baseline": rounded_sql(BASE.format(src=OLD), *B_COLS),
    "n07_detect_with_baseline": rounded_sql(f"""SELECT event_type, ts, event_id, 'baseline' AS method, CASE WHEN value > mean THEN 'spike' ELSE 'drop' END AS anomaly_type, greatest({Z_SEV.format(z="z")}, {D_SEV.format(x="abs(value - median) / iqr")}) AS severity,
      value AS actual_value, mean AS expected_value, abs(value - mean) AS deviation, CASE WHEN mean <> 0 THEN 100 * abs(value - mean) / mean ELSE 0.0 END AS deviation_percent, z AS z_score, least(0.99, 1 - exp(-0.5 * abs(z))) AS confidence FROM {JOINED} WHERE is_valid AND (abs(z) >= 3 OR outside)""", *F_COLS),
    "n08_change_points": rounded_sql(f"""SELECT event_type, day, i::BIGINT AS index, abs(ma - mb) / sqrt((va + vb) / 2) AS magnitude FROM (SELECT event_type, day, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, avg(value) OVER b AS mb, avg(value) OVER a AS ma, var_pop(value) OVER b AS vb, var_pop(value) OVER a AS va
      FROM {DAY_SERIES} WINDOW b AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE i >= 5 AND i < n - 5 AND va + vb > 0 AND abs(ma - mb) / sqrt((va + vb) / 2) >= 1""", "magnitude"),
    "n10_compare_baseline": rounded_sql(f"""
WITH j AS (SELECT event_type, avg(value) AS current_mean, quantile_cont(value, 0.5) AS current_median, quantile_cont(value, 0.99) AS current_p99, count(value) AS sample_count, count(*) FILTER (WHERE is_valid AND (abs(z) >= 2 OR outside)) AS anomaly_count, any_value(mean) AS m, any_value(median) AS md, any_value(p99) AS p FROM {JOINED} GROUP BY 1),
c AS (SELECT event_type, current_mean, current_median, current_p99, sample_count, anomaly_count, {CHANGE.format(b="m", n="current_mean")} AS mean_change_percent, {CHANGE.format(b="md", n="current_median")} AS median_change_percent, {CHANGE.format(b="p", n="current_p99")} AS p99_change_percent FROM j)
SELECT *, abs(mean_change_percent) >= 10 OR abs(p99_change_percent) >= 10 OR anomaly_count > sample_count * 0.1 AS is_significant,
  CASE WHEN abs(mean_change_percent) >= 50 OR abs(p99_change_percent) >= 50 OR anomaly_count / sample_count > 0.25 THEN 'critical' WHEN abs(mean_change_percent) >= 25 OR abs(p99_change_percent) >= 25 OR anomaly_count / sample_count > 0.1 THEN 'degraded'
  WHEN abs(mean_change_percent) >= 10 OR abs(p99_change_percent) >= 10 THEN 'changed' ELSE 'normal' END AS overall_status FROM c""", "current_mean", "current_median", "current_p99", "mean_change_percent", "median_change_percent", "p99_change_percent"),
    "n12_baseline_anomalies": rounded_sql(f"""SELECT event_type, ts, event_id, 'comparison' AS method, CASE WHEN value > mean THEN 'spike' ELSE 'drop' END AS anomaly_type,
      CASE WHEN abs(ch) >= 50 THEN 'critical' WHEN abs(ch) >= 25 THEN 'high' WHEN abs(ch) >= 10 THEN 'medium' WHEN abs(ch) >= 5 THEN 'low' ELSE 'info' END AS severity, value AS actual_value, mean AS expected_value, abs(value - mean) AS deviation, abs(ch) AS deviation_percent, z AS z_score, least(0.99, abs(z) / 5) AS confidence
      FROM (SELECT *, {CHANGE.format(b="mean", n="value")} AS ch FROM {JOINED}) WHERE is_valid AND (abs(z) >= 2 OR outside)""", *F_COLS),
    "n14_deviation_within": rounded_sql(f"""SELECT event_id, event_type, value, CASE WHEN is_valid THEN 0.6 * abs(z) + 0.4 * CASE WHEN iqr > 0 AND value < lower_fence THEN (lower_fence - value) / iqr WHEN iqr > 0 AND value > upper_fence THEN (value - upper_fence) / iqr ELSE 0.0 END ELSE 0.0 END AS deviation_score,
      NOT is_valid OR (abs(z) <= 2 AND value >= p25 - iqr AND value <= p75 + iqr) AS within_baseline FROM {JOINED}""", "value", "deviation_score"),
    "n16_drift": rounded_sql(f"""WITH w AS (SELECT event_type, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, avg(value) AS mean, stddev_pop(value) AS std_dev, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY 1, 2),
      d AS (SELECT event_type, arg_min(mean, week) AS m1, arg_max(mean, week) AS m2, arg_min(std_dev, week) AS s1, arg_max(std_dev, week) AS s2, arg_min(p99, week) AS p1, arg_max(p99, week) AS p2 FROM w GROUP BY 1),
      x AS (SELECT event_type, {CHANGE.format(b="m1", n="m2")} AS mean_drift_percent, {CHANGE.format(b="s1", n="s2")} AS std_drift_percent, {CHANGE.format(b="p1", n="p2")} AS p99_drift_percent FROM d)
      SELECT *, abs(mean_drift_percent) >= 10 OR abs(p99_drift_percent) >= 10 AS is_drifting FROM x""", "mean_drift_percent", "std_drift_percent", "p99_drift_percent"),
    "n17_regression": rounded_sql(f"""SELECT o_orderpriority, t AS t_statistic, (e1 + e2) * (e1 + e2) / (e1 * e1 / (before_n - 1) + e2 * e2 / (after_n - 1)) AS degrees, (after_mean - before_mean) / sqrt(((before_n - 1) * before_std ** 2 + (after_n - 1) * after_std ** 2) / (before_n + after_n - 2)) AS effect_size,
      {CHANGE.format(b="before_p99", n="after_p99")} AS p99_change_percent, mean_change_percent >= 0.1 AS quick_check, abs(t) > 1.959963984540054 AS significant
      FROM (SELECT *, (after_mean - before_mean) / sqrt(e1 + e2) AS t FROM (SELECT *, before_std ** 2 / before_n AS e1, after_std ** 2 / after_n AS e2 FROM ({DIST})))""", "t_statistic", "degrees", "effect_size", "p99_change_percent", digits=5),
    "n24_distributions": rounded_sql(DIST, *DIST_COLS),
}
