"""Queries of the distribution statistics over events, lineitem and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import stats
from quarrylens.plans.common import rounded, rounded_sql, t

P_SQL = "quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, quantile_cont(value, 0.999) AS p999"
P_COLS = ("min_value", "max_value", "mean", "std_dev", "median", "p50", "p75", "p90", "p95", "p99", "p999")
SUMMARY_SQL = f"count(value) AS sample_count, min(value) AS min_value, max(value) AS max_value, avg(value) AS mean, stddev_pop(value) AS std_dev, quantile_cont(value, 0.5) AS median, {P_SQL}"


def rating_sql(score: str) -> str:
    return f"CASE WHEN {score} >= 0.94 THEN 'Excellent' WHEN {score} >= 0.85 THEN 'Good' WHEN {score} >= 0.70 THEN 'Fair' WHEN {score} >= 0.50 THEN 'Poor' ELSE 'Unacceptable' END"


def apdex_sql(keys: str, source: str, t_ms: float = 100.0) -> str:
    return f"""SELECT *, (satisfied_count + 0.5 * tolerating_count) / total_count AS score, {rating_sql("(satisfied_count + 0.5 * tolerating_count) / total_count")} AS rating FROM (
      SELECT {keys}, count(*) FILTER (WHERE value <= {t_ms}) AS satisfied_count, count(*) FILTER (WHERE value > {t_ms} AND value <= {4 * t_ms}) AS tolerating_count,
        count(*) FILTER (WHERE value > {4 * t_ms}) AS frustrated_count, count(value) AS total_count FROM {source} WHERE value IS NOT NULL GROUP BY ALL)"""


def a01(s, d):
    return rounded(stats.percentile_summary(t(s, d, "events"), ["event_type"]))


def a02(s, d):
    return rounded(stats.single_percentile(t(s, d, "lineitem").withColumn("value", F.col("l_extendedprice")), ["l_returnflag"], 97.5))


def a03(s, d):
    return rounded(stats.custom_percentiles(t(s, d, "events"), ["event_type"], [1, 10, 42.5, 99.99]))


def a04(s, d):
    return stats.histogram(t(s, d, "events"), ["event_type"])


def a05(s, d):
    return rounded(stats.apdex(t(s, d, "events"), ["event_type"], threshold=100.0))


def a05_hourly(s, d):
    """Apdex and percentiles of each event type in each hour, in one aggregation."""
    events = t(s, d, "events").where(F.col("value").isNotNull())
    made = stats.summary(events.withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz")), ["event_type", "hour"], "value", *stats.apdex_columns(threshold=100.0))
    return rounded(stats.with_apdex(stats.with_percentiles(made)))


def a07(s, d):
    return rounded(stats.weighted_apdex(t(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity", threshold=20000.0))


def a08(s, d):
    return rounded(stats.recommended_threshold(t(s, d, "events"), ["event_type"]))


def _sla(s, d):
    return stats.sla_check(t(s, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["day"], is_error=F.col("event_type") == "error", threshold=150.0, error_rate_limit=12.0, downtime=(F.col("event_type") == "error").cast("int"), total_seconds=86400.0)


def a09(s, d):
    return rounded(_sla(s, d))


def a11(s, d):
    return rounded(stats.compliance_rate(_sla(s, d)))


def a12(s, d):
    return rounded(stats.window_aggregate(t(s, d, "events"), ["event_type"], seconds=6 * 3600))


def a13(s, d):
    return rounded(stats.anchored_windows(t(s, d, "events"), ["user_id"], seconds=86400))


def a14(s, d):
    made = t(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 100).alias("slow"), (F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.min(F.unix_micros(F.col("ts").cast("timestamp")))).alias("_us"))
    return rounded(made.select("event_type", "n", stats.throughput(F.col("n"), F.col("_us") / 1e6).alias("throughput"), stats.rate(F.col("slow"), F.col("n")).alias("slow_rate")))


def _daily(s, d):
    return t(s, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def a15(s, d):
    return rounded(stats.index_trend(_daily(s, d), ["event_type"], "day"))


def a16(s, d):
    return rounded(stats.index_trend(t(s, d, "events"), ["user_id"], "event_id", lower_is_better=False))


def a17(s, d):
    return rounded(stats.compare_periods(t(s, d, "orders"), ["o_orderpriority"], "o_totalprice", F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")))


def trend_sql(source: str, key: str, order: str, better: str) -> str:
    return f"""
WITH r AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1.0 AS x, value::DOUBLE AS y, avg(value) OVER (PARTITION BY {key}) AS m, stddev_pop(value) OVER (PARTITION BY {key}) AS s FROM {source} WHERE value IS NOT NULL),
g AS (SELECT {key}, count(*) AS data_points, coalesce(CASE WHEN count(*) > 1 THEN regr_slope(y, x) END, 0.0) AS slope, CASE WHEN coalesce(var_pop(y), 0) = 0 THEN 0.0 ELSE greatest(0.0, coalesce(regr_r2(y, x), 0.0)) END AS confidence,
  arg_min(y, x) AS baseline_value, arg_max(y, x) AS current_value, count(*) FILTER (WHERE s > 0 AND abs((y - m) / s) > 2.0) AS far FROM r GROUP BY {key} HAVING count(*) >= 2),
h AS (SELECT *, CASE WHEN baseline_value <> 0 THEN 100 * (current_value - baseline_value) / baseline_value ELSE 0.0 END AS change_percent FROM g)
SELECT * EXCLUDE (far), CASE WHEN data_points >= 3 THEN far ELSE 0 END AS anomalies_detected,
  CASE WHEN abs(change_percent) < 5 OR confidence < 0.7 THEN 'stable' WHEN {better} THEN 'improving' ELSE 'degrading' END AS direction FROM h"""


DAILY_SQL = "(SELECT event_type, ts::DATE AS day, avg(value) AS value, count(*) AS n FROM events GROUP BY ALL)"
TREND_COLS = ("slope", "confidence", "baseline_value", "current_value", "change_percent")
SLA_SQL = """
WITH g AS (SELECT strftime(ts, '%Y-%m-%d') AS day, quantile_cont(value, 0.95) AS percentile_value, count(*) AS total_requests, count(*) FILTER (WHERE event_type = 'error') AS error_count FROM events WHERE value IS NOT NULL GROUP BY 1),
h AS (SELECT *, (150.0 - percentile_value) / 150.0 * 100 AS margin_percent, 100.0 * (86400.0 - error_count) / 86400.0 AS availability, 100.0 * error_count / total_requests AS error_rate FROM g)
SELECT * REPLACE (nullif(availability, 0) AS availability, nullif(error_rate, 0) AS error_rate),
  CASE WHEN percentile_value > 150 OR availability < 99.9 OR error_rate > 12 THEN 'breached' WHEN margin_percent < 10 THEN 'warning' ELSE 'compliant' END AS status,
  array_to_string(list_filter([CASE WHEN percentile_value > 150 THEN 'percentile' END, CASE WHEN availability < 99.9 THEN 'availability' END, CASE WHEN error_rate > 12 THEN 'error_rate' END], lambda x: x IS NOT NULL), ',') AS violations FROM h"""

QUERIES = {
    "a01_percentiles_by_type": a01, "a02_single_percentile": a02, "a03_custom_percentiles": a03, "a04_histogram_by_type": a04, "a05_apdex_by_type": a05, "a05_apdex_by_type_hour": a05_hourly, "a07_weighted_apdex": a07,
    "a08_recommended_threshold": a08, "a09_sla_by_day": a09, "a11_compliance": a11, "a12_window_aggregate": a12, "a13_anchored_windows": a13, "a14_throughput_rate": a14, "a15_index_trend": a15, "a16_anomaly_count": a16, "a17_compare_periods": a17,
}

ORACLES = {
    "a01_percentiles_by_type": rounded_sql(f"SELECT event_type, {SUMMARY_SQL} FROM events GROUP BY event_type", *P_COLS),
    "a02_single_percentile": rounded_sql("SELECT l_returnflag, quantile_cont(l_extendedprice, 0.975) AS percentile_value FROM lineitem GROUP BY 1", "percentile_value"),
    "a03_custom_percentiles": rounded_sql("SELECT event_type, p::DOUBLE AS percentile, v AS percentile_value FROM (SELECT event_type, unnest([1.0, 10.0, 42.5, 99.99]) AS p, unnest(quantile_cont(value, [0.01, 0.1, 0.425, 0.9999])) AS v FROM events GROUP BY event_type)", "percentile", "percentile_value"),
    "a05_apdex_by_type": rounded_sql(apdex_sql("event_type", "events"), "score"),
    "a05_apdex_by_type_hour": rounded_sql(
        f"""SELECT a.*, (satisfied_count + 0.5 * tolerating_count) / total_count AS score, {rating_sql("(satisfied_count + 0.5 * tolerating_count) / total_count")} AS rating FROM (
      SELECT event_type, date_trunc('hour', ts) AS hour, {SUMMARY_SQL}, count(*) FILTER (WHERE value <= 100) AS satisfied_count, count(*) FILTER (WHERE value > 100 AND value <= 400) AS tolerating_count,
      count(*) FILTER (WHERE value > 400) AS frustrated_count, count(value) AS total_count FROM events WHERE value IS NOT NULL GROUP BY 1, 2) a""", *P_COLS, "score"),
    "a07_weighted_apdex": rounded_sql(
        f"""SELECT *, {rating_sql("score")} AS rating FROM (SELECT l_returnflag, l_linestatus, count(*) FILTER (WHERE l_extendedprice <= 20000) AS satisfied_count, count(*) FILTER (WHERE l_extendedprice > 20000 AND l_extendedprice <= 80000) AS tolerating_count,
      count(*) FILTER (WHERE l_extendedprice > 80000) AS frustrated_count, count(*) AS total_count, sum(CASE WHEN l_extendedprice <= 20000 THEN l_quantity WHEN l_extendedprice <= 80000 THEN 0.5 * l_quantity ELSE 0 END) / sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2)""", "score"),
    "a08_recommended_threshold": rounded_sql("""SELECT event_type, value AS recommended_threshold FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
      WHERE rn = least(floor(0.85 * n), n - 1) + 1""", "recommended_threshold"),
    "a09_sla_by_day": rounded_sql(SLA_SQL, "percentile_value", "margin_percent", "availability", "error_rate"),
    "a11_compliance": rounded_sql(f"SELECT coalesce(avg(CASE WHEN status = 'compliant' THEN 100.0 ELSE 0.0 END), 100.0) AS compliance_rate, count(*) AS n_results FROM ({SLA_SQL})", "compliance_rate"),
    "a12_window_aggregate": rounded_sql(f"SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, sum(value) AS sum_value, count(value) / 21600.0 AS throughput, {SUMMARY_SQL} FROM events WHERE value IS NOT NULL GROUP BY 1, 2", *P_COLS, "sum_value", "throughput"),
    "a13_anchored_windows": rounded_sql("""
WITH RECURSIVE r AS (SELECT user_id, epoch_us(ts) AS us, value FROM events WHERE value IS NOT NULL),
w(user_id, start) AS (SELECT user_id, min(us) FROM r GROUP BY user_id UNION ALL SELECT w.user_id, (SELECT min(us) FROM r WHERE r.user_id = w.user_id AND us >= w.start + 86400000000) FROM w WHERE start IS NOT NULL)
SELECT w.user_id, make_timestamp(start) AS window_start, count(*) AS sample_count, sum(value) AS sum_value, avg(value) AS mean, min(value) AS min_value, max(value) AS max_value, count(*) / 86400.0 AS throughput
FROM w JOIN r ON r.user_id = w.user_id AND us >= start AND us < start + 86400000000 WHERE start IS NOT NULL GROUP BY 1, 2""", "sum_value", "mean", "min_value", "max_value", "throughput"),
    "a14_throughput_rate": rounded_sql("SELECT event_type, n, CASE WHEN us > 0 THEN n / (us / 1e6) ELSE 0.0 END AS throughput, 100.0 * slow / n AS slow_rate FROM (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 100) AS slow, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM events GROUP BY 1)", "throughput", "slow_rate"),
    "a15_index_trend": rounded_sql(trend_sql(DAILY_SQL, "event_type", "day", "slope < 0"), *TREND_COLS),
    "a16_anomaly_count": rounded_sql(trend_sql("events", "user_id", "event_id", "slope > 0"), *TREND_COLS),
    "a17_compare_periods": rounded_sql("""SELECT *, CASE WHEN abs(change_percent) < 5 THEN 'stable' WHEN change_percent < 0 THEN 'improving' ELSE 'degrading' END AS direction FROM (SELECT *, CASE WHEN baseline_value <> 0 THEN 100 * (current_value - baseline_value) / baseline_value ELSE 0.0 END AS change_percent FROM (
      SELECT o_orderpriority, avg(o_totalprice) FILTER (WHERE NOT o_orderdate >= TIMESTAMP '1996-01-01') AS baseline_value, avg(o_totalprice) FILTER (WHERE o_orderdate >= TIMESTAMP '1996-01-01') AS current_value, count(*) AS data_points FROM orders GROUP BY 1))""", "baseline_value", "current_value", "change_percent"),
}
ORACLES["a04_histogram_by_type"] = """
WITH b(bucket, label, lo, hi) AS (VALUES (0, '<=10', -1e300, 10), (1, '10-25', 10, 25), (2, '25-50', 25, 50), (3, '50-100', 50, 100), (4, '100-250', 100, 250), (5, '250-500', 250, 500), (6, '500-1000', 500, 1000),
  (7, '1000-2500', 1000, 2500), (8, '2500-5000', 2500, 5000), (9, '5000-10000', 5000, 10000), (10, '>10000', 10000, 1e300))
SELECT k.event_type, b.bucket::INTEGER AS bucket, label, count(e.value) AS n FROM (SELECT DISTINCT event_type FROM events WHERE value IS NOT NULL) k CROSS JOIN b
LEFT JOIN events e ON e.event_type = k.event_type AND e.value > lo AND e.value <= hi GROUP BY ALL"""
