"""Queries of trends, forecasts and objectives over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import slo, trend
from quarrylens.plans.common import rounded, rounded_sql, t

AS_OF = "2024-01-30 00:00:00"


def _days(s, d):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return t(s, d, "events").groupBy("event_type", day.alias("ts")).agg(F.avg("value").alias("value"))


DAYS = "(SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS ts, avg(value) AS value FROM events GROUP BY ALL)"
T_COLS = ("slope", "r_squared", "mean", "std_dev", "start_value", "end_value", "slope_per_day", "volatility", "change_absolute", "change_percent", "confidence")
TREND_SQL = f"""
WITH g AS (SELECT event_type, count(*) AS data_points, min(ts) AS period_start, max(ts) AS period_end, coalesce(regr_slope(value, x), 0.0) AS slope, CASE WHEN var_pop(value) = 0 THEN 0.0 ELSE greatest(0.0, coalesce(regr_r2(value, x), 0.0)) END AS r_squared, avg(value) AS mean, stddev_pop(value) AS std_dev,
  arg_min(value, ts) AS start_value, arg_max(value, ts) AS end_value FROM (SELECT *, epoch_us(ts) / 1e6 - 1.6e9 AS x FROM {DAYS}) GROUP BY 1 HAVING count(*) >= 5),
h AS (SELECT *, slope * 86400 AS slope_per_day, CASE WHEN mean <> 0 THEN std_dev / mean ELSE 0.0 END AS volatility, end_value - start_value AS change_absolute, CASE WHEN start_value = 0 THEN 0.0 ELSE (end_value - start_value) / abs(start_value) * 100 END AS change_percent FROM g)
SELECT *, CASE WHEN abs(change_percent) < 5 THEN 'stable' WHEN r_squared < 0.01 THEN 'unknown' WHEN slope > 0 THEN 'improving' ELSE 'degrading' END AS direction, 0.7 * r_squared + 0.3 * least(1.0, data_points / 30) AS confidence, abs(change_percent) >= 5 AND r_squared >= 0.01 AS is_significant FROM h"""


def _trend(s, d):
    return trend.time_trend(_days(s, d), ["event_type"], r2_limit=0.01)


def t05(s, d):
    made = trend.with_synthetic_time(t(s, d, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("value")), ["conv_id"], "turn", "2024-01-01 00:00:00")
    return rounded(made)


P_COLS = ("predicted_value", "lower_bound", "upper_bound", "model_fit", "last_value", "volatility")
COMMON = "count(*) AS training_points, epoch_us(max(ts)) AS last_us, arg_max(value, ts) AS last_value, stddev_pop(value) / avg(value) AS volatility"
POINTS = "SELECT event_type, step, make_timestamp((last_us + step * 86400000000)::BIGINT) AS forecast_at, p AS predicted_value, p - w AS lower_bound, p + w AS upper_bound, model_fit, training_points, last_value, volatility FROM"
STEPS = "(SELECT unnest(range(1, 8))::INTEGER AS step)"
LINEAR = f"""{POINTS} (SELECT *, my + b * (lx + step * 86400 - mx) AS p, 1.96 * sqrt(greatest(0, (syy - b * b * sxx) / (training_points - 2))) * sqrt(1 + 1 / training_points + pow(lx + step * 86400 - mx, 2) / sxx) AS w
  FROM (SELECT event_type, {COMMON}, regr_slope(value, x) AS b, avg(x) AS mx, avg(value) AS my, var_pop(x) * count(*) AS sxx, var_pop(value) * count(*) AS syy, greatest(0, regr_r2(value, x)) AS model_fit, max(x) AS lx FROM (SELECT *, epoch_us(ts) / 1e6 - 1.6e9 AS x FROM {DAYS}) GROUP BY 1 HAVING count(*) >= 10), {STEPS})"""
HOLT = f"""
WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i, count(*) OVER (PARTITION BY event_type) AS n, first_value(value) OVER (PARTITION BY event_type ORDER BY ts) AS y1, last_value(value) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS yn FROM {DAYS}),
f(event_type, i, level, trend, ss) AS (SELECT event_type, i, y1, (yn - y1) / n, 0.0::DOUBLE FROM r WHERE i = 1
  UNION ALL SELECT event_type, i, nl, 0.1 * (nl - level) + 0.9 * trend, ss + pow(value - (nl + 0.1 * (nl - level) + 0.9 * trend), 2) FROM (SELECT r.event_type, r.i, r.value, f.level, f.trend, f.ss, 0.3 * r.value + 0.7 * (f.level + f.trend) AS nl FROM f JOIN r ON r.event_type = f.event_type AND r.i = f.i + 1)),
e AS (SELECT f.event_type, level, trend, ss FROM f JOIN r USING (event_type, i) WHERE i = n),
g AS (SELECT event_type, {COMMON}, var_pop(value) * count(*) AS syy FROM {DAYS} GROUP BY 1 HAVING count(*) >= 10)
{POINTS} (SELECT *, level + step * trend AS p, 1.96 * sqrt(ss / training_points) * sqrt(1 + step * 0.1) AS w, greatest(0, 1 - ss / syy) AS model_fit FROM e JOIN g USING (event_type), {STEPS})"""
MOVING = f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) <= 7 AS recent FROM {DAYS}),
g AS (SELECT event_type, {COMMON}, avg(value) FILTER (WHERE recent) AS a, stddev_pop(value) FILTER (WHERE recent) AS sd, avg(value) AS my, var_pop(value) AS vy FROM r GROUP BY 1 HAVING count(*) >= 10)
{POINTS} (SELECT *, a AS p, 1.96 * sd * sqrt(1 + step * 0.05) AS w, greatest(0, 1 - sd * sd / (vy + pow(my - a, 2))) AS model_fit FROM g, {STEPS})"""


def t13(s, d):
    parts = [trend.forecast_summary(f(_days(s, d), ["event_type"]), ["event_type"]).withColumn("forecast_method", F.lit(n)) for n, f in (("linear", trend.linear_forecast), ("exponential", trend.holt_forecast), ("moving_average", trend.moving_average_forecast))]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _summary_sql(points: str, name: str) -> str:
    return f"""SELECT event_type, periods, expected_value_at_end, last_value, model_fit, training_points, volatility, CASE WHEN (expected_value_at_end - a) / periods > 0 THEN 'degrading' WHEN expected_value_at_end < a THEN 'improving' ELSE 'stable' END AS trend_direction,
      (expected_value_at_end - last_value) / abs(last_value) * 100 AS expected_change_percent, array_to_string(list_filter([CASE WHEN model_fit < 0.3 THEN 'low model fit' END, CASE WHEN training_points < 30 THEN 'limited history' END, CASE WHEN volatility > 0.5 THEN 'high volatility' END, CASE WHEN low < 0 THEN 'negative bounds' END], lambda x: x IS NOT NULL), ',') AS warnings, '{name}' AS forecast_method
      FROM (SELECT event_type, count(*) AS periods, arg_min(predicted_value, step) AS a, arg_max(predicted_value, step) AS expected_value_at_end, min(lower_bound) AS low, any_value(last_value) AS last_value, any_value(model_fit) AS model_fit, any_value(training_points) AS training_points, any_value(volatility) AS volatility FROM ({points}) GROUP BY 1)"""


def _sli(s, d):
    service = F.concat(F.lit("svc"), (F.col("user_id") % 4).cast("string"))
    return t(s, d, "events").groupBy(service.alias("service_name"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count_if(F.col("event_type") != "error").alias("good_events"), F.count("*").alias("total_events")).withColumn("slo_type", F.lit("availability"))


def _slo(s):
    return s.createDataFrame([(f"slo{k}", f"svc{k}", target, 30) for k, target in enumerate((75.0, 80.0, 70.0, 99.0))], "name string, service_name string, target double, window_days int")


SLI = "(SELECT 'svc' || (user_id % 4) AS service_name, date_trunc('hour', ts)::TIMESTAMP AS ts, count(*) FILTER (WHERE event_type <> 'error') AS good_events, count(*) AS total_events, 'availability' AS slo_type FROM events GROUP BY 1, 2)"
SLO = "(SELECT * FROM (VALUES ('slo0', 'svc0', 75.0::DOUBLE, 30), ('slo1', 'svc1', 80.0::DOUBLE, 30), ('slo2', 'svc2', 70.0::DOUBLE, 30), ('slo3', 'svc3', 99.0::DOUBLE, 30)) v(name, service_name, target, window_days))"


def budget_sql(source: str) -> str:
    return f"""SELECT *, total_events - good_events AS bad_events, CASE WHEN total_events > 0 THEN 100.0 * good_events / total_events ELSE 100.0 END AS current_sli, (100.0 - target) / 100 * total_events AS allowed_failures, (100.0 - target) / 100 * total_events - (total_events - good_events) AS remaining_budget,
      {_CONSUMED} AS budget_consumed_percent, CASE WHEN {_CONSUMED} >= 100 THEN 'breached' WHEN {_CONSUMED} >= 80 THEN 'at_risk' ELSE 'compliant' END AS status, (100.0 - target) / 100 * total_events - (total_events - good_events) AS projected_budget
      FROM (SELECT * REPLACE (coalesce(good_events, 0)::BIGINT AS good_events, coalesce(total_events, 0)::BIGINT AS total_events) FROM ({source}))"""


_CONSUMED = "CASE WHEN (100.0 - target) * total_events > 0 THEN (total_events - good_events) / ((100.0 - target) / 100 * total_events) * 100 WHEN total_events - good_events > 0 THEN 100.0 ELSE 0.0 END"
B_COLS = ("target", "current_sli", "allowed_failures", "remaining_budget", "budget_consumed_percent", "projected_budget")
RATE = "coalesce(CASE WHEN total_events > 0 THEN (total_events - good_events) / total_events ELSE 0.0 END / ((100.0 - target) / 100), 0.0)"
HISTORY = f"""SELECT *, CASE WHEN burn_rate >= 14.4 THEN 'critical' WHEN burn_rate >= 6 THEN 'warning' WHEN burn_rate >= 1 THEN 'elevated' ELSE 'none' END AS alert_severity, CASE WHEN burn_rate > 1 THEN window_days * 24 / burn_rate END AS time_to_exhaustion_hours, burn_rate >= 14.4 AS is_critical, burn_rate < 14.4 AND burn_rate >= 6 AS is_warning FROM (
  SELECT *, {RATE} * 100 AS budget_consumed_in_window, {RATE} / (0.02 / (window_days * 24)) AS burn_rate FROM (
  SELECT s.*, step, u AS calculated_at, coalesce(sum(m.good_events), 0)::BIGINT AS good_events, coalesce(sum(m.total_events), 0)::BIGINT AS total_events FROM {SLO} s CROSS JOIN (SELECT i::INTEGER AS step, TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR + i * INTERVAL 1 HOUR AS u FROM range(0, 25) r(i))
  LEFT JOIN {SLI} m ON m.service_name = s.service_name AND m.ts >= u - INTERVAL 72 SECOND AND m.ts <= u GROUP BY ALL))"""
R_COLS = ("target", "burn_rate", "budget_consumed_in_window", "time_to_exhaustion_hours")


def _history(s, d):
    return slo.burn_history(_slo(s), _sli(s, d), AS_OF, window_hours=0.02)


def s06(s, d):
    return rounded(slo.burn_rate(_slo(s), _sli(s, d), AS_OF, window_hours=6.0).drop("exhausted_at"))


def s07(s, d):
    return rounded(slo.multi_window_burn(_slo(s), _sli(s, d), AS_OF))


S07 = f"""SELECT name, service_name, lb AS burn_rate, sb AS burn_rate_short, lb AS burn_rate_long, lc * 100 AS budget_consumed_in_window, CASE WHEN least(lb, sb) >= 14.4 THEN 'critical' WHEN least(lb, sb) >= 6 THEN 'warning' ELSE 'none' END AS alert_severity, CASE WHEN lb > 1 THEN 720 / lb END AS time_to_exhaustion_hours FROM (
  SELECT *, sc / (1 / 720) AS sb, lc / (6 / 720) AS lb FROM (SELECT name, service_name, coalesce((st - sg) / nullif(st, 0), 0) / ((100 - target) / 100) AS sc, coalesce((lt - lg) / nullif(lt, 0), 0) / ((100 - target) / 100) AS lc FROM {SLO} JOIN (
  SELECT service_name, sum(good_events) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR AND ts <= TIMESTAMP '{AS_OF}') AS sg, sum(total_events) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR AND ts <= TIMESTAMP '{AS_OF}') AS st,
  sum(good_events) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 6 HOUR AND ts <= TIMESTAMP '{AS_OF}') AS lg, sum(total_events) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 6 HOUR AND ts <= TIMESTAMP '{AS_OF}') AS lt FROM {SLI} GROUP BY 1) USING (service_name)))"""
SLI_RATES = "*, total_events - good_events AS bad_events, CASE WHEN total_events > 0 THEN good_events / total_events ELSE 1.0 END AS success_rate, 1.0 - CASE WHEN total_events > 0 THEN good_events / total_events ELSE 1.0 END AS failure_rate"
SUMS = "sum(good_events)::BIGINT AS good_events, sum(total_events)::BIGINT AS total_events, count(*) AS measurement_count"

QUERIES = {
    "t01_time_trend": lambda s, d: rounded(_trend(s, d)),
    "t05_synthetic_time": t05,
    "t06_time_change_points": lambda s, d: rounded(trend.time_change_points(_days(s, d), ["event_type"], "ts", window=6, threshold=0.8)),
    "t07_trend_report": lambda s, d: rounded(trend.trend_report(_trend(s, d), "event_type")),
    "t09_interval": lambda s, d: rounded(trend.intervals(t(s, d, "events"), ["event_type"])),
    "t10_linear_forecast": lambda s, d: rounded(trend.linear_forecast(_days(s, d), ["event_type"])),
    "t11_holt_forecast": lambda s, d: rounded(trend.holt_forecast(_days(s, d), ["event_type"])),
    "t12_moving_average_forecast": lambda s, d: rounded(trend.moving_average_forecast(_days(s, d), ["event_type"])),
    "t13_forecast_summary": t13,
    "s01_error_budget": lambda s, d: rounded(slo.error_budget(_slo(s), _sli(s, d), AS_OF)),
    "s02_period_budget": lambda s, d: rounded(slo.period_budget(_slo(s), _sli(s, d), "2024-01-10 06:00:00", "2024-01-20 12:00:00")),
    "s03_multi_window_budgets": lambda s, d: rounded(slo.multi_window_budgets(_slo(s), _sli(s, d), [1, 7, 14, 28], AS_OF)),
    "s04_daily_budgets": lambda s, d: rounded(slo.daily_budgets(_slo(s), _sli(s, d), 20, AS_OF)),
    "s06_burn_rate": s06,
    "s07_multi_window_burn": s07,
    "s08_burn_history": lambda s, d: rounded(_history(s, d)),
    "s09_incidents": lambda s, d: slo.incidents(_history(s, d).withColumn("is_critical", F.col("burn_rate") >= 9000).withColumn("is_warning", F.col("burn_rate") >= 6000), ["name"]),
    "s14_latest": lambda s, d: slo.latest(_sli(s, d), ["service_name", "slo_type"]),
    "s15_sli_hourly": lambda s, d: rounded(slo.aggregate_sli(_sli(s, d), ["service_name"], 1)),
    "s15_sli_daily": lambda s, d: rounded(slo.aggregate_sli(_sli(s, d), ["service_name"], 24)),
    "s16_overall_sli": lambda s, d: rounded(slo.overall_sli(slo.sli_history(_sli(s, d), service="svc1", start="2024-01-05", end="2024-01-09 12:00:00"))),
    "s17_inventory": lambda s, d: slo.inventory(_sli(s, d)),
    "s18_cleared": lambda s, d: rounded(slo.overall_sli(slo.cleared(_sli(s, d), "svc2"), ["service_name"])),
}

ORACLES = {
    "t01_time_trend": rounded_sql(TREND_SQL, *T_COLS),
    "t05_synthetic_time": "SELECT conv_id, turn, length(text)::DOUBLE AS value, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS ts FROM conversations",
    "t06_time_change_points": rounded_sql(f"""SELECT event_type, ts, i::BIGINT AS index, abs(ma - mb) / sqrt((va + vb) / 2) AS magnitude FROM (SELECT event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, avg(value) OVER b AS mb, avg(value) OVER a AS ma, var_pop(value) OVER b AS vb, var_pop(value) OVER a AS va
      FROM {DAYS} WINDOW b AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) WHERE i >= 6 AND i < n - 6 AND va + vb > 0 AND abs(ma - mb) / sqrt((va + vb) / 2) >= 0.8""", "magnitude"),
    "t07_trend_report": f"""SELECT *, CASE WHEN degrading > improving THEN 'degrading' WHEN improving > degrading THEN 'improving' ELSE 'stable' END AS overall_health FROM (SELECT count(*) AS metrics_analyzed, count(*) FILTER (WHERE direction = 'improving') AS improving, count(*) FILTER (WHERE direction = 'degrading') AS degrading,
      count(*) FILTER (WHERE direction NOT IN ('improving', 'degrading')) AS stable, arg_max(event_type, abs(change_percent)) FILTER (WHERE direction = 'degrading') AS worst_metric, count(*) FILTER (WHERE is_significant AND direction = 'degrading') AS significant_degradations, count(*) FILTER (WHERE volatility > 0.5) AS volatile_metrics FROM ({TREND_SQL}))""",
    "t09_interval": rounded_sql("SELECT event_type, coalesce(quantile_cont(CASE WHEN g > 0 THEN g END, 0.5), 86400) AS interval_seconds FROM (SELECT event_type, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY event_type ORDER BY ts) AS g FROM events) GROUP BY 1", "interval_seconds"),
    "t10_linear_forecast": rounded_sql(LINEAR, *P_COLS), "t11_holt_forecast": rounded_sql(HOLT, *P_COLS), "t12_moving_average_forecast": rounded_sql(MOVING, *P_COLS),
    "t13_forecast_summary": rounded_sql(" UNION ALL ".join(_summary_sql(p, n) for p, n in ((LINEAR, "linear"), (HOLT, "exponential"), (MOVING, "moving_average"))), "expected_value_at_end", "last_value", "model_fit", "volatility", "expected_change_percent"),
    "s01_error_budget": rounded_sql(budget_sql(f"SELECT s.*, count(m.ts) AS n_rows, sum(m.good_events) AS good_events, sum(m.total_events) AS total_events FROM {SLO} s LEFT JOIN {SLI} m ON m.service_name = s.service_name AND m.ts BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY * window_days AND TIMESTAMP '{AS_OF}' GROUP BY ALL"), *B_COLS),
    "s02_period_budget": rounded_sql(budget_sql(f"SELECT s.* REPLACE (10 AS window_days), count(m.ts) AS n_rows, sum(m.good_events) AS good_events, sum(m.total_events) AS total_events FROM {SLO} s LEFT JOIN {SLI} m ON m.service_name = s.service_name AND m.ts BETWEEN TIMESTAMP '2024-01-10 12:00:00' AND TIMESTAMP '2024-01-20 12:00:00' GROUP BY ALL"), *B_COLS),
    "s03_multi_window_budgets": rounded_sql(budget_sql(f"SELECT name, s.service_name, target, w::INTEGER AS window_days, sum(m.good_events) AS good_events, sum(m.total_events) AS total_events FROM {SLO} s CROSS JOIN (SELECT unnest([1, 7, 14, 28]) AS w) LEFT JOIN {SLI} m ON m.service_name = s.service_name AND m.ts BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY * w AND TIMESTAMP '{AS_OF}' GROUP BY ALL"), *B_COLS),
    "s04_daily_budgets": rounded_sql(budget_sql(f"SELECT s.* EXCLUDE (window_days), o::INTEGER AS day_offset, sum(m.good_events) AS good_events, sum(m.total_events) AS total_events FROM {SLO} s CROSS JOIN range(0, 20) r(o) JOIN {SLI} m ON m.service_name = s.service_name AND m.ts BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY * (o + 1) AND TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY * o GROUP BY ALL"), *B_COLS),
    "s06_burn_rate": rounded_sql(f"""SELECT *, CASE WHEN burn_rate >= 14.4 THEN 'critical' WHEN burn_rate >= 6 THEN 'warning' WHEN burn_rate >= 1 THEN 'elevated' ELSE 'none' END AS alert_severity, CASE WHEN burn_rate > 1 THEN window_days * 24 / burn_rate END AS time_to_exhaustion_hours, burn_rate >= 14.4 AS is_critical, burn_rate < 14.4 AND burn_rate >= 6 AS is_warning FROM (
      SELECT *, {RATE} * 100 AS budget_consumed_in_window, {RATE} / (6 / (window_days * 24)) AS burn_rate FROM (SELECT s.*, TIMESTAMP '{AS_OF}' AS calculated_at, coalesce(sum(m.good_events), 0)::BIGINT AS good_events, coalesce(sum(m.total_events), 0)::BIGINT AS total_events FROM {SLO} s LEFT JOIN {SLI} m ON m.service_name = s.service_name AND m.ts >= TIMESTAMP '{AS_OF}' - INTERVAL 6 HOUR AND m.ts <= TIMESTAMP '{AS_OF}' GROUP BY ALL))""", *R_COLS),
    "s07_multi_window_burn": rounded_sql(S07, "burn_rate", "burn_rate_short", "burn_rate_long", "budget_consumed_in_window", "time_to_exhaustion_hours"),
    "s08_burn_history": rounded_sql(HISTORY, *R_COLS),
    "s09_incidents": f"""SELECT name, min(calculated_at) AS started_at, arg_max(nxt, calculated_at) AS ended_at, CASE WHEN bool_or(burn_rate >= 9000) THEN 'critical' ELSE 'warning' END AS severity FROM (SELECT *, sum((NOT burn_rate >= 6000)::INTEGER) OVER (PARTITION BY name ORDER BY calculated_at) AS run, lead(calculated_at) OVER (PARTITION BY name ORDER BY calculated_at) AS nxt FROM ({HISTORY}))
      WHERE burn_rate >= 6000 GROUP BY name, run HAVING arg_max(nxt, calculated_at) IS NOT NULL AND arg_max(coalesce(nxt, TIMESTAMP '1970-01-01'), calculated_at) > min(calculated_at)""",
    "s14_latest": f"SELECT * FROM {SLI} QUALIFY row_number() OVER (PARTITION BY service_name, slo_type ORDER BY ts DESC) = 1",
    "s15_sli_hourly": rounded_sql(f"SELECT {SLI_RATES} FROM (SELECT service_name, date_trunc('hour', ts)::TIMESTAMP AS period_start, {SUMS} FROM {SLI} GROUP BY 1, 2)", "success_rate", "failure_rate"),
    "s15_sli_daily": rounded_sql(f"SELECT {SLI_RATES} FROM (SELECT service_name, date_trunc('day', ts)::TIMESTAMP AS period_start, {SUMS} FROM {SLI} GROUP BY 1, 2)", "success_rate", "failure_rate"),
    "s16_overall_sli": rounded_sql(f"SELECT {SLI_RATES} FROM (SELECT {SUMS} FROM {SLI} WHERE service_name = 'svc1' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-09 12:00:00')", "success_rate", "failure_rate"),
    "s17_inventory": f"SELECT service_name, count(*) AS n_rows, count(DISTINCT slo_type) AS n_types FROM {SLI} GROUP BY 1",
    "s18_cleared": rounded_sql(f"SELECT {SLI_RATES} FROM (SELECT service_name, {SUMS} FROM {SLI} WHERE service_name <> 'svc2' GROUP BY 1)", "success_rate", "failure_rate"),
}
