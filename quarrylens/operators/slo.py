"""Service level objectives: error budgets, burn rates, incidents, and indicators over time.

slo: name, service_name, target (percent), window_days. sli: service_name, ts, good_events, total_events. as_of is always given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.functions.numeric import ratio

CRITICAL, WARNING, ELEVATED = 14.4, 6.0, 1.0
AT_RISK, BREACHED = 80.0, 100.0
US = 1_000_000


def micros(ts: Column | str) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def budget_columns(df: DataFrame) -> DataFrame:
    """Budget figures from total_events, good_events and target."""
    df = df.withColumn("total_events", F.coalesce("total_events", F.lit(0)).cast("long")).withColumn("good_events", F.coalesce("good_events", F.lit(0)).cast("long"))
    df = df.withColumn("bad_events", F.col("total_events") - F.col("good_events"))
    df = df.withColumn("current_sli", ratio(100.0 * F.col("good_events"), "total_events", 100.0)).withColumn("allowed_failures", (F.lit(100.0) - F.col("target")) / 100 * F.col("total_events"))
    df = df.withColumn("remaining_budget", F.col("allowed_failures") - F.col("bad_events"))
    consumed = F.when(F.col("allowed_failures") > 0, F.col("bad_events") / F.col("allowed_failures") * 100).when(F.col("bad_events") > 0, 100.0).otherwise(0.0)
    df = df.withColumn("budget_consumed_percent", consumed)
    df = df.withColumn("status", F.when(F.col("budget_consumed_percent") >= BREACHED, "breached").when(F.col("budget_consumed_percent") >= AT_RISK, "at_risk").otherwise("compliant"))
    return df.withColumn("projected_budget", F.col("remaining_budget"))  # at as_of no time of the window is left


def window_sums(slo: DataFrame, sli: DataFrame, windows: DataFrame, ids: list[str]) -> DataFrame:
    """Sums over windows [from_us, to_us], both ends included, that may overlap: windows has service_name, the two and ids.

    The join is by service and by bucket of time, a window reaching into few buckets, so it is an equi-join with a residual
    condition and not a nested loop. Windows without rows are kept.
    """
    size = F.lit(86400 * US)
    buckets = windows.withColumn("_b", F.explode(F.sequence(F.floor(F.col("from_us") / size), F.floor(F.col("to_us") / size))))
    rows = sli.select("service_name", micros("ts").alias("_us"), "good_events", "total_events").withColumn("_b", F.floor(F.col("_us") / size))
    # Rows of one microsecond are added up before the join.
    rows = rows.groupBy("service_name", "_b", "_us").agg(F.sum("good_events").alias("good_events"), F.sum("total_events").alias("total_events"), F.count("*").alias("_rows"))
    met = buckets.join(rows, ["service_name", "_b"]).where(F.col("_us").between(F.col("from_us"), F.col("to_us")))
    sums = met.groupBy("service_name", *ids).agg(F.sum("good_events").alias("good_events"), F.sum("total_events").alias("total_events"), F.sum("_rows").alias("n_rows"))
    return slo.join(windows, "service_name").join(sums, ["service_name", *ids], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good_events", "total_events", "n_rows")})


def error_budget(slo: DataFrame, sli: DataFrame, as_of: str) -> DataFrame:
    """One budget for each objective, over its window up to as_of."""
    end = micros(F.lit(as_of))
    windows = slo.select("service_name", "name", end.alias("to_us"), (end - F.col("window_days") * F.lit(86400 * US)).alias("from_us"))
    return budget_columns(window_sums(slo.drop("name"), sli, windows, ["name"])).drop("from_us", "to_us")


def multi_window_budgets(slo: DataFrame, sli: DataFrame, days: list[int], as_of: str) -> DataFrame:
    """S3. All windows end at as_of, so one scan with conditional sums serves them all."""
    end = micros(F.lit(as_of))
    age = (end - micros("ts")) / F.lit(86400.0 * US)
    inside = lambda d: (age >= 0) & (age <= d)
    sums = sli.groupBy("service_name").agg(*(F.sum(F.when(inside(d), F.col(c))).alias(f"_{c}_{d}") for d in days for c in ("good_events", "total_events")))
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("window_days"), F.col(f"_good_events_{d}").alias("good_events"), F.col(f"_total_events_{d}").alias("total_events")) for d in days)))
    return budget_columns(slo.drop("window_days").join(sums, "service_name", "left").select("name", "service_name", "target", each.alias("_x")).select("name", "service_name", "target", "_x.*"))


def daily_budgets(slo: DataFrame, sli: DataFrame, days: int, as_of: str) -> DataFrame:
    """Slices of 24 hours back from as_of, both ends included, so a row on an edge counts in two; slices without rows are left out."""
    back = (micros(F.lit(as_of)) - micros("ts")) / F.lit(86400 * US)
    offsets = F.when((back >= 0) & (back <= days), F.array_distinct(F.array(F.floor(back).cast("int"), (F.ceil(back) - 1).cast("int"))))
    placed = sli.withColumn("day_offset", F.explode(offsets)).where((F.col("day_offset") >= 0) & (F.col("day_offset") < days))
    sums = placed.groupBy("service_name", "day_offset").agg(F.sum("good_events").alias("good_events"), F.sum("total_events").alias("total_events"))
    return budget_columns(slo.drop("window_days").join(sums, "service_name"))


def period_budget(slo: DataFrame, sli: DataFrame, start: str, end: str) -> DataFrame:
    """The period is cut to whole days (at least one) before its end."""
    rows = sli.where((micros("ts") >= micros(F.lit(start))) & (micros("ts") <= micros(F.lit(end))))
    days = F.greatest(F.lit(1), F.floor((micros(F.lit(end)) - micros(F.lit(start))) / F.lit(86400.0 * US)).cast("int"))
    return error_budget(slo.withColumn("window_days", days), rows, end)


def burn_severity(rate: Column) -> Column:
    """S11."""
    return F.when(rate >= CRITICAL, "critical").when(rate >= WARNING, "warning").when(rate >= ELEVATED, "elevated").otherwise("none")


def burn_columns(df: DataFrame, hours: Column, prefix: str = "") -> DataFrame:
    """burn_rate and budget_consumed_in_window from the sums; the rate is scaled by window over objective window."""
    bad = F.col("total_events") - F.col("good_events")
    fraction = (F.lit(100.0) - F.col("target")) / 100
    consumed = F.when(fraction > 0, ratio(bad, "total_events") / fraction).otherwise(0.0)
    return df.withColumn(f"{prefix}consumed", F.coalesce(consumed, F.lit(0.0))).withColumn(f"{prefix}burn_rate", F.col(f"{prefix}consumed") / (hours / (F.col("window_days") * 24)))


def burn_verdict(df: DataFrame) -> DataFrame:
    rate = F.col("burn_rate")
    return (
        df.withColumn("budget_consumed_in_window", F.col("consumed") * 100).withColumn("alert_severity", burn_severity(rate))
        .withColumn("time_to_exhaustion_hours", F.when(rate > 1.0, F.col("window_days") * 24 / rate))
        .withColumn("is_critical", rate >= CRITICAL).withColumn("is_warning", (rate < CRITICAL) & (rate >= WARNING)).drop("consumed")
    )


def burn_history(slo: DataFrame, sli: DataFrame, as_of: str, window_hours: float = 1.0, history_hours: int = 24, step_hours: float = 1.0) -> DataFrame:
    """The burn rate of each objective at every step of the history, step 0 being its start."""
    end = micros(F.lit(as_of))
    n = int(history_hours / step_hours)
    at = (end - F.lit(int(history_hours * 3600 * US)) + F.col("step") * F.lit(int(step_hours * 3600 * US))).cast("long")
    windows = slo.select("service_name", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("step")).select("service_name", "step", at.alias("to_us"), (at - int(window_hours * 3600 * US)).alias("from_us"))
    made = window_sums(slo, sli, windows, ["step"]).withColumn("calculated_at", F.timestamp_micros("to_us").cast("timestamp_ntz"))
    return burn_verdict(burn_columns(made, F.lit(window_hours))).drop("from_us", "to_us", "n_rows")


def burn_rate(slo: DataFrame, sli: DataFrame, as_of: str, window_hours: float = 1.0) -> DataFrame:
    """With the time at which the budget is used up."""
    made = burn_history(slo, sli, as_of, window_hours, 0, 1.0).drop("step")
    out = F.timestamp_micros((F.unix_micros(F.col("calculated_at").cast("timestamp")) + F.col("time_to_exhaustion_hours") * 3600 * US).cast("long")).cast("timestamp_ntz")
    return made.withColumn("exhausted_at", out)


def multi_window_burn(slo: DataFrame, sli: DataFrame, as_of: str, short_hours: float = 1.0, long_hours: float = 6.0) -> DataFrame:
    """Both windows in one pass; an alert needs both rates."""
    age = (micros(F.lit(as_of)) - micros("ts")) / F.lit(3600.0 * US)
    sums = sli.groupBy("service_name").agg(*(F.sum(F.when((age >= 0) & (age <= h), F.col(c))).alias(f"{n}_{c}") for n, h in (("short", short_hours), ("long", long_hours)) for c in ("good_events", "total_events")))
    made = slo.join(sums, "service_name", "left")
    for n, h in (("short", short_hours), ("long", long_hours)):
        made = made.withColumn("good_events", F.coalesce(f"{n}_good_events", F.lit(0))).withColumn("total_events", F.coalesce(f"{n}_total_events", F.lit(0)))
        made = burn_columns(made, F.lit(h), f"{n}_")
    both = F.least("short_burn_rate", "long_burn_rate")
    severity = F.when(both >= CRITICAL, "critical").when(both >= WARNING, "warning").otherwise("none")
    return made.select("name", "service_name", F.col("long_burn_rate").alias("burn_rate"), F.col("short_burn_rate").alias("burn_rate_short"), F.col("long_burn_rate").alias("burn_rate_long"), (F.col("long_consumed") * 100).alias("budget_consumed_in_window"),
                       severity.alias("alert_severity"), F.when(F.col("long_burn_rate") > 1.0, F.col("window_days") * 24 / F.col("long_burn_rate")).alias("time_to_exhaustion_hours"))


def incidents(history: DataFrame, keys: list[str], at: str = "calculated_at", min_hours: float = 0.5) -> DataFrame:
    """Runs of critical or warning rows, ended by the next row that is neither; one without an end is not reported."""
    order = W.partitionBy(*keys).orderBy(at)
    alert = F.col("is_critical") | F.col("is_warning")
    rows = history.withColumn("_alert", alert).withColumn("_run", F.sum((~alert).cast("int")).over(order)).withColumn("_next", F.lead(at).over(order))
    runs = rows.where("_alert").groupBy(*keys, "_run").agg(F.min(at).alias("started_at"), F.max_by("_next", at).alias("ended_at"), F.max(F.col("is_critical").cast("int")).alias("_c"))
    hours = (micros("ended_at") - micros("started_at")) / F.lit(3600.0 * US)
    return runs.where(F.col("ended_at").isNotNull() & (hours >= min_hours)).select(*keys, "started_at", "ended_at", F.when(F.col("_c") == 1, "critical").otherwise("warning").alias("severity"))


def record(sli: DataFrame, path: str) -> None:
    """Append a batch of indicator rows to a table of Parquet files."""
    sli.write.mode("append").parquet(path)


def sli_history(sli: DataFrame, service: str | None = None, slo_type: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The filters that are given, in order of time. They reach the scan."""
    made = sli
    for column, value in (("service_name", service), ("slo_type", slo_type)):
        made = made.where(F.col(column) == value) if value is not None else made
    made = made.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz")) if start else made
    made = made.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz")) if end else made
    return made.orderBy("ts")


def latest(sli: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each group."""
    rest = [c for c in sli.columns if c not in keys]
    return sli.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*rest)).alias("_x") if "ts" not in rest else F.max(F.struct("ts", *(c for c in rest if c != "ts"))).alias("_x")).select(*keys, "_x.*")


def rates(df: DataFrame) -> DataFrame:
    success = ratio("good_events", "total_events", 1.0)
    return df.withColumn("bad_events", F.col("total_events") - F.col("good_events")).withColumn("success_rate", success).withColumn("failure_rate", 1.0 - success)


def aggregate_sli(sli: DataFrame, keys: list[str], hours: int = 1) -> DataFrame:
    """Sums over periods that start at multiples of their length."""
    period = F.window(F.col("ts").cast("timestamp"), f"{hours} hours")["start"].cast("timestamp_ntz")
    return rates(sli.groupBy(*keys, period.alias("period_start")).agg(F.sum("good_events").alias("good_events"), F.sum("total_events").alias("total_events"), F.count("*").alias("measurement_count")))


def overall_sli(sli: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """S16; over no rows the success rate is 1."""
    return rates(sli.groupBy(*(keys or [])).agg(F.coalesce(F.sum("good_events"), F.lit(0)).alias("good_events"), F.coalesce(F.sum("total_events"), F.lit(0)).alias("total_events"), F.count("*").alias("measurement_count")))


def inventory(sli: DataFrame) -> DataFrame:
    """Services with their number of rows and of types."""
    return sli.groupBy("service_name").agg(F.count("*").alias("n_rows"), F.count_distinct("slo_type").alias("n_types"))


def cleared(sli: DataFrame, service: str | None = None) -> DataFrame:
    """What is left after one service, or all, is cleared."""
    return sli.where(~F.col("service_name").eqNullSafe(F.lit(service))) if service is not None else sli.where(F.lit(False))
