"""Queries that run a stream over the event table to its end, and their batch twins in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import anomaly
from quarrylens.plans.anomaly_queries import ORACLES as ANOMALY_SQL
from quarrylens.plans.common import rounded, rounded_sql, scratch, t
from quarrylens.plans.stats_queries import rating_sql
from quarrylens.streaming import sli


#: After all events.
END = "2999-01-01 00:00:00"


def _finished(s, d, build):
    """The rows that a stream over the events has written when all are read."""
    top = scratch(s, "stream")
    events = t(s, d, "events")
    source = sli.read_parquet_stream(s, f"{d}/events.parq*", events.schema)
    # An event of the far future lets the watermark pass all windows, so that none is left open but its own.
    last = events.limit(1).select(*(F.lit(END).cast("timestamp_ntz").alias(c) if c == "ts" else F.col(c) for c in events.columns))
    last.write.parquet(f"{top}/last")
    made = build(source.unionByName(sli.read_parquet_stream(s, f"{top}/last", events.schema)))
    sli.run_to_parquet(made, f"{top}/out", f"{top}/checkpoint").awaitTermination()
    return s.read.schema(made.schema).parquet(f"{top}/out")


def m12_sli(s, d):
    made = _finished(s, d, lambda e: sli.windowed_sli(e, F.concat(F.lit("svc"), F.col("user_id") % 4), F.col("event_type") == "error", late="0 seconds"))
    return rounded(made)


def m12_apdex(s, d):
    made = _finished(s, d, lambda e: sli.windowed_apdex(e, ["event_type"], late="0 seconds", threshold=100.0))
    return rounded(made)


def m12_detect(s, d):
    old = t(s, d, "events").where(F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz"))
    base = anomaly.baseline(old, ["event_type"])
    recent = lambda e: e.where((F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")) & (F.col("ts") < F.lit(END).cast("timestamp_ntz")))
    return rounded(_finished(s, d, lambda e: sli.detect_on_stream(recent(e), base, ["event_type"])))


QUERIES = {"m12_stream_sli": m12_sli, "m12_stream_apdex": m12_apdex, "m12_stream_detect": m12_detect}

ORACLES = {
    "m12_stream_sli": rounded_sql("""SELECT *, total_events - good_events AS bad_events, good_events / total_events AS success_rate, 1.0 - good_events / total_events AS failure_rate FROM (SELECT 'svc' || (user_id % 4) AS service_name, date_trunc('hour', ts)::TIMESTAMP AS period_start, count(*) FILTER (WHERE event_type <> 'error') AS good_events, count(*) AS total_events FROM events GROUP BY 1, 2)""", "success_rate", "failure_rate"),
    "m12_stream_apdex": rounded_sql(f"""SELECT *, (satisfied_count + 0.5 * tolerating_count) / total_count AS score, {rating_sql("(satisfied_count + 0.5 * tolerating_count) / total_count")} AS rating FROM (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS window_start, count(*) FILTER (WHERE value <= 100) AS satisfied_count, count(*) FILTER (WHERE value > 100 AND value <= 400) AS tolerating_count,
      count(*) FILTER (WHERE value > 400) AS frustrated_count, avg(value) AS mean, max(value) AS max_value, count(value) AS total_count FROM events GROUP BY 1, 2)""", "mean", "max_value", "score"),
    "m12_stream_detect": ANOMALY_SQL["n07_detect_with_baseline"],
}
