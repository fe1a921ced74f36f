"""The windowed operators as Structured Streaming: late rows are held back by a watermark, windows are emitted when it has passed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quarrylens.operators.anomaly import _found, _outside, _with_baseline, _z_against, confidence_from_z, severity_from_distance, severity_from_z
from quarrylens.operators.slo import rates
from quarrylens.operators.stats import apdex_columns, with_apdex


def read_parquet_stream(spark, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def windowed_sli(events: DataFrame, service: Column, is_bad: Column, ts: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """S15 on a stream."""
    rows = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    sums = rows.groupBy(service.alias("service_name"), F.window("_at", window).alias("_w")).agg(F.count_if(~is_bad).alias("good_events"), F.count("*").alias("total_events"))
    return rates(sums.select("service_name", F.col("_w.start").cast("timestamp_ntz").alias("period_start"), "good_events", "total_events"))


def windowed_apdex(events: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", window: str = "1 hour", late: str = "10 minutes", threshold: float = 500.0) -> DataFrame:
    """A5, A12 on a stream."""
    rows = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    made = rows.groupBy(*keys, F.window("_at", window).alias("_w")).agg(*apdex_columns(value, threshold), F.avg(value).alias("mean"), F.max(value).alias("max_value"))
    return with_apdex(made.withColumn("window_start", F.col("_w.start").cast("timestamp_ntz")).drop("_w"))


def detect_on_stream(events: DataFrame, baseline: DataFrame, keys: list[str], ts: str = "ts", seq: str = "event_id", value: str = "value", z: float = 3.0) -> DataFrame:
    """N7 on a stream: a join with a static baseline, row by row, without state."""
    rows = _with_baseline(events, baseline, keys).where("b_is_valid")
    score = _z_against(value)
    distance = F.when(F.col("b_iqr") > 0, F.abs(F.col(value) - F.col("b_median")) / F.col("b_iqr")).otherwise(0.0)
    hit = rows.where((F.abs(score) >= z) | _outside(value))
    return _found(hit, keys, ts, seq, value, "b_mean", "baseline", F.when(F.col(value) > F.col("b_mean"), "spike").otherwise("drop"), F.greatest(severity_from_z(score), severity_from_distance(distance)), confidence_from_z(score), score)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what there is and stop; appended files are committed exactly once."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
