"""Sources and sinks: JSON and comma lists of values, trees of text files, tables, and the interchange formats of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_GLOB = "*.{py,js,ts,java,go,rb,sh,sql}"


def values_from_text(df: DataFrame, column: str) -> DataFrame:
    """A comma list of numbers as rows: seq, value. Parts that are no numbers are null."""
    return df.select(F.posexplode(F.split(column, ",")).alias("seq", "_v")).select("seq", F.trim("_v").try_cast("double").alias("value"))


def values_from_json(spark: SparkSession, path: str, field: str = "data") -> DataFrame:
    """Metric samples of JSON documents that hold an array of numbers or of objects with value and timestamp."""
    docs = spark.read.text(path, wholetext=True).select(F.col("value").alias("_j"))
    objects = F.from_json(F.get_json_object("_j", f"$.{field}"), "array<struct<timestamp:string,value:double>>")
    numbers = F.transform(F.from_json(F.get_json_object("_j", f"$.{field}"), "array<double>"), lambda x: F.struct(F.lit(None).cast("string").alias("timestamp"), x.alias("value")))
    is_objects = F.get_json_object("_j", f"$.{field}[0].value").isNotNull()
    each = docs.select(F.posexplode(F.when(is_objects, objects).otherwise(numbers)).alias("seq", "_x"))
    return each.select("seq", F.col("_x.timestamp").try_cast("timestamp_ntz").alias("ts"), F.col("_x.value").alias("value"))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """metric, ts, value from JSON lines; bad lines are kept in _corrupt."""
    return spark.read.schema("metric string, ts timestamp_ntz, value double, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def source_tree(spark: SparkSession, path: str, glob: str = SOURCE_GLOB, excluded: tuple[str, ...] = ("/.git/", "/node_modules/", "/__pycache__/", "/.venv/")) -> DataFrame:
    """H1: path, size, text of the files of a tree."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    for part in excluded:
        files = files.where(~F.col("path").contains(part))
    return files.select("path", F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))


def trace_documents(spark: SparkSession, path: str) -> DataFrame:
    """One trace export a file, as column json."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "json")


def changed_since(current: DataFrame, state: DataFrame, key: str, content: str) -> DataFrame:
    """Rows whose content hash is not in the state table (key, hash): what an incremental run has to look at."""
    return current.withColumn("hash", F.sha2(content, 256)).join(state.select(key, "hash"), [key, "hash"], "left_anti")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, partitioned by columns if given; only the partitions in df are replaced."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def annotations(findings: DataFrame) -> DataFrame:
    """Workflow annotations, one line a finding (file_path, line_number, severity, title)."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("notice")
    return findings.select(F.format_string("::%s file=%s,line=%d::%s", level, "file_path", "line_number", "title").alias("value"))
