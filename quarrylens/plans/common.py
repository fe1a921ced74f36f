"""Helpers of the query catalogue."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show; -0.0 as 0.0."""
    return df.select(*((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def rounded_sql(sql: str, *doubles: str, digits: int = 6) -> str:
    """The same for SQL."""
    put = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({put}) FROM ({sql.strip()})"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder that spark.checkpoint.dir names. Only a local session may have none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{named or tempfile.mkdtemp(prefix='quarrylens-')}/{name}-{uuid.uuid4().hex}"
