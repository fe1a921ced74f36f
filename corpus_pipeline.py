"""A corpus pipeline: quality classifier, line dedup, Jaccard join, decontamination, mixing. Counted as part of quarrylens.llm.

Each stage reads what the stage before it wrote. Stages that change a text also set n_chars, where there is that column.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import decontamination, jaccard_join, line_dedup, mixing, quality_classifier
from quarrylens.llm.common import ensure_checkpoint_dir, release, table


def _measured(docs: DataFrame) -> DataFrame:
    kinds = dict(docs.dtypes)
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kinds["n_chars"])) if "n_chars" in kinds else docs


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality_classifier.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines whose template recurs; documents that lose their last word go. Copies of whole documents keep the lines
    they share with the first of them, so that the next stage still finds them to be copies."""
    return _measured(line_dedup.remove_repeated_lines(docs, spare_copies=True))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of benchmark items."""
    return _measured(decontamination.remove_contamination(docs, table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, copies numbered by copy_no."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    top = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
        release(spark)
    return docs


#: The quality classifier cannot be put in SQL; tests/llm holds the stages against brute force instead.
ORACLE_SQL = None
