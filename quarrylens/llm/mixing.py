"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Every document has a fixed hash, of its doc_id and text. A source's target is met by whole rounds over the source (each document once in each) and,
for the rest of its budget, by the documents whose hash lies below a threshold. The threshold comes from sums of sizes by
hash bucket: the bucket in which the running sum passes the budget is refined into sub-buckets, and only that bucket, until
single hash values remain. Nothing is sorted but bucket sums, and a rerun takes the same documents.

Defined results: a null or empty text has size 0, and so is never taken; a null source is a source of its own and last in
order; rows without doc_id are told apart by their texts; only rows equal in doc_id and text share a hash and are taken
together; a very long text is counted whole; an empty table gives an empty result; other columns are ignored (plan) or kept as
they are (mix).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrylens.llm.common import WORD_PATTERN, cut, table

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Bits of the hash that each refinement uses; what is left decides by itself.
LEVELS = (10, 10, 10)
HASH_BITS = 60
BROADCAST_SOURCES = 100_000


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of MD5 of the id and the MD5 of the text."""
    named = F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target; one row a source.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes. A target stops at `most` times
    its source, and the excess goes to the others by weight: sources are capped in the order of cap to weight, and the first
    that is not capped sets the level of all that follow.
    """
    one = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))  # so windows over all rows see one row a source
    order = W.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    every = W.partitionBy(F.lit(0))
    n = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.coalesce(*(F.when(n == k, F.lit(w)) for k, w in enumerate(weights))).cast("long")
    capped = one.select("source", "source_size", weight.alias("w"), (most * F.col("source_size")).alias("cap"))
    rank = W.partitionBy(F.lit(0)).orderBy(F.col("cap").cast("double") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, rest = rank.rowsBetween(W.unboundedPreceding, -1), rank.rowsBetween(0, W.unboundedFollowing)
    level = capped.select(
        "source", "source_size", "w", "cap",
        F.row_number().over(rank).alias("at"),
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        F.sum("w").over(rest).alias("w_rest"),
    ).withColumn("open", F.col("cap") * F.col("w_rest") > F.col("left") * F.col("w"))
    first = F.min(F.when(F.col("open"), F.struct("at", "left", "w_rest"))).over(every)
    done = level.withColumn("first", first)
    target = F.when(F.col("first").isNull() | (F.col("at") < F.col("first.at")), F.col("cap").cast("double")).otherwise((F.col("first.left") * F.col("w")).cast("double") / F.col("first.w_rest"))
    return done.select("source", "source_size", target.alias("target"))


def _with_source(rows: DataFrame, by_source: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """rows with the columns of by_source, which has a row a source; a hot source is no hot key."""
    right = by_source.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if few:
        return rows.join(F.broadcast(right), same, how).drop("_source")  # the number of sources has been checked
    salts = 64
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.withColumn("_row_salt", F.pmod(F.col("h"), F.lit(salts))).join(right, same & (F.col("_row_salt") == F.col("_salt")), how).drop("_source", "_salt", "_row_salt")


def _boundary(sums: DataFrame, at: Column) -> DataFrame:
    """source, at, left: the bucket in which the running sum passes the budget, and the budget left at its start."""
    run = W.partitionBy("source").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    upto = sums.withColumn("upto", F.sum("n").over(run))
    return upto.where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("n") <= F.col("budget"))).select("source", "at", (F.col("budget") - (F.col("upto") - F.col("n"))).alias("left"), "n")


def mix_rules(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> tuple[DataFrame, DataFrame, bool]:
    """The sizes and hashes of docs; source, source_size, target, rounds, threshold (a row a source); are the sources few?"""
    sized = cut(docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h")))
    targets = cut(source_targets(sized, weights, most))
    few = targets.count() <= BROADCAST_SOURCES
    rounds = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    budgets = targets.select("source", "source_size", "target", rounds.alias("rounds"), (F.col("target") - rounds * F.col("source_size")).alias("budget"))
    limits, shift = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix")), HASH_BITS
    for bits in (*LEVELS, 0):
        above, shift = shift, shift - bits if bits else 0
        rows = _with_source(sized.where("size > 0"), limits, few).where(F.shiftright("h", above) == F.col("prefix"))
        sums = rows.select("source", "budget", "size", F.shiftright("h", shift).alias("at")).groupBy("source", "at").agg(F.sum("size").alias("n"), F.max("budget").alias("budget"))
        edge = cut(_boundary(sums, F.col("at")))
        limits = edge.select("source", F.col("left").alias("budget"), F.col("at").alias("prefix"))
    # The hash at the boundary is taken if the sum comes nearer to the budget with it.
    cuts = edge.select(F.col("source").alias("_s"), (F.col("at") + (F.col("n") - F.col("left") < F.col("left")).cast("long")).alias("threshold"))
    full = budgets.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left")
    return sized, full.select("source", "source_size", "target", "rounds", F.coalesce("threshold", F.lit(0)).alias("threshold")), few


def _copies(most: int) -> Column:
    return F.least(F.lit(most), F.col("rounds") + (F.col("h") < F.col("threshold")).cast("long")).cast("long")


def plan_mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (0 to most): how often the mix takes each document."""
    sized, rules, few = mix_rules(docs, weights, most)
    return _with_source(sized, rules, few, "left").select("doc_id", "source", "size", "source_size", "target", _copies(most).alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """docs as the mix takes them: each row 0 to `most` times, with all its columns and copy_no (from 1). No text is shuffled."""
    _, rules, few = mix_rules(docs, weights, most)
    names = [F.col(f"_d.{c}").alias(c) for c in docs.columns]
    rows = docs.where(text_size(F.col("text")) > 0).select(F.struct(*docs.columns).alias("_d"), "source", row_hash(F.col("doc_id"), F.col("text")).alias("h"))
    taken = _with_source(rows, rules.select("source", "rounds", "threshold"), few).select("_d", _copies(most).alias("copies")).where("copies > 0")
    return taken.select("_d", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select(*names, F.col("_copy").alias("copy_no"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def oracle_ctes(docs: str = "documents", prefix: str = "") -> str:
    """The mix in SQL, by sorting: a WITH list that ends in {prefix}mixed(r, doc_id, source, size, source_size, target, copies)."""
    w = " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(WEIGHTS))
    return f"""
{prefix}sized AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD_PATTERN}')), 0)::BIGINT AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM {docs}),
{prefix}one AS (SELECT source, sum(size)::BIGINT AS source_size FROM {prefix}sized GROUP BY source),
{prefix}weighed AS (
  SELECT *, {MOST_REPEATS} * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {len(WEIGHTS)} {w} END::BIGINT AS w FROM {prefix}one),
{prefix}levels AS (
  SELECT *, row_number() OVER o AS pos, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS left_over,
    (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS w_rest
  FROM {prefix}weighed WINDOW o AS (ORDER BY cap::DOUBLE / w, source IS NULL, encode(source))),
{prefix}first_open AS (SELECT pos AS fa, left_over AS fl, w_rest AS fw FROM {prefix}levels WHERE cap * w_rest > left_over * w ORDER BY pos LIMIT 1),
{prefix}targets AS (
  SELECT source, source_size, CASE WHEN fa IS NULL OR pos < fa THEN cap::DOUBLE ELSE (fl * w)::DOUBLE / fw END AS target
  FROM {prefix}levels LEFT JOIN {prefix}first_open ON true),
{prefix}budgets AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END::BIGINT AS rounds FROM {prefix}targets),
{prefix}hashed AS (
  SELECT source, h, sum(size)::BIGINT AS n FROM {prefix}sized WHERE size > 0 GROUP BY source, h),
{prefix}sums AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM {prefix}hashed),
{prefix}mixed AS (
  SELECT s.r, s.doc_id, s.source, s.size, b.source_size, b.target,
    least({MOST_REPEATS}, b.rounds + CASE WHEN s.size > 0 AND (x.upto <= b.target - b.rounds * b.source_size
      OR (x.upto - x.n <= b.target - b.rounds * b.source_size AND x.upto - (b.target - b.rounds * b.source_size) < (b.target - b.rounds * b.source_size) - (x.upto - x.n))) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM {prefix}sized s JOIN {prefix}budgets b ON s.source IS NOT DISTINCT FROM b.source LEFT JOIN {prefix}sums x ON x.source IS NOT DISTINCT FROM s.source AND x.h = s.h)"""


def oracle() -> str:
    return f"WITH {oracle_ctes()} SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed"
