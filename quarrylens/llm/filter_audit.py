"""Audit of how filters interact, from a histogram of failure masks, in DataFrame functions only.

Native expressions turn each text into a mask of the filters that it fails; that it repeats a smaller doc_id's text comes from
grouping the texts (by SHA-256) for their minimum doc_id. Then only counts matter: a part (language) has at most 32 cells, one
for each mask, and every order of the filters, all 120, is read off the cells. Texts are read once and never shuffled.

Copies of a text are merged before they meet: each task sums its own, a digest has one row for each part, mask and label, and
how many of these rows stay (those at the minimum) follows from the counts, without joining rows back to their digest.

Defined results: a null or empty text has no words, fails no rule on words, and is equal to other null or empty texts; a null
lang is the part '' like an empty one; a row without doc_id has no smaller doc_id and is smaller than none; repeated rows count
each, and rows equal in doc_id do not repeat each other; a doc_id with several labels is good (toxic) if one of them says so;
rows without label are neither; a very long text is counted whole; an empty table gives no part; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrylens.llm.common import WORD_PATTERN, cut, table

LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SYMBOLS = "[#$%&*|]"
#: Rows without doc_id are dealt over so many keys, as one key could hold most of them.
SALTS = 64


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


#: Letter -> (name of the array of words, text) to what fails. The letter after the last is the one for repeated texts.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda words, text: F.size(words) < LEAST_WORDS,
    "B": lambda words, text: 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
    "C": lambda words, text: 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text),
    "D": lambda words, text: F.regexp_like(text, F.lit(SYMBOLS)),
}


def letters(filters=FILTERS) -> str:
    """The letters of the filters in the order of their bits, with the one for repeated texts."""
    return "".join(filters) + chr(ord(max(filters)) + 1)


def failure_masks(docs: DataFrame, filters=FILTERS) -> DataFrame:
    """doc_id, part, digest, mask: bit k is set if filter k fails; repeats are not yet in it."""
    read = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    split = read.select("*", words_of(F.col("text")).alias("words"))
    mask = F.lit(0)
    for k, fails in enumerate(filters.values()):
        mask = mask + F.when(fails(F.col("words"), F.col("text")), F.lit(1 << k)).otherwise(0)
    return split.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), mask.alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (one for each doc_id, part, digest and mask, n times) with good and toxic."""
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic")).withColumn("_zero", F.lit(0).cast("long"))
    # No row without doc_id meets a label: its salt only keeps such rows from meeting each other.
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(F.lit(0)).cast("long")
    joined = rows.withColumn("_salt", salt).join(known, (F.col("doc_id") == F.col("_id")) & (F.col("_salt") == F.col("_zero")), "left")
    return joined.select(*rows.columns, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def cells(docs: DataFrame, labels: DataFrame, filters=FILTERS) -> DataFrame:
    """part, mask, n, good, toxic (longs): documents of each part by all the filters that they fail, repeats included."""
    repeat = 1 << len(filters)
    rows = failure_masks(docs, filters).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    one = ["digest", "part", "mask", "good", "toxic"]
    merged = labelled(rows, labels).groupBy(*one).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_without"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least")
    )
    first = F.min("least").over(W.partitionBy("digest"))  # a row for each part and label: as many as there are parts, at most
    stay = F.col("n_without") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    told = merged.withColumn("first", first).withColumn("stay", stay)
    both = F.explode(F.array(F.struct(F.col("mask"), F.col("stay").alias("n")), F.struct((F.col("mask") + repeat).alias("mask"), (F.col("n") - F.col("stay")).alias("n"))))
    count = lambda c: F.sum(F.when(F.col(c), F.col("c.n")).otherwise(0)).alias(c)
    return told.select("part", "good", "toxic", both.alias("c")).where("c.n > 0").groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), count("good"), count("toxic"))


def interactions(cell: DataFrame, names: str) -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A part is one row with an array of at most 2 ** len(names) cells, from which each order and step is summed. A filter is the
    first of the k that a document fails in one k-th of all orders, which gives what it removes over all of them.
    """
    part = cell.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = ["".join(p) for p in itertools.permutations(names)]
    steps = part.select("part", "cells", F.explode(F.lit(orders)).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(names)))).alias("step"))
    earlier, own, before, bit = F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1), F.substring(F.col("filter_order"), F.col("step"), F.lit(1)), F.lit(0), F.lit(0)
    for k, name in enumerate(names):
        before = before + F.when(F.contains(earlier, F.lit(name)), F.lit(1 << k)).otherwise(0)
        bit = bit + F.when(own == name, F.lit(1 << k)).otherwise(0)
    at = steps.select("*", before.alias("before"), bit.alias("bit"))
    passed, fails = (lambda c: c.mask.bitwiseAND(F.col("before")) == 0), (lambda c: c.mask.bitwiseAND(F.col("bit")) != 0)
    total = lambda where, value: F.aggregate(F.filter("cells", where), F.lit(0).cast("long"), lambda s, c: s + value(c))
    removed, n = (lambda c: passed(c) & fails(c)), (lambda c: c.n)
    share = lambda c: c.n * (F.lit(len(orders)) / F.bit_count(c.mask)).cast("long")
    return at.select(
        "part", "filter_order", "step",
        total(lambda c: passed(c) & ~fails(c), n).alias("kept"), total(removed, n).alias("removed"), total(lambda c: ~passed(c) & fails(c), n).alias("redundant"),
        total(lambda c: c.mask == F.col("bit"), n).alias("unique_fails"), total(removed, lambda c: c.good).alias("good_lost"), total(removed, lambda c: c.toxic).alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters=FILTERS) -> DataFrame:
    return interactions(cut(cells(docs, labels, filters)), letters(filters))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def oracle() -> str:
    """By applying each order to the masks, summed over orders for shapley."""
    k = len(letters())
    bits = " + ".join(f"((mask >> (strpos('{letters()}', substr(filter_order, {j}, 1)) - 1) & 1) << {j - 1})" for j in range(1, k + 1))
    measures = ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {a}" for c, a in (
        ("n * (failed & ((1 << step) - 1) = 0)::INT", "kept"), ("n * (failed & ((1 << step) - 1) = 1 << (step - 1))::INT", "removed"),
        ("n * (failed & (1 << (step - 1)) != 0 AND failed & ((1 << (step - 1)) - 1) != 0)::INT", "redundant"), ("n * (failed = 1 << (step - 1))::INT", "unique_fails"),
        ("good * (failed & ((1 << step) - 1) = 1 << (step - 1))::INT", "good_lost"), ("toxic * (failed & ((1 << step) - 1) = 1 << (step - 1))::INT", "toxic_lost"),
    ))
    spelled = " CROSS JOIN ".join(f"(SELECT unnest(string_split('{letters()}', '')) AS l{j}) t{j}" for j in range(k))
    differ = " AND ".join(f"l{i} <> l{j}" for i in range(k) for j in range(i))
    return f"""
WITH parts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM parts GROUP BY t),
known AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, (len(w) < {LEAST_WORDS})::INT + 2 * (100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > {MOST_CAPITALS} * length(t))::INT
    + 8 * regexp_matches(t, '{SYMBOLS}')::INT + 16 * coalesce(p.doc_id > first, false)::INT AS mask, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic
  FROM parts p JOIN firsts USING (t) LEFT JOIN known k ON p.doc_id = k.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY ALL),
orders AS (SELECT {" || ".join(f"l{j}" for j in range(k))} AS filter_order FROM {spelled} WHERE {differ}),
ordered AS (SELECT part, filter_order, n, good, toxic, {bits} AS failed FROM cells CROSS JOIN orders),
counted AS (SELECT part, filter_order, step, {measures} FROM ordered CROSS JOIN (SELECT unnest(range(1, {k + 1}))::INT AS step) GROUP BY ALL)
SELECT *, sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1))::BIGINT AS shapley FROM counted
"""
