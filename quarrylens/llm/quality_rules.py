"""Quality rules whose thresholds adapt to each language and source, through mergeable quantile sketches.

Each document gets four counts (base features). Of the documents that pass the base rules, every (language, source) keeps a
sketch for each ratio: a histogram over logarithmic buckets (relative error 1 %), which merges by adding counts, is the same
in any order, and has a bounded number of buckets. A group's fences lie `REACH` spreads (interquartile range, at least a
floor) beyond its quartiles. A group of fewer than `MIN_GROUP` documents takes the merged sketch of its language, and a
language of fewer takes that of all. The fences are joined back and a document outside any of them is rejected.

Defined results: a null or empty text has no words and fails the base rules; null language or source is a group of its own;
equal rows get equal results, each its own row, as do rows without doc_id; a ratio on a fence is inside; a very long text is
counted whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrylens.llm.common import cut, doc_input, map_batches, table, texts

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
REACH = 5.0
MIN_GROUP = 200
GAMMA = 1.02
ZERO_BUCKET = -100_000
#: Ratio -> (numerator, denominator, least spread, is there a lower fence).
RATIOS = {
    "word_length": ("word_chars", "n_words", 0.2, True),
    "symbol_ratio": ("n_symbols", "n_words", 0.02, False),
    "dup_line_ratio": ("n_dup_lines", "n_lines", 0.08, False),
    "repeat_ratio": ("n_repeat_words", "n_words", 0.06, False),
}
BROADCAST_GROUPS = 100_000
SALTS = 32


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, n, covered = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            n += i + 3 - max(covered, i)
            covered = i + 3
    return n


def features(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word)."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.split()] if b"\n" in text else [text] * bool(words)
    return (
        len(words),
        len(b"".join(words).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def base_features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each document; base_failed."""

    def run(batch):
        rows = [features(t) for t in texts(batch)]
        return {c: batch.column(c).to_pylist() for c in ("doc_id", "lang", "source")} | {n: [r[k] for r in rows] for k, n in enumerate(NAMES)}

    kinds = dict(docs.dtypes)
    made = map_batches(doc_input(docs, "lang", "source"), run, f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, source {kinds['source']}, " + ", ".join(f"{n} long" for n in NAMES))
    return made.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def ratio(name: str) -> Column:
    over, under, _, _ = RATIOS[name]
    return F.coalesce(F.try_divide(F.col(over).cast("double"), F.col(under)), F.lit(0.0))


def bucket(x: Column) -> Column:
    return F.when(x < 1e-6, F.lit(ZERO_BUCKET)).otherwise(F.ceil(F.log(x) / F.log(F.lit(GAMMA))).cast("int"))


def bucket_value(k: Column) -> Column:
    return F.when(k == ZERO_BUCKET, F.lit(0.0)).otherwise(2 * F.pow(F.lit(GAMMA), k) / (GAMMA + 1))


def sketches(feats: DataFrame) -> DataFrame:
    """lang, source, name, k (bucket), n: the sketch of each group."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), bucket(ratio(n)).alias("k")) for n in RATIOS)))
    return feats.where(~F.col("base_failed")).select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.name", "x.k").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """For each group of keys: n_docs, and low_ and high_ for each ratio, from the merged sketches."""
    merged = sketch.groupBy(*keys, "name", "k").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*keys, "name")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("k"))).withColumn("total", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("k")))
    quartiles = ranked.groupBy(*keys, "name").agg(bucket_value(at(0.25)).alias("q1"), bucket_value(at(0.75)).alias("q3"), F.max("total").alias("total"))
    floor = F.coalesce(*(F.when(F.col("name") == n, F.lit(r[2])) for n, r in RATIOS.items()))
    spread = F.greatest(F.col("q3") - F.col("q1"), floor)
    sided = quartiles.select(*keys, "name", "total", (F.col("q1") - REACH * spread).alias("low"), (F.col("q3") + REACH * spread).alias("high"))
    pick = lambda n, c: F.max(F.when(F.col("name") == n, F.col(c))).alias(f"{c}_{n}")
    return sided.groupBy(*keys).agg(F.max("total").alias("n_docs"), *(pick(n, c) for n in RATIOS for c in ("low", "high")))


def group_fences(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The fences that hold for each (lang, source): its own, else its language's, else those of all."""
    bounds = [f"{c}_{n}" for n in RATIOS for c in ("low", "high")]
    own, lang, whole = fences(sketch, ["lang", "source"]), fences(sketch, ["lang"]), fences(sketch.withColumn("_all", F.lit(1)), ["_all"])
    lang = lang.select(F.col("lang").alias("_lang"), F.col("n_docs").alias("lang_docs"), *(F.col(b).alias(f"lang_{b}") for b in bounds))
    whole = whole.select("_all", *(F.col(b).alias(f"all_{b}") for b in bounds))
    joined = own.withColumn("_all", F.lit(1)).join(lang, F.col("lang").eqNullSafe(F.col("_lang")), "left").join(F.broadcast(whole), "_all", "left")  # whole has one row
    chosen = lambda b: F.when(F.col("n_docs") >= min_group, F.col(b)).when(F.col("lang_docs") >= min_group, F.col(f"lang_{b}")).otherwise(F.col(f"all_{b}"))
    return joined.select("lang", "source", *(chosen(b).alias(b) for b in bounds))


def judge(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, and kept."""
    feats = cut(base_features(docs))
    limits = cut(group_fences(sketches(feats), min_group)).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    if limits.count() <= BROADCAST_GROUPS:
        joined = feats.join(F.broadcast(limits), same, "left")  # its size has just been checked
    else:
        salt = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS))
        spread = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = feats.withColumn("_row_salt", salt).join(spread, same & (F.col("_row_salt") == F.col("_salt")), "left").drop("_salt", "_row_salt")
    outside = F.lit(False)
    for n, (_, _, _, lower) in RATIOS.items():
        outside = outside | F.coalesce(ratio(n) > F.col(f"high_{n}"), F.lit(False))
        if lower:
            outside = outside | F.coalesce(ratio(n) < F.col(f"low_{n}"), F.lit(False))
    return joined.select(*feats.columns, (~F.col("base_failed") & ~outside).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle(min_group: int = MIN_GROUP) -> str:
    word = r"[^\x20\x09-\x0D]"
    value = f"CASE WHEN {{0}} = {ZERO_BUCKET} THEN 0.0 ELSE 2 * pow({GAMMA}, {{0}}) / ({GAMMA} + 1) END"
    each = " UNION ALL ".join(f"SELECT lang, source, '{n}' AS name, {over} / {under} AS x, {least}::DOUBLE AS least FROM counts WHERE NOT base_failed" for n, (over, under, least, _) in RATIOS.items())

    def fences(name: str, keys: str) -> str:
        over = f"PARTITION BY {keys}name" if keys else "PARTITION BY name"
        return f"""
{name}_q AS (SELECT {keys}name, least, total, min(k) FILTER (WHERE upto >= 0.25 * total) AS a, min(k) FILTER (WHERE upto >= 0.75 * total) AS b FROM (
  SELECT {keys}name, least, k, sum(n) OVER ({over} ORDER BY k) AS upto, sum(n) OVER ({over}) AS total FROM (SELECT {keys}name, least, k, count(*) AS n FROM buckets GROUP BY ALL)) GROUP BY {keys}name, least, total),
{name} AS (SELECT {keys}name, total, {value.format("a")} - {REACH} * greatest({value.format("b")} - {value.format("a")}, least) AS low, {value.format("b")} + {REACH} * greatest({value.format("b")} - {value.format("a")}, least) AS high FROM {name}_q)"""

    outside = " OR ".join(f"coalesce(bool_or(c.name = '{n}' AND (x > high{' OR x < low' if lower else ''})), false)" for n, (_, _, _, lower) in RATIOS.items())
    checks = " UNION ALL ".join(f"SELECT r, lang, source, '{n}' AS name, {over} / {under} AS x FROM counts WHERE NOT base_failed" for n, (over, under, _, _) in RATIOS.items())
    return f"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
parts AS (SELECT *, regexp_extract_all(t, '{word}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM rows),
windows AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM parts WHERE len(w) >= 3)),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM windows JOIN (SELECT r, win FROM windows GROUP BY ALL HAVING count(*) > 1) USING (r, win)) GROUP BY r),
counted AS (
  SELECT r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines FROM parts LEFT JOIN repeats USING (r)),
counts AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
buckets AS (SELECT lang, source, name, least, CASE WHEN x < 1e-6 THEN {ZERO_BUCKET} ELSE ceil(ln(x) / ln({GAMMA}))::INTEGER END AS k FROM ({each})),
{fences("own", "lang, source, ")},{fences("langs", "lang, ")},{fences("whole", "")},
limits AS (
  SELECT o.lang, o.source, o.name, CASE WHEN o.total >= {min_group} THEN o.low WHEN g.total >= {min_group} THEN g.low ELSE a.low END AS low, CASE WHEN o.total >= {min_group} THEN o.high WHEN g.total >= {min_group} THEN g.high ELSE a.high END AS high
  FROM own o JOIN langs g ON o.lang IS NOT DISTINCT FROM g.lang AND o.name = g.name JOIN whole a ON o.name = a.name),
judged AS (SELECT r, {outside} AS outside FROM ({checks}) c JOIN limits m ON c.lang IS NOT DISTINCT FROM m.lang AND c.source IS NOT DISTINCT FROM m.source AND c.name = m.name GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(outside, false) AS kept FROM counts LEFT JOIN judged j ON counts.r = j.r
"""
