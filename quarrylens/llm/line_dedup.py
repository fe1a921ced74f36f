"""Line dedup with a log-template tree.

Each line of `MIN_TOKENS` words or more is parsed to a fixed depth: a leaf of the tree is named by the token count and the
`DEPTH` leading tokens, tokens with a digit being a variable field. In leaves that `MIN_DOCS` documents reach, the other variable
fields are generalised: a token that fewer than `MIN_DOCS` lines have at its position gives way to the commonest token of the
leaf there, if at least `SIMILARITY` of the line's tokens stay. The outcome is the line's template. A template that recurs is
dropped from every document but the one with the least doc_id, which keeps its lines. It recurs if `MIN_DOCS` documents hold
it; a template of `LONG_TOKENS` words or more, such as a passage, if two do. A masked line that recurs by itself is its own
template and is not generalised. Lines of fewer than `MIN_TOKENS` words are too short to be templates and stay.

All counts are aggregates that combine before they are shuffled, so a line that a third of all documents hold is no hot task,
and the result does not depend on the order of rows, unlike with a tree that is grown line by line. The recurring masks are
broadcast, if a count shows that they are few; else lists of the lines to drop go to the documents by a join.

Ahead of a dedup of documents, lines can be spared in copies (spare_copies): a copy that loses what it shares would no longer be
found to be one. A document is held against the document that keeps the most of the lines it is to lose, by the SKETCH least hashes
of their five-word shingles; where these put the similarity at COPY or more, it loses no lines to that document, only to others.

Defined results: a null text has no lines and stays null; an empty text has one empty line; short lines always stay; rows
with the same doc_id are one document (null doc_id included); ties between tokens go to the later one by code point; a very
long text or line is parsed whole; an empty table gives an empty result; further columns are ignored (plan) or kept (remove).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import ARRAY_ROWS, SLICE_ROWS, WordHashes, cut, doc_input, give_back, map_batches, small, table, texts, window_hashes

MIN_TOKENS, DEPTH, MIN_DOCS, SIMILARITY = 4, 3, 5, 0.7
#: Templates of so many words recur from two documents on.
LONG_TOKENS, LONG_DOCS = 40, 2
#: Hashes of a text's sketch, and the similarity estimated from it (0.05 is its standard deviation at 0.8) from which lines are spared.
SKETCH, COPY, SHINGLE = 64, 0.7, 5
FIELD = b"<*>"
BLANK, VARIABLE = r"[ \t\x0B\f\r]+", r"[^ ]*[0-9][^ ]*"
DIGITS = b"0123456789"


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def parsed(line: bytes) -> tuple[int, int, bytes] | None:
    """Leaf, hash and masked text of a line that is long enough: single spaces, tokens with a digit as variable fields."""
    tokens = line.split()
    if len(tokens) < MIN_TOKENS:
        return None
    if len(line.translate(None, DIGITS)) < len(line):
        tokens = [t if len(t.translate(None, DIGITS)) == len(t) else FIELD for t in tokens]
    mask = b" ".join(tokens)
    leaf = b"%d %s" % (len(tokens), b" ".join(tokens[:DEPTH]))
    return signed(xxhash.xxh3_64_intdigest(leaf)), signed(xxhash.xxh3_64_intdigest(mask)), mask


def parsed_lines(text: bytes) -> Iterator[tuple[int, int, bytes]]:
    return (p for p in map(parsed, text.split(b"\n")) if p)


def needed(is_long: Column) -> Column:
    """The documents in which a template must stand to recur."""
    return F.when(is_long, F.lit(LONG_DOCS)).otherwise(F.lit(MIN_DOCS))


def reached_leaves(docs: DataFrame) -> DataFrame:
    """leaf, wide: the leaves that enough documents reach; do MIN_DOCS?"""

    def run(batch):
        ids, leaves, long_ = [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            mine = {p[0]: p[2].count(b" ") + 1 >= LONG_TOKENS for p in parsed_lines(text)}
            ids.extend([doc] * len(mine))
            leaves.extend(mine)
            long_.extend(mine.values())
        return {"doc_id": ids, "leaf": leaves, "long": long_}

    pairs = map_batches(doc_input(docs), run, f"doc_id {dict(docs.dtypes)['doc_id']}, leaf long, long boolean")
    return pairs.distinct().groupBy("leaf", "long").count().where(F.col("count") >= needed(F.col("long"))).select("leaf", (F.col("count") >= MIN_DOCS).alias("wide"))


def lines_in(docs: DataFrame, leaves: DataFrame) -> DataFrame:
    """leaf, mh, wide, long, mask (empty outside wide leaves, where nothing is generalised), doc_id of the distinct lines of each
    document in leaves (materialised)."""
    few = leaves.count() <= ARRAY_ROWS
    known = None
    if few:
        found = leaves.toArrow()  # its size has just been checked
        order = np.argsort(codes := found.column("leaf").to_numpy())
        known = docs.sparkSession.sparkContext.broadcast((codes[order], np.array(found.column("wide").to_pylist(), bool)[order]))

    def run(batch):
        out = {k: [] for k in ("leaf", "mh", "wide", "long", "mask", "doc_id")}
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            rows = list({p[:2]: p for p in parsed_lines(text)}.values())
            wide = [True] * len(rows)
            if known is not None and rows:
                codes, flags = known.value
                at = np.minimum(np.searchsorted(codes, mine := np.array([r[0] for r in rows])), max(len(codes) - 1, 0))
                inside = np.flatnonzero(codes[at] == mine).tolist() if len(codes) else []
                rows, wide = [rows[k] for k in inside], flags[at[inside]].tolist() if inside else []
            out["leaf"].extend(r[0] for r in rows)
            out["mh"].extend(r[1] for r in rows)
            out["wide"].extend(wide)
            out["long"].extend(r[2].count(b" ") + 1 >= LONG_TOKENS for r in rows)
            out["mask"].extend(r[2].decode("utf-8", "replace") if w else "" for r, w in zip(rows, wide, strict=True))
            out["doc_id"].extend([doc] * len(rows))
        return out

    made = map_batches(doc_input(docs), run, f"leaf long, mh long, wide boolean, long boolean, mask string, doc_id {dict(docs.dtypes)['doc_id']}")
    if few:
        return made
    joined = made.drop("wide").join(leaves, "leaf")
    return joined.withColumn("mask", F.when(F.col("wide"), F.col("mask")).otherwise("")).select(*made.columns)


def recurring(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaf, mh, doc_id) of the lines in leaves that many documents reach; (leaf, mh, first) of the lines whose template recurs."""
    line = ("leaf", "mh", "wide", "long", "mask")
    held = cut(lines_in(docs, cut(reached_leaves(docs))).groupBy(*line, "doc_id").agg(F.count("*").alias("times")).drop("times"))
    distinct = cut(held.groupBy(*line).agg(F.count("*").alias("docs"), F.min("doc_id").alias("first")))
    tokens = distinct.where("wide").select("leaf", "mh", "docs", "long", F.posexplode(F.split("mask", " ")).alias("pos", "token"))
    support = tokens.groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("support"))
    commonest = support.groupBy("leaf", "pos").agg(F.max(F.struct("support", "token")).alias("top"))
    rare = tokens.where(F.col("docs") < needed(F.col("long")))
    placed = rare.join(support, ["leaf", "pos", "token"]).join(commonest, ["leaf", "pos"])
    frequent = F.col("support") >= MIN_DOCS
    general = placed.groupBy("leaf", "mh").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.when(frequent, F.col("token")).otherwise(F.col("top.token")).alias("token")))).alias("parts"),
        (F.count_if(frequent) >= SIMILARITY * F.count("*")).alias("alike"),
    )
    general = general.where("alike").select("leaf", "mh", F.array_join(F.col("parts.token"), " ").alias("general"))
    template = distinct.join(general, ["leaf", "mh"], "left").select("leaf", "mh", "docs", "first", "long", F.when(F.col("wide"), F.xxhash64(F.coalesce("general", "mask"))).otherwise(F.col("mh")).alias("template"))
    template = cut(template)
    sums = template.groupBy("leaf", "template", "long").agg(F.sum("docs").alias("support"), F.max("docs").alias("best"), F.min("first").alias("first")).withColumn("need", needed(F.col("long")))
    sums = cut(sums.where(F.col("support") >= F.col("need")))
    # One mask that enough documents hold decides; else a document with several masks of a template must count once.
    open_ = small(cut(sums.where(F.col("best") < F.col("need")).select("leaf", "template", "need")))
    masks = small(cut(template.select("leaf", "mh", "template").join(open_, ["leaf", "template"])))
    holders = held.select("leaf", "mh", "doc_id").join(masks, ["leaf", "mh"]).select("leaf", "template", "need", "doc_id").distinct()
    proven = holders.groupBy("leaf", "template", "need").count().where(F.col("count") >= F.col("need")).select("leaf", "template")
    totals = cut(sums.where(F.col("best") >= F.col("need")).select("leaf", "template", "first").unionByName(sums.join(proven, ["leaf", "template"]).select("leaf", "template", "first")))
    return held.select("leaf", "mh", "doc_id"), template.select("leaf", "mh", "template").join(small(totals), ["leaf", "template"]).select("leaf", "mh", "first")


def sketch(text: bytes, hashes: WordHashes) -> list[int]:
    """The SKETCH least 32-bit hashes of the text's five-word shingles (of all its words, if they are fewer)."""
    words = hashes.array(text.lower().split())
    shingles = window_hashes(words, min(SHINGLE, len(words)))
    return np.unique((shingles >> np.uint64(32)).astype(np.uint32).view(np.int32))[:SKETCH].tolist() if len(words) else []


def copies(docs: DataFrame, held: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, first (materialised): documents that are copies of the one which keeps the most of the lines they are to lose."""
    lost = held.join(small(templates), ["leaf", "mh"]).where("doc_id <> first").groupBy("doc_id", "first").agg(F.count("*").alias("lines"))
    most = lost.groupBy("doc_id").agg(F.min(F.struct((-F.col("lines")).alias("lines"), "first")).alias("m")).select("doc_id", "m.first")

    hashes = WordHashes()

    def run(batch):
        return {"doc_id": batch.column("doc_id").to_pylist(), "sketch": [sketch(x, hashes) for x in texts(batch)]}

    made = map_batches(doc_input(docs), run, f"doc_id {dict(docs.dtypes)['doc_id']}, sketch array<int>").where("doc_id is not null")
    made = cut(made.groupBy("doc_id").agg(F.min("sketch").alias("sketch")))
    pairs = most.join(made.withColumnRenamed("sketch", "_a"), "doc_id").join(made.select(F.col("doc_id").alias("first"), F.col("sketch").alias("_b")), "first")
    least = F.slice(F.array_sort(F.array_union("_a", "_b")), 1, SKETCH)
    shared = F.size(F.array_intersect(least, F.array_intersect("_a", "_b")))
    return cut(pairs.where((F.size(least) > 0) & (shared >= COPY * F.size(least))).select("doc_id", "first"))


def drop_lists(held: DataFrame, templates: DataFrame, spared: DataFrame | None = None) -> DataFrame:
    """doc_id, drop: hashes of the masked lines that each document loses."""
    lost = held.join(templates, ["leaf", "mh"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    if spared is not None:
        lost = lost.join(spared, ["doc_id", "first"], "left_anti")
    return lost.groupBy("doc_id").agg(F.collect_set("mh").alias("drop"))


def dedup_lines(docs: DataFrame, spare_copies: bool = False) -> DataFrame:
    """All columns of docs with the text that is left, and _n_lines and _n_dropped. Copies of whole documents can be spared."""
    held, templates = recurring(docs)
    templates = cut(templates)
    spared = copies(docs, held, templates) if spare_copies else None
    few, shared, partner, joined = templates.count() <= ARRAY_ROWS and (spared is None or spared.count() <= ARRAY_ROWS), None, None, docs
    if few:  # masks that recur, and the document that keeps each: their number has just been checked
        found = templates.select("mh", "first").toArrow()
        order = np.argsort(masks := found.column("mh").to_numpy())
        first = found.column("first").to_pylist()
        shared = docs.sparkSession.sparkContext.broadcast((masks[order], [first[k] for k in order.tolist()]))
        if spared is not None:
            pairs = spared.toArrow()
            partner = docs.sparkSession.sparkContext.broadcast(dict(zip(pairs.column("doc_id").to_pylist(), pairs.column("first").to_pylist(), strict=True)))
    else:
        lists = cut(drop_lists(held, templates, spared).select(F.col("doc_id").alias("_id"), F.col("drop").alias("_drop")))
        joined = docs.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(*docs.columns, "_drop")
    at, at_id, schema = docs.columns.index("text"), docs.columns.index("doc_id"), docs.select("*", F.lit(0).cast("long").alias("_n_lines"), F.lit(0).cast("long").alias("_n_dropped")).schema

    def lost(lines: list[str], doc: object, drop: list[int] | None) -> list[int]:
        """The places of the lines that a document loses."""
        if shared is None:
            gone = set(drop or ())
            return [k for k, x in enumerate(lines) if gone and (p := parsed(x.encode())) and p[1] in gone]
        masks, first = shared.value
        met = [(k, p[1]) for k, x in enumerate(lines) if (p := parsed(x.encode()))] if len(masks) else []
        if not met:
            return []
        at = np.minimum(np.searchsorted(masks, mine := np.array([m for _, m in met])), len(masks) - 1)
        kept = {doc, partner.value.get(doc, doc)} if partner is not None else {doc}
        return [met[j][0] for j in np.flatnonzero(masks[at] == mine).tolist() if first[at[j]] not in kept]

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        for batch in (b.slice(k, SLICE_ROWS) for b in batches for k in range(0, b.num_rows, SLICE_ROWS)):
            new, n_lines, n_dropped = [], [], []
            drops = batch.column(batch.num_columns - 1).to_pylist() if shared is None else [None] * batch.num_rows
            for text, doc, drop in zip(batch.column(at).to_pylist(), batch.column(at_id).to_pylist(), drops, strict=True):
                lines = text.split("\n") if text is not None else []
                gone = lost(lines, doc, drop)
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
                gone = set(gone)
                new.append("\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text)
            arrays = [batch.column(k) for k in range(batch.num_columns - (shared is None))]
            arrays[at] = pa.array(new, arrays[at].type)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=schema.names)
        batch = arrays = new = None
        give_back()

    return joined.mapInArrow(run, schema)


def remove_repeated_lines(docs: DataFrame, spare_copies: bool = False) -> DataFrame:
    """docs with the text that is left; documents of which no word is left, but was before, are gone."""
    done = dedup_lines(docs, spare_copies)
    return done.where((F.col("_n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("text_sha256"))


def oracle_ctes(docs: str = "documents", prefix: str = "") -> str:
    """A WITH list that ends in {prefix}deduped(r, doc_id, text, n_lines, n_dropped)."""
    p = prefix
    return rf"""
{p}rows AS (SELECT row_number() OVER () AS r, * FROM {docs}),
{p}split AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM {p}rows),
{p}lines AS (
  SELECT *, regexp_replace(trim(regexp_replace(line, '{BLANK}', ' ', 'g'), ' '), '{VARIABLE}', '{FIELD.decode()}', 'g') AS mask FROM {p}split),
{p}parsed AS (
  SELECT *, string_split(mask, ' ') AS tokens, len(string_split(mask, ' ')) AS n FROM {p}lines),
{p}leafed AS (SELECT *, n || ' ' || array_to_string(tokens[1:{DEPTH}], ' ') AS leaf FROM {p}parsed WHERE n >= {MIN_TOKENS}),
{p}needs AS (SELECT *, CASE WHEN n >= {LONG_TOKENS} THEN {LONG_DOCS} ELSE {MIN_DOCS} END AS need FROM {p}leafed),
{p}reached AS (SELECT leaf FROM (SELECT DISTINCT leaf, need, doc_id FROM {p}needs) GROUP BY leaf, need HAVING count(*) >= need),
{p}masks AS (
  SELECT leaf, mask, tokens, need, count(*) AS docs, min(doc_id) AS first
  FROM (SELECT DISTINCT leaf, mask, tokens, need, doc_id FROM {p}needs JOIN {p}reached USING (leaf)) GROUP BY ALL),
{p}wide AS (SELECT leaf FROM (SELECT DISTINCT leaf, doc_id FROM {p}leafed) GROUP BY leaf HAVING count(*) >= {MIN_DOCS}),
{p}tokens AS (SELECT leaf, mask, docs, need, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM {p}masks WHERE leaf IN (SELECT leaf FROM {p}wide)),
{p}support AS (SELECT leaf, pos, token, sum(docs) AS support FROM {p}tokens GROUP BY ALL),
{p}commonest AS (SELECT leaf, pos, (max({{'s': support, 't': token}})).t AS top FROM {p}support GROUP BY ALL),
{p}general AS (
  SELECT leaf, mask, string_agg(CASE WHEN support >= {MIN_DOCS} THEN token ELSE top END, ' ' ORDER BY pos) AS general
  FROM {p}tokens JOIN {p}support USING (leaf, pos, token) JOIN {p}commonest USING (leaf, pos) WHERE docs < need
  GROUP BY leaf, mask HAVING count(*) FILTER (WHERE support >= {MIN_DOCS}) >= {SIMILARITY} * count(*)),
{p}templates AS (SELECT m.leaf, m.mask, need, first, coalesce(general, m.mask) AS template FROM {p}masks m LEFT JOIN {p}general g ON m.leaf = g.leaf AND m.mask = g.mask),
{p}holders AS (SELECT DISTINCT t.leaf, template, t.need, doc_id FROM {p}templates t JOIN {p}needs l ON l.leaf = t.leaf AND l.mask = t.mask),
{p}recurs AS (SELECT leaf, template FROM {p}holders GROUP BY leaf, template, need HAVING count(*) >= need),
{p}totals AS (SELECT leaf, template, min(first) AS first FROM {p}templates JOIN {p}recurs USING (leaf, template) GROUP BY ALL),
{p}gone AS (SELECT mask, t.first FROM {p}templates JOIN {p}totals t USING (leaf, template)),
{p}judged AS (
  SELECT l.*, l.n >= {MIN_TOKENS} AND g.mask IS NOT NULL AND l.doc_id IS DISTINCT FROM g.first AS lost FROM {p}parsed l LEFT JOIN {p}gone g ON l.mask = g.mask),
{p}put AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT lost), '') AS left_text
  FROM {p}judged GROUP BY r),
{p}deduped AS (
  SELECT d.* EXCLUDE (text), CASE WHEN d.text IS NOT NULL THEN left_text END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped
  FROM {p}rows d LEFT JOIN {p}put USING (r))"""


def oracle() -> str:
    return f"WITH {oracle_ctes()} SELECT doc_id, n_lines, n_dropped, sha256(text) AS text_sha256 FROM deduped"
