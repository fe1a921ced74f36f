"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over the token windows of each text.

Normalised words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. A window is `width` consecutive
words of a benchmark item; an item of fewer words, but not none, is one window. Each window is filed under its longest word
(the most telling one), so that a scan looks up single words and verifies the whole window only there; verification compares
the words themselves, so no hash collision can make a hit.

The hash set is broadcast in blocks of about `block_bytes` of benchmark text: items are dealt to blocks by hash, the sizes of
the blocks are checked, and more blocks are made until each holds at most twice as much or a single item. A larger benchmark is
scanned block by block against all documents, the spans are merged per document, and only then words are removed.

Defined results: null or empty texts have no words and no hits; an item with null text has no windows; an item without item_id
makes hits, but is not named among the items; repeated documents keep a row each; repeated items count as the items they are
(by item_id); windows that overlap make one span, so ties cannot occur; a very long text is scanned whole; empty tables give no
hits or no rows; other columns are ignored (find) or kept as they are (remove).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import SLICE_ROWS, cut, doc_input, map_batches, small, table, texts

WIDTH = 10
BLOCK_BYTES = 4_000_000
_WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
#: Lower-cases A-Z and turns every byte outside words into a space. In UTF-8 all bytes of non-ASCII characters are 0x80 up.
NORMALISE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))

Index = dict[bytes, list[tuple[int, tuple[bytes, ...], tuple[str, ...]]]]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMALISE).split()


def index_of(items: list[tuple[str | None, bytes]], width: int) -> Index:
    """Longest word -> (its place in the window, the window, the items that hold it)."""
    owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - width + 1) if words else 0):
            owners[tuple(words[i : i + width])].update([item] if item is not None else ())
    index: Index = defaultdict(list)
    for window, who in owners.items():
        at = max(range(len(window)), key=lambda k: len(window[k]))
        index[window[at]].append((at, window, tuple(sorted(who))))
    return dict(index)


def scan(words: list[bytes], index: Index) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged [start, end) word spans that windows cover, and the items hit."""
    spans, items = [], set()
    for i, word in [(i, w) for i, w in enumerate(words) if w in index]:
        for at, window, who in index[word]:
            start = i - at
            if start >= 0 and tuple(words[start : start + len(window)]) == window:
                spans.append((start, start + len(window)))
                items.update(who)
    return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _block(n: int):
    return F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(n))


def blocks_of(benchmark: DataFrame, block_bytes: int) -> list[int]:
    """Numbers of the blocks of benchmark items; a block holds at most twice block_bytes, or one item."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    while n > 1:
        sizes = benchmark.groupBy(_block(n).alias("b")).agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_distinct("text").alias("kinds"))
        if sizes.where((F.col("bytes") > 2 * block_bytes) & (F.col("kinds") > 1)).isEmpty():
            break
        n *= 2
    return list(range(n))


def block_items(benchmark: DataFrame, block: int, n: int) -> list[tuple[str | None, bytes]]:
    part = benchmark if n == 1 else benchmark.where(_block(n) == block)
    rows = part.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).distinct().collect()  # one bounded block
    return [(r[0], r[1] or b"") for r in rows]


def removed(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    starts, ends, at, mask = [], [], 0, text.translate(NORMALISE)
    for w in mask.split():
        at = mask.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : starts[a]])
        last = ends[b - 1]
    return b"".join([*out, text[last:]])


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings), spans ([start, end) in words)."""
    return contamination(docs, benchmark, width, block_bytes, blocks_of(benchmark, block_bytes)).drop("row_key")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int, block_bytes: int, blocks: list[int]) -> DataFrame:
    """As find_contamination, with row_key: the MD5 of the text if there is more than one block."""
    sc = docs.sparkSession.sparkContext

    def scanned(block: int) -> DataFrame:
        items = sc.broadcast(block_items(benchmark, block, len(blocks)))
        held: dict[str, Index] = {}

        def run(batch):
            if "index" not in held:
                held["index"] = index_of(items.value, width)
            index, out = held["index"], {k: [] for k in ("doc_id", "n_words", "n_hit", "item_ids", "spans", "row_key")}
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                words = words_of(text)
                spans, who = scan(words, index)
                for k, v in (("doc_id", doc), ("n_words", len(words)), ("n_hit", sum(b - a for a, b in spans)), ("item_ids", sorted(who)), ("spans", [{"start": a, "end": b} for a, b in spans]), ("row_key", hashlib.md5(text).hexdigest() if len(blocks) > 1 else "")):
                    out[k].append(v)
            return out

        return map_batches(doc_input(docs), run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>, row_key string")

    if len(blocks) == 1:
        return scanned(0)
    return merge_blocks([scanned(k) for k in blocks])


def merge_blocks(parts: list[DataFrame]) -> DataFrame:
    """Unite the hits of several benchmark blocks. Equal documents (id and text) of one block stand for each other."""
    union = parts[0].withColumn("_block", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        union = union.unionByName(p.withColumn("_block", F.lit(k)))
    one = union.groupBy("doc_id", "row_key", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
        F.flatten(F.collect_set("spans")).alias("_spans"),
        F.count_if(F.col("_block") == 0).alias("_copies"),
    )

    def unite(batch):
        out = {k: batch.column(k).to_pylist() for k in ("doc_id", "row_key", "n_words", "item_ids", "_copies")}
        spans = [merged([(s["start"], s["end"]) for s in x]) for x in batch.column("_spans").to_pylist()]
        return out | {"n_hit": [sum(b - a for a, b in x) for x in spans], "spans": [[{"start": a, "end": b} for a, b in x] for x in spans]}

    kind = dict(union.dtypes)["doc_id"]
    done = map_batches(one, unite, f"doc_id {kind}, row_key string, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>, _copies long")
    return done.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select("doc_id", "n_words", "n_hit", "item_ids", "spans", "row_key")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, whole_documents: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the hit spans cut from the text, or without the documents that have any; all columns of docs stay.

    A text that is nothing but hits becomes empty. A benchmark of one block is scanned and applied in one pass; of more, the
    spans of all blocks are found first, block by block, and joined to the documents that have any.
    """
    sc, blocks, columns, kind = docs.sparkSession.sparkContext, blocks_of(benchmark, block_bytes), docs.columns, docs.schema
    at, n_columns = columns.index("text"), len(columns)
    shared, rows = None, docs
    if len(blocks) == 1:
        shared = sc.broadcast(block_items(benchmark, 0, 1))
    else:
        found = contamination(docs, benchmark, width, block_bytes, blocks).where("n_hit > 0").select(F.col("doc_id").alias("_id"), "row_key", F.col("spans").alias("_spans"))
        found = small(cut(found.dropDuplicates(["_id", "row_key"])))
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")) == F.col("row_key"))
        rows = docs.join(found, same, "left").select(*docs.columns, "_spans")

    def run(batches):
        import pyarrow as pa

        index = index_of(shared.value, width) if shared else None
        for batch in (b.slice(k, SLICE_ROWS) for b in batches for k in range(0, b.num_rows, SLICE_ROWS)):
            keep, new = [], []
            known = batch.column(n_columns).to_pylist() if index is None else [None] * batch.num_rows
            for text, spans in zip(batch.column(at).to_pylist(), known, strict=True):
                raw = (text or "").encode()
                spans = [(s["start"], s["end"]) for s in spans or ()] if index is None else scan(words_of(raw), index)[0]
                keep.append(not (spans and whole_documents))
                new.append(removed(raw, spans).decode() if spans else text)
            arrays = [batch.column(k) for k in range(n_columns)]
            arrays[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def oracle() -> str:
    words = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({words.format("text")}, []) AS w FROM documents),
b AS (SELECT item_id, {words.format("text")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS n, array_to_string(w[i:i + {WIDTH} - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WIDTH - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item_id FROM places JOIN windows USING (n, win)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
