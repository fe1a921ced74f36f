"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are the words that the training tokens have at least twice; all others are one rare symbol, whose words share its mass
by their base probability. Contexts grow from one symbol to `DEPTH` symbols, as long as they occur four times; each keeps the next
symbols it was seen with twice. These counts are the model's and do not grow with the corpus. A context is a state of the tree
only if its distribution diverges from that of its longest shorter state: the log-likelihood it gains on the training tokens must
exceed half the logarithm of its count for each of its parameters. Distributions are smoothed by absolute discounting, and the
mass set free goes to the distribution of the shorter state, at last to the base (add one half over the vocabulary). A text is
scored token by token from the longest suffix that is a state. Symbols and contexts are named by 64-bit and 63-bit hashes, so
neither the number of symbols nor the depth is bound.

The tree is a table and grows with the corpus; no part of it is left out. What a state or an entry changes in the logarithm of a
token's probability does not depend on the other states, so a text's score is its base and a sum of values looked up by key. The
`HEAD_ROWS` states and entries of the largest counts are broadcast, all others are looked up after a shuffle, as are the counts of
words under KNOWN_SHARE of the tokens. Bitmaps of keys (`MOST_BITS` bits at most) spare lookups of what the tree surely lacks;
what they let pass is settled by the lookup, so they change the work and not the result. Tables go through shuffles and files as
arrays packed by slices of the range of codes.

Defined results: a null or empty text is the end token alone; equal rows have equal scores, each its own row; rows without
doc_id are training rows; an empty training set gives every token the probability 1 / (V + 1) with V = 0; an empty table
gives an empty result; a very long text is scored whole; counts decide, so ties cannot occur; columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

import gc
import itertools
import math
import time
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import MEMO_BYTES, cut, doc_input, ensure_checkpoint_dir, map_batches, mix64, release, table
from quarrylens.llm.language_id import held_out

KNOWN_SHARE = 5e-7
#: Growth of the counts that a symbol or an entry needs: none, so two occurrences are enough in any corpus; a context needs CONTEXT entries' worth.
SYMBOL_GROWTH, ENTRY_GROWTH, CONTEXT, MOST_ENTRIES = 0.0, 0.0, 2, math.inf
LEAST = 2
DEPTH, DISCOUNT = 3, 0.5
#: Rows of the tree that are broadcast, and the size of a bitmap: bits for each key, and at most.
HEAD_ROWS, BITS_EACH, MOST_BITS = 2_000_000, 16, 1 << 29
#: Bytes of a chunk of texts and of what is hashed at once, tokens of a task that adds counts, and the slices of codes that such a task has at least.
CHUNK_BYTES, HASH_BYTES, TASK_TOKENS, SLICES = 1 << 21, 1 << 18, 2_000_000, 4
#: Tokens that a slice has at least: each task makes a row for each slice that it meets, so slices follow the corpus, not the partitions.
SLICE_TOKENS = 100_000
#: Parts in which the texts are scored if there are more than PART_TOKENS training tokens, so that not all lookups are on disk at once.
PARTS, PART_TOKENS = 4, 5_000_000
#: Rows that a task that adds counts gathers before it adds them up.
GATHERED = 4_000_000
#: The end of a text is the empty word; what stands before a text and what marks the key of a word are no words.
END, START, WORD = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"", b" ", b"  "))
RARE = 0
#: Packed rows: entries or grams, contexts, words; tree rows of depth d have TREE + d.
GRAMS, TABLE, TREE, WORDS, DOCS, ASK, ASK_WORDS = 0, 1, 2, 20, 21, 22, 23
PACKED = "slice int, kind byte, a binary, b binary, c binary, d binary"
#: Of a value that is looked up: sums of whole numbers do not depend on their order.
UNIT = 2.0**-36


def fold(codes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The code of a context and what follows: a symbol, or the code of a shorter context and that symbol."""
    return (mix64(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + symbols.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)


def spread(keys: np.ndarray) -> np.ndarray:
    """What deals keys in slices: the same for a code and for the key of the state of that code."""
    keys = keys.view(np.int64)
    return (keys ^ (keys >> np.int64(63))).view(np.uint64) << np.uint64(1)


def log_base(n: int, v: int, counts: np.ndarray) -> np.ndarray:
    return np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))


@dataclass
class Level:
    """States of one depth and their entries, each sorted by code; what they add to the logarithm of a probability."""

    contexts: np.ndarray
    log_left: np.ndarray
    entries: np.ndarray
    adds: np.ndarray


@dataclass
class Tree:
    n: int
    v: int
    words: np.ndarray  # known word hashes, sorted
    counts: np.ndarray
    symbols: np.ndarray  # the symbol of each known word
    slice_bits: int
    tasks: int
    levels: list[Level] = field(default_factory=list)  # what is broadcast
    rest: DataFrame | None = None  # packed: keys, values of all other states and entries, and of words that are not known
    bitmap: Bitmap | None = None  # of the rest, without words
    paths: list[str] = field(default_factory=list)  # the files of the rest

    def log_base(self, counts: np.ndarray) -> np.ndarray:
        return log_base(self.n, self.v, counts)

    def log_p(self, symbols: np.ndarray, contexts: list[np.ndarray], base: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol after its contexts of depth 1, 2, ... (-1: none); base: that without context."""
        out, grams = base.copy(), symbols
        for level, codes in zip(self.levels, contexts, strict=False):
            grams = fold(codes, grams)
            for keys, values, asked, some in ((level.contexts, level.log_left, codes, codes >= 0), (level.entries, level.adds, grams, (codes >= 0) & (symbols != RARE))):
                at, there = find(keys, asked)
                some = np.flatnonzero(some & there)
                out[some] += values[at[some]]
        return out


class Index:
    """Sorted, evenly spread 64-bit keys that are found by their first bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], ~np.uint64(0)), np.append(values[order], 0.0)
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.edge = np.searchsorted(self.keys[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key (0: none) and whether it is there."""
        at = self.edge[keys >> self.shift]
        low = np.flatnonzero(self.keys[at] < keys)
        while len(low):
            at[low] += 1
            low = low[self.keys[at[low]] < keys[low]]
        there = self.keys[at] == keys
        return np.where(there, self.values[at], 0.0), there


@dataclass
class Bitmap:
    """Two bits for each of a set of keys, in the block of their code: a key without them is not in the set."""

    bits: int
    words: np.ndarray

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in places(keys, self.bits):
            out &= (self.words[at >> np.int64(6)] >> (at & np.int64(63)).astype(np.uint64)) & np.uint64(1) != 0
        return out


def blocks(spreads: np.ndarray, bits: int) -> np.ndarray:
    return (spreads >> np.uint64(64 - (bits.bit_length() - 10))).astype(np.int64)


def places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    block, inner = blocks(spread(keys), bits) << np.int64(9), keys.view(np.uint64)
    return [block | (x & np.uint64(511)).astype(np.int64) for x in (inner, inner >> np.uint64(9))]


def bitmap(rows: DataFrame, n: int, slice_bits: int, tasks: int) -> Bitmap:
    """Of the n keys in column a of packed rows."""
    bits = min(MOST_BITS, 1 << max(10, (n * BITS_EACH).bit_length()))

    def run(batches):
        own: dict[int, list[bytes]] = {}
        for batch in batches:
            for k, a in zip(batch.column("slice").to_pylist(), batch.column("a").to_pylist(), strict=True):
                own.setdefault(k, []).append(a)
        for k, parts in own.items():
            low, high = blocks(np.array([k << (64 - slice_bits), ((k + 1) << (64 - slice_bits)) - 1], np.uint64), bits).tolist()
            made = np.zeros((high - low + 1) * 512, bool)
            for at in places(np.frombuffer(b"".join(parts), np.int64), bits):
                made[at - (low << 9)] = True
            yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([np.packbits(made, bitorder="little").tobytes()], pa.binary())], ["low", "made"])

    words = np.zeros(bits // 64, np.uint64)
    got = rows.select("slice", "a").repartition(tasks, "slice").mapInArrow(run, "low long, made binary").toArrow()
    for low, made in zip(got.column("low").to_pylist(), got.column("made"), strict=True):
        part = np.frombuffer(made.as_buffer(), np.uint64)
        words[low * 8 : low * 8 + len(part)] |= part
    return Bitmap(bits, words)


@dataclass
class Chunk:
    """Some texts of a batch: the hash of each token, one text after the other, each with its end."""

    hashes: np.ndarray
    starts: np.ndarray

    def steps(self):
        """For each depth the code of the symbols before each token, that of one symbol less with the token (at first the token),
        and that of all these with the token; -1 if there are fewer."""
        before = np.empty_like(self.hashes)
        before[1:] = self.hashes[:-1]
        before[self.starts] = START
        codes, parents = fold(np.zeros(len(before), np.int64), before), self.hashes.view(np.int64)
        for _ in range(DEPTH):
            grams = np.where(codes >= 0, fold(codes, parents), -1)
            yield codes, parents, grams
            codes, parents = np.empty_like(grams), grams
            codes[1:] = grams[:-1]
            codes[self.starts] = -1

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts)

    def row(self, tokens: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, tokens, "right") - 1


SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: A number for each byte, the same for upper and lower case, 0 for white space.
BYTE = np.where(SPACE, np.uint64(0), mix64(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
_R = 0xD1342543DE82EF95
POWERS, INVERSE = (np.multiply.accumulate(np.append(np.uint64(1), np.full(HASH_BYTES + MEMO_BYTES, x, np.uint64))) for x in (_R, pow(_R, -1, 1 << 64)))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words in bytes; those of up to MEMO_BYTES are a sum over powers of an odd number, mixed."""
    out = np.empty(len(starts), np.uint64)
    long = ends - starts > MEMO_BYTES
    done = 0
    while done < len(starts):
        low = starts[done]
        end = max(done + 1, int(np.searchsorted(starts, low + HASH_BYTES)))
        some = slice(done, end)
        part = data[low : min(ends[end - 1], starts[end - 1] + MEMO_BYTES)]
        sums = np.add.reduceat(BYTE[part] * POWERS[: len(part)], starts[some] - low)
        out[some] = mix64(sums * INVERSE[starts[some] - low] + (ends[some] - starts[some]).astype(np.uint64))
        done = end
    for k in np.flatnonzero(long):
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes().lower())
    return out


def chunks(batch):
    """The texts of a batch in chunks of bounded size (a single longer text is a chunk)."""
    column = batch.column("text")
    if column.null_count:
        column = column.fill_null(b"")
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(edges, edges[low] + CHUNK_BYTES, "right")) - 1)
        yield hashed(data[edges[low] : edges[high]], edges[low : high + 1] - edges[low])
        low = high


def hashed(data: np.ndarray, edges: np.ndarray) -> Chunk:
    space = SPACE[data]
    is_start, is_end = ~space, ~space
    is_start[1:] &= space[:-1]
    is_end[:-1] &= space[1:]
    inner = edges[:-1][edges[:-1] < len(data)]
    is_start[inner] = ~space[inner]
    inner = edges[1:][edges[1:] > 0] - 1
    is_end[inner] = ~space[inner]
    starts, ends = np.flatnonzero(is_start), np.flatnonzero(is_end) + 1
    del is_start, is_end, space
    before = np.searchsorted(starts, edges)
    out = np.full(len(starts) + len(edges) - 1, END, np.uint64)
    out[np.arange(len(starts)) + np.repeat(np.arange(len(edges) - 1), np.diff(before))] = word_hashes(data, starts, ends)
    return Chunk(out, before[:-1] + np.arange(len(edges) - 1))


def packed(kind: int, slices: np.ndarray, **columns: np.ndarray) -> dict:
    """Packed rows of columns that are sorted by slice."""
    first = firsts(slices)
    sides = list(zip(first.tolist(), np.append(first, len(slices))[1:].tolist(), strict=True))
    none = [None] * len(first)
    return {"slice": slices[first].astype(np.int32), "kind": np.full(len(first), kind, np.int8)} | {k: [columns[k][i:j].tobytes() for i, j in sides] if k in columns else none for k in "abcd"}


def dealt(kind: int, slice_bits: int, keys: np.ndarray, **columns: np.ndarray) -> dict:
    slices = spread(keys) >> np.uint64(64 - slice_bits)
    order = np.argsort(slices, kind="stable")
    return packed(kind, slices[order], **{k: x[order] for k, x in columns.items()})


def record_batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns["slice"], pa.int32()), pa.array(columns["kind"], pa.int8()), *(pa.array(columns[k], pa.binary()) for k in "abcd")], ["slice", "kind", *"abcd"])


def unpacked(batch, kind: int, *types) -> list[np.ndarray]:
    """The columns of the packed rows of a kind, end to end."""
    some = pa.array(np.flatnonzero(batch.column("kind").to_numpy() == kind))
    return [np.frombuffer(b"".join(batch.column(k).take(some).to_pylist()), t) for k, t in zip("abcd", types, strict=False)]


def joined(parts: list[list[np.ndarray]], *types) -> list[np.ndarray]:
    return [np.concatenate([np.zeros(0, t), *(p[k] for p in parts)]) for k, t in enumerate(types)]


def stored(df: DataFrame, *by: str) -> str:
    """The path of a table as Parquet in the shared checkpoint folder, parted by columns."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tree-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return path


def dropped(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def freed(spark: SparkSession) -> None:
    """release, once the JVM has heard which tables Python let go of: a thread of its own tells it. Spark holds the last query
    until another has run."""
    gc.collect()
    time.sleep(0.5)
    release(spark)


def find(table_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table_):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table_, keys), len(table_) - 1)
    return at, table_[at] == keys


def firsts(values: np.ndarray) -> np.ndarray:
    """Where sorted values differ from those before."""
    return np.flatnonzero(np.append(np.ones(min(len(values), 1), bool), values[1:] != values[:-1]))


def numbers(df: DataFrame) -> list[np.ndarray]:
    got = df.toArrow()
    return [got.column(c).to_numpy() for c in df.columns]


def word_counts(training: DataFrame) -> DataFrame:
    """word (hash), n: counts of all training tokens."""

    def run(batch):
        word, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(c.hashes for c in chunks(batch))]), return_counts=True)
        return {"word": word.view(np.int64), "n": n}

    return map_batches(doc_input(training), run, "word long, n long", rows=0).groupBy("word").agg(F.sum("n").alias("n"))


def gram_counts(training: DataFrame, depth: int, frequent: Bitmap | None, slice_bits: int) -> DataFrame:
    """Packed context, parent, n of the texts' chunks, dealt by the parent; only contexts that the bitmap lets pass (None: all)."""
    shared = training.sparkSession.sparkContext.broadcast(frequent)
    top = np.uint64(64 - slice_bits)

    def run(batch):
        for chunk in chunks(batch):
            context, parent, gram = next(itertools.islice(chunk.steps(), depth - 1, None))
            some = np.flatnonzero(context >= 0)
            if shared.value is not None:
                some = some[shared.value.has(context[some])]
            gram, parent = gram[some], parent[some]
            key = ((spread(parent) >> top) << top) | (gram.view(np.uint64) >> np.uint64(slice_bits - 1))
            order = np.argsort(key)
            first = firsts(gram[order])
            at, n = order[first], np.diff(np.append(first, len(order))).astype(np.int32)
            by_parent = np.argsort(spread(parent[at]))  # by slice too; runs of a parent compress well
            at, n = at[by_parent], n[by_parent]
            yield packed(GRAMS, key[at] >> top, a=context[some[at]], b=parent[at], c=n)

    return map_batches(doc_input(training), run, PACKED, rows=0)


def added(context: np.ndarray, parent: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Counts of the same gram added up: context, parent, n."""
    gram = fold(context, parent)
    order = np.argsort(gram)
    first = firsts(gram[order])
    at = order[first]
    return [context[at], parent[at], np.add.reduceat(n[order].astype(np.int64), first) if len(first) else n.astype(np.int64)]


def counted(slice_bits: int):
    """From gram_counts and code, log_p of the entries one symbol shorter: packed context, code, n, log_p of the shorter entry, of
    what was counted LEAST times, dealt by context."""

    def run(batches):
        grams, shorter, size = [], [], 0
        for batch in batches:
            got = unpacked(batch, GRAMS, np.int64, np.int64, np.int32)
            shorter.append(unpacked(batch, TABLE, np.int64, np.float64))
            grams.append(got)
            size += len(got[0])
            if size > GATHERED and len(grams) > 1:
                grams = [added(*joined(grams, np.int64, np.int64, np.int64))]
                size = len(grams[0][0]) // 2
        context, parent, n = added(*joined(grams, np.int64, np.int64, np.int64))
        del grams
        codes, log_p = joined(shorter, np.int64, np.float64)
        order = np.argsort(codes)
        codes, log_p = codes[order], log_p[order]
        often = np.flatnonzero(n >= LEAST)
        context, parent, n = context[often], parent[often], n[often]
        order = np.argsort(parent)
        at, there = find(codes, parent[order])
        order, at = order[there], at[there]
        if len(order):
            yield record_batch(dealt(GRAMS, slice_bits, context[order], a=context[order], b=fold(context[order], parent[order]), c=n[order], d=log_p[at]))

    return run


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(n) * 8).astype(np.int16)


def grown(depth: int, slice_bits: int):
    """From counted and context, total: what passes the divergence test, dealt by code, as TREE + depth: key, value, size class.
    Keys are -1 - code of states and codes of their entries. And, for the next depth, all entries as GRAMS: code, log_p, n; and
    contexts that are frequent enough as TABLE: code, n."""

    def run(batches):
        entries, contexts = [], []
        for batch in batches:
            entries.append(unpacked(batch, GRAMS, np.int64, np.int64, np.int64, np.float64))
            contexts.append(unpacked(batch, TABLE, np.int64, np.int64))
        context, code, n, below = joined(entries, np.int64, np.int64, np.int64, np.float64)
        known, total = joined(contexts, np.int64, np.int64)
        order = np.argsort(known)
        known, total = known[order], total[order]
        order = np.argsort(context)
        at, there = find(known, context[order])
        order, at = order[there], at[there]
        if not len(order):
            return
        context, code, n, below = context[order], code[order], n[order], below[order]
        first = firsts(context)
        kinds, explicit, total = np.diff(np.append(first, len(context))), np.add.reduceat(n, first), total[at[first]]
        left = np.maximum((total - explicit + DISCOUNT * kinds) / total, 1e-12)
        of = np.repeat(np.arange(len(first)), kinds)
        p = (n - DISCOUNT) / total[of] + left[of] * 10.0**below
        gain = np.add.reduceat(n * (np.log(p) - below * math.log(10)), first) + (total - explicit) * np.log(left)
        state = gain > 0.5 * np.log(total + 1) * (kinds + 1)
        states, told = np.flatnonzero(state), np.flatnonzero(state[of])
        log_left, log_p = np.log10(left), np.log10(p)
        key = np.concatenate([-1 - context[first[states]], code[told]])
        value = np.concatenate([log_left[states], log_p[told] - below[told] - log_left[of[told]]])
        if len(key):
            yield record_batch(dealt(TREE + depth, slice_bits, key, a=key, b=value, c=size_class(np.concatenate([total[states], n[told]]))))
        if depth < DEPTH:
            yield record_batch(dealt(GRAMS, slice_bits, code, a=code, b=np.where(state[of], log_p, below)))
            often = np.flatnonzero(n >= max(4, CONTEXT * LEAST))
            if len(often):
                yield record_batch(dealt(TABLE, slice_bits, code[often], a=code[often], b=n[often]))

    return run


def word_keys(words: np.ndarray) -> np.ndarray:
    return fold(np.full(len(words), WORD), words)


def learn(training: DataFrame, counts: DataFrame) -> Tree:
    """counts: word_counts(training), materialised."""
    spark = training.sparkSession
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // TASK_TOKENS + 1)
    slice_bits = min(SLICES * tasks, n // SLICE_TOKENS + 1).bit_length()
    end = int(END.astype(np.int64))
    is_known = (F.col("n") >= max(LEAST, math.ceil(n * KNOWN_SHARE))) | (F.col("word") == F.lit(end))  # at most 1 / KNOWN_SHARE
    words, known = numbers(counts.where(is_known))
    order = np.argsort(words.view(np.uint64))
    words, known = words.view(np.uint64)[order], known[order]
    tree = Tree(n, v, words, known, np.where((known >= LEAST) | (words == END), words.view(np.int64), RARE), slice_bits, tasks)
    rows = int(known[words == END].sum())
    freed(spark)

    def as_contexts(batch):
        code = fold(np.zeros(batch.num_rows, np.int64), batch.column("word").to_numpy())
        return dealt(TABLE, slice_bits, code, a=code, b=batch.column("n").to_numpy())

    def as_symbols(batch):
        word = batch.column("word").to_numpy()
        return dealt(TABLE, slice_bits, word, a=word, b=log_base(n, v, batch.column("n").to_numpy()))

    def as_rest(batch):
        key, count = word_keys(batch.column("word").to_numpy()), batch.column("n").to_numpy()
        return dealt(WORDS, slice_bits, key, a=key, b=log_base(n, v, count) - log_base(n, v, np.zeros(1)))

    begin = spark.createDataFrame([(int(START.astype(np.int64)), rows)] if rows else [], "word long, n long")
    often, is_end = F.col("n") >= LEAST, F.col("word") == F.lit(end)
    contexts = map_batches(counts.where(often & ~is_end).unionByName(begin), as_contexts, PACKED, rows=0)
    shorter = map_batches(counts.where(often | is_end), as_symbols, PACKED, rows=0)
    frequent, parts, done = None, [], []
    for depth in range(1, DEPTH + 1):
        made = gram_counts(training, depth, frequent, slice_bits).unionByName(shorter).repartition(tasks, "slice").mapInArrow(counted(slice_bits), PACKED)
        path = stored(made.unionByName(contexts).repartition(tasks, "slice").mapInArrow(grown(depth, slice_bits), PACKED), "kind")
        for x in done:
            dropped(spark, x)
        done = [f"{path}/kind={k}" for k in (GRAMS, TABLE)]
        tree.paths.append(path)
        whole = spark.read.schema(PACKED).parquet(path)
        parts.append(whole.where(F.col("kind") == TREE + depth))
        contexts, shorter = whole.where(F.col("kind") == TABLE), whole.where(F.col("kind") == GRAMS).withColumn("kind", F.lit(TABLE).cast("byte"))
        n_often = contexts.agg(F.coalesce(F.sum(F.length("a")), F.lit(0))).first()[0] // 8
        freed(spark)
        if depth == DEPTH or not n_often:
            break
        frequent = bitmap(contexts, n_often, slice_bits, tasks)
    for x in done:
        dropped(spark, x)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)

    def classes(batch):
        k, rows = np.unique(np.frombuffer(b"".join(batch.column("c").to_pylist()), np.int16), return_counts=True)
        return {"k": k, "rows": rows}

    least, n_rest, room = 1 << 14, 0, HEAD_ROWS  # no size class is as large
    for k, rows in sorted(map_batches(whole, classes, "k int, rows long", rows=0).groupBy("k").agg(F.sum("rows")).collect(), reverse=True):
        room -= rows
        if room < 0:
            n_rest += rows
        else:
            least = k

    def in_head(batch):
        for depth in range(1, DEPTH + 1):
            key, value, k = unpacked(batch, TREE + depth, np.int64, np.float64, np.int16)
            yield {"depth": [depth], "key": [key[k >= least].tobytes()], "value": [value[k >= least].tobytes()]}

    def in_rest(batch):
        rows = [(k, *(np.frombuffer(x, t) for x, t in zip(r, (np.int64, np.float64, np.int16), strict=True))) for k, *r in zip(*(batch.column(c).to_pylist() for c in ("slice", "a", "b", "c")), strict=True)]
        rows = [(k, key[size < least], value[size < least]) for k, key, value, size in rows]
        rows = [(k, key.tobytes(), value.tobytes()) for k, key, value in rows if len(key)]
        return {"slice": [k for k, _, _ in rows], "kind": [TREE] * len(rows), "a": [a for _, a, _ in rows], "b": [b for _, _, b in rows]} | {c: [None] * len(rows) for c in "cd"}

    head = map_batches(whole, in_head, "depth int, key binary, value binary", rows=0).toArrow()  # at most HEAD_ROWS
    for depth in range(1, DEPTH + 1):
        some = head.filter(pa.compute.equal(head.column("depth"), depth))
        key, value = (np.frombuffer(b"".join(some.column(c).to_pylist()), t) for c, t in (("key", np.int64), ("value", np.float64)))
        order = np.argsort(key)
        key, value = key[order], value[order]
        edge = np.searchsorted(key, 0)
        tree.levels.append(Level(-1 - key[:edge][::-1], value[:edge][::-1], key[edge:], value[edge:]))
    rest = map_batches(whole, in_rest, PACKED, rows=0)
    tree.bitmap = bitmap(rest, n_rest, slice_bits, tasks)
    tree.rest = rest.unionByName(map_batches(counts.where(~is_known), as_rest, PACKED, rows=0))
    freed(spark)
    return tree


def log_none(tree: Tree) -> float:
    return float(tree.log_base(np.zeros(1))[0])


def broadcast(spark: SparkSession, tree: Tree):
    """The head of the tree, the known words and the bitmap of the rest, for scored."""
    keys, values = (np.concatenate([np.zeros(0, t), *(y for x in tree.levels for y in x_of(x))]) for t, x_of in ((np.int64, lambda x: (-1 - x.contexts, x.entries)), (np.float64, lambda x: (x.log_left, x.adds))))
    return spark.sparkContext.broadcast((Index(keys.view(np.uint64), values), Index(tree.words, tree.log_base(tree.counts)), tree.bitmap))


def scored(docs: DataFrame, tree: Tree, shared, kind: str) -> DataFrame:
    """What the broadcast part of the tree and the known words say of each text, as DOCS; and packed keys and rows of what is left
    to look up: its other words as ASK_WORDS, and as ASK the states and entries that the rest of the tree may have. part and row
    tell texts apart."""
    none, slice_bits, done = log_none(tree), tree.slice_bits, [0]
    names = ["part", "row", "doc_id", "n_tokens", "n_known", "base", "score"]

    def run(batch):
        head, words, rest = shared.value
        part = TaskContext.get().partitionId()

        def asked(number, key, row):
            made = dealt(number, slice_bits, key, a=key, b=row.astype(np.int32))
            n = len(made["slice"])
            return made | {k: [None] * n for k in names} | {"part": [part] * n}

        at = 0
        for chunk in chunks(batch):
            n, first = len(chunk.starts), done[0]
            base, known = words.find(chunk.hashes)
            score, ask = base + np.where(known, 0.0, none), []
            sums = {"n_tokens": chunk.sums(np.ones(len(base), np.int64)), "n_known": chunk.sums(known.astype(np.int64)), "base": chunk.sums(score)}
            others = np.flatnonzero(~known)
            yield asked(ASK_WORDS, word_keys(chunk.hashes[others]), first + chunk.row(others))
            for codes, _, grams in chunk.steps():
                some = np.flatnonzero(codes >= 0)
                for key in (-1 - codes[some], grams[some]):
                    value, there = head.find(key.view(np.uint64))
                    score[some] += value
                    missing = np.flatnonzero(~there)
                    missing = missing[rest.has(key[missing])]
                    ask.append((key[missing], some[missing]))
            key, token = (np.concatenate(x) for x in zip(*ask, strict=True))
            yield asked(ASK, key, first + chunk.row(token))
            yield {"slice": [part % (1 << slice_bits)] * n, "kind": [DOCS] * n, "part": [part] * n, "row": range(first, first + n), "doc_id": batch.column("doc_id").slice(at, n), "score": chunk.sums(score)} | {k: [None] * n for k in "abcd"} | sums
            at, done[0] = at + n, first + n

    return map_batches(doc_input(docs), run, f"{PACKED}, part int, row int, doc_id {kind}, n_tokens long, n_known long, base double, score double")


OF_DOCS = ["doc_id", "row", "n_tokens", "n_known", "base", "score"]


def looked_up(batches):
    """Per part the rows and values of what was asked for and is there, packed; texts go through."""
    tables, asked, doc_type = {TREE: [], WORDS: []}, {ASK: [], ASK_WORDS: []}, None
    for batch in batches:
        kinds, doc_type = batch.column("kind").to_numpy(), batch.schema.field("doc_id").type
        docs = batch.take(pa.array(np.flatnonzero(kinds == DOCS)))
        if docs.num_rows:
            yield pa.RecordBatch.from_arrays([docs.column("part"), docs.column("kind"), *(docs.column(k) for k in ("a", "b", *OF_DOCS))], ["part", "kind", "a", "b", *OF_DOCS])
        for kind, parts in tables.items():
            parts.append(unpacked(batch, kind, np.int64, np.float64))
        for kind, parts in asked.items():
            some = batch.filter(pa.array(kinds == kind)).select(["part", "a"])
            part = np.repeat(some.column("part").to_numpy(zero_copy_only=False).astype(np.int32), [len(x) // 8 for x in some.column("a").to_pylist()])
            parts.append([*unpacked(batch, kind, np.int64, np.int32), part])
    for kind, of in ((ASK, TREE), (ASK_WORDS, WORDS)):
        key, value = joined(tables.pop(of), np.int64, np.float64)
        order = np.argsort(key)
        key, value = key[order], value[order]
        sought, row, part = joined(asked.pop(kind), np.int64, np.int32, np.int32)
        order = np.argsort(sought)
        at, there = find(key, sought[order])
        order, at = order[there], at[there]
        by_part = np.argsort(part[order], kind="stable")
        order, at = order[by_part], at[by_part]
        if len(order):
            made = packed(kind, part[order], a=row[order], b=np.rint(value[at] / UNIT).astype(np.int64))
            n = len(made["kind"])
            none = [pa.nulls(n, t) for t in (doc_type, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(made["slice"]), pa.array(made["kind"]), pa.array(made["a"], pa.binary()), pa.array(made["b"], pa.binary()), *none], ["part", "kind", "a", "b", *OF_DOCS])


def summed(batches):
    """The texts with the values that were looked up for them."""
    docs, asked = [], {ASK: [], ASK_WORDS: []}
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        docs.append(batch.take(pa.array(np.flatnonzero(kinds == DOCS))))
        for kind, parts in asked.items():
            some = batch.filter(pa.array(kinds == kind)).select(["part", "a"])
            part = np.repeat(some.column("part").to_numpy(zero_copy_only=False).astype(np.int64), [len(x) // 4 for x in some.column("a").to_pylist()])
            row, value = unpacked(batch, kind, np.int32, np.int64)
            parts.append([part << 32 | row, value])
    if not sum(x.num_rows for x in docs):
        return
    table_ = pa.Table.from_batches(docs).combine_chunks()
    ids = table_.column("part").to_numpy().astype(np.int64) << 32 | table_.column("row").to_numpy()
    order = np.argsort(ids)
    table_, ids = table_.take(pa.array(order)), ids[order]
    found, sums = np.zeros(len(ids), np.int64), {}
    for kind, parts in asked.items():
        own, value = joined(parts, np.int64, np.int64)
        at = np.searchsorted(ids, own)
        sums[kind] = np.zeros(len(ids), np.int64)
        np.add.at(sums[kind], at, value)
        if kind == ASK_WORDS:
            np.add.at(found, at, 1)
    of_words = sums[ASK_WORDS] * UNIT
    columns = [table_.column("doc_id"), table_.column("n_tokens"), pa.array(table_.column("n_known").to_numpy() + found), pa.array(table_.column("base").to_numpy() + of_words), pa.array(table_.column("score").to_numpy() + of_words + sums[ASK] * UNIT)]
    yield from pa.table(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score"]).to_batches(max_chunksize=10_000)


def score_documents(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score; the tree learns from the rows where training holds."""
    spark, learnt = docs.sparkSession, docs.where(training)
    tree = learn(learnt, cut(word_counts(learnt)))
    shared, kind = broadcast(spark, tree), dict(docs.dtypes)["doc_id"]
    of_docs = f"doc_id {kind}, row int, n_tokens long, n_known long, base double, score double"
    schema = f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double"
    rest, paths = tree.rest.withColumn("part", F.lit(-1)), []
    parts = PARTS if tree.n > PART_TOKENS else 1
    for k in range(parts):
        own = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) == k) if parts > 1 else docs
        made = scored(own, tree, shared, kind).unionByName(rest, allowMissingColumns=True)
        made = made.repartition(tree.tasks, "slice").mapInArrow(looked_up, f"part int, kind byte, a binary, b binary, {of_docs}")
        paths.append(stored(made.repartition(tree.tasks, "part").mapInArrow(summed, schema)))
        if parts > 1:
            spark.range(1).collect()
            freed(spark)
    for path in tree.paths:
        dropped(spark, path)
    done = spark.read.schema(schema).parquet(*paths)
    return done.select("doc_id", "n_tokens", "n_known", F.lit(tree.n).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = score_documents(table(spark, sf_dir, "documents"), ~held_out(5))
    return done.select("doc_id", held_out(5).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
