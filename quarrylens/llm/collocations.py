"""Phrase collocations of each language, mined over dictionary-encoded words.

1. Words are counted by language. Those of `least` occurrences or more are the dictionary; a word's id is the 56-bit hash of
   language and word (checked to be unique in the dictionary), so that a task needs no copy of the dictionary, but a bitmap of it,
   of bounded size. A word that the bitmap does not know breaks a piece; one that it passes wrongly only makes phrases that are
   too rare to count.
2. Pairs of ids are radix-sorted and merged by each task, `HELD` windows at a time; what follows one word is one row of packed ids
   and counts, so that a pair takes 8 bytes. Rows are partitioned by a leading digit of the word, sorted, merged and counted.
3. Windows of up to `longest` ids, cut before the first pair that is not frequent, are packed into binary keys of fixed width,
   partitioned by ranges of the key's leading digit, sorted and run-length counted, with zeros behind their end. In
   sorted order all windows that begin with a phrase follow each other, so one pass counts the phrases of every length.
4. Counts join back by key for the cuts of each phrase, for longer phrases that make it redundant, and for the words of its ids.

Defined results: a null or empty text has no words; a null lang is `und`; repeated rows count each; doc_id is not used; ties go to
the smallest cut, and in the ranking to the greater count, then the phrase by its bytes; a very long text is read in parts and
counted whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrylens.llm.common import BROADCAST_ROWS, WordHashes, cut, mix64, release, small, table

LONGEST, LEAST, TOP, PERCENT = 5, 100, 2000, 100
#: Bits of a bitmap for each key, and at most (32 MB).
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Keys that a task holds before it merges equal ones; words that it counts before it lets them go; bytes of a text read at a time.
HELD, WORDS_HELD, PART_BYTES = 1 << 20, 200_000, 1 << 20
SALTS = 16
#: A word with more than one in so many occurrences is hot: its keys are dealt to 2 ** HOT_BITS ranges.
HOT_WORDS, HOT_BITS = 2000, 6
SEEDS = 16
#: Bytes of an id that are not 0, and a count that is told apart from smaller ones, which take a byte.
ID_BYTES, MANY = 7, 255

#: Lower case; what ends a piece becomes a dot, and a tab a space.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\x0a\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz......... ")
_M = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, part by part; a word of one dot ends a piece."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PART_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].translate(_TABLE).replace(b".", b" . ").split()
        at = end


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            yield lang.as_py(), text.as_py() or b""


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def lang_salt(lang: str, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode(), seed=seed)


def ids_of(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Ids of words by their hash and language: the first ID_BYTES bytes tell them apart; 0, which ends a piece, stays 0."""
    return np.where(hashes == 0, np.uint64(0), np.maximum(mix64(hashes ^ np.uint64(salt)) & ~np.uint64(255), np.uint64(256)))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word (binary), n; word is null for the number of all words of a language."""

    def run(batches):
        held: dict[str, Counter] = {}

        def rows():
            for lang, counts in held.items():
                counts.pop(b".", None)
                n = sum(counts.values())
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(counts) + 1)), pa.array([*counts, None], pa.binary()), pa.array([*counts.values(), n], pa.int64())], ["lang", "word", "n"])
            held.clear()

        for lang, text in _texts(batches):
            for words in words_of(text):
                held.setdefault(lang, Counter()).update(words)
            if sum(map(len, held.values())) > WORDS_HELD:
                yield from rows()
        yield from rows()

    return _input(docs).mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Bits:
    """A bitmap of 64-bit keys."""

    def __init__(self, size: int):
        self.shift, self.words = np.uint64(64 - (size.bit_length() - 1)), np.zeros(size // 64, np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> self.shift
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap(keys: DataFrame, n: int, most: int = MOST_BITS) -> Bits:
    """Of n keys in column key (long): the JVM merges them into words of 64 bits, of which there are at most MOST_BITS / 64."""
    made = Bits(min(most, 1 << max(10, (n * BITS_EACH).bit_length())))
    at = F.shiftrightunsigned(F.col("key"), int(made.shift))
    got = keys.select((F.shiftright(at, 6)).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {int(made.shift)}) & 63 AS int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    made.words[got.column("at").to_numpy()] = got.column("bit").to_numpy().view(np.uint64)
    return made


def dictionary(counts: DataFrame, least: int = LEAST) -> tuple[DataFrame, int]:
    """lang, word, n, id of each word of `least` occurrences or more, and the seed with which their ids differ."""
    frequent = counts.where((F.col("n") >= least) & F.col("word").isNotNull())
    for seed in range(SEEDS):

        def run(batches, seed=seed):
            for batch in batches:
                langs, words = batch.column("lang").to_pylist(), batch.column("word").to_pylist()
                salts = {lang: lang_salt(lang, seed) for lang in set(langs)}
                ids = [int(ids_of(np.array([xxhash.xxh3_64_intdigest(w)], np.uint64), salts[lang]).view(np.int64)[0]) for lang, w in zip(langs, words, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(ids, pa.int64())], ["lang", "word", "n", "id"])

        made = cut(frequent.mapInArrow(run, "lang string, word binary, n long, id long"))
        if made.groupBy("id").count().where("count > 1").isEmpty():
            return made, seed
    raise RuntimeError("two words of the dictionary have one hash")


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of rows of big-endian numbers of 64 bits: a stable sort by each 16-bit digit, the last first."""
    digits = keys.view(">u2").reshape(len(keys), 4 * keys.shape[1]).astype(np.uint16)
    order = np.arange(len(keys))
    for k in range(digits.shape[1] - 1, -1, -1):
        digit = digits[:, k]
        if digit.any():
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def merged(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ids to keys (big-endian bytes) that differ, sorted, and how often each is there."""
    keys = np.ascontiguousarray(ids.astype(">u8"))
    keys = keys[radix_order(keys)]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * _M + b)


def windows(ids: np.ndarray, n: int, width: int, pairs: Bits | None) -> np.ndarray:
    """A row of up to `width` ids for each of the first n places; zeros behind an end of a piece or (pairs given) before a pair
    that is too rare. Only rows that tell something: of two ids, or with pairs of three."""
    padded = np.append(ids, np.zeros(width, np.uint64))
    rows = np.zeros((n, width), np.uint64)
    rows[:, 0] = ids[:n]
    goes_on = ids[:n] != 0
    for k in range(1, width):
        after = padded[k : k + n]
        goes_on = goes_on & (after != 0)
        if pairs is not None:
            goes_on = goes_on & pairs.has(pair_hash(padded[k - 1 : k - 1 + n], after))
        rows[:, k] = np.where(goes_on, after, np.uint64(0))
    return rows[rows[:, 1 if pairs is None else 2] != 0]


def places_in(starts: np.ndarray, sizes: np.ndarray, step: int) -> np.ndarray:
    """starts, starts + step, ...: so many places for each row."""
    return np.repeat(starts - step * (np.cumsum(sizes) - sizes), sizes) + step * np.arange(sizes.sum())


def grouped_pairs(digit: np.ndarray, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """key (digit, first id), m, rest: for each digit and first id of sorted pairs the m second ids in ID_BYTES bytes each, how often
    each pair is there in a byte, and after them 8 bytes for each of those that are there MANY times or more."""
    first = np.flatnonzero(np.append(True, (ids[1:, 0] != ids[:-1, 0]) | (digit[1:] != digit[:-1])))
    m = np.diff(np.append(first, len(ids)))
    row, many = np.repeat(np.arange(len(first)), m), np.flatnonzero(n >= MANY)
    of_many = np.bincount(row[many], minlength=len(first))
    size = (ID_BYTES + 1) * m + 8 * of_many
    offsets = np.append(0, np.cumsum(size))
    start = offsets[:-1]
    rest = np.zeros(offsets[-1], np.uint8)
    second = np.ascontiguousarray(ids[:, 1].astype(">u8")).view(np.uint8).reshape(-1, 8)[:, :ID_BYTES]
    rest[places_in(start, m, ID_BYTES)[:, None] + np.arange(ID_BYTES)] = second
    rest[places_in(start + ID_BYTES * m, m, 1)] = np.minimum(n, MANY)
    rest[places_in(start + (ID_BYTES + 1) * m, of_many, 8)[:, None] + np.arange(8)] = np.ascontiguousarray(n[many].astype("<i8")).view(np.uint8).reshape(-1, 8)
    keys = np.concatenate([np.ascontiguousarray(digit[first].astype(">u2")).view(np.uint8).reshape(-1, 2), np.ascontiguousarray(ids[first, 0].astype(">u8")).view(np.uint8).reshape(-1, 8)], axis=1)
    binary = lambda at, data: pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data.tobytes())])
    return pa.RecordBatch.from_arrays([binary(10 * np.arange(len(first) + 1), keys), pa.array(m, pa.int32()), binary(offsets, rest)], ["key", "m", "rest"])


def ungrouped(m: np.ndarray, offsets: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Second ids and counts of rows of grouped_pairs, one row after the other."""
    start, m = offsets[:-1].astype(np.int64), m.astype(np.int64)
    ids = np.zeros((m.sum(), 8), np.uint8)
    ids[:, :ID_BYTES] = rest[places_in(start, m, ID_BYTES)[:, None] + np.arange(ID_BYTES)]
    n = rest[places_in(start + ID_BYTES * m, m, 1)].astype(np.int64)
    of_many = (np.diff(offsets) - (ID_BYTES + 1) * m) // 8
    n[n == MANY] = np.ascontiguousarray(rest[places_in(start + (ID_BYTES + 1) * m, of_many, 8)[:, None] + np.arange(8)]).view("<i8").ravel()
    return ids.view(">u8").ravel().astype(np.uint64), n


def pair_counts(packed: DataFrame, least: int = LEAST) -> DataFrame:
    """key (two ids), n of the pairs with `least` occurrences or more. packed: rows of grouped_pairs, of which many may have a key.
    A partition holds all rows of a key; of a key only the pairs that differ are held."""

    def run(batches):
        open_ = b"", np.zeros(0, np.uint64), np.zeros(0, np.int64)  # the key that may go on, its second ids and counts

        def done(keys, group, second, n):
            often = np.flatnonzero(n >= least)
            both = np.concatenate([np.frombuffer(b"".join(keys[g][2:] for g in group[often].tolist()), np.uint8).reshape(-1, 8), np.ascontiguousarray(second[often].astype(">u8")).view(np.uint8).reshape(-1, 8)], axis=1)
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in both], pa.binary()), pa.array(n[often], pa.int64())], ["key", "n"])

        for batch in batches:
            m, low = batch.column("m").to_numpy(), 0
            while low < len(m):
                high = low + max(1, int(np.searchsorted(np.cumsum(m[low:], dtype=np.int64), HELD, "right")))
                rest = batch.column("rest").slice(low, high - low)
                offsets = np.frombuffer(rest.buffers()[1], np.int32)[rest.offset : rest.offset + len(rest) + 1]
                second, n = ungrouped(m[low:high], offsets, np.frombuffer(rest.buffers()[2], np.uint8))
                keys, group = [open_[0]], []
                for key in batch.column("key").slice(low, high - low).to_pylist():
                    if key != keys[-1]:
                        keys.append(key)
                    group.append(len(keys) - 1)
                group = np.concatenate([np.zeros(len(open_[1]), np.int64), np.repeat(np.array(group), m[low:high])])
                second, n = np.concatenate([open_[1], second]), np.concatenate([open_[2], n])
                order = np.lexsort((second, group))
                group, second = group[order], second[order]
                at = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (second[1:] != second[:-1])))
                group, second, n = group[at], second[at], np.add.reduceat(n[order], at)
                last = int(np.searchsorted(group, len(keys) - 1))
                open_ = keys[-1], second[last:], n[last:]
                yield done(keys, group[:last], second[:last], n[:last])
                low = high
        yield done([open_[0]], np.zeros(len(open_[1]), np.int64), *open_[1:])

    return packed.repartition(F.substring("key", 1, 2)).sortWithinPartitions("key").mapInArrow(run, "key binary, n long")


def packed_keys(docs: DataFrame, seed: int, words: Bits, hot: np.ndarray, pairs: Bits | None, width: int) -> DataFrame:
    """Rows of grouped_pairs if no pairs are given, else key, n: keys of a task that differ, and how often each is there. A key has `width` ids of 8 bytes behind a leading digit of
    two bytes, the hash of its first id; that of a hot word also depends on the ids behind it (one, or two if pairs are given), so
    that no range is much larger than others. Keys of one word stay together and compress well."""
    shared = docs.sparkSession.sparkContext.broadcast((words, pairs, hot))  # two bitmaps of at most MOST_BITS, at most HOT_WORDS ids

    def run(batches):
        words, pairs, hot = shared.value
        memo, salts = WordHashes(), {}
        hashes: list[np.ndarray] = []  # of texts not yet packed
        salt: list[int] = []
        held: list[np.ndarray] = []  # windows not yet merged

        def pack(ends: bool):
            """Windows of all words, but for the last of a text that goes on in another part."""
            every, each = np.concatenate(hashes), np.repeat(np.array(salt, np.uint64), [len(h) for h in hashes])
            ids = ids_of(every, each)
            ids = np.where(words.has(ids), ids, np.uint64(0))
            goes_on = 0 if ends else min(width - 1, len(ids))
            hashes[:], salt[:] = [every[k : k + 1] for k in range(len(ids) - goes_on, len(ids))], each[len(ids) - goes_on :].tolist()
            for k in range(0, len(ids) - goes_on, HELD):
                held.append(windows(ids[k : k + HELD + width - 1], min(HELD, len(ids) - goes_on - k), width, pairs))

        def rows():
            ids, n = merged(np.concatenate(held))
            held.clear()
            first, rest = ids[:, 0].astype(np.uint64), ids[:, 1].astype(np.uint64)
            if pairs is not None:
                rest = pair_hash(rest, ids[:, 2].astype(np.uint64))
            is_hot = np.isin(first, hot)
            digit = mix64(first + np.where(is_hot, mix64(rest) >> np.uint64(64 - HOT_BITS), np.uint64(0)) * _M)
            if pairs is None:
                digit, order, some = digit >> np.uint64(48), np.arange(len(ids)), np.flatnonzero(is_hot)
                order[some] = some[np.lexsort((digit[some], first[some]))]  # the pairs of a word are together already
                ids, n, digit = ids[order], n[order], digit[order]
                for k in range(0, len(ids), 50_000):
                    yield grouped_pairs(digit[k : k + 50_000], ids[k : k + 50_000], n[k : k + 50_000])
                return
            keys = np.concatenate([(digit >> np.uint64(48)).astype(">u2").view(np.uint8).reshape(-1, 2), ids.view(np.uint8).reshape(len(ids), 8 * width)], axis=1)
            for k in range(0, len(keys), 50_000):
                part = np.ascontiguousarray(keys[k : k + 50_000])
                offsets = np.arange(len(part) + 1, dtype=np.int32) * keys.shape[1]
                yield pa.RecordBatch.from_arrays([pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(part.tobytes())]), pa.array(n[k : k + 50_000], pa.int64())], ["key", "n"])

        n = 0
        for lang, text in _texts(batches):
            if lang not in salts:
                salts[lang] = lang_salt(lang, seed)
            for part in words_of(text):
                memo[b"."] = 0
                hashes.append(np.fromiter(map(memo.__getitem__, part), np.uint64, len(part)))
                salt.append(salts[lang])
                n += len(part)
                if n >= HELD:
                    pack(False)
                    n = 0
                    if sum(map(len, held)) >= HELD:
                        yield from rows()
            hashes.append(np.zeros(1, np.uint64))  # ends the text's last piece
            salt.append(0)
        if hashes:
            pack(True)
        if held:
            yield from rows()

    return _input(docs).mapInArrow(run, "key binary, m int, rest binary" if pairs is None else "key binary, n long")


def run_lengths(packed: DataFrame, lengths: list[int], least: int = LEAST) -> DataFrame:
    """key (ids), n of the phrases of so many words with `least` occurrences or more. packed: key, n, where equal keys may come
    again. Ranges of the leading digit are the partitions, so a phrase that the digit is taken from lies in one of them."""

    def run(batches):
        open_: dict[int, tuple[bytes, int]] = {}  # words -> the run that may go on in the next batch: its key, n

        def done(found):
            found = [(key[2:], n) for key, n in found if n >= least and any(key[-8:])]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], ["key", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, n = batch.column("key"), batch.column("n").to_numpy()
            offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1]
            table_ = np.frombuffer(keys.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(keys), -1)
            found = []
            for words in lengths:
                part = table_[:, : 2 + 8 * words]
                starts = np.flatnonzero(np.append(True, (part[1:] != part[:-1]).any(axis=1)))
                sums = np.add.reduceat(n, starts)
                if words in open_:
                    key, before = open_[words]
                    if part[0].tobytes() == key:
                        sums[0] += before
                    else:
                        found.append((key, before))
                found += [(part[starts[k]].tobytes(), int(sums[k])) for k in np.flatnonzero(sums[:-1] >= least).tolist()]
                open_[words] = part[starts[-1]].tobytes(), int(sums[-1])
            yield done(found)
        yield done(open_.values())

    return packed.repartition(F.substring("key", 1, 2)).sortWithinPartitions("key").mapInArrow(run, "key binary, n long")


def n_words() -> Column:
    return (F.length("key") / 8).cast("int")


def part_of(at: Column, words: Column) -> Column:
    """So many ids of column key from the one at `at` (from 0)."""
    return F.substring(F.col("key"), 8 * at + 1, 8 * words)


def _looked_up(rows: DataFrame, known: DataFrame, on: str, few: bool) -> DataFrame:
    """rows with the columns of known, which has a row for each key, named as column `on` of rows; a frequent word is no hot key."""
    if few:
        return rows.join(F.broadcast(known), on)  # counted before
    spread = known.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).join(spread, [on, "_salt"]).drop("_salt")


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The dictionary (lang, word, n, id); lang, total; key, n of all phrases of 2 to `longest` words with `least` occurrences."""
    spark = docs.sparkSession
    counts = cut(word_counts(docs).where((F.col("n") >= least) | F.col("word").isNull()))
    words, seed = dictionary(counts, least)
    known = bitmap(words.select(F.col("id").alias("key")), words.count(), most_bits)
    total = counts.where("word IS NULL").agg(F.sum("n")).first()[0] or 0
    hot = words.where(F.col("n") > total // HOT_WORDS).select("id").toArrow().column("id").to_numpy().view(np.uint64)  # fewer than HOT_WORDS
    release(spark)
    pairs = cut(pair_counts(packed_keys(docs, seed, known, hot, None, 2), least))
    release(spark)
    found = [pairs]
    if longest > 2:

        def hashes(batches):
            for batch in batches:
                keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pair_hash(keys[:, 0], keys[:, 1]).view(np.int64))], ["key"])

        often = bitmap(pairs.select("key").mapInArrow(hashes, "key long"), pairs.count(), most_bits)
        found.append(cut(run_lengths(packed_keys(docs, seed, known, hot, often, longest), list(range(3, longest + 1)), least)))
    phrases = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    release(spark)
    return words, counts.where("word IS NULL").select("lang", F.col("n").alias("total")), phrases


def scored(words: DataFrame, totals: DataFrame, phrases: DataFrame, percent: int = PERCENT) -> DataFrame:
    """lang, key, a, l, r, n, score of the phrases that no longer one makes redundant, by their lowest-scoring cut."""
    one = words.select(F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("key"), "n", "lang")
    known = cut(one.unionByName(phrases.withColumn("lang", F.lit(None).cast("string"))))
    few = known.count() <= BROADCAST_ROWS
    cuts = phrases.select("key", "n", F.explode(F.sequence(F.lit(1), n_words() - 1)).alias("k"))
    sides = cuts.select("key", F.col("n").alias("a"), "k", part_of(F.lit(0), F.col("k")).alias("left"), part_of(F.col("k"), n_words() - F.col("k")).alias("right"))
    left = _looked_up(sides, known.select(F.col("key").alias("left"), F.col("n").alias("l"), "lang"), "left", few)
    both = _looked_up(left, known.select(F.col("key").alias("right"), F.col("n").alias("r")), "right", few)
    each = both.groupBy("key").agg(F.max("a").alias("a"), F.max("lang").alias("lang"), F.collect_list(F.struct("k", "l", "r")).alias("cuts"))
    inside = phrases.where(n_words() > 2).select("key", "n", F.explode(F.sequence(F.lit(2), n_words() - 1)).alias("m")).select("*", F.explode(F.sequence(F.lit(0), n_words() - F.col("m"))).alias("at"))
    longer = inside.groupBy(part_of(F.col("at"), F.col("m")).alias("key")).agg(F.max("n").alias("longer"))
    kept = each.join(longer, "key", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).join(small(totals), "lang")
    wide = "decimal(18,0)"  # of 38 digits in all, a product takes 36
    score = f"((cast(1000 * a AS {wide}) * cast(total AS {wide})) div (cast(c.l AS {wide}) * cast(c.r AS {wide})))"
    least_cut = F.array_min(F.expr(f"transform(cuts, c -> named_struct('score', {score}, 'k', c.k, 'l', c.l, 'r', c.r))"))
    return kept.select("lang", "key", "a", F.col("total").alias("n"), least_cut.alias("c")).select("lang", "key", "a", "c.l", "c.r", "n", "c.score")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, percent: int = PERCENT, most_bits: int = MOST_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language."""
    words, totals, phrases = frequent_phrases(docs, longest, least, most_bits)
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = cut(scored(words, totals, phrases, percent).withColumn("rank", F.rank().over(best)).where(F.col("rank") <= top))
    ids = first.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), n_words() - 1), lambda k: part_of(k, F.lit(1)))).alias("at", "id"))
    named = ids.join(words.select(F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("id"), "word"), "id")
    spelled = named.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda w: w.word.cast("string")), " ").alias("phrase"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase").cast("binary"))
    ranked = first.drop("rank").join(spelled, "key").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def oracle(longest: int = LONGEST, least: int = LEAST, top: int = TOP, percent: int = PERCENT) -> str:
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS m, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces WHERE len(w) >= {k})" for k in range(1, longest + 1))
    upper = "".join(map(chr, range(65, 91)))
    return f"""
WITH split AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM split),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
counts AS (SELECT lang, m, phrase, count(*) AS a FROM ({grams}) GROUP BY ALL HAVING count(*) >= {least}),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE m >= 2),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)),
scores AS (SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, n, ((1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = lp JOIN counts r ON r.lang = c.lang AND r.phrase = rp JOIN totals t ON t.lang = c.lang),
least AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, a FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM candidates))),
redundant AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, encode(s.phrase)) AS rank, s.phrase, a, l, r, n::BIGINT AS n, score
FROM least s LEFT JOIN redundant d ON d.lang = s.lang AND d.phrase = s.phrase WHERE longer IS NULL OR 100 * longer < {percent} * a
QUALIFY rank <= {top}
"""
