"""Language identification by language-bitmask n-gram filters.

Each language's training texts give 4-byte n-grams of its letters. A bit-sliced Bloom filter holds one bit mask in each slot,
a bit a language: the AND of an n-gram's slots is the set of all languages that contain it. A text is decided by the number
of its n-grams that each language contains (a popcount), corrected for the share of false positives that the fill of the
language's slice predicts.

A language's filter takes the n-grams that make up at least `LEAST_SHARE` of its n-grams (so at most 1 / LEAST_SHARE of them,
a proven bound on what is broadcast) and that are not `RARER` times rarer than in the language where they are commonest.

Defined results: a text that is null or has no letter is `und` with score 0; ties go to the language that comes first by code
point; a text that matches nothing takes the language with the most training n-grams, with score 0; without any training text
all are `und`; equal rows have equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrylens.llm.common import doc_input, map_batches, mix64, table, texts

LEAST_SHARE = 1e-6
RARER = 5.0
HASHES = 3
SLOTS_PER_NGRAM = 16
#: A-Z to a-z, other ASCII but letters to a space.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
ANY_LETTER = re.compile(r"[^\W\d_]")


def ngrams(text: bytes) -> np.ndarray:
    """The 4-byte n-grams of the words, each padded by one space, as numbers."""
    a = np.frombuffer(b" " + b" ".join(text.translate(LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    return (a[:-3] << 24) | (a[1:-2] << 16) | (a[2:-1] << 8) | a[3:] if len(a) > 3 else a[:0]


def ngram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of docs (lang not null)."""

    def run(batch):
        langs, by = batch.column("lang").to_pylist(), {}
        for lang, text in zip(langs, texts(batch), strict=True):
            by.setdefault(lang, []).append(ngrams(text))
        for lang, parts in by.items():
            grams, n = np.unique(np.concatenate(parts), return_counts=True)
            yield {"lang": [lang] * len(grams), "gram": grams.astype(np.int64), "n": n}

    return map_batches(doc_input(docs, "lang"), run, "lang string, gram long, n long", rows=0).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """Bit-sliced Bloom filters; planes of up to 64 languages."""

    def __init__(self, langs: list[str], weights: dict[str, int], members: list[np.ndarray]):
        self.langs, self.fallback = langs, max(sorted(weights), key=weights.get) if weights else None
        most = max([1, *(len(m) for m in members)])
        self.bits = max(10, int(np.ceil(np.log2(SLOTS_PER_NGRAM * most))))
        kind = np.uint8 if len(langs) <= 8 else np.uint16 if len(langs) <= 16 else np.uint64
        self.planes = [np.zeros(1 << self.bits, kind) for _ in range(-(-len(langs) // 64) or 1)]
        for k, grams in enumerate(members):
            plane, bit = self.planes[k // 64], kind(1 << (k % 64))
            for h in self.slots(grams):
                plane[h] |= bit
        self.fp = np.array([np.count_nonzero(self.planes[k // 64] & kind(1 << (k % 64))) / (1 << self.bits) for k in range(len(langs))]) ** HASHES

    def slots(self, grams: np.ndarray) -> list[np.ndarray]:
        h = mix64(grams.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        step, mask = (h >> np.uint64(32)) | np.uint64(1), np.uint64((1 << self.bits) - 1)
        return [((h + np.uint64(k) * step) & mask).astype(np.int64) for k in range(HASHES)]

    def masks(self, grams: np.ndarray) -> list[np.ndarray]:
        """For each plane, the languages that contain each n-gram, as bits."""
        slots = self.slots(grams)
        return [np.bitwise_and.reduce([plane[s] for s in slots]) for plane in self.planes]

    def popcounts(self, grams: np.ndarray) -> np.ndarray:
        counts = np.zeros(len(self.langs), np.int64)
        for p, masks in enumerate(self.masks(grams)):
            size = min(64, len(self.langs) - 64 * p)
            if size <= 16:
                seen = np.bincount(masks, minlength=1 << size)
                which = np.arange(len(seen))
                for b in range(size):
                    counts[64 * p + b] = seen[(which >> b) & 1 == 1].sum()
            else:
                for b in range(size):
                    counts[64 * p + b] = np.count_nonzero(masks & np.uint64(1 << b))
        return counts

    def decide(self, text: bytes) -> tuple[str, float]:
        if not self.langs or not ANY_LETTER.search(text.decode("utf-8", "replace")):
            return "und", 0.0
        grams = ngrams(text)
        n = len(grams)
        if not n:
            return self.fallback, 0.0
        true = np.clip((self.popcounts(grams) - n * self.fp) / (1 - self.fp + 1e-12), 0, n)
        best = int(np.argmax(true))
        return (self.langs[best], float(true[best] / n)) if true[best] > 0 else (self.fallback, 0.0)


def learn(training: DataFrame) -> Filters:
    """Filters from the rows of training (text and non-null lang)."""
    counts = ngram_counts(training.where(F.col("lang").isNotNull()))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one row a language
    langs = sorted(totals)
    total = F.coalesce(*(F.when(F.col("lang") == x, F.lit(totals[x])) for x in langs)) if langs else F.lit(1)
    share = F.col("n") / total
    shares = counts.where((share >= LEAST_SHARE) & (F.col("n") > 1)).select("lang", "gram", share.alias("share"))
    chosen = shares.withColumn("most", F.max("share").over(W.partitionBy("gram"))).where(F.col("share") * RARER >= F.col("most")).select("lang", "gram")
    found = chosen.toArrow()  # at most 1 / LEAST_SHARE n-grams a language
    names, grams = np.array(found.column("lang").to_pylist(), object), found.column("gram").to_numpy()
    return Filters(langs, totals, [np.sort(grams[names == x]) if len(grams) else np.zeros(0, np.int64) for x in langs])


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batch):
        made = [shared.value.decide(t) for t in texts(batch)]
        return {"doc_id": batch.column("doc_id").to_pylist(), "lang_pred": [m[0] for m in made], "score": [m[1] for m in made]}

    return map_batches(doc_input(docs), run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def held_out(mod: int, doc_id: Column | None = None) -> Column:
    return F.coalesce(F.pmod(F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string").cast("binary")), F.lit(mod)) == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = learn(docs.where(~held_out(3)))
    return identify(docs, filters).select("doc_id", held_out(3).alias("held_out"), "lang_pred", "score")
