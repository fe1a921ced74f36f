"""Quality classifier from weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer.

Ten overlapping labellers vote good, bad or nothing on each document, and none judges texts that are too short for it. All
documents are counted by vote pattern (at most 3^10), and expectation-maximisation on these counts estimates the share of good
documents and how often each labeller votes on good and on bad ones. The posterior of a document's pattern is its label, and these labels train a
logistic scorer on hashed features (word shapes, and the document's statistics in steps). Every document is then scored.

The counts cover all documents. The scorer alone is fitted on a bounded sample: the `TRAIN_ROWS` documents with the least
hash of doc_id and text, so that only equal rows tie with the last of them, and the order of rows does not count.

Each text is taken apart once: its features are stored, and counted, sampled and scored from there. Only the filter, which hands
on whole rows, takes it apart again.

Defined results: a null or empty text gets no votes but has a score, that of the prior and the intercept; equal rows have
equal results, each its own row; an empty table gives an empty result; columns other than doc_id and text are ignored (score)
or kept (filter). A document is kept if its score is at least one half.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import MEMO_BYTES, SLICE_ROWS, WORD_HASH_MEMO, cut, doc_input, give_back, map_batches, table, texts
from quarrylens.llm.quality_rules import repeated_words

TRAIN_ROWS = 20_000
DIM = 4096
EPOCHS, RATE, DECAY = 400, 0.5, 1e-4
BAD, GOOD = 0, 1
#: A labeller's part of a pattern: it gives no vote, it gives its vote, or it does not judge such short texts.
NONE, GIVEN, SHORT = 0, 1, 2
SYMBOLS = b"#*$%&|<>~^={}[]"
#: Labeller -> (its vote, words it needs, the statistics that must lie within bounds for it to vote).
LABELLERS = {
    "many symbols": (BAD, 1, {"symbols": (0.15, 1e9)}),
    "many repeats": (BAD, 20, {"repeats": (0.30, 1.0)}),
    "many capitals": (BAD, 5, {"capitals": (0.30, 1.0)}),
    "few kinds of words": (BAD, 50, {"variety": (0.0, 0.30)}),
    "long words": (BAD, 10, {"word_length": (9.0, 1e9)}),
    "short words": (BAD, 10, {"word_length": (0.0, 2.5)}),
    "words without letters": (BAD, 10, {"no_letter": (0.30, 1.0)}),
    "repeated lines": (BAD, 20, {"dup_lines": (0.40, 1.0)}),
    "plain writing": (GOOD, 10, {"symbols": (0.0, 0.05), "capitals": (0.0, 0.25), "no_letter": (0.0, 0.25)}),
    "varied prose": (GOOD, 20, {"variety": (0.45, 1.0), "repeats": (0.0, 0.30), "dup_lines": (0.0, 0.40)}),
}
NAMES = ("symbols", "repeats", "capitals", "variety", "word_length", "ended_lines", "no_letter", "dup_lines")
_UPPER, _LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))
_LETTERS = frozenset(_UPPER + _LOWER) | frozenset(range(0x80, 0x100))
#: Letters by case, digits as 0, everything else as it is.
_SHAPE = bytes(0x58 if b in _UPPER else 0x78 if b in _LOWER or b >= 0x80 else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))


class Shapes(dict):
    """Word to (hash bucket of its shape, does it have a letter)."""

    def __missing__(self, word: bytes) -> tuple[int, bool]:
        shape = word.translate(_SHAPE)
        runs = bytes(b for k, b in enumerate(shape) if k == 0 or b != shape[k - 1])[:12]
        value = (xxhash.xxh3_64_intdigest(runs) % DIM, not _LETTERS.isdisjoint(word))
        if len(word) <= MEMO_BYTES:
            if len(self) >= WORD_HASH_MEMO:
                self.clear()
            self[word] = value
        return value


def statistics(words: list[bytes], text: bytes, no_letter: int) -> tuple[float, ...]:
    """The statistics of NAMES."""
    n = max(len(words), 1)
    lines = [x.rstrip() for x in text.split(b"\n") if x.split()]
    upper, lower = len(text) - len(text.translate(None, _UPPER)), len(text) - len(text.translate(None, _LOWER))
    chars = len(b"".join(words).decode("utf-8", "replace"))
    return (
        (len(text) - len(text.translate(None, SYMBOLS))) / n,
        repeated_words(words) / n,
        upper / max(upper + lower, 1),
        len(set(words)) / n,
        chars / n,
        sum(x[-1:] in b".!?" for x in lines) / max(len(lines), 1),
        no_letter / n,
        1 - len(set(lines)) / max(len(lines), 1),
    )


def vote(stats: dict[str, float], n_words: int) -> list[int]:
    return [SHORT if n_words < needs else GIVEN if all(low <= stats[k] <= high for k, (low, high) in bounds.items()) else NONE for _, needs, bounds in LABELLERS.values()]


def features(text: bytes, shapes: Shapes) -> tuple[int, np.ndarray, np.ndarray]:
    """The vote pattern in base 3, and the places and values of the hashed features."""
    words = text.split()
    met = [shapes[w] for w in words]
    stats = statistics(words, text, sum(not m[1] for m in met))
    pattern = 0
    for v in vote(dict(zip(NAMES, stats, strict=True)), len(words)):
        pattern = 3 * pattern + v
    buckets, n = np.unique(np.array([m[0] for m in met], np.int64), return_counts=True)
    steps = [xxhash.xxh3_64_intdigest(f"{k}:{round(min(x, 20.0) * (2 if k == 'word_length' else 20))}".encode()) % DIM for k, x in zip(NAMES, stats, strict=True)] if words else []
    steps.append(xxhash.xxh3_64_intdigest(f"size:{len(words).bit_length()}".encode()) % DIM)
    return pattern, np.concatenate([buckets, np.array(steps, np.int64)]), np.concatenate([n / max(len(words), 1), np.full(len(steps), 0.5)])


def described(docs: DataFrame) -> DataFrame:
    """doc_id, k, pattern, at, value of each document (materialised): the key that draws the sample, the vote pattern and the hashed features."""
    memo: list[Shapes] = []
    key = F.xxhash64(F.lit("train"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")))  # equal only for rows that are equal

    def run(batch):
        memo or memo.append(Shapes())
        rows = [features(t, memo[0]) for t in texts(batch)]
        return {c: batch.column(c) for c in ("doc_id", "k")} | {"pattern": [r[0] for r in rows], "at": [r[1].astype(np.int32) for r in rows], "value": [r[2] for r in rows]}

    return cut(map_batches(doc_input(docs.withColumn("k", key), "k"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, k long, pattern int, at array<int>, value array<double>"))


def votes_of(pattern: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        pattern, v = divmod(pattern, 3)
        out.append(v)
    return out[::-1]


def label_model(counts: dict[int, int], rounds: int = 200) -> tuple[float, np.ndarray, dict[int, float]]:
    """Share of good documents, how often each labeller votes on bad and on good ones, posterior of each pattern.

    A labeller has one vote, good or bad, that it gives or not, so its accuracy is the pair of rates at which it gives it in either class.
    """
    patterns = sorted(counts)
    votes = np.array([votes_of(p) for p in patterns]).reshape(len(patterns), len(LABELLERS))
    given, judged = (votes == GIVEN).astype(float), (votes != SHORT).astype(float)
    weight = np.array([counts[p] for p in patterns], float)
    against = np.array([v[0] == BAD for v in LABELLERS.values()])
    prior, rate = 0.8, np.where(against, [[0.30], [0.02]], [[0.30], [0.70]])
    good = np.zeros(len(patterns))
    for _ in range(rounds):
        log_bad, log_good = (np.log(p) + (given * np.log(r) + (judged - given) * np.log(1 - r)).sum(1) for p, r in ((1 - prior, rate[0]), (prior, rate[1])))
        good = 1 / (1 + np.exp(np.clip(log_bad - log_good, -700, 700)))
        prior = float(np.clip((weight @ good + 8) / (weight.sum() + 10), 0.01, 0.99))
        rate = np.stack([((weight * g) @ given + 0.5) / ((weight * g) @ judged + 1) for g in (1 - good, good)])
        rate = np.clip(rate, 1e-4, 1 - 1e-4)
    return prior, rate, dict(zip(patterns, good.tolist(), strict=True))


def fit(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weights of the hashed features, the intercept last: logistic regression by gradient descent with momentum. Feature cols[k] of row rows[k] is vals[k]."""
    w, speed, m = np.zeros(DIM + 1), np.zeros(DIM + 1), max(len(label), 1)
    scale = 1 / np.maximum(np.sqrt(np.bincount(cols, vals**2, DIM) / m), 0.02)  # a step that suits rare features too
    for _ in range(EPOCHS):
        z = np.bincount(rows, vals * w[cols], len(label)) + w[DIM]
        off = 1 / (1 + np.exp(-z)) - label
        grad = np.append(np.bincount(cols, vals * off[rows], DIM) / m * scale, off.sum() / m) + DECAY * w
        speed = 0.9 * speed - RATE * 0.1 * grad
        w += speed * np.append(scale, 1.0)
    return w


def learn(made: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, dict[int, float]]:
    """Weights of the scorer, posterior of each pattern. made: described."""
    counts = {r.pattern: r.n for r in made.groupBy("pattern").agg(F.count("*").alias("n")).collect()}  # at most 3^10 patterns
    _, _, posterior = label_model(counts)
    chosen = made.select("k").orderBy("k").limit(train_rows).agg(F.max("k")).first()[0]  # the sample bound is a parameter
    some = made.where(F.col("k") <= F.lit(chosen)).select("pattern", "at", F.col("value").cast("array<float>").alias("value")) if chosen is not None else None
    if some is None:
        return fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)), posterior
    got = some.limit(train_rows).toArrow().combine_chunks()
    at, value = (got.column(c).combine_chunks() for c in ("at", "value"))
    lengths = np.diff(at.offsets.to_numpy()) if len(at) else np.zeros(0, np.int64)
    label = np.array([posterior[p] for p in got.column("pattern").to_pylist()])
    return fit(np.repeat(np.arange(len(label)), lengths), at.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy().astype(float), label), posterior


def score_quality(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, posterior (of the weak labels), score (of the linear scorer), kept."""
    made = described(docs)
    shared = docs.sparkSession.sparkContext.broadcast(learn(made, train_rows))

    def run(batch):
        weights, posterior = shared.value
        at, value = (batch.column(c) for c in ("at", "value"))
        row = np.repeat(np.arange(batch.num_rows), np.diff(at.offsets.to_numpy()))
        z = np.bincount(row, weights[at.flatten().to_numpy()] * value.flatten().to_numpy(), batch.num_rows) + weights[DIM]
        score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return {"doc_id": batch.column("doc_id"), "posterior": [posterior.get(p, 0.5) for p in batch.column("pattern").to_pylist()], "score": score, "kept": score >= 0.5}

    return map_batches(made, run, f"doc_id {dict(docs.dtypes)['doc_id']}, posterior double, score double, kept boolean")


def keep_good(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns, in one more pass over the text."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(described(docs), train_rows))
    at_text, memo = docs.columns.index("text"), []

    def run(batches):
        import pyarrow as pa

        memo or memo.append(Shapes())
        weights = shared.value[0]
        pa.set_memory_pool(pa.system_memory_pool())
        for batch in (b.slice(k, SLICE_ROWS) for b in batches for k in range(0, b.num_rows, SLICE_ROWS)):
            made = (features((t or "").encode(), memo[0]) for t in batch.column(at_text).to_pylist())
            yield batch.filter(pa.array([bool(weights[at] @ value + weights[DIM] >= 0) for _, at, value in made], pa.bool_()))
        batch = None
        give_back()

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents")).select("doc_id", "posterior", "score", "kept")
