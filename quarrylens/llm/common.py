"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import itertools
import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern [^\x20\x09-\x0D]+; bytes.split() splits on the same six bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Words that a worker's memo holds, and the bytes up to which a word (or a part of a text) is kept: so a memo's size is bounded.
WORD_HASH_MEMO, MEMO_BYTES = 150_000, 64
#: Rows that an operator takes from a batch at a time.
SLICE_ROWS = 2_000
#: Rows of a narrow table that may be broadcast for a join, and numbers that may be broadcast as an array or in lists.
BROADCAST_ROWS, ARRAY_ROWS = 100_000, 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """A cluster names the shared folder in spark.checkpoint.dir; only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not named:
            import tempfile

            named = tempfile.mkdtemp(prefix="quarrylens-checkpoint-")
        sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle and checkpoint files of finished phases: Spark deletes them when nothing refers to them any more.

    A thread of its own tells the JVM which tables Python let go of."""
    gc.collect()
    time.sleep(0.1)
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if a count shows that it is small; else joins shuffle. df is materialised and narrow."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def give_back() -> None:
    """Hand the freed memory of a Python worker back to the system. Idle workers stay for a minute, and there may be more of them than
    cores, so what each of them held at most would count for all."""
    pa.system_memory_pool().release_unused()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[dict[str, list]] | dict[str, list]], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """mapInArrow with fn from so many rows of a record batch (0: all) to columns by name."""
    from pyspark.sql.types import StructType, _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # gives memory back between batches
        for part in batches:
            for batch in (part.slice(k, rows or part.num_rows) for k in range(0, part.num_rows, rows or part.num_rows or 1)):
                made = fn(batch)
                for cols in [made] if isinstance(made, dict) else made:
                    yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in arrow], schema=arrow)
                made = cols = batch = None
            part = None
            give_back()

    return df.mapInArrow(run, struct)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(name).to_pylist()]


def doc_input(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, the wanted other columns, and text as bytes; further columns are not read."""
    return docs.select("doc_id", *others, F.col("text").cast("binary").alias("text"))


class WordHashes(dict):
    """Word to 64-bit hash, kept for words met before; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= WORD_HASH_MEMO:
                self.clear()
            self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * _M2
    x = x ^ (x >> np.uint64(29))
    x = x * _M3
    return x ^ (x >> np.uint64(32))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One hash for each n consecutive word hashes."""
    m = len(words) - n + 1
    out = np.zeros(max(m, 0), np.uint64)
    for k in range(n if m > 0 else 0):
        out = mix64(out * _M1 + words[k : k + m])
    return out


def chunked(it: Iterable, n: int) -> Iterator[list]:
    it = iter(it)
    while part := list(itertools.islice(it, n)):
        yield part
