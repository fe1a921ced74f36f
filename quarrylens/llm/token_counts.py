"""Token counts with overlap resynchronisation for huge texts.

A text of up to `CHUNK` characters is taken whole. A longer one is encoded in chunks that overlap, with offsets, and two
neighbours are spliced at a common boundary that is proven stable: a place in the overlap where both encodings start a token,
and where an ASCII white space character follows one that is not white space. The pre-tokeniser never joins such a pair into
one piece, looks only ahead from the start of a piece, and pieces are encoded apart; so what stands left of the place and
what stands right of it have the tokens of the whole text. If an overlap has no such place, it is widened and encoded again,
at last up to the end of the text. For the same reason the counts of a shorter text's parts between such spaces add up, and a
part that was met before is not encoded again.

Defined results: a null or empty text has no bytes and no tokens; equal rows have equal counts, each its own row; an empty
table gives an empty result; other columns are ignored. Special strings in a text count as the library counts them by default.
"""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import MEMO_BYTES, doc_input, map_batches, table, texts

CHUNK, OVERLAP = 32_768, 512
LIMIT = 512
MEMO = 300_000
STABLE_SPACE, UNSTABLE_SPACE = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s |^ ")


def stable(text: str, p: int) -> bool:
    return 0 < p < len(text) and text[p] in " \t\n\r" and not text[p - 1].isspace()


def count_huge(text: str, encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text; encode gives the (start, end) offsets of a string's tokens."""
    total, at, end = 0, 0, len(text)
    while end - at > chunk:
        edge, wide = at + chunk, overlap
        right_offsets: list[tuple[int, int]] = []
        while True:
            stop = min(end, edge + wide)
            left_offsets = encode(text[at:stop])
            if stop == end and wide >= end - edge:
                return total + len(left_offsets)  # the widened chunk holds the whole rest
            right_offsets = encode(text[edge:stop])
            starts = {a + edge for a, _ in right_offsets}
            common = [k for k, (a, _) in enumerate(left_offsets) if a + at in starts and a + at > edge and stable(text, a + at)]
            if common:
                break
            wide *= 2
        splice = common[0]
        total += splice
        at += left_offsets[splice][0]
    return total + (len(encode(text[at:])) if at < end else 0)


class Parts(dict):
    """Part of a text to its number of tokens; emptied when it has grown large."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def __missing__(self, part: str) -> int:
        n = len(self.tokenizer.encode(part, add_special_tokens=False))
        if len(part) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[part] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a text, as the sum over the parts that start at a space after a character that is not white space."""
        if UNSTABLE_SPACE.search(text):
            return sum(map(self.__getitem__, STABLE_SPACE.split(text)))
        first, *rest = text.split(" ")
        return sum(map(self.__getitem__, [" " + x for x in rest]), self[first] if first else 0)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens."""
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path or default_path()).read_text())  # a tokenizer file, of fixed size
    held: dict[str, object] = {}

    def run(batch):
        if "t" not in held:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_str(spec.value)
            t.no_truncation()
            t.no_padding()
            held["t"], held["parts"] = t, Parts(t)
        t, parts = held["t"], held["parts"]
        raw = texts(batch)
        counts = []
        for s in (x.decode("utf-8", "replace") for x in raw):
            counts.append(count_huge(s, lambda x: t.encode(x, add_special_tokens=False).offsets, chunk, overlap) if len(s) > chunk else parts.count(s))
        return {"doc_id": batch.column("doc_id").to_pylist(), "n_bytes": [len(x) for x in raw], "n_tokens": counts}

    return map_batches(doc_input(docs), run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
