"""Chat formatting whose text can be read back: rendered, reparsed by a deterministic grammar, and escaped until identical.

A conversation is written as turns, each an opening marker, a space, its text, a space, a closing marker and a line feed (turns
of roles without markers of their own also carry the role's name). The parser knows one grammar: at the start of a turn it needs
an opening marker, and inside a text only the closing marker of this turn may stand. A text is first written as it is; if the
parser does not give back the same turn, a backslash is put before each marker in it, and if the role's name is at fault before
those of the name too. A marker behind a backslash is text, and reading takes one backslash away, so any text comes back, also one
that holds backslashes before markers. Markers hold no backslash, no white space at their ends and do not overlap, which makes
this exact; `Template` refuses others.

Turns are rendered and verified where they are read, each by itself. Only then are they dealt by conv_id, sorted by Spark (on
disk, if need be) and streamed: a task holds one part (`PART_CHARS`) of one conversation at a time, however long it is. A digest of
a whole conversation is a sequence by nature, so a conversation stays in one task, which only joins and hashes.

Defined results: a null text is empty; a null role is the role '' without markers of its own; rows are ordered by turn, null first, then by role
and by what they are written as (so ties and repeated rows have one order); rows without conv_id are one conversation; an
empty table has no conversation; very long texts are written whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import map_batches, table

#: Code points after which a conversation goes on in a further part.
PART_CHARS = 1 << 20
PARTS = "part int, formatted string, loss array<struct<start:int,end:int>>"


class GrammarError(ValueError):
    """A text that the grammar does not make."""


@dataclass(frozen=True)
class Template:
    """Role -> (opening, closing marker); the markers of other roles: opening, between name and text, closing; roles under the loss mask."""

    roles: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        marks = self.markers
        if len(set(marks)) < len(marks) or any(not m or m != m.strip() or "\\" in m for m in marks):
            raise ValueError("markers must differ and have no backslash and no white space at their ends")
        if any(a != b and (b in a or any(a.endswith(b[:k]) for k in range(1, len(b)))) for a in marks for b in marks) or any(a.endswith(a[:k]) for a in marks for k in range(1, len(a))):
            raise ValueError("markers must not overlap")
        object.__setattr__(self, "pattern", re.compile("|".join(map(re.escape, marks))))
        object.__setattr__(self, "escaped", re.compile(r"\\(" + "|".join(map(re.escape, marks)) + ")"))
        object.__setattr__(self, "openings", {o: (r, c) for r, (o, c) in self.roles.items()} | {self.other[0]: (None, self.other[2])})

    @property
    def markers(self) -> list[str]:
        return [m for pair in self.roles.values() for m in pair] + list(self.other)

    def escape(self, text: str) -> str:
        return self.pattern.sub(r"\\\g<0>", text)

    def unescape(self, text: str) -> str:
        return self.escaped.sub(r"\1", text) if "\\" in text else text

    def parse(self, formatted: str) -> list[tuple[str, str, int, int]]:
        """role, text, and where the text stands (start, end) of each turn."""
        marks = [m.span() for m in self.pattern.finditer(formatted) if not m.start() or formatted[m.start() - 1] != "\\"]
        turns, at, k = [], 0, 0

        def expect(good: bool):
            if not good:
                raise GrammarError(f"no turn at {at}")

        while at < len(formatted):
            expect(k + 1 < len(marks) and marks[k][0] == at and formatted[slice(*marks[k])] in self.openings)
            role, closing = self.openings[formatted[slice(*marks[k])]]
            start = marks[k][1] + 1
            if role is None:
                between = marks[k + 1]
                expect(k + 2 < len(marks) and formatted[slice(*between)] == self.other[1] and formatted[start - 1] == formatted[between[0] - 1] == " " and start < between[0])
                role, start, k = self.unescape(formatted[start : between[0] - 1]), between[1] + 1, k + 1
            end = marks[k + 1][0] - 1
            expect(formatted[slice(*marks[k + 1])] == closing and start <= end and formatted[start - 1] == formatted[end] == " " and formatted[marks[k + 1][1] : marks[k + 1][1] + 1] == "\n")
            turns.append((role, self.unescape(formatted[start:end]), start, end))
            at, k = marks[k + 1][1] + 1, k + 2
        return turns

    def write(self, role: str, text: str) -> tuple[str, int, int]:
        """A turn as it is formatted, and where its text stands: verbatim, or with markers escaped where else it would not read back."""
        for name, body in ((role, text), (role, self.escape(text)), (self.escape(role), self.escape(text))):
            opening, closing = self.roles.get(role, (f"{self.other[0]} {name} {self.other[1]}", self.other[2]))
            made = f"{opening} {body} {closing}\n"
            try:
                back = self.parse(made)
            except GrammarError:
                continue
            if len(back) == 1 and back[0][:2] == (role, text):
                return made, back[0][2], back[0][3]
        raise GrammarError(f"the turn of role {role!r} does not read back")


TEMPLATE = Template()


def written(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, turn, role, piece (the turn as it is formatted), start and end of its text in piece under the loss mask, else null."""

    def run(batch):
        roles = [r or "" for r in batch.column("role").to_pylist()]
        made = [template.write(r, t or "") for r, t in zip(roles, batch.column("text").to_pylist(), strict=True)]
        masked = [r in template.trained for r in roles]
        spans = {n: [m[k] if on else None for m, on in zip(made, masked, strict=True)] for k, n in ((1, "start"), (2, "end"))}
        return {"conv_id": batch.column("conv_id"), "turn": batch.column("turn"), "role": roles, "piece": [m[0] for m in made], **spans}

    kinds = dict(conversations.dtypes)
    return map_batches(conversations.select("conv_id", "turn", "role", "text"), run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, piece string, start int, end int")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True)


def _emit(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Batches of rows that come one by one; a batch is full at about 4 MB."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if weight >= 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _streamed(df: DataFrame, fn, schema: str, size) -> DataFrame:
    """mapInArrow of fn from the rows of a partition, in their order, to rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    struct = _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)
    return df.mapInArrow(lambda batches: _emit(fn(_rows(batches)), arrow, size), struct)


def format_conversations(conversations: DataFrame, template: Template = TEMPLATE, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, part (from 0), formatted, loss (spans of the texts under the loss mask, in code points of this part)."""

    def join(rows):
        now, part, pieces, loss, n = None, 0, [], [], 0

        def full():
            return now[0], part, "".join(pieces), [{"start": a, "end": b} for a, b in loss]

        for conv, piece, start, end in rows:
            if now is not None and (now != (conv,) or n >= part_chars):
                yield full()
                part, pieces, loss, n = part + 1 if now == (conv,) else 0, [], [], 0
            now = (conv,)
            pieces.append(piece)
            if start is not None:
                loss.append((n + start, n + end))
            n += len(piece)
        if now is not None:
            yield full()

    kind = dict(conversations.dtypes)["conv_id"]
    ordered = written(conversations, template).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "piece")
    return _streamed(ordered.select("conv_id", "piece", "start", "end"), join, f"conv_id {kind}, {PARTS}", lambda row: len(row[2]))


def read_back(parts: DataFrame, template: Template = TEMPLATE, in_order: bool = False) -> DataFrame:
    """What the parser finds in formatted conversations: a row for each, with digests of its turns and of its text under the loss
    mask. in_order: the parts of a conversation follow each other in one partition, as format_conversations leaves them."""

    def digest(rows):
        now = None
        for conv, _, formatted, loss in rows:
            if now != (conv,):
                if now is not None:
                    yield now[0], n_turns, turns.hexdigest(), loss_chars, masked.hexdigest(), chars  # noqa: F821
                now, n_turns, turns, loss_chars, masked, chars = (conv,), 0, hashlib.sha256(), 0, hashlib.sha256(), 0
            for role, text, _, _ in template.parse(formatted):
                n_turns += 1
                turns.update(f"{role}\n{text}\n".encode())
            for span in loss:
                text = template.unescape(formatted[span["start"] : span["end"]])
                loss_chars += len(text)
                masked.update(text.encode())
            chars += len(formatted)
        if now is not None:
            yield now[0], n_turns, turns.hexdigest(), loss_chars, masked.hexdigest(), chars

    kind = dict(parts.dtypes)["conv_id"]
    ordered = parts.select("conv_id", "part", "formatted", "loss")
    if not in_order:
        ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return _streamed(ordered, digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", lambda row: 200)


#: A conversation whose texts are made of markers.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    probe = spark.createDataFrame(PROBE, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string")
    return read_back(format_conversations(rows.unionByName(probe)), in_order=True)


def oracle(template: Template = TEMPLATE) -> str:
    marks = "|".join(re.escape(m) for m in template.markers)
    escaped = lambda x: rf"regexp_replace({x}, '({marks})', '\\\1', 'g')"
    known = " ".join(f"WHEN role = '{r}' THEN '{o} ' || {escaped('text')} || ' {c}'" for r, (o, c) in template.roles.items())
    o, between, c = template.other
    order = "ORDER BY turn NULLS FIRST, role, piece"
    trained = ", ".join(f"'{r}'" for r in template.trained)
    return rf"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE[0][3]}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE[1][3]}'),
pieces AS (SELECT *, CASE {known} ELSE '{o} ' || {escaped('role')} || ' {between} ' || {escaped('text')} || ' {c}' END || chr(10) AS piece FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role IN ({trained})), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' {order}) FILTER (WHERE role IN ({trained})), '')) AS loss_sha256,
  sum(length(piece))::BIGINT AS formatted_chars
FROM pieces GROUP BY conv_id
"""
