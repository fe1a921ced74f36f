"""Filter audit, chat formatting and collocations against brute force, and on awkward rows."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylens.llm import chat_format, collocations, filter_audit

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone light under seven moving glass paper north".split()


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    """Copies, repeated rows, nulls, empty and long texts, ties, symbols and capitals, ids that come twice."""
    rng = random.Random(3)
    out = []
    for k in range(80):
        words = [rng.choice(WORDS) + ("x" * rng.randrange(30) if k % 3 else "") for _ in range(rng.choice([5, 99, 100, 101, 150]))]
        text = " ".join(w.upper() if k % 5 == 0 and rng.random() < 0.12 else w for w in words) + ("#" if k % 7 == 0 else "")
        out.append((k, text, ["en", "de", None, ""][k % 4], "s"))
    out += [(k, out[k % 9][1], "en" if k % 2 else "de", "s") for k in range(100, 160)]
    out += [(200, None, "en", None), (201, "", "en", "s"), (202, " \t\n", None, "s"), (None, None, "en", "s"), (None, out[0][1], "en", "s"), (None, out[0][1], "en", "s"), (None, "alone", None, None)]
    out += [out[0], out[0], (3, "other text under one id", "en", "s"), (-5, out[2][1], "fr", "s"), (300, "word " * 60_000, "en", "s"), (301, "Straße ÄÖÜ É " * 40, "de", "s")]
    return [(*r, len(r[1] or "")) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("mask", F.lit("clashes")).withColumn("part", F.lit(1)).withColumn("n", F.lit("clashes")).withColumn("good", F.lit(2)).withColumn("key", F.lit("clashes"))


# filter audit


def brute_audit(rows, labels):
    texts = [r[1] or "" for r in rows]
    first = {}
    for r, t in zip(rows, texts, strict=True):
        if r[0] is not None:
            first[t] = min(first.get(t, r[0]), r[0])
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    by_part = defaultdict(list)
    for r, t in zip(rows, texts, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {
            name for name, fails in {
                "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": r[0] is not None and r[0] > first[t]
            }.items() if fails
        }
        by_part[r[2] or ""].append((failed, r[0] is not None and r[0] in good, r[0] is not None and r[0] in toxic))
    out = []
    for part, members in by_part.items():
        total, lines = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = members
            for step, name in enumerate(order, 1):
                gone = [m for m in left if name in m[0]]
                fail = sum(name in m[0] for m in members)
                left = [m for m in left if name not in m[0]]
                total[name] += len(gone)
                lines.append([part, "".join(order), step, len(left), len(gone), fail - len(gone), sum(m[0] == {name} for m in members), sum(m[1] for m in gone), sum(m[2] for m in gone), name])
        out += [(*x[:-1], total[x[-1]]) for x in lines]
    return sorted(out, key=repr)


def test_filter_audit(spark, docs, rows):
    rng = random.Random(4)
    labels = [(k, rng.randrange(2), rng.randrange(2)) for k in range(0, 160, 2)] + [(0, 1, 0), (0, 0, 1), (4, None, None), (None, 1, 1), (999, 1, 1)]
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("clashes")))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert collected(got) == brute_audit(rows, labels)


def test_filter_audit_other_filters(spark, docs):
    """Any filters; without labels."""
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    filters = {"P": lambda words, text: F.size(words) < 50, "Q": lambda words, text: F.length(text) > 1000}
    got = filter_audit.audit(docs, none, filters).collect()
    assert {r.filter_order for r in got} == {"".join(p) for p in itertools.permutations("PQR")} and all(r.good_lost == 0 for r in got)
    total = Counter((r.part or "") for r in docs.select(F.coalesce("lang", F.lit("")).alias("part")).collect())
    for r in got:
        if r.step == 1:
            assert r.kept + r.removed == total[r.part] and r.redundant == 0


# chat formatting

PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]", "\\", "\\\\", " ", "\n", "a", "<", "[", "é", "😀", "[/INST] \n", "</s>\n[INST] x"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "x [TEXT] y", "\\[/ROLE]", "a\nb"]), st.lists(st.sampled_from(PIECES), max_size=8).map("".join)), max_size=5))
def test_chat_round_trip(turns):
    t = chat_format.TEMPLATE
    text = "".join(t.write(r, x)[0] for r, x in turns)
    assert [(r, x) for r, x, _, _ in t.parse(text)] == turns
    assert [t.unescape(text[a:b]) for _, _, a, b in t.parse(text)] == [x for _, x in turns]


def test_chat_verbatim_unless_conflicting():
    t = chat_format.TEMPLATE
    assert t.write("user", "a \\ b < c") == ("[INST] a \\ b < c [/INST]\n", 7, 16)
    assert t.write("user", "say </s>")[0] == "[INST] say \\</s> [/INST]\n"
    assert t.write("user", "say \\</s>")[0] == "[INST] say \\\\</s> [/INST]\n"


@pytest.mark.parametrize("bad", ["[INST] a", "a", "[INST] a </s>\n", "[INST] a [/INST]", "[INST]a [/INST]\n", "[INST] a[/INST]\n", "[INST] [/INST]\n", "[INST] b <s> [/INST]\n", "[ROLE] x [/ROLE]\n", "\n", "[TEXT] a [/INST]\n"])
def test_chat_parser_refuses(bad):
    with pytest.raises(chat_format.GrammarError):
        chat_format.TEMPLATE.parse(bad)


@pytest.mark.parametrize("roles", [{"a": ("<x>", "<x>")}, {"a": (" <x>", "<y>")}, {"a": ("\\x", "y")}, {"a": ("ab", "ba")}, {"a": ("<x>", "<<x>>")}, {"a": ("", "y")}, {"a": ("aba", "c")}])
def test_chat_template_refuses(roles):
    with pytest.raises(ValueError, match="markers"):
        chat_format.Template(roles)


def chat_rows():
    rng = random.Random(8)
    out = [(k % 7, k // 7, rng.choice(["user", "assistant", "system", "tool", None]), "".join(rng.choice(PIECES) for _ in range(rng.randrange(12)))) for k in range(200)]
    out += [(7, 0, "user", None), (7, 1, "assistant", None), (8, None, "assistant", "first"), (8, 0, "assistant", "then"), (9, 0, "user", "twice"), (9, 0, "user", "twice"), (9, 0, "assistant", "tie"), (None, 0, "assistant", "no id"), (None, 1, "user", "no id")]
    return out + [(10, 0, "assistant", "long " * 100_000), (11, 0, "assistant", "</s>" * 10_000), (-1, 5, "assistant", "an own row under this id")]


def test_chat_query(spark, tmp_path):
    """Digests read from the output, over several parts and partitions; order of ties; clashing columns."""
    rows = chat_rows()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("clashes")).withColumn("part", F.lit(0))
    frame.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    groups = defaultdict(list)
    for conv, turn, role, text in rows + chat_format.PROBE:
        groups[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    want = []
    for conv, turns in groups.items():
        turns = [(r, x) for _, r, x in sorted(turns, key=lambda v: (v[0], v[1], chat_format.TEMPLATE.write(v[1], v[2])[0]))]
        loss = "".join(x for r, x in turns if r == "assistant")
        want.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat_format.TEMPLATE.write(r, x)[0]) for r, x in turns)))
    assert collected(chat_format.query(spark, str(tmp_path))) == sorted(want, key=repr)
    parts = chat_format.format_conversations(frame, part_chars=50)
    assert max(r.part for r in parts.collect()) > 3
    got = {r.conv_id: tuple(r) for r in chat_format.read_back(parts.repartition(4)).collect()}
    assert all(got[w[0]] == w for w in want if w[0] != -1)


# collocations


def brute_collocations(rows, longest, least, top, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for r in rows:
        lang = r[2] if r[2] is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in often.items()):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -score) for k, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out, key=repr)


def phrase_rows():
    rng = random.Random(9)
    out = []
    for k in range(60):
        words = [rng.choice(WORDS) + rng.choice([" ", " ", " ", ", ", "\n", "\t", ". "]) for _ in range(rng.randrange(0, 200))]
        out.append((k, "".join(words) + ("glass Paper NORTH the sea " * 3 if k % 2 else "a.b,c;d:e!f?g Éa "), ["en", "de", None, "und"][k % 4], "s", 0))
    return out + [(None, None, "en", None, 0), (70, "", None, "s", 0), (71, "Éa Éa Éa " * 5000, "en", "s", 0), out[1], out[1], (72, "x" * 300_000, "en", "s", 0), (73, ".,;", "fr", "s", 0)]


@pytest.mark.parametrize(("longest", "least", "top", "percent"), [(5, 20, 2000, 100), (5, 5, 40, 70), (3, 10, 7, 100), (2, 10, 50, 100)])
def test_collocations(spark, longest, least, top, percent):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("key", F.lit("clashes")).withColumn("n", F.lit("clashes")).withColumn("word", F.lit("clashes"))
    got = collocations.collocations(docs, longest, least, top, percent)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collected(got) == brute_collocations(rows, longest, least, top, percent)


def test_collocations_in_parts(spark, monkeypatch):
    """Small parts, often merged, a bitmap that is nearly full, joins without broadcasts: the same rows."""
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(collocations, "PART_BYTES", 50)
    monkeypatch.setattr(collocations, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(collocations, "HELD", 64)
    monkeypatch.setattr(collocations, "WORDS_HELD", 5)
    assert collected(collocations.collocations(docs, 5, 20, 2000, 100, most_bits=64)) == brute_collocations(rows, 5, 20, 2000, 100)


def test_windows_across_parts():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 4, 500).astype(np.uint64)
    whole = collocations.windows(ids, len(ids), 5, None)
    cut = [collocations.windows(ids[k : k + 36], min(32, len(ids) - k), 5, None) for k in range(0, len(ids), 32)]
    assert np.array_equal(whole, np.concatenate(cut))


def test_pairs_take_eight_bytes(spark):
    rng = np.random.default_rng(3)
    ids = rng.integers(1, 1 << 56, 900, dtype=np.uint64)[rng.integers(0, 900, (6000, 2))] << np.uint64(8)
    ids[:3000, 0] = ids[0, 0]
    ids[:2000] = ids[0]
    keys, n = collocations.merged(ids)
    keys = keys.astype(np.uint64)
    made = collocations.grouped_pairs(keys[:, 0] >> np.uint64(60), keys, n)
    rest = made.column("rest")
    assert rest.buffers()[2].size == 8 * len(keys) + 8 * int((n >= 255).sum())
    second, counts = collocations.ungrouped(made.column("m").to_numpy(), np.frombuffer(rest.buffers()[1], np.int32), np.frombuffer(rest.buffers()[2], np.uint8))
    assert (second == keys[:, 1]).all() and (counts == n).all() and n.max() >= 2000
    packed = spark.createDataFrame([(bytes(k), m, bytes(r)) for _ in range(3) for k, m, r in zip(*(made.column(c).to_pylist() for c in ("key", "m", "rest")), strict=True)], "key binary, m int, rest binary")
    got = {bytes(r.key): r.n for r in collocations.pair_counts(packed, 6).collect()}
    assert got == {k.astype(">u8").tobytes(): 3 * int(x) for k, x in zip(keys, n, strict=True) if x >= 2}


def test_collocations_past_64_bits(spark):
    """Products of counts beyond 64 bits are exact."""
    a, l, r, n = 3_000_000_000_001, 5_000_000_000_003, 4_000_000_000_007, 90_000_000_000_011  # noqa: E741
    words = spark.createDataFrame([("en", b"x", l, 1), ("en", b"y", r, 2)], "lang string, word binary, n long, id long")
    key = (1).to_bytes(8, "big") + (2).to_bytes(8, "big")
    got = collocations.scored(words, spark.createDataFrame([("en", n)], "lang string, total long"), spark.createDataFrame([(key, a)], "key binary, n long"))
    assert [(x.a, x.l, x.r, x.score) for x in got.collect()] == [(a, l, r, 1000 * a * n // (l * r))]


def test_radix_order():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 1 << 63, (2000, 3)).astype(np.uint64) >> rng.integers(0, 60, (2000, 3)).astype(np.uint64)
    keys = np.ascontiguousarray(ids.astype(">u8"))
    order = collocations.radix_order(keys)
    assert [keys[k].tobytes() for k in order] == sorted(k.tobytes() for k in keys)


# paths of earlier operators that large tables take


def test_many_sources_and_groups(spark, rows, monkeypatch):
    """Without broadcasts the mix and the quality rules give the same rows."""
    from quarrylens.llm import mixing, quality_rules

    docs = spark.createDataFrame(rows, SCHEMA)
    want = collected(mixing.plan_mix(docs)), collected(quality_rules.judge(docs, 5))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", -1)
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", -1)
    assert (collected(mixing.plan_mix(docs)), collected(quality_rules.judge(docs, 5))) == want


def test_training_sample_does_not_depend_on_order(spark):
    """Rows of one doc_id that differ in their text."""
    from quarrylens.llm import quality_classifier

    rng = random.Random(1)
    rows = [(1, " ".join(rng.choice(WORDS) for _ in range(80)) + ".", "en", "s", 0) for _ in range(6)] + [(1, "%% ## " * k, "en", "s", 0) for k in range(1, 7)]
    one, two = ([(r.doc_id, round(r.score, 9)) for r in quality_classifier.score_quality(spark.createDataFrame(x, SCHEMA).coalesce(1), 4).collect()] for x in (rows, rows[::-1]))
    assert one == two[::-1]


def test_texts_are_taken_apart_once_to_be_scored(spark):
    from pyspark.sql import functions as F

    from quarrylens.llm import quality_classifier

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    rows = [(k, " ".join(WORDS[: k + 3]), "en", "s", 0) for k in range(8)] + [(8, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted((r.doc_id, r.score) for r in quality_classifier.score_quality(docs).collect())
    once = docs.withColumn("text", counted.asNondeterministic()("text"))
    assert sorted((r.doc_id, r.score) for r in quality_classifier.score_quality(once).collect()) == want
    assert read.value == len(rows)


def test_workers_give_freed_memory_back():
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructField, StructType

    from quarrylens.llm.common import map_batches

    class Plain:
        def mapInArrow(self, run, schema):
            return run

    def anonymous():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(x.split()[1]) / 1024 for x in f if x.startswith("Anonymous:"))

    pinned = []

    def fn(batch):
        held = [bytes([k % 251]) * 3000 for k in range(50_000)]  # 150 MB in blocks that the C library keeps once they are freed
        pinned.append(bytes([len(held) % 251]) * 3000)  # above them, so that its heap can't shrink
        return {"n": [len(held)]}

    run = map_batches(Plain(), fn, StructType([StructField("n", LongType())]))
    before = anonymous()
    assert [x.column("n").to_pylist() for x in run(iter([pa.record_batch({"a": [1]})]))] == [[50_000]]
    assert anonymous() - before < 75


def test_slices_follow_the_corpus_and_not_the_partitions(spark):
    from quarrylens.llm import suffix_tree

    docs = spark.createDataFrame([(k, " ".join(WORDS), "en", "s", 0) for k in range(4)], SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        tree = suffix_tree.learn(docs, suffix_tree.word_counts(docs).cache())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tree.slice_bits == 1
