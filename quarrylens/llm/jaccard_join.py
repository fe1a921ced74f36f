"""N-gram Jaccard join by grouped prefixes.

Each text becomes the set of its distinct word shingles (64-bit hashes). Equal sets are one class. In any global order of
shingles, two sets with similarity of at least t share a shingle among the first n - ceil(t n) + 1 of each; the order here
puts shingles that many classes hold behind the others, so that common passages make no candidates, and else goes by hash.
Classes with identical prefixes and size are one group. Groups meet on prefix shingles, are filtered by size, expanded to
their members, filtered by a parity bitmap (its Hamming distance never exceeds the symmetric difference), and verified on
the whole sets.

As the result is connected components, members already known to be connected need no verification. First every group and
every posting list is tested as a star around one member. Long lists in which more than one component is left are tested as stars
around HUBS other members. What then is left in a list are pairs of members of different components that pass the filters, with
the list's largest component on one side only; of the pairs of two components a few are verified at a time, until no untested
pair of different components remains. So large groups of copies make a number of pairs in proportion to their size, and no link
between components is lost.

Defined results: a null or empty text, or one without words, has an empty set, no links, and is its own component; a text of
fewer words than a shingle is one shingle; equal rows form one component, each its own row; rows without doc_id take part like
others, and a component of such rows alone has no component_id; an empty table gives an empty result; a very long text is one
set like any other; columns other than doc_id and text are ignored (components) or kept (one_of_each).
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import ARRAY_ROWS, BROADCAST_ROWS, WordHashes, cut, doc_input, map_batches, release, small, table, texts, window_hashes
from quarrylens.llm.components import components

WIDTH = 3
PERCENT = 90
#: Times a prefix's share of a set, the share of the hash range in which common shingles are looked for.
HEAD = 2
#: A shingle of more classes than this goes behind the others in the order.
COMMON = 16
#: Parity bits of a class: at least BITS, and BITS_PER_TOKEN for each shingle, but not more than MOST_BITS. Posting lists carry
#: them folded to a FOLD-th, but not below BITS.
BITS, BITS_PER_TOKEN, MOST_BITS, FOLD = 1024, 4, 65536, 16
#: Further hubs of a list of more than COMMON classes in which more than one component is left.
HUBS = 6


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a word hash sequence."""
    return np.unique(window_hashes(words, min(width, len(words)))) if len(words) else np.zeros(0, np.uint64)


def class_id(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes(), 7)).astype(np.int64))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def index_length(n: int, percent: int) -> int:
    """How much of the smaller of two sets must be looked at: its prefix for sets that are not smaller."""
    return n - -(-2 * n * percent // (100 + percent)) + 1


def parity_bits(tokens: np.ndarray) -> list[int]:
    """The parity of the tokens in each of so many buckets that unlike sets of this size differ in more of them than like sets may."""
    bits = BITS
    while bits < BITS_PER_TOKEN * len(tokens) and bits < MOST_BITS:
        bits *= 2
    return np.packbits((np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64).tolist()


def head_limit(percent: int) -> np.uint64:
    """Where the head of the hash range ends; prefixes lie before it, but for very short texts."""
    return np.uint64(min(HEAD * (100 - percent), 100) * (2**64 - 1) // 100)


def described(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, th (hash of the text where doc_id is null), n (set size), cid (class id), bits, head: the shingles in the head of the hash range, at least a prefix."""
    memo: list[WordHashes] = []

    def run(batch):
        memo or memo.append(WordHashes())
        out = {k: [] for k in ("n", "cid", "bits", "head")}
        for text in texts(batch):
            tokens = shingle_set(memo[0].array(text.lower().split()), width)
            size = max(int(np.searchsorted(tokens, head_limit(percent))), prefix_length(len(tokens), percent)) if len(tokens) else 0
            out["n"].append(len(tokens))
            out["cid"].append(class_id(tokens))
            out["bits"].append(parity_bits(tokens))
            out["head"].append(tokens[:size].view(np.int64))
        return {c: batch.column(c).to_pylist() for c in ("doc_id", "th")} | out

    return map_batches(doc_input(docs).withColumn("th", null_key()), run, f"doc_id {dict(docs.dtypes)['doc_id']}, th long, n long, cid long, bits array<long>, head array<long>")


def null_key() -> Column:
    """What names a row without doc_id: a hash of its text."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64(F.col("text").cast("binary")))


def with_prefixes(classes: DataFrame, common: DataFrame, percent: int) -> DataFrame:
    """cid, n, bits, prefix (in order), lead (its part for sets that are not smaller), gkey (of prefix and size). common: shingles that go behind the others of the head."""
    n_common = common.count()
    shared = None
    rows = classes.select("cid", "n", "bits", "head")
    if n_common <= ARRAY_ROWS:
        known = common.toArrow().column("token").to_numpy() if n_common else np.zeros(0, np.int64)  # its size has just been checked
        shared = classes.sparkSession.sparkContext.broadcast(np.sort(known))
    else:
        hits = rows.select("cid", F.explode("head").alias("token")).join(common, "token").groupBy("cid").agg(F.collect_set("token").alias("known"))
        rows = rows.join(hits, "cid", "left")

    def run(batch):
        heads, sizes, known = batch.column("head"), batch.column("n").to_pylist(), batch.column("known") if shared is None else None
        prefixes, keys = [], []
        for k, n in enumerate(sizes):
            head = np.asarray(heads[k].values)
            late = shared.value if known is None else np.sort(np.asarray(known[k].values if known[k].is_valid else [], np.int64))
            at = np.searchsorted(late, head)
            is_common = late[np.minimum(at, len(late) - 1)] == head if len(late) else np.zeros(len(head), bool)
            beyond = head.view(np.uint64) >= head_limit(percent)
            order = np.argsort(2 * beyond + (is_common & ~beyond), kind="stable")[: prefix_length(n, percent)]
            prefixes.append(head[order])
            keys.append(int(np.uint64(xxhash.xxh3_64_intdigest(np.sort(head[order]).tobytes(), n)).astype(np.int64)))
        leads = [index_length(n, percent) for n in sizes]
        return {"cid": batch.column("cid"), "n": batch.column("n"), "bits": batch.column("bits"), "prefix": prefixes, "lead": leads, "gkey": keys}

    return map_batches(rows, run, "cid long, n long, bits array<long>, prefix array<long>, lead int, gkey long")


def _apart(x: Column, y: Column) -> Column:
    """Hamming distance of two parity bitmaps; the larger is folded to the size of the smaller, where each bit is the parity of two or more."""
    words = BITS // 64
    plain = sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(words)), F.lit(0))
    size = F.least(F.size(x), F.size(y))
    fold = lambda z, k: F.aggregate(F.sequence(k, F.size(z) - 1, size), F.lit(0).cast("long"), lambda a, j: a.bitwiseXOR(F.get(z, j)))
    general = F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), lambda a, k: a + F.bit_count(fold(x, k).bitwiseXOR(fold(y, k))))
    return F.when((F.size(x) == words) & (F.size(y) == words), plain).otherwise(general)


def folded(bits: Column) -> Column:
    """A parity bitmap folded to a FOLD-th of its size, but not below BITS."""
    size = F.greatest(F.lit(BITS // 64), (F.size(bits) / FOLD).cast("int"))
    fold = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.aggregate(F.sequence(k, F.size(bits) - 1, size), F.lit(0).cast("long"), lambda a, j: a.bitwiseXOR(F.get(bits, j))))
    return F.when(F.size(bits) <= BITS // 64, bits).otherwise(fold)


def may_link(a: str, b: str, percent: int) -> Column:
    """Size filter and parity filter. No pair at or above the threshold fails them."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    fits = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    return F.when(fits, _apart(F.col(f"{a}.bits"), F.col(f"{b}.bits")) * (100 + percent) <= (100 - percent) * (na + nb)).otherwise(False)


def whole_sets(docs: DataFrame, wanted: DataFrame, width: int, few: bool) -> DataFrame:
    """cid, partner, tokens: the whole set of each class in wanted (doc_id, th, cid, partners), once for each partner."""
    memo: list[WordHashes] = []
    mine = wanted.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "cid", "partners")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("th").eqNullSafe(F.col("_th"))
    some = doc_input(docs).withColumn("th", null_key()).join(F.broadcast(mine) if few else mine, same).select("text", "cid", "partners")

    def run(batch):
        memo or memo.append(WordHashes())
        out = {"cid": [], "partner": [], "tokens": []}
        for text, cid, partners in zip(texts(batch), batch.column("cid").to_pylist(), batch.column("partners").to_pylist(), strict=True):
            tokens = shingle_set(memo[0].array(text.lower().split()), width)
            if class_id(tokens) == cid:  # rows that share a doc_id may differ in text
                out["cid"].extend([cid] * len(partners))
                out["partner"].extend(partners)
                out["tokens"].extend([tokens.view(np.int64)] * len(partners))
        return out

    return map_batches(some, run, "cid long, partner long, tokens array<long>")


def verified(docs: DataFrame, pairs: DataFrame, first_docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (u, v) of classes whose whole sets reach the threshold. The sets of v go to that of u: one shuffle."""
    few = pairs.count() <= BROADCAST_ROWS  # then what is broadcast has at most so many partners
    hubs = pairs.select(F.col("u").alias("cid")).distinct().withColumn("partners", F.array("cid"))
    rest = pairs.groupBy(F.col("v").alias("cid")).agg(F.collect_list("u").alias("partners"))
    a = whole_sets(docs, cut(hubs.join(first_docs, "cid").select("cid", "doc_id", "th", "partners")), width, few).select(F.col("cid").alias("u"), F.col("tokens").alias("a"))
    b = whole_sets(docs, cut(rest.join(first_docs, "cid").select("cid", "doc_id", "th", "partners")), width, few).select(F.col("partner").alias("u"), F.col("cid").alias("v"), F.col("tokens").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    return b.join(a, "u").where(100 * common >= percent * (F.size("a") + F.size("b") - common)).select("u", "v").distinct()


def ordered(u: Column, v: Column) -> list[Column]:
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def connected_classes(docs: DataFrame, described_docs: DataFrame, first_docs: DataFrame, width: int, percent: int) -> DataFrame:
    """u, v: classes and the least class of their component (u = v is left out)."""
    if percent >= 100:
        return docs.sparkSession.createDataFrame([], "u long, v long")  # only equal sets are linked, and those are one class
    least = -(-percent // (100 - percent)) or 1  # the smallest set that can be linked with another: one of n and one of n + 1 shingles
    copies = cut(first_docs.where("copies > 1").select(F.col("cid").alias("_cid"), F.col("doc_id").alias("_first"), F.col("th").alias("_th")))
    classes = described_docs.where(F.col("n") >= least).join(small(copies), F.col("cid") == F.col("_cid"), "left").where("_cid is null or (doc_id <=> _first and th <=> _th)").drop("_cid", "_first", "_th")
    if not copies.where("_th is not null").isEmpty():  # of equal rows without doc_id one stands for the class
        classes = classes.where("th is null").unionByName(classes.where("th is not null").dropDuplicates(["cid"]))
    common = cut(classes.select(F.explode("head").alias("token")).groupBy("token").count().where(F.col("count") > COMMON).select("token"))
    nodes = cut(with_prefixes(classes, common, percent))
    release(docs.sparkSession)

    grouped = nodes.groupBy("gkey").agg(F.min("cid").alias("gid"), F.count("*").alias("size")).where("size > 1").select("gkey", "gid")
    members = cut(nodes.select("gkey", "cid").join(grouped, "gkey").select("gid", "cid"))  # of groups of two and more
    others = cut(members.where("cid <> gid"))
    leaders = nodes.join(small(others.select("cid")), "cid", "left_anti")
    bucket = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    postings = leaders.select(F.posexplode("prefix").alias("pos", "token"), F.col("cid").alias("gid"), bucket.alias("b"), "lead").select("token", "gid", "b", (F.col("pos") < F.col("lead")).alias("leads"))
    met = cut(postings.groupBy("token").count().where("count > 1").select("token"))
    shared = cut(postings.join(small(met), "token", "left_semi"))
    release(docs.sparkSession)

    info = nodes.select("cid", "n", "bits")
    hubs = cut(shared.groupBy("token", "b").agg(F.min("gid").alias("hub"), F.count("*").alias("c")).where("c > 1").select("token", "b", "hub"))
    stars = shared.join(hubs, ["token", "b"]).where("gid <> hub").select(*ordered(F.col("hub"), F.col("gid")))
    stars = stars.unionByName(others.select(*ordered(F.col("gid"), F.col("cid")))).distinct()
    tested = cut(filtered(stars, info, percent))
    release(docs.sparkSession)
    links = cut(verified(docs, tested, first_docs, width, percent))
    labels = components(links)
    release(docs.sparkSession)

    lists = shared.select("token", "gid", "leads").join(small(members), "gid", "left").select("token", "leads", F.coalesce("cid", "gid").alias("cid"))
    lists = open_lists(lists.unionByName(members.select(F.col("gid").alias("token"), F.lit(True).alias("leads"), "cid")), labels)  # a group is a list too
    batch = cut(star_pairs(lists, info, labels, percent).join(tested, ["u", "v"], "left_anti"))
    if not batch.isEmpty():
        tested = cut(tested.unionByName(batch))
        new = cut(verified(docs, batch, first_docs, width, percent))
        release(docs.sparkSession)
        labels = components(labels.unionByName(new))
    release(docs.sparkSession)

    found = cut(untested_pairs(lists, info, labels, percent).join(tested, ["u", "v"], "left_anti"))
    most = 4
    while True:
        # Pairs of different components. Of those of two components some go first, as one link is enough.
        of = small(labels.select(F.col("u").alias("_n"), F.col("v").alias("_l")))
        named = found.join(of, F.col("u") == F.col("_n"), "left").withColumn("lu", F.coalesce("_l", "u")).drop("_n", "_l")
        named = named.join(of, F.col("v") == F.col("_n"), "left").withColumn("lv", F.coalesce("_l", "v")).drop("_n", "_l")
        fresh = named.where("lu <> lv").join(tested, ["u", "v"], "left_anti")
        part = F.pmod(F.xxhash64("u", "v"), F.lit(most))
        batch = cut(fresh.groupBy(F.least("lu", "lv"), F.greatest("lu", "lv"), part).agg(F.min(F.struct("u", "v")).alias("p")).select("p.u", "p.v"))
        del of, named, fresh
        release(docs.sparkSession)
        if batch.isEmpty():
            return labels
        new = cut(verified(docs, batch, first_docs, width, percent))
        tested = cut(tested.unionByName(batch))
        release(docs.sparkSession)
        labels = components(labels.unionByName(new))
        release(docs.sparkSession)
        most *= 16


def with_labels(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """lists with the component label of each cid."""
    of = small(labels.select(F.col("u").alias("_n"), F.col("v").alias("_l")))
    return lists.join(of, F.col("cid") == F.col("_n"), "left").withColumn("label", F.coalesce("_l", "cid")).drop("_n", "_l")


def open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Those lists (token, leads, cid) whose members are of more than one component (materialised)."""
    labelled = with_labels(lists, labels)
    open_ = cut(labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token"))
    return cut(lists.join(small(open_), "token", "left_semi"))


def brief(info: DataFrame) -> DataFrame:
    return info.select("cid", "n", folded(F.col("bits")).alias("bits"))


def filtered(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs u, v that pass the filters with their whole bitmaps."""
    return pairs.join(info.alias("x"), F.col("u") == F.col("x.cid")).join(info.alias("y"), F.col("v") == F.col("y.cid")).where(may_link("x", "y", percent)).select("u", "v")


def star_pairs(lists: DataFrame, info: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """u, v: members of long lists with the HUBS members of least hash, if of different components, that pass the filters."""
    labelled = with_labels(lists, labels)
    hub = lambda k: F.min(F.struct(F.xxhash64(F.lit(k), "cid").alias("h"), F.col("cid").alias("hub"), F.col("label").alias("hub_label")))
    sums = labelled.groupBy("token").agg(F.count("*").alias("members"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.array(*map(hub, range(HUBS))).alias("hubs"))
    long_ = sums.where((F.col("members") > COMMON) & (F.col("lo") != F.col("hi"))).select("token", F.explode(F.array_distinct(F.transform("hubs", lambda x: F.struct(x["hub"], x["hub_label"])))).alias("x"))
    hubs = small(cut(long_.select("token", F.col("x.hub").alias("cid"), F.col("x.hub_label").alias("label")).join(brief(info), "cid")))
    members = labelled.join(small(cut(hubs.select("token").distinct())), "token", "left_semi").join(brief(info), "cid")
    x, y = members.alias("x"), hubs.alias("y")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & F.when(F.col("x.label") != F.col("y.label"), may_link("x", "y", percent)).otherwise(False))
    return filtered(met.select(*ordered(F.col("x.cid"), F.col("y.cid"))).distinct(), info, percent)


def untested_pairs(lists: DataFrame, info: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """u, v: pairs of classes of different components that share a list and pass the filters.

    In each list the largest component is left out on one side, so a list that one component fills makes no pairs.
    """
    labelled = with_labels(lists, labels)
    sizes = labelled.groupBy("token", "label").count()
    majors = sizes.groupBy("token").agg(F.max_by("label", F.struct("count", "label")).alias("major"), F.count("*").alias("labels")).where("labels > 1").select("token", "major")
    active = labelled.join(small(cut(majors)), "token").join(brief(info), "cid").select("token", "leads", "cid", "label", "n", "bits", (F.col("label") != F.col("major")).alias("minor"))
    active = cut(active)
    x, y = active.where("minor").alias("x"), active.alias("y")
    # The shingle must stand in the index part of the smaller set, or of both if they are equally large.
    placed = (F.col("x.leads") | (F.col("x.n") > F.col("y.n"))) & (F.col("y.leads") | (F.col("y.n") > F.col("x.n")))
    once = ~F.col("y.minor") | (F.col("x.cid") < F.col("y.cid"))
    wanted = F.when(placed & once & (F.col("x.label") != F.col("y.label")), may_link("x", "y", percent)).otherwise(False)
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & wanted).select(*ordered(F.col("x.cid"), F.col("y.cid"))).distinct()
    return filtered(met, info, percent)


def labelled_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, th, n, cid, root (the class that names the component; null for empty sets), component (its least doc_id)."""
    made = cut(described(docs, width, percent))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    first_docs = cut(made.where("n > 0").groupBy("cid").agg(F.min(row).alias("r"), F.count("*").alias("copies")).select("cid", "r.doc_id", "r.th", "copies"))
    labels = connected_classes(docs, made, first_docs, width, percent)
    joined = labels.select(F.col("u").alias("cid"), F.col("v").alias("root")).unionByName(labels.select(F.col("v").alias("cid"), F.col("v").alias("root")).distinct())
    known = first_docs.join(joined, "cid", "left")
    least = known.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    named = known.where("root is not null or copies > 1").join(least, "root", "left").select(F.col("cid").alias("_cid"), "root", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component"))
    joined_rows = made.select("doc_id", "th", "n", "cid").join(named, (F.col("cid") == F.col("_cid")) & (F.col("n") > 0), "left")
    component = F.when(F.col("_cid").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return joined_rows.select("doc_id", "th", "n", "cid", F.when(F.col("n") > 0, F.coalesce("root", "cid")).alias("root"), component.alias("component"))


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links of at least `percent` % similarity reach."""
    return labelled_rows(docs, width, percent).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs with the row of the smallest doc_id of each component; of rows that share a doc_id, one.

    Of a component of rows without doc_id alone, a row with the least text hash stays; rows without doc_id and words all stay.
    """
    found = cut(labelled_rows(docs, width, percent))
    losers = found.where("doc_id <> component").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(small(cut(losers)), "doc_id", "left_anti")
    again = cut(found.where("doc_id = component").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not again.isEmpty():
        kept = kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    kept = kept.select(*docs.columns)
    nameless = found.where("doc_id is null")
    if nameless.isEmpty():
        return kept
    least = nameless.where("component is null and n > 0").groupBy("root").agg(F.min("th").alias("_th"))
    marked = docs.where("doc_id is null").select(F.struct(*docs.columns).alias("_d"), null_key().alias("th"))
    words = marked.join(nameless.where("n > 0").select("th").distinct(), "th", "left_anti")
    one = marked.join(least.select(F.col("_th").alias("th")).distinct(), "th", "left_semi").dropDuplicates(["th"])
    return kept.unionByName(words.unionByName(one).select("_d.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def oracle_ctes(docs: str = "documents", prefix: str = "") -> str:
    """A WITH RECURSIVE list that ends in {prefix}components(r, doc_id, n_shingles, component_id)."""
    return rf"""
{prefix}w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM {docs}),
{prefix}sets AS (
  SELECT DISTINCT r, array_to_string(w[i:i + {WIDTH} - 1], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - {WIDTH - 1}) + 1)) AS i FROM {prefix}w WHERE len(w) > 0)),
{prefix}sizes AS (SELECT r, count(*) AS n FROM {prefix}sets GROUP BY r),
{prefix}links AS (
  SELECT a.r AS x, b.r AS y FROM {prefix}sets a JOIN {prefix}sets b USING (s) JOIN {prefix}sizes na ON na.r = a.r JOIN {prefix}sizes nb ON nb.r = b.r
  GROUP BY a.r, b.r, na.n, nb.n HAVING 100 * count(*) >= {PERCENT} * (na.n + nb.n - count(*))),
{prefix}reach(x, y) AS (SELECT x, y FROM {prefix}links UNION SELECT c.x, l.y FROM {prefix}reach c JOIN {prefix}links l ON c.y = l.x),
{prefix}components AS (
  SELECT d.r, d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least_id, d.doc_id) AS component_id
  FROM {prefix}w d LEFT JOIN {prefix}sizes USING (r)
  LEFT JOIN (SELECT x AS r, min(o.doc_id) AS least_id FROM {prefix}reach JOIN {prefix}w o ON o.r = y GROUP BY x) USING (r))"""


def oracle() -> str:
    return f"WITH RECURSIVE {oracle_ctes()} SELECT doc_id, n_shingles, component_id FROM components"
