"""Components, break suggestions and communities of graphs against plain reimplementations."""

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import graph
from quarrylens.operators.series import estimated_bytes


def strong(edges):
    """node -> least node of its component, by searching forward and backward from each node."""
    out, into, nodes = defaultdict(set), defaultdict(set), {x for e in edges for x in e}
    for a, b in edges:
        out[a].add(b)
        into[b].add(a)

    def reach(start, links):
        seen, todo = {start}, [start]
        while todo:
            for y in links[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    label = {}
    for n in sorted(nodes):
        if n not in label:
            for m in reach(n, out) & reach(n, into):
                label[m] = n
    return label


def frame(spark, edges, kind="long"):
    return spark.createDataFrame(edges or [], f"src {kind}, dst {kind}").repartition(3)


GRAPHS = [
    [], [(1, 1)], [(1, 2)], [(1, 2), (2, 1)], [(k, (k + 1) % 50) for k in range(50)],
    [(k, (k + 1) % 30) for k in range(30)] + [(5, 100), (100, 101), (101, 102), (102, 100), (7, 40), (40, 41), (41, 12), (200, 3), (300, 301), (301, 41)],
    [(a, b) for a in range(8) for b in range(8)],
    [(k, k + 1) for k in range(60)] + [(k, k + 2) for k in range(60)] + [(60, 40), (20, 10)],
]


def together(graphs):
    """Graphs side by side: each with numbers of its own."""
    return [(1000 * k + a, 1000 * k + b) for k, edges in enumerate(graphs) for a, b in edges]


def randomly(seed, n, m):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def test_strong_components(spark):
    edges = together(GRAPHS)
    assert {r.node: r.component for r in graph.strong_components(frame(spark, edges)).collect()} == strong(edges)
    assert graph.strong_components(frame(spark, [])).count() == 0


@pytest.mark.parametrize("chained", [0.0])
def test_strong_components_of_random_graphs(spark, monkeypatch, chained):
    """Names as nodes; with chains always merged."""
    monkeypatch.setattr(graph, "CHAINED", chained)
    edges = together([randomly(1, 60, 70), randomly(2, 100, 130), randomly(3, 60, 200)])
    names = [(f"n{a}", f"n{b}") for a, b in edges]
    assert {r.node: r.component for r in graph.strong_components(frame(spark, names, "string")).collect()} == strong(names)


def test_long_ring_and_long_chain(spark):
    """Rounds do not grow with the length of chains."""
    n = 5_000
    ring = spark.range(n).select(F.col("id").alias("src"), F.pmod(F.col("id") * 7919 + 1, F.lit(n)).alias("dst"))
    whole = spark.range(n).select(F.col("id").alias("src"), F.pmod(F.col("id") + 1, F.lit(n)).alias("dst"))
    assert graph.strong_components(whole).where("component = 0").count() == n
    assert graph.strong_components(ring).count() == n
    chain = spark.range(20_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = graph.strong_components(chain)
    assert got.count() == 20_001 and got.where("node <> component").isEmpty()


def test_feedback_edges(spark):
    """What is left has no cycle, nothing outside components is cut, a ring is cut once."""
    edges = together([*GRAPHS, randomly(6, 60, 110)])
    cut = [(r.src, r.dst) for r in graph.feedback_edges(frame(spark, edges)).collect()]
    label = strong(edges)
    assert len(cut) == len(set(cut)) and set(cut) <= set(edges) and all(label[a] == label[b] for a, b in cut)
    left = [e for e in set(edges) if e not in set(cut)]
    nodes = spark.createDataFrame([(x,) for x in {x for e in edges for x in e}], "node long")
    assert graph.topological_levels(frame(spark, left), nodes).where("layer IS NULL").isEmpty()
    assert all(a != b for a, b in left) and sum(4000 <= a < 5000 for a, _ in cut) == 1


def test_cycle_breaks(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "x"), ("b", "x"), ("b", "y"), ("d", "d"), ("e", "f"), ("f", "e")]
    got = {tuple(r.path): (r.src, r.dst, r.dependencies, r.reason) for r in graph.cycle_breaks(frame(spark, edges, "string")).collect()}
    assert got == {
        ("a", "b", "c", "a"): ("c", "a", 1, "Source has only 1 dependencies"), ("d", "d"): ("d", "d", 1, "Source has only 1 dependencies"), ("e", "f", "e"): ("e", "f", 1, "Source has only 1 dependencies")
    }


def plain_communities(edges):
    """The same rules, one node at a time over frozen communities."""
    links = defaultdict(lambda: defaultdict(int))
    for a, b in edges:
        if a != b:
            links[a][b] = links[b][a] = 1
    total, member = sum(map(len, links.values())), {n: n for n in links}
    first = {a: dict(x) for a, x in links.items()}

    def score(links, comm):
        weight = defaultdict(int)
        for a, x in links.items():
            weight[comm[a]] += sum(x.values())
        return total * sum(w for a, x in links.items() for b, w in x.items() if comm[a] == comm[b]) - sum(w * w for w in weight.values())

    while True:
        comm, k = {n: n for n in links}, {n: sum(x.values()) for n, x in links.items()}
        before = best = score(links, comm)
        idle = turn = 0
        while idle < 2:
            weight, size, new = defaultdict(int), defaultdict(int), {}
            for n in links:
                weight[comm[n]] += k[n]
                size[comm[n]] += 1
            for n, x in links.items():
                kin = defaultdict(int)
                for b, w in x.items():
                    if b != n:
                        kin[comm[b]] += w
                own = comm[n]
                gain = lambda c: total * kin.get(c, 0) - k[n] * (weight[c] - (k[n] if c == own else 0))  # noqa: B023, E731
                free = [(-gain(c), c) for c in kin if c != own and not (size[c] == size[own] == 1 and c > own)]
                new[n] = min(free)[1] if free and -min(free)[0] > gain(own) and zlib.crc32(str(n).encode()) % 2 == turn % 2 else own
            reached = score(links, new)
            comm, best, idle = (new, reached, 0) if reached > best else (comm, best, idle + 1)
            turn += 1
        if best == before:
            break
        least = {c: min(n for n in comm if comm[n] == c) for c in set(comm.values())}
        member = {n: least[comm[c]] for n, c in member.items()}
        merged = defaultdict(lambda: defaultdict(int))
        for a, x in links.items():
            for b, w in x.items():
                merged[least[comm[a]]][least[comm[b]]] += w
        links = merged
    return member, score(first, member) / total**2, best / total**2


def planted(seed, groups, size, inner, outer):
    rng = random.Random(seed)
    n = groups * size
    edges = [(a, b) for a in range(n) for b in range(a) if rng.random() < (inner if a % groups == b % groups else outer)]
    return edges + [(n, n + 1), (n + 1, n + 2), (n + 2, n), (n + 5, n + 6), (3, 3)]


def test_communities(spark):
    """Small, as each round is a handful of Spark jobs."""
    edges = planted(2, 3, 6, 0.7, 0.05) + [(100, k) for k in range(101, 106)]
    want, score, best = plain_communities(edges)
    df = frame(spark, edges)
    found = graph.communities(df)
    assert {r.node: r.community for r in found.collect()} == want and abs(score - best) < 1e-12
    assert abs(graph.modularity(df, found).first()[0] - score) < 1e-12


def test_walks_read_their_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(x):
        read.add(1)
        return x

    edges = spark.range(6).select(F.col("id").alias("src"), F.udf(counted, "long").asNondeterministic()(F.col("id") + 1).alias("dst"))
    nodes = spark.range(8).select(F.col("id").alias("node"))
    for walk, rows in ((lambda: graph.depths(edges, nodes), 8), (lambda: graph.closure(edges), 21), (lambda: graph.shortest_paths(edges, 0), 7), (lambda: graph.topological_levels(edges, nodes), 8)):
        before = read.value
        assert walk().count() == rows and read.value - before == 6


def test_estimates_do_not_grow_with_rounds(spark):
    """What a round leaves has the size of its rows, not a product of the sizes of all rounds before."""
    ring = spark.range(64).select(F.col("id").alias("src"), F.pmod(F.col("id") + 1, F.lit(64)).alias("dst"))
    _, on_cycle, (hops, rooted, _) = graph._without_chains(graph._links(ring))
    assert len(hops) == 7 and on_cycle.count() == 64 and rooted.isEmpty()
    assert max(map(estimated_bytes, hops)) < 1 << 20
