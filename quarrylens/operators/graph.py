"""Graphs as edge tables (src, dst): reachability, depth, cycles, components, coupling. Walks are level by level and joined, not recursive on the driver."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.series import stored as _stored

#: Levels after which what a walk has found is put together anew, so that plans do not grow with its length.
GATHER_LEVELS = 16
#: Share of nodes of one outgoing link from which merging chains is worth its rounds.
CHAINED = 0.6


def _links(edges: DataFrame) -> DataFrame:
    """src, dst, each once (materialised): what edges are made of is read once, not again in each step of a walk."""
    return _stored(edges.select("src", "dst").distinct())


def levels(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """origin, node, level: breadth first from each start (origin, node) along the edges; a node has the level of its first visit."""
    return _levels(_links(edges), starts)


def _levels(links: DataFrame, starts: DataFrame) -> DataFrame:
    frontier = _stored(starts.select("origin", "node").distinct().withColumn("level", F.lit(0)))
    seen = frontier
    for level in itertools.count(1):  # ends, as each level has nodes not seen before
        step = frontier.join(links, frontier["node"] == links["src"]).select("origin", F.col("dst").alias("node")).distinct()
        frontier = _stored(step.join(seen, ["origin", "node"], "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if level % GATHER_LEVELS == 0:
            seen = _stored(seen.repartition("origin", "node"))
    return seen


def closure(edges: DataFrame) -> DataFrame:
    """Src, dst of all pairs joined by a path of one edge or more."""
    links = _links(edges)
    first = links.select(F.col("src").alias("origin"), F.col("dst").alias("node"))
    return _levels(links, first).select(F.col("origin").alias("src"), F.col("node").alias("dst"))


def callees(edges: DataFrame) -> DataFrame:
    """For each service all that it calls, directly or not."""
    return closure(edges).select(F.col("src").alias("service"), F.col("dst").alias("callee"))


def callers(edges: DataFrame) -> DataFrame:
    """For each service all that call it."""
    return closure(edges).select(F.col("dst").alias("service"), F.col("src").alias("caller"))


def depths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node, depth: steps from the nearest node that no edge enters; -1 if there is no way."""
    links, nodes = _links(edges), _stored(nodes.select("node").distinct())
    roots = nodes.join(links.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    seen = _levels(links, roots.withColumn("origin", F.lit(0))).groupBy("node").agg(F.min("level").alias("depth"))
    return nodes.join(seen, "node", "left").select("node", F.coalesce("depth", F.lit(-1)).alias("depth"))


def _trimmed(links: DataFrame) -> DataFrame:
    """links without the nodes that no link enters or leaves, again as long as a quarter of the links goes with them."""
    n = links.count()
    while n:
        links = _stored(links.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(links.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        before, n = n, links.count()
        if n > 0.75 * before:
            break
    return links


def _without_chains(links: DataFrame) -> tuple[DataFrame, DataFrame | None, tuple | None]:
    """links with all nodes of one outgoing link merged into the first of several (or none) behind them; node, mark of the cycles
    such nodes make among themselves; what _unchained needs.

    Where a chain ends is found by doubling: after k rounds a pointer is 2^k links long, or stands at the end of its chain. A
    pointer that never stands still leads into a cycle, and after as many links as there are nodes it is on it.
    """
    degree = _stored(links.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("to")))
    single = degree.where("n = 1").select(F.col("src").alias("node"), "to")
    n, every = degree.agg(F.count_if(F.col("n") == 1), F.count("*")).first()
    if n < CHAINED * every or not n:
        return links, None, None
    hops = [_stored(single.withColumn("least", F.col("node")))]
    inside = hops[0].join(single.select(F.col("node").alias("to")), "to", "left_semi")
    while 1 << (len(hops) - 1) < n and not inside.isEmpty():
        far = hops[-1].select(F.col("node").alias("to"), F.col("to").alias("far"), F.col("least").alias("far_least"))
        hops.append(_stored(hops[-1].join(far, "to", "left").select("node", F.coalesce("far", "to").alias("to"), F.least("least", "far_least").alias("least"))))
        inside = hops[-1].join(single.select(F.col("node").alias("to")), "to", "left_semi")
    endless = _stored(inside)
    rooted = _stored(hops[-1].select("node", F.col("to").alias("root")).join(endless.select("node"), "node", "left_anti"))
    on_cycle = endless.select(F.col("to").alias("node")).distinct().join(hops[-1].select("node", F.col("least").alias("mark")), "node")
    rest = links.join(single.select(F.col("node").alias("src")), "src", "left_anti").join(endless.select(F.col("node").alias("dst")), "dst", "left_anti")
    rest = _stored(rest.join(rooted.withColumnRenamed("node", "dst"), "dst", "left").select("src", "dst", "root"))
    merged = _stored(rest.select("src", F.coalesce("root", "dst").alias("dst")).where("src <> dst").distinct())
    return merged, on_cycle, (hops, rooted, rest.where("root IS NOT NULL"))


def _unchained(marks: DataFrame, chain: tuple) -> DataFrame:
    """marks (node, mark) with those of merged nodes: of a chain, what is behind a link from the component of the chain's end."""
    hops, rooted, entries = chain
    of = lambda c: marks.select(F.col("node").alias(c), F.col("mark").alias(f"{c}_mark"))
    known = entries.join(of("src"), "src", "left").join(of("root"), "root", "left").where(F.coalesce("src_mark", "src") == F.coalesce("root_mark", "root"))
    met = _stored(known.select(F.col("dst").alias("node")).distinct())
    for hop in hops:
        met = _stored(met.unionByName(met.join(hop, "node").select(F.col("to").alias("node"))).distinct())
    inner = met.join(rooted, "node").join(of("root"), "root", "left").select("node", F.coalesce("root_mark", "root").alias("mark"))
    return _stored(marks.unionByName(inner).repartition("node"))  # else partitions add up


def _coloured(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links that are left, and node, mark of the components found: each node takes the greatest node that reaches it as its
    colour, and of a colour those nodes are one component from which its own node can be reached."""
    nodes = links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).distinct()
    colour = _stored(nodes.withColumn("colour", F.col("node")))
    while True:  # ends, as colours only grow
        near = links.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("near"))
        new = _stored(colour.join(near, "node", "left").select("node", F.greatest("colour", "near").alias("colour"), (F.col("near") > F.col("colour")).alias("moved")))
        colour = new.select("node", "colour")
        if new.where("moved").isEmpty():
            break
    both = links.join(colour.select(F.col("node").alias("src"), "colour"), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("dst_colour")), "dst")
    inner = _stored(both.where("colour = dst_colour").select("src", "dst", "colour"))
    frontier = _stored(colour.where("node = colour").select("node", F.col("colour").alias("mark")))
    found = frontier
    for level in itertools.count(1):  # ends, as each level has nodes not found before
        step = inner.join(frontier.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), F.col("colour").alias("mark")).distinct()
        frontier = _stored(step.join(found, "node", "left_anti"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
        if level % GATHER_LEVELS == 0:
            found = _stored(found.repartition("node"))
    found = _stored(found)
    left = inner.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti")
    return _stored(left.select("src", "dst")), found


def strong_components(edges: DataFrame) -> DataFrame:
    """Node, component: the least node of its strongly connected component; nodes on no cycle are their own.

    Nodes without a way in or out are trimmed, chains are merged (in both directions in turn), and what resists is coloured forward
    and searched backward. Each step shuffles the links that are left a few times; long rings and chains take logarithmic rounds,
    the rest as many as its paths are long.
    """
    return _strong_components(_links(edges))


def _strong_components(every: DataFrame) -> DataFrame:
    """strong_components of materialised links."""
    nodes = every.select(F.col("src").alias("node")).unionByName(every.select(F.col("dst").alias("node"))).distinct()
    links = every.where("src <> dst")
    marks, chains = nodes.limit(0).withColumn("mark", F.col("node")), []
    n = links.count()
    while n:
        links = _trimmed(links)
        for _ in ("forward", "backward"):
            links, found, chain = _without_chains(links)
            if chain is not None:
                marks = marks.unionByName(found)
                chains.append(chain)
            links = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))  # components are the same backward
        before, n = n, links.count()
        if n > 0.7 * before:
            links, found = _coloured(links)
            marks = marks.unionByName(found)
            n = links.count()
    marks = _stored(marks.repartition("node"))
    for chain in reversed(chains):
        marks = _unchained(marks, chain)
    marked = _stored(nodes.join(marks, "node", "left").select("node", F.coalesce("mark", "node").alias("mark")))
    least = marked.groupBy("mark").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1").drop("n")
    return marked.join(least, "mark", "left").select("node", F.coalesce("component", "node").alias("component"))


def _inner_links(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """src, dst, component of the (materialised) links inside strongly connected components, loops left out; node, component."""
    part = _stored(_strong_components(every))
    links = every.where("src <> dst")
    both = links.join(part.select(F.col("node").alias("src"), "component"), "src").join(part.select(F.col("node").alias("dst"), F.col("component").alias("_other")), "dst")
    return _stored(both.where("component = _other").select("src", "dst", "component")), part


def feedback_edges(edges: DataFrame) -> DataFrame:
    """Src, dst, component, dependencies (of src): links whose removal leaves no cycle; loops are among them.

    In each component the link to break first leaves the node with the fewest dependencies (then the least), towards the least
    of its targets. From that target on, nodes are ordered by their distance, then by name, and links against the order are cut.
    Of these, links that go to a later layer of what is left come back, as such links close no cycle.
    """
    every = _links(edges)
    inner, part = _inner_links(every)
    degree = _stored(every.groupBy("src").agg(F.count("*").alias("dependencies")))
    first = inner.join(degree, "src").groupBy("component").agg(F.min(F.struct("dependencies", "src", "dst")).alias("first"))
    starts = first.select(F.col("component").alias("origin"), F.col("first.dst").alias("node"))
    place = _stored(_levels(inner.select("src", "dst"), starts).select("node", "level"))
    at = lambda c: place.select(F.col("node").alias(c), F.struct("level", "node").alias(f"{c}_at"))
    placed = _stored(inner.join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", "component", (F.col("src_at") > F.col("dst_at")).alias("against")))
    layer = _stored(topological_levels(placed.where("NOT against"), place.select("node")))
    by = lambda c: layer.select(F.col("node").alias(c), F.col("layer").alias(f"{c}_layer"))
    cut = placed.where("against").join(by("src"), "src").join(by("dst"), "dst").where("src_layer >= dst_layer").select("src", "dst", "component")
    loops = every.where("src = dst").join(part.withColumnRenamed("node", "src"), "src").select("src", "dst", "component")
    return cut.unionByName(loops).join(degree, "src").select("src", "dst", "component", "dependencies")


def cycle_breaks(edges: DataFrame) -> DataFrame:
    """For each simple cycle (path) the link to remove: the one whose source has the fewest dependencies, the first from the
    cycle's least node on ties; src, dst, dependencies, reason."""
    links = _links(edges)
    degree = links.groupBy("src").agg(F.count("*").alias("dependencies"))
    steps = _cycles(links).select("path", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("at", "src")).withColumn("dst", F.col("path")[F.col("at") + 1])
    best = steps.join(degree, "src").groupBy("path").agg(F.min(F.struct("dependencies", "at", "src", "dst")).alias("b"))
    return best.select("path", "b.src", "b.dst", "b.dependencies", F.concat(F.lit("Source has only "), F.col("b.dependencies").cast("string"), F.lit(" dependencies")).alias("reason"))


def cycles(edges: DataFrame) -> DataFrame:
    """Simple cycles of any length, each once, from its least node; severity by length. Only edges inside a strongly
    connected component are walked; in a dense component the number of cycles itself grows exponentially."""
    return _cycles(_links(edges))


def _cycles(every: DataFrame) -> DataFrame:
    """cycles of materialised links."""
    links = _stored(_inner_links(every)[0].select("src", "dst").unionByName(every.where("src = dst")))
    paths = links.where("dst >= src").select(F.array("src", "dst").alias("path"))
    found = paths.where(F.col("path")[0] == F.col("path")[1])
    while True:  # ends, as simple paths are no longer than a component
        open_ = paths.where(F.col("path")[0] != F.element_at("path", -1))
        step = open_.join(links, F.element_at("path", -1) == F.col("src")).where((F.col("dst") == F.col("path")[0]) | ((F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst"))))
        paths = _stored(step.select(F.array_append("path", F.col("dst")).alias("path")))
        closed = paths.where(F.col("path")[0] == F.element_at("path", -1))
        found = found.unionByName(closed)
        if paths.isEmpty():
            break
    length = F.size("path") - 1
    return found.select("path", length.alias("length"), F.when(length <= 2, "critical").when(length <= 3, "high").when(length <= 5, "medium").otherwise("low").alias("severity"))


def shortest_paths(edges: DataFrame, start: object) -> DataFrame:
    """Node, distance from one start."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    one = spark.range(1).select(F.lit(start).cast(kind).alias("node"), F.lit(0).alias("origin"))
    return levels(edges, one).select("node", F.col("level").alias("distance"))


def topological_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node, layer: nodes whose sources are all in earlier layers; those on cycles or behind them come last, layer null."""
    left = _stored(nodes.select("node").distinct())
    links = _links(edges.where("src <> dst"))
    done = None
    for layer in itertools.count():  # ends, as each layer takes nodes away
        blocked = links.join(left.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        free = _stored(left.join(blocked, "node", "left_anti").withColumn("layer", F.lit(layer)))
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        if layer % GATHER_LEVELS == GATHER_LEVELS - 1:
            done = _stored(done.repartition("node"))
        left = _stored(left.join(free, "node", "left_anti"))
    rest = left.withColumn("layer", F.lit(None).cast("int"))
    return rest if done is None else done.unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """Node, component: the least node that edges reach in either direction, by repeated minima along edges and labels."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = _stored(both)
    label = _stored(both.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:  # ends, as labels only fall
        near = both.join(label, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("m")).withColumnRenamed("src", "node")
        down = label.join(near, "node", "left").select("node", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        jump = down.join(down.select(F.col("node").alias("component"), F.col("component").alias("up")), "component", "left").select("node", F.least("component", "up").alias("component"), "was")
        new = _stored(jump)
        moved = not new.where("component <> was").isEmpty()
        label = new.drop("was")
        if not moved:
            break
    return label


def _parity(node: Column) -> Column:
    return F.pmod(F.crc32(node.cast("string").cast("binary")), F.lit(2))


def _wide(c: Column | str) -> Column:
    """A sum of weights as a decimal, of which a product of two is exact."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def _modularity_sum(links: DataFrame, comm: DataFrame, total: int) -> int:
    """total * (weight inside communities) - (sum of squared weights of communities): modularity times total squared. Exact."""
    both = links.join(comm.select(F.col("node").alias("src"), F.col("c").alias("a")), "src").join(comm.select(F.col("node").alias("dst"), F.col("c").alias("b")), "dst")
    inside = both.where("a = b").agg(F.sum("w")).first()[0] or 0
    squares = both.groupBy("a").agg(_wide(F.sum("w")).alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0] or 0
    return total * int(inside) - int(squares)


def _moved(links: DataFrame, comm: DataFrame, total: int, parity: int) -> DataFrame:
    """comm (node, c, k) after the nodes of one parity have moved to the neighbouring community of greatest gain, if it is greater
    than that of staying; ties go to the least community. Two single nodes only meet at the lesser one."""
    sums = _stored(comm.groupBy("c").agg(F.sum("k").alias("t"), F.count("*").alias("size")))
    outer = links.where("src <> dst")
    near = outer.join(comm.select(F.col("node").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("node"), "c").agg(F.sum("w").alias("kin"))
    near = near.join(sums, "c").join(comm.select("node", F.col("c").alias("own"), "k").join(sums.select(F.col("c").alias("own"), F.col("size").alias("own_size")), "own"), "node")
    gain = F.lit(total).cast("decimal(19,0)") * _wide("kin") - _wide("k") * (_wide("t") - F.when(F.col("c") == F.col("own"), _wide("k")).otherwise(_wide(F.lit(0)))).cast("decimal(19,0)")
    valued = near.withColumn("gain", gain.cast("decimal(38,0)"))
    # A node without a link into its own community would gain -k * (t - k) by staying.
    own = F.max(F.when(F.col("c") == F.col("own"), F.col("gain")))
    free = (F.col("c") != F.col("own")) & ~((F.col("size") == 1) & (F.col("own_size") == 1) & (F.col("c") > F.col("own")))
    best = F.min(F.when(free, F.struct((-F.col("gain")).alias("less"), F.col("c").alias("c"))))
    picked = valued.groupBy("node").agg(own.alias("stay"), best.alias("best"))
    ready = comm.join(sums.select("c", "t"), "c").join(picked, "node", "left")
    stay = F.coalesce(F.col("stay"), (-_wide("k") * (_wide(F.col("t") - F.col("k")))).cast("decimal(38,0)"))
    goes = F.coalesce((_parity(F.col("node")) == parity) & (-F.col("best.less") > stay), F.lit(False))
    return ready.select("node", F.when(goes, F.col("best.c")).otherwise(F.col("c")).alias("c"), "k")


def communities(edges: DataFrame) -> DataFrame:
    """Node, community: the least node of its community, by parallel modularity optimisation on the undirected graph.

    Level by level: nodes of one parity (of the CRC-32 of their name) move at a time, each to the neighbouring community with the greatest gain; a round counts if it raises
    the modularity; after two rounds that do not, communities become the nodes of the next level. If the plain connected components
    have the greater modularity, they are the answer. All gains are whole numbers, so reruns agree; loops do not count.
    """
    pairs = _links(edges.where("src <> dst"))
    links = _stored(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("w", F.lit(1).cast("long")))
    total = links.count()
    nodes = links.select(F.col("src").alias("node")).distinct()
    member = _stored(nodes.withColumn("community", F.col("node")))
    first, best = links, None
    while total:
        comm = _stored(links.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).select("node", F.col("node").alias("c"), "k"))
        before = score = _modularity_sum(links, comm, total)
        idle = 0
        for turn in itertools.count():  # ends, as the score grows and is bounded
            new = _stored(_moved(links, comm, total, turn % 2))
            reached = _modularity_sum(links, new, total)
            if reached > score:
                comm, score, idle = new, reached, 0
            elif (idle := idle + 1) == 2:
                break
        best = score
        if score == before:
            break
        named = _stored(comm.join(comm.groupBy("c").agg(F.min("node").alias("to")), "c").select("node", "to"))
        member = _stored(member.join(named.withColumnRenamed("node", "community"), "community").select("node", F.col("to").alias("community")))
        end = lambda c, x: named.select(F.col("node").alias(c), F.col("to").alias(x))
        links = _stored(links.join(end("src", "a"), "src").join(end("dst", "b"), "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
    if not total:
        return member
    whole = _stored(components(pairs).select("node", F.col("component").alias("community")))
    return whole if _modularity_sum(first, whole.withColumnRenamed("community", "c"), total) > best else member


def modularity(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row, modularity of a partition (node, community) of the undirected graph."""
    pairs = _links(edges.where("src <> dst"))
    links = _stored(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("w", F.lit(1).cast("long")))
    total = links.count()
    score = _modularity_sum(links, parts.withColumnRenamed("community", "c"), total) / (total * total) if total else 0.0
    return edges.sparkSession.range(1).select(F.lit(score).alias("modularity"))


def coupling(edges: DataFrame) -> DataFrame:
    """H8, H9: in and out degree of each node and its instability; stable below .2, unstable above .8."""
    links = _links(edges.where("src <> dst"))
    out = links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("ce"))
    into = links.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ca"))
    made = out.join(into, "node", "full").select("node", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("ce", F.lit(0)).alias("ce"))
    made = made.withColumn("instability", F.col("ce") / (F.col("ca") + F.col("ce")))
    return made.withColumn("category", F.when(F.col("instability") < 0.2, "stable").when(F.col("instability") > 0.8, "unstable").otherwise("balanced"))


def layer_violations(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Edges from a lower layer to a higher one. layers: node, rank (0 is the top, which may use all below)."""
    a, b = layers.select(F.col("node").alias("src"), F.col("rank").alias("src_rank")), layers.select(F.col("node").alias("dst"), F.col("rank").alias("dst_rank"))
    return edges.join(a, "src").join(b, "dst").where("src_rank > dst_rank").select("src", "dst", "src_rank", "dst_rank")
