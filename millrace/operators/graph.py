"""Graph operators over edge tables (src, dst): loops of joins and aggregations, each round written, one scalar of convergence a round."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.state import written


def edge_list(calls: DataFrame, src: str, dst: str) -> DataFrame:
    """src, dst, weight: calls counted by pair, without loops."""
    return calls.where(F.col(src) != F.col(dst)).groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.count("*").alias("weight"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree over distinct edges."""
    e = edges.select("src", "dst").distinct()
    both = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def stats(edges: DataFrame) -> DataFrame:
    """nodes, edges, avg_degree, max_degree, density (edges / n(n-1))."""
    d = degrees(edges)
    n, e = F.count("*"), F.sum("out_degree")
    return d.agg(n.alias("nodes"), e.alias("edges"), F.round(F.avg(F.col("out_degree") + F.col("in_degree")), 6).alias("avg_degree"), F.max(F.col("out_degree") + F.col("in_degree")).alias("max_degree"), F.round(e / F.greatest(n * (n - 1), F.lit(1)), 6).alias("density"))


def cross_class_edges(edges: DataFrame, labels: DataFrame, top: int = 5, skip: str = "Other") -> DataFrame:
    """from_class, to_class, weight, gateways (the top sources by weight): edges between different classes. labels: node, class."""
    a, b = labels.withColumnsRenamed({"node": "src", "class": "from_class"}), labels.withColumnsRenamed({"node": "dst", "class": "to_class"})
    e = edges.join(a, "src").join(b, "dst").where((F.col("from_class") != F.col("to_class")) & (F.col("from_class") != skip) & (F.col("to_class") != skip))
    by = e.groupBy("from_class", "to_class", "src").agg(F.sum("weight").alias("w"))
    from millrace.functions.semantics import top_n

    best = top_n(by, ["from_class", "to_class"], top, F.desc("w"), F.col("src")).groupBy("from_class", "to_class").agg(F.sort_array(F.collect_list(F.struct("rank", "src"))).alias("g"))
    return by.groupBy("from_class", "to_class").agg(F.sum("w").alias("weight")).join(best.select("from_class", "to_class", F.col("g.src").alias("gateways")), ["from_class", "to_class"])


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tol: float = 1e-6, nodes: DataFrame | None = None) -> DataFrame:
    """node, rank: uniform start, distinct edges, the mass of nodes without edges out spread evenly; ends at an L1 change below tol (0: after rounds)."""
    e = written(edges.select("src", "dst").distinct())
    out = e.groupBy("src").agg(F.count("*").alias("out"))
    v = written((nodes if nodes is not None else nodes_of(e)).select("node").distinct().join(out.withColumnRenamed("src", "node"), "node", "left"))
    n = v.count()
    ranks = v.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds if n else 0):
        sent = e.join(ranks.where("out IS NOT NULL").select(F.col("node").alias("src"), (F.col("rank") / F.col("out")).alias("part")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("part").alias("got"))
        dangling = ranks.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("d")).first().d
        value = F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(dangling / n))
        new = written(ranks.join(sent, "node", "left").select("node", "out", value.alias("rank"), F.abs(value - F.col("rank")).alias("moved")))
        ranks = new.drop("moved")
        if tol and new.agg(F.sum("moved")).first()[0] < tol:
            break
    return ranks.select("node", "rank")


def hits(edges: DataFrame, rounds: int = 50, tol: float = 1e-6) -> DataFrame:
    """node, hub, authority: both from the old vectors, L2 norms."""
    e = written(edges.select("src", "dst").distinct())
    s = written(nodes_of(e).withColumns({"hub": F.lit(1.0), "authority": F.lit(1.0)}))
    for _ in range(rounds):
        a = e.join(s.select(F.col("node").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("hub").alias("a"))
        h = e.join(s.select(F.col("node").alias("dst"), "authority"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("authority").alias("h"))
        new = written(s.join(a, "node", "left").join(h, "node", "left").select("node", "hub", "authority", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("h", F.lit(0.0)).alias("h")))
        norm = new.agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("a"), F.sqrt(F.sum(F.col("h") * F.col("h"))).alias("h")).first()
        if not norm.a or not norm.h:
            break
        s2 = new.select("node", (F.col("h") / norm.h).alias("h2"), (F.col("a") / norm.a).alias("a2"), "hub", "authority")
        moved = s2.agg(F.sum(F.abs(F.col("h2") - F.col("hub")) + F.abs(F.col("a2") - F.col("authority")))).first()[0]
        s = s2.select("node", F.col("h2").alias("hub"), F.col("a2").alias("authority"))
        if moved < tol:
            break
    return s


def bfs_depth(edges: DataFrame, roots: DataFrame, limit: int = 200) -> DataFrame:
    """node, depth: fewest steps from any root (column node), up to limit."""
    e = written(edges.select("src", "dst").distinct())
    seen = written(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for d in range(1, limit + 1):
        step = e.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = written(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)))
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier) if d % 8 else written(seen.unionByName(frontier))
    return seen


def roots_of(edges: DataFrame) -> DataFrame:
    """Nodes without edges in."""
    return degrees(edges).where("in_degree = 0").select("node")


def closure(edges: DataFrame) -> DataFrame:
    """src, dst: everything that each node reaches, itself excluded. What is new joins all that is known on either side, so that rounds are as many as the logarithm of the longest way."""
    known = new = written(edges.select("src", "dst").where("src <> dst").distinct())
    while True:
        after = new.select("src", F.col("dst").alias("via")).join(known.select(F.col("src").alias("via"), "dst"), "via")
        before = known.select("src", F.col("dst").alias("via")).join(new.select(F.col("src").alias("via"), "dst"), "via")
        step = after.unionByName(before).select("src", "dst").where("src <> dst").distinct()
        new = written(step.join(known, ["src", "dst"], "left_anti"))
        if not new.limit(1).count():
            return known
        known = written(known.unionByName(new))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component: the smallest node reachable over edges in either direction. Hooking to the smallest grandparent and shortcuts."""
    e = written(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    p = written(e.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("f"), F.col("node").alias("gf")))
    while True:
        least = e.join(p.select(F.col("node").alias("dst"), "gf"), "dst").groupBy("src").agg(F.min("gf").alias("m"))
        own = p.join(least, p.node == least.src)
        up = own.select("node", F.least("f", "gf", "m").alias("f")).unionByName(own.select(F.col("f").alias("node"), F.col("m").alias("f"))).groupBy("node").agg(F.min("f").alias("f"))
        new = written(up.join(up.select(F.col("node").alias("f"), F.col("f").alias("gf")), "f").join(p.select("node", F.col("gf").alias("was")), "node").select("node", "f", "gf", (F.col("gf") != F.col("was")).alias("moved")))
        p = new.drop("moved")
        if not new.where("moved").limit(1).count():
            break
    out = p.select("node", F.col("gf").alias("component"))
    return out if nodes is None else nodes.select("node").distinct().join(out, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def scc(edges: DataFrame) -> DataFrame:
    """node, component: strongly connected components of more than one node, named by their smallest node.

    Forward colours: the smallest node that reaches each node. In a colour, what reaches the colour's node backwards is its component.
    Assigned nodes leave, until nothing is left that lies on a cycle.
    """
    e = written(trimmed(edges.select("src", "dst").where("src <> dst").distinct()))
    done: DataFrame | None = None
    while e.limit(1).count():
        colour = written(nodes_of(e).withColumn("colour", F.col("node")))
        while True:  # smallest ancestor
            got = e.join(colour.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("m"))
            new = written(colour.join(got, "node", "left").select("node", F.least("colour", "m").alias("colour"), (F.coalesce("m", "colour") < F.col("colour")).alias("moved")))
            colour = new.drop("moved")
            if not new.where("moved").limit(1).count():
                break
        inside = e.join(colour.withColumnsRenamed({"node": "src", "colour": "c"}), "src").join(colour.withColumnsRenamed({"node": "dst", "colour": "d"}), "dst").where("c = d").select("src", "dst", "c")
        inside = written(inside)
        back = frontier = written(colour.where("node = colour"))
        while True:
            step = inside.join(frontier.select(F.col("node").alias("dst"), F.col("colour").alias("c")), ["dst", "c"]).select(F.col("src").alias("node"), F.col("c").alias("colour")).distinct()
            frontier = written(step.join(back, ["node", "colour"], "left_anti"))
            if not frontier.limit(1).count():
                break
            back = written(back.unionByName(frontier))
        found = back.select("node", F.col("colour").alias("component"))
        done = found if done is None else done.unionByName(found)
        left = e.join(back.select(F.col("node").alias("src")), "src", "left_anti").join(back.select(F.col("node").alias("dst")), "dst", "left_anti")
        e = written(trimmed(left))
    if done is None:
        return nodes_of(edges).limit(0).withColumn("component", F.col("node"))
    size = done.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return done.join(size, "component", "left_semi").select("node", "component")


def trimmed(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Edges without some that cannot lie on a cycle: their source has none in or their target none out."""
    for _ in range(rounds):
        edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    return edges


def label_propagation(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """node, community: synchronous, both directions weighted, a node keeps a vote of its own; ties go to the smaller label, so runs agree."""
    e = written(edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    c = written(nodes_of(e).withColumn("community", F.col("node")))
    for _ in range(rounds):
        votes = e.join(c.select(F.col("node").alias("dst"), "community"), "dst").select(F.col("src").alias("node"), "community", "weight").unionByName(c.withColumn("weight", F.lit(1).cast("long")))
        sums = votes.groupBy("node", "community").agg(F.sum("weight").alias("w"))
        new = written(sums.groupBy("node").agg(F.min_by("community", F.struct(-F.col("w"), F.col("community"))).alias("new")).join(c, "node"))
        moved = new.where("new <> community").limit(1).count()
        c = new.select("node", F.col("new").alias("community"))
        if not moved:
            break
    return c


def layers(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, layer, cyclic: a node follows when all it depends on (its dst) are placed; what lies on or behind a cycle comes in the last layer. Also a topological order with (layer, node)."""
    e = written(edges.select("src", "dst").where("src <> dst").distinct())
    left = written((nodes if nodes is not None else nodes_of(e)).select("node").distinct())
    placed: DataFrame | None = None
    layer = 0
    while True:
        free = written(left.join(e.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select("node", F.lit(layer).alias("layer"), F.lit(False).alias("cyclic")))
        if not free.limit(1).count():
            break
        placed = free if placed is None else placed.unionByName(free)
        left = written(left.join(free.select("node"), "node", "left_anti"))
        e = written(e.join(free.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
        layer += 1
    rest = left.select("node", F.lit(layer).alias("layer"), F.lit(True).alias("cyclic"))
    return rest if placed is None else placed.unionByName(rest)


def critical_path(edges: DataFrame, layered: DataFrame | None = None) -> DataFrame:
    """node, length: the longest chain of dependencies behind each node of the acyclic part."""
    placed = layers(edges) if layered is None else layered
    return placed.where("NOT cyclic").select("node", F.col("layer").alias("length"))


def critical_route(edges: DataFrame, layered: DataFrame | None = None) -> DataFrame:
    """position, node: the longest chain of dependencies itself, from its head on; ties go to the smaller node at every place.

    Each node points to a dependency one layer below; the pointers are followed from the head, a scalar a step.
    """
    length = written(critical_path(edges, layered))
    head = length.agg(F.min_by("node", F.struct(-F.col("length"), F.col("node"))).alias("node"), F.max("length").alias("length")).first()
    if head.node is None:
        return length.limit(0).select(F.col("length").alias("position"), "node")
    up, down = length.withColumnsRenamed({"node": "src", "length": "upper"}), length.withColumnsRenamed({"node": "dst", "length": "lower"})
    near = edges.select("src", "dst").join(up, "src").join(down, "dst").where("upper = lower + 1")
    first = written(near.groupBy("src").agg(F.min("dst").alias("dst"), F.max("upper").alias("upper")))
    route = [(0, head.node)]
    for place in range(1, head.length + 1):
        route.append((place, first.where((F.col("src") == route[-1][1]) & (F.col("upper") == head.length - place + 1)).first().dst))
    return edges.sparkSession.createDataFrame(route, f"position int, node {dict(length.dtypes)['node']}")


def paths(edges: DataFrame, starts: DataFrame, depth: int | None = 20, sinks: DataFrame | None = None) -> DataFrame:
    """path, kind: simple paths from starts to sinks (by default nodes without edges out); 'cycle' where the next node is on the path already, 'cut' at the depth bound (None: there is none)."""
    e = written(edges.select("src", "dst").where("src <> dst").distinct())
    end = sinks if sinks is not None else nodes_of(e).join(e.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    end = written(end.select("node").distinct())
    open_ = written(starts.select(F.array("node").alias("path")))
    out: DataFrame | None = None
    for d in count():
        last = open_.withColumn("node", F.element_at("path", -1))
        ended = last.join(end, "node", "left_semi").select("path", F.lit("sink").alias("kind"))
        going = last.join(end, "node", "left_anti")
        if d == depth:
            parts = ended.unionByName(going.select("path", F.lit("cut").alias("kind")))
        else:
            step = written(going.join(e, going.node == e.src).select("path", "dst", F.array_contains("path", F.col("dst")).alias("back")))
            parts = ended.unionByName(step.where("back").select(F.array_append("path", F.col("dst")).alias("path"), F.lit("cycle").alias("kind")))
        parts = written(parts)
        out = parts if out is None else out.unionByName(parts)
        if d == depth:
            break
        open_ = written(step.where("NOT back").select(F.array_append("path", F.col("dst")).alias("path")))
        if not open_.limit(1).count():
            break
    return out


def short_cycles(edges: DataFrame, most: int | None = 3) -> DataFrame:
    """cycle: simple cycles of 2 to most nodes (None: of any length), once each, beginning at their smallest node.

    Only edges that can lie on a cycle are followed. In a dense graph the cycles themselves grow with the power of their length.
    """
    e = written(trimmed(edges.select("src", "dst").where("src <> dst").distinct()))
    p = e.where("src < dst").select(F.array("src", "dst").alias("cycle"))
    out: DataFrame | None = None
    for n in count(2):
        last = p.select("cycle", F.element_at("cycle", -1).alias("src"), F.element_at("cycle", 1).alias("first"))
        closed = last.join(e, "src").where("dst = first").select("cycle")
        out = closed if out is None else out.unionByName(closed)
        if n == most:
            return out
        p = last.join(e, "src").where((F.col("dst") > F.col("first")) & ~F.array_contains("cycle", F.col("dst"))).select(F.array_append("cycle", F.col("dst")).alias("cycle"))
        if n > 2:
            p = written(p)
            if not p.limit(1).count():
                return out


def betweenness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """node, score: shortest-path betweenness over the given sources (all nodes, or a seeded sample), divided by their number.

    Level by level for all sources at once: path counts forward, dependencies backward.
    """
    e = written(edges.select("src", "dst").where("src <> dst").distinct())
    s = written(sources.select(F.col("node").alias("s")).distinct())
    n = s.count()
    level = written(s.select("s", F.col("s").alias("node"), F.lit(1.0).alias("sigma"), F.lit(0).alias("d")))
    seen, levels = level, [level]
    for d in count(1):
        step = level.join(e, level.node == e.src).groupBy("s", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma"))
        level = written(step.join(seen.select("s", "node"), ["s", "node"], "left_anti").select("s", "node", "sigma", F.lit(d).alias("d")))
        if not level.limit(1).count():
            break
        levels.append(level)
        seen = written(seen.unionByName(level))
    total: DataFrame | None = None
    below = levels[-1].select("s", "node", "sigma", F.lit(0.0).alias("delta"))
    for upper in reversed(levels[:-1]):
        share = e.join(below.select("s", F.col("node").alias("dst"), ((1 + F.col("delta")) / F.col("sigma")).alias("f")), "dst").groupBy("s", F.col("src").alias("node")).agg(F.sum("f").alias("f"))
        below = written(upper.join(share, ["s", "node"], "left").select("s", "node", "sigma", (F.col("sigma") * F.coalesce("f", F.lit(0.0))).alias("delta")))
        total = below if total is None else total.unionByName(below)
    if total is None:
        return nodes_of(edges).withColumn("score", F.lit(0.0))
    score = total.where("node <> s").groupBy("node").agg((F.sum("delta") / n).alias("score"))
    return nodes_of(edges).join(score, "node", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"))


def hierarchy(parents: DataFrame, child: str, parent: str, limit: int | None = None) -> DataFrame:
    """node, chain: from each node up through its parent until there is none or one repeats, or up to limit steps where the caller asks for that."""
    p = written(parents.groupBy(F.col(child).alias("c")).agg(F.min(parent).alias("p")))
    open_ = written(p.select(F.col("c").alias("node"), F.array("c").alias("chain")))
    done: DataFrame | None = None
    for _ in count() if limit is None else range(limit):
        step = written(open_.withColumn("c", F.element_at("chain", -1)).join(p, "c", "left").select("node", "chain", "p", F.coalesce(F.array_contains("chain", F.col("p")), F.lit(True)).alias("ends")))
        ended = step.where("ends").select("node", "chain")
        done = ended if done is None else done.unionByName(ended)
        open_ = written(step.where("NOT ends").select("node", F.array_append("chain", F.col("p")).alias("chain")))
        if not open_.limit(1).count():
            return done
    return done.unionByName(open_)


def first_edge_chains(edges: DataFrame, order: Column, depth: int = 5) -> DataFrame:
    """node, chain: along the first edge out of each node, up to depth steps or until a node repeats."""
    first = edges.groupBy("src").agg(F.min_by("dst", order).alias("dst"))
    return hierarchy(first, "src", "dst", depth)


def patterns(edges: DataFrame, gate: int = 3) -> DataFrame:
    """kind, nodes: handshakes (cycles of 2 or 3) and gates (gate successors or more)."""
    shake = short_cycles(edges, 3).select(F.lit("handshake").alias("kind"), F.col("cycle").alias("nodes"))
    gates = degrees(edges).where(F.col("out_degree") >= gate).select(F.lit("gate").alias("kind"), F.array("node").alias("nodes"))
    return shake.unionByName(gates)


def teardowns(writes: DataFrame) -> DataFrame:
    """state_key, node, role: who ends (writes 0) and who begins (writes more) a state that has both. writes: state_key, node, value."""
    role = F.when(F.col("value") == 0, "ends").when(F.col("value") > 0, "begins")
    w = writes.select("state_key", "node", role.alias("role")).where("role IS NOT NULL").distinct()
    both = w.groupBy("state_key").agg(F.count_distinct("role").alias("n")).where("n = 2").select("state_key")
    return w.join(both, "state_key")


def ping_pong(steps: DataFrame, chain: str, order: str, direction: str, least: int = 4) -> DataFrame:
    """chain, first, last (of order), steps: the longest runs of a chain in which each direction differs from the one before, of at least `least` steps."""
    w = Window.partitionBy(chain).orderBy(order)
    begins = F.coalesce((F.lag(direction).over(w) == F.col(direction)).cast("int"), F.lit(1))
    runs = steps.select(chain, order, direction).withColumn("__b", begins).withColumn("__run", F.sum("__b").over(w))
    return runs.groupBy(chain, "__run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("steps")).where(F.col("steps") >= least).drop("__run")


def linear_chains(edges: DataFrame, least: int = 3) -> DataFrame:
    """chain: from roots on along nodes with one edge out whose target has one edge in, at least `least` nodes."""
    e = written(edges.select("src", "dst").where("src <> dst").distinct())
    d = degrees(e)
    only = written(e.join(d.where("out_degree = 1").select(F.col("node").alias("src")), "src", "left_semi").join(d.where("in_degree = 1").select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
    begins = only.join(d.where("in_degree = 0").select(F.col("node").alias("src")), "src", "left_semi").select(F.col("src").alias("node"))
    return paths(only, begins, None).where(F.size("path") >= least).select(F.col("path").alias("chain"))
