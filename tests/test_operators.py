"""Golden cases of graphs, timelines, matching, mining."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import compare, graph, joins, mining, profile, search


def frame(spark, rows, weight=False):
    return spark.createDataFrame([(a, b, 1) for a, b in rows], "src long, dst long, weight long")


GOLD = [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6)]
CLIQUES = [(a, b) for g in (range(10, 14), range(20, 24)) for a, b in itertools.permutations(g, 2)] + [(13, 20)]


def test_graph_goldens(spark):
    e = frame(spark, GOLD)
    assert {(r.node, r.component) for r in graph.scc(e).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert {r.dst for r in graph.closure(e).collect() if r.src == 4} == {5, 6}
    assert {r.node: r.depth for r in graph.bfs_depth(e, graph.roots_of(e)).collect()} == {4: 0, 5: 1, 6: 2}
    s = graph.stats(e).first()
    assert (s.nodes, s.edges, s.density) == (6, 5, round(5 / 30, 6))
    assert abs(graph.pagerank(e).agg(F.sum("rank")).first()[0] - 1) < 1e-9
    assert {tuple(r.cycle) for r in graph.short_cycles(e).collect()} == {(1, 2, 3)}
    assert {(r.node, r.layer, r.cyclic) for r in graph.layers(e).collect()} == {(6, 0, False), (5, 1, False), (4, 2, False), (1, 3, True), (2, 3, True), (3, 3, True)}
    assert {(tuple(r.path), r.kind) for r in graph.paths(e, graph.roots_of(e)).collect()} == {((4, 5, 6), "sink")}
    assert {tuple(r.chain) for r in graph.linear_chains(e).collect()} == {(4, 5, 6)}


def test_edges_count_calls(spark):
    calls = spark.createDataFrame([(1, 2)] * 3 + [(2, 2), (2, 1)], "a long, b long")
    assert {(r.src, r.dst, r.weight) for r in graph.edge_list(calls, "a", "b").collect()} == {(1, 2, 3), (2, 1, 1)}


def test_communities_and_components(spark):
    e = frame(spark, CLIQUES)
    c = {r.node: r.community for r in graph.label_propagation(e).collect()}
    assert {c[n] for n in range(10, 14)} == {10} and len({c[n] for n in range(20, 24)}) == 1 and c[20] != c[10]
    nodes = spark.createDataFrame([(99,), (10,)], "node long")
    assert {r.node: r.component for r in graph.components(e, nodes).collect()} == {99: 99, 10: 10}


def reach(edges):
    nodes = {x for e in edges for x in e}
    out = {n: {b for a, b in edges if a == n} for n in nodes}
    while True:
        new = {n: s | {y for x in s for y in out[x]} for n, s in out.items()}
        if new == out:
            return out
        out = new


def test_scc_and_closure_at_random(spark):
    rnd = random.Random(1)
    edges = sorted({(rnd.randrange(25), rnd.randrange(25)) for _ in range(45)})
    edges = [(a, b) for a, b in edges if a != b]
    r = reach(edges)
    assert {(x.src, x.dst) for x in graph.closure(frame(spark, edges)).collect()} == {(a, b) for a in r for b in r[a] if a != b}
    want = {(n, min(m for m in r[n] if n in r[m])) for n in r if any(m != n and n in r[m] for m in r[n])}
    assert {(x.node, x.component) for x in graph.scc(frame(spark, edges)).collect()} == want


def test_betweenness(spark):
    e = frame(spark, [(1, 2), (2, 3), (1, 4), (4, 3), (3, 5)])
    got = {r.node: r.score * 5 for r in graph.betweenness(e, graph.nodes_of(e)).collect()}
    assert got == pytest.approx({1: 0, 2: 1.0, 3: 3.0, 4: 1.0, 5: 0})


def test_hits(spark):
    got = {r.node: (r.hub, r.authority) for r in graph.hits(frame(spark, [(1, 3), (2, 3)])).collect()}
    assert got[3] == pytest.approx((0, 1)) and got[1][0] == pytest.approx(2**-0.5)


def test_timeline(spark):
    h = spark.createDataFrame([("k", 1, 5), ("k", 2, 6), ("k", 4, 6), ("j", 3, 1)], "key string, build long, v long")
    got = {(r.key, r.build, r.action, r.readded) for r in compare.timeline(h, ["key"], "build", "v").collect()}
    assert got == {("k", 1, "added", False), ("k", 2, "modified", False), ("k", 3, "removed", False), ("k", 4, "added", True), ("j", 3, "added", False), ("j", 4, "removed", False)}
    v = {r.key: (r.changes, r.volatility) for r in compare.volatility(compare.timeline(h, ["key"], "build", "v"), ["key"], 4).collect()}
    assert v["k"] == (4, 1.3333)


def test_field_diff(spark):
    kind = "owner string, fields array<struct<name: string, type: string>>"
    old = spark.createDataFrame([("m", [("a", "int"), ("b", "int"), ("c", "int"), ("d", "int")])], kind)
    new = spark.createDataFrame([("m", [("b", "int"), ("a", "int"), ("c", "long"), ("e", "int")])], kind)
    assert {r.field: r.change for r in compare.field_diff(old, new, "owner").collect()} == {"a": "reordered", "b": "reordered", "c": "retyped", "d": "removed", "e": "added"}


def test_renames_need_adjacent_builds(spark):
    h = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("s", 4, "c")], "slot string, n long, label string")
    assert [(r.n, r.old_label, r.new_label) for r in compare.renames(h, ["slot"], "n", "label").collect()] == [(2, "a", "b")]


def test_islands(spark):
    df = spark.createDataFrame([("x", o) for o in (0, 4, 8, 12, 30, 34, 50)], "t string, o long")
    assert [(r["first"], r["last"], r.members) for r in compare.stride_islands(df, ["t"], "o", F.lit(4)).collect()] == [(0, 12, 4)]


def test_priority_match(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "l long")
    right = spark.createDataFrame([(10,), (20,), (30,)], "r long")
    s1 = spark.createDataFrame([(1, 10, 1.0)], "l long, r long, score double")
    s2 = spark.createDataFrame([(1, 20, 9.0), (2, 10, 8.0), (2, 20, 5.0), (3, 20, 6.0), (3, 30, 1.0)], "l long, r long, score double")
    got = {(r.l, r.r, r.strategy) for r in joins.priority_match(left, right, "l", "r", [("exact", s1), ("near", s2)]).collect()}
    assert got == {(1, 10, "exact"), (3, 20, "near")}
    assert joins.priority_match(left, right, "l", "r", []).count() == 0


@pytest.mark.parametrize("t", [0.3, 0.5, 0.8, 1.0])
def test_jaccard_pairs_lose_nothing(spark, t):
    rnd = random.Random(7)
    sets = {i: sorted({rnd.randrange(12) for _ in range(rnd.randint(0, 8))}) for i in range(60)}
    df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()], "k long, e array<string>")
    got = {(r.a, r.b) for r in joins.jaccard_pairs(df, "k", "e", t).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= t - 1e-12}
    assert got == want


def test_dependencies_take_the_first_stage(spark):
    r = spark.createDataFrame([("a", "k", 5), ("b", "q", 1)], "node string, state_key string, value long")
    w = spark.createDataFrame([("a", "k", 5), ("c", "k", 5), ("d", "k", 9), ("e", "q", 7)], "node string, state_key string, value long")
    got = {(x.reader, x.writer, x.stage) for x in joins.dependencies(r, w, [F.col("w.value") == F.col("r.value"), F.col("w.value") > F.col("r.value")]).collect()}
    assert got == {("a", "c", 0), ("b", "e", 1)}


def test_cascade_and_votes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "ab"), (3, "b")], "id long, name string")
    assert [r.id for r in search.cascade(df, [F.col("id") == 9, F.col("name").contains("b"), F.lit(True)]).orderBy("id").collect()] == [2, 3]
    v = spark.createDataFrame([("k", "x", 2.0), ("k", "a", 2.0), ("k", "x", 0.5), ("j", "z", 0.1)], "k string, c string, w double")
    got = {r.k: (r.winner, r.confidence) for r in search.weighted_vote(v, "k", "c", "w", 1.0).collect()}
    assert got == {"k": ("x", 2.5 / 4.5)}


def test_ngrams_and_clones(spark):
    rows = [(i, list("abcdefgh")) for i in range(12)] + [(50, list("abcdefgx")), (60, ["nop"] * 9)]
    df = spark.createDataFrame(rows, "k long, w array<string>")
    top = {r.gram: r.df for r in mining.document_frequency(df, "k", "w", [4]).collect()}
    assert top["a|b|c|d"] == 13 and "nop|nop|nop|nop" not in top
    assert df.where(mining.is_trivial(F.col("w"), ["nop", "int3"])).count() == 1
    pairs = mining.clone_pairs(df, "k", "w", 4, 2, 50, 4)
    assert pairs.count() == 12 * 11 // 2 + 12 and pairs.where("jaccard = 1").count() == 66


def test_cosine(spark):
    m = "map<string, double>"
    df = spark.createDataFrame([({"a": 1.0, "b": 1.0}, {"a": 1.0}), ({}, {}), ({}, {"a": 1.0})], f"x {m}, y {m}")
    got = [r.c for r in df.select(mining.histogram_cosine(F.col("x"), F.col("y")).alias("c")).collect()]
    assert got == pytest.approx([2**-0.5, 1.0, 0.0])


def test_alignment(spark):
    df = spark.createDataFrame([(1, list("abc"), list("axc")), (2, None, [])], "id long, a array<string>, b array<string>")
    got = {r.id: ([o.tag for o in r.ops], r.ratio) for r in mining.align(df, "id", "a", "b").collect()}
    assert got[1] == (["equal", "replace", "equal"], pytest.approx(2 / 3)) and got[2] == ([], 1.0)


def test_profiles(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 4, 8, 1, 2, 4, 8] * 4] + [(None,)], "v double")
    r = profile.numeric(df, ["v"]).first()
    assert (r.total, r.nulls, r.distinct, r.is_flags, r.is_enum, r.is_integer) == (33, 1, 4, True, True, True)
    assert list(r.samples) == [1, 2, 4, 8]
    e = spark.createDataFrame([("seq", x) for x in range(5)] + [("flags", 1 << x) for x in range(9)] + [("neg", -5), ("neg", 900)], "k string, v long")
    assert {r.k: (r.kind, r.width) for r in profile.enums(e, "k", "v").collect()} == {"seq": ("flags", "uint8"), "flags": ("flags", "uint16"), "neg": ("sparse", "int16")}


def test_long_ways_are_followed_to_their_end(spark):
    """A chain of 300 steps, a hierarchy of 60 levels: nothing stops before the end."""
    line = frame(spark, [(i, i + 1) for i in range(300)])
    assert graph.closure(line).where("src = 0").count() == 300
    up = spark.createDataFrame([(i, i + 1) for i in range(60)], "c long, p long")
    assert max(len(r.chain) for r in graph.hierarchy(up, "c", "p").collect()) == 61
