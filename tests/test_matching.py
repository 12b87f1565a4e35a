"""Strategies of matching and loops of graphs against plain Python."""

import random

from pyspark.sql import functions as F

from millrace.operators import compare, graph, joins, matching


def jac(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def near(got, want):
    assert {k: (s, round(c, 9)) for k, (s, c) in got.items()} == {k: (s, round(c, 9)) for k, (s, c) in want.items()}


def test_strategies(spark):
    rnd = random.Random(5)
    side = lambda off: {off + i: dict(name=rnd.choice("abcdefgh"), grams={*rnd.sample(range(12), rnd.randint(0, 9))}, up={*rnd.sample(range(6), rnd.randint(0, 4))}, size=rnd.randint(0, 400)) for i in range(40)}
    a, b = side(0), side(100)
    for i in range(15):
        b[100 + i]["grams"] = set(a[i]["grams"])
        b[100 + i]["up"] = set(a[i]["up"])
    frame = lambda d, i: spark.createDataFrame([(k, v["name"], sorted(v["grams"]), sorted(v["up"]), v["size"]) for k, v in d.items()], f"{i} int, name string, grams array<int>, up array<int>, size int")
    x, y = frame(a, "l"), frame(b, "r")
    read = lambda df: {(r.l, r.r): (r.score, r.closeness) for r in df.collect()}

    def ambiguous(pairs, lowest):
        return {k: (max(s - 10, lowest) if sum(k[0] == o[0] for o in pairs) > 1 else s, c) for k, (s, c) in pairs.items()}

    only = lambda d: {v["name"]: k for k, v in d.items() if sum(w["name"] == v["name"] for w in d.values()) == 1}
    near(read(matching.unique_key(x, y, "l", "r", "name", 100.0)), {(k, only(b)[n]): (100.0, 0.0) for n, k in only(a).items() if n in only(b)})
    j = {(i, k): jac(v["grams"], w["grams"]) for i, v in a.items() for k, w in b.items()}
    want = ambiguous({k: (float(max(70, min(85, int(round(100 * c, 9))))), c) for k, c in j.items() if c > 0.7}, 50.0)
    assert len(want) > 10
    near(read(matching.similar_sets(x, y, "l", "r", "grams")), want)
    c = {(i, k): 0.6 * j[i, k] + 0.4 * jac(a[i]["up"], b[k]["up"]) for i, k in j}
    near(read(matching.neighbourhoods(x, y, "l", "r", "grams", "up")), ambiguous({k: (75.0 if s > 0.8 else 65.0, s) for k, s in c.items() if s > 0.5}, 40.0))
    size = {(i, k): abs(v["size"] - w["size"]) / v["size"] for i, v in a.items() for k, w in b.items() if v["size"] and w["size"] and v["size"] // 64 == w["size"] // 64}
    near(read(matching.sizes(x, y, "l", "r", "size")), {k: (50.0, -s) for k, s in size.items() if s <= 0.2})
    t = lambda d, i: spark.createDataFrame([(k, f"w{g}") for k, v in d.items() for g in (k % 100 // 2, 50 + k % 7, 200 + (k if k % 3 else 0))], f"{i} int, w string")
    rows = [{(r[0], r[1]) for r in t(d, "l").collect()} for d in (a, b)]
    lone = [{w: k for k, w in r if sum(o == w for _, o in r) == 1} for r in rows]
    shared = {}
    for w, k in lone[0].items():
        if w in lone[1]:
            shared[k, lone[1][w]] = shared.get((k, lone[1][w]), 0) + 1
    near(read(matching.unique_strings(t(a, "l"), t(b, "r"), "l", "r", "w")), ambiguous({k: (95.0 if n >= 3 else 90.0, float(n)) for k, n in shared.items()}, 50.0))

    cands = [("sets", matching.similar_sets(x, y, "l", "r", "grams")), ("size", matching.sizes(x, y, "l", "r", "size"))]
    done = {}
    for name, df in cands:
        rest = read(df)
        while True:
            rest = {k: v for k, v in rest.items() if all(k[0] != o[0] and k[1] != o[1] for o in done)}
            best = lambda i: {k[i]: k for k in sorted(rest, key=lambda k: (-rest[k][0], -rest[k][1], k[1 - i]), reverse=True)}  # noqa: B023, E731
            mutual = {*best(0).values()} & {*best(1).values()}
            if not mutual:
                break
            done |= {k: name for k in mutual}
    got = {(r.l, r.r): r.strategy for r in joins.priority_match(x, y, "l", "r", cands).collect()}
    assert got == done and len({k for k, _ in got}) == len(got) == len({k for _, k in got})
    assert joins.priority_match(x, y, "l", "r", []).count() == 0


def test_held_pairs(spark):
    rnd = random.Random(3)
    steps = [(f, i, rnd.choice("XYZ"), rnd.random() < 0.6) for f in range(5) for i in range(30)]
    want = []
    for f in range(5):
        held = []
        for _, i, lock, takes in (s for s in steps if s[0] == f):
            if takes:
                want += [(f, i, o, lock) for o in sorted(set(held)) if o != lock]
                held.append(lock)
            elif lock in held:
                held.remove(lock)
    got = compare.held_pairs(spark.createDataFrame(steps, "f int, i int, lock string, takes boolean"), "f", "i", "lock", "takes")
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 20


def test_cycles_routes_and_patterns(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 7) for i in range(7)] + [(20, 0), (3, 21)], "src int, dst int")
    assert [r.cycle for r in graph.short_cycles(ring, None).collect()] == [list(range(7))]
    assert graph.short_cycles(ring, 6).count() == 0
    dag = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (5, 2), (3, 4)], "src int, dst int")
    assert [r.node for r in graph.critical_route(dag).orderBy("position").collect()] == [1, 2, 3, 4]
    assert graph.critical_route(dag.limit(0)).count() == 0
    w = spark.createDataFrame([("k", 1, 0), ("k", 2, 5), ("j", 1, 0), ("i", 3, None)], "state_key string, node int, value int")
    assert {tuple(r) for r in graph.teardowns(w).collect()} == {("k", 1, "ends"), ("k", 2, "begins")}
    d = spark.createDataFrame([(1, i, c) for i, c in enumerate("aababbbab")] + [(2, 0, "a")], "c int, i int, d string")
    assert {tuple(r) for r in graph.ping_pong(d, "c", "i", "d").collect()} == {(1, 1, 4, 4)}


def test_parents(spark):
    v = spark.createDataFrame([("t", "p", x) for x in range(1, 11)], "table string, column string, value long")
    ids = spark.createDataFrame([("a", x) for x in (1, 2)] + [("b", x) for x in (1, 2, 3)] + [("c", x) for x in (4, 5, 6)] + [("t", x) for x in range(1, 11)], "table string, value long")
    assert [tuple(r) for r in joins.parents(v, ids).collect()] == [("t", "p", "b", 3, 10)]
    assert joins.parents(v, ids.where(F.col("table") == "a")).count() == 0
