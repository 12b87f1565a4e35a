"""Queries over what the given tables don't hold: keys beyond their ranges, many rows of a key."""

import glob
import math
import os
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace import catalog
from millrace.operators import joins, mining, similarity
from millrace.sources import code

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.fixture
def held_to_sql(spark, tmp_path):
    """Asserts that a query gives what its SQL gives, with tables made by SQL from the smallest ones instead of the given ones."""

    def check(name: str, **tables: str):
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for t in (os.path.basename(p)[:-8] for p in glob.glob(f"{SF}/*.parquet")):
            con.execute(f"COPY ({tables.get(t, 'SELECT * FROM {}')}) TO '{tmp_path}/{t}.parquet'".format(f"'{SF}/{t}.parquet'"))
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        df = catalog.queries()[name](spark, str(tmp_path))
        cur = con.execute(catalog.oracle_sql()[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        want = sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=repr)
        got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
        assert got == want
        return got

    return check


def test_ids_wider_than_their_fields(held_to_sql):
    rows = held_to_sql("bit_decode", events="SELECT * REPLACE (event_id + 5_000_000_000 AS event_id, user_id + 65_530 AS user_id) FROM {}")
    assert any(r[4] is not None and r[4] < 100 for r in rows)


def test_dependencies_make_no_pairs_beyond_their_results(spark):
    """A thousand readers and writers of one key, a writer each: stages are keys of the join; a node with two values is served for each."""
    r = spark.range(1000).select(F.col("id").alias("node"), F.lit("k").alias("state_key"), F.col("id").alias("value"))
    w = r.withColumn("node", F.col("node") + 1000)
    same = F.col("w.value") == F.col("r.value")
    plan = joins.dependencies(r, w, [same])._jdf.queryExecution().optimizedPlan().toString()
    assert "value" in plan.split("Join Inner")[1].split("\n")[0]
    again = r.union(r.where("node = 0").withColumn("value", F.lit(-1).cast("long")))
    got = joins.dependencies(again, w, [same, F.col("w.value") > F.col("r.value") + 997])
    assert got.where("stage = 0").count() == 1000 and sorted(map(tuple, got.where("stage = 1").collect())) == [(0, "k", 1997, 1), (0, "k", 1998, 1), (0, "k", 1999, 1)]


def test_long_sources_are_scanned_once(spark, tmp_path):
    """A file of 20,000 entries: the text that holds them is not searched again for each (which takes minutes)."""
    text = "enum Big : uint32\n{\n" + ",\n".join(f"    P_{i} = 0x{i:X}" for i in range(20_000)) + "\n};\n"
    (tmp_path / "big.h").write_text(text)
    began = time.monotonic()
    df = code.enums(spark, str(tmp_path))
    assert df.agg(F.count("*"), F.sum("value"), F.min("enum")).first() == (20_000, 19_999 * 10_000, "Big")
    assert time.monotonic() - began < 30


def test_neighbours_meet_within_their_kind(held_to_sql, spark):
    """Brand and type are keys of the join, and its work stays spread however little it reads."""
    held_to_sql("neighbourhood_pairs", part="SELECT p.* REPLACE (p_partkey + i AS p_partkey) FROM {} p, (SELECT unnest([0, 1000, 2000]) AS i)")
    df = catalog.queries()["neighbourhood_pairs"](spark, SF)
    join = df._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1].split("\n")[0]
    assert "__s0" in join and "__s1" in join and df.rdd.getNumPartitions() == 4


def test_ranges_lose_nothing(held_to_sql, spark):
    """Every pair that comparing all with all finds, and the work stays spread however little it reads."""
    held_to_sql("range_bucket_join", part="SELECT p.* REPLACE (p_partkey + i AS p_partkey, p_retailprice * (1 + i / 7000) AS p_retailprice) FROM {} p, (SELECT unnest([0, 1000, 2000]) AS i)")
    assert catalog.queries()["range_bucket_join"](spark, SF).rdd.getNumPartitions() == 4
    rnd = random.Random(4)
    values = [rnd.choice([rnd.uniform(0.01, 60), float(rnd.randint(1, 60)), 0.0, -3.0, math.inf, math.nan, 1e-300]) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    left, right = df.withColumnsRenamed({"i": "l", "v": "x"}), df.withColumnsRenamed({"i": "r", "v": "y"})
    for within in (0.002, 0.1, 0.5, 1.0, 1.5):
        got = {(r.l, r.r) for r in joins.range_join(left, right, "x", "y", 8, within).collect()}
        finite = [(i, v) for i, v in enumerate(values) if math.isfinite(v)]
        assert got == {(i, k) for i, x in finite for k, y in finite if x // 8 == y // 8 and abs(y - x) < within * x}


def test_near_prices_meet_across_buckets(held_to_sql, spark):
    """Every pair of a brand within 0.2 %, whatever multiple of eight lies between; without buckets odd values meet as all pairs do."""
    rows = held_to_sql("range_bucket_join")
    parts = duckdb.sql(f"SELECT p_partkey, p_brand, p_retailprice FROM '{SF}/part.parquet'").fetchall()
    price = {i: v for i, _, v in parts}
    assert set(rows) == {(i, k) for i, b, x in parts for k, c, y in parts if b == c and i < k and abs(y - x) < 0.002 * x} and len(rows) == len(set(rows))
    assert any(price[l] // 8 != price[r] // 8 for l, r in rows)
    rnd = random.Random(5)
    values = [rnd.choice([rnd.uniform(0.01, 60), rnd.uniform(7.99, 8.01), float(rnd.randint(1, 60)), 0.0, -3.0, math.inf, math.nan, 1e-300, 1e300, None]) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    left, right = df.withColumnsRenamed({"i": "l", "v": "x"}), df.withColumnsRenamed({"i": "r", "v": "y"})
    finite = [(i, v) for i, v in enumerate(values) if v is not None and math.isfinite(v)]
    for within in (0.002, 0.1, 0.5, 1.0, 1.5):
        got = sorted((r.l, r.r) for r in joins.range_join(left, right, "x", "y", None, within).collect())
        assert got == [(i, k) for i, x in finite for k, y in finite if abs(y - x) < within * x]


def test_late_strategies_take_unmatched_rows_only(spark):
    """A strategy given as a function is asked for the candidates of those left, and not at all where none is; sets meet across the sides as all pairs do."""
    left, right = spark.createDataFrame([(i,) for i in range(9)], "l int"), spark.createDataFrame([(i,) for i in range(20, 29)], "r int")
    asked = []

    def late(upto):
        def of(rest):
            asked.append(sorted(r.l for r in rest.collect()))
            return rest.where(F.col("l") < upto).select("l", (F.col("l") + 20).alias("r"), F.lit(1.0).alias("score"))

        return of

    first = left.where("l < 3").select("l", (F.col("l") + 20).alias("r"), F.lit(5.0).alias("score"))
    got = joins.priority_match(left, right, "l", "r", [("first", first), ("late", late(6)), ("later", late(9)), ("never", late(9))])
    assert {r.l: r.strategy for r in got.collect()} == {i: "first" if i < 3 else "late" if i < 6 else "later" for i in range(9)}
    assert asked == [list(range(3, 9)), list(range(6, 9))]
    rnd = random.Random(8)
    a, b = ([(i, sorted({rnd.randrange(15) for _ in range(rnd.randint(0, 9))})) for i in range(50)] for _ in range(2))
    for least in (0.17, 0.5, 1.0):
        found = joins.jaccard_across(spark.createDataFrame(a, "l int, e array<int>"), spark.createDataFrame(b, "r int, e array<int>"), "l", "r", "e", least)
        assert {(r.l, r.r) for r in found.collect()} == {(i, k) for i, x in a for k, y in b if x and y and len({*x} & {*y}) / len({*x} | {*y}) >= least - 1e-12}


def test_similar_sets_meet_as_all_pairs_do(spark, monkeypatch):
    """Families of near and equal sets over many cells and blocks: what all pairs give; copies are not compared, and candidates are hardly more than the pairs."""
    monkeypatch.setattr(similarity, "FEW", 20)
    rnd = random.Random(11)
    sets = []
    for _ in range(60):
        first = rnd.sample(range(5000), rnd.choice([1, 3, 12, 40, 90, 300]))
        sets += [[x for x in first if rnd.random() > 0.12] + rnd.sample(range(5000), rnd.randint(0, len(first) // 8)) for _ in range(rnd.randint(1, 6))] + [first] * rnd.randint(0, 3)
    df = spark.createDataFrame([(i, list(map(str, s))) for i, s in enumerate(sets)], "k long, e array<string>")
    sides = [set(s) for s in sets]
    want = {(a, b): len(sides[a] & sides[b]) / len(sides[a] | sides[b]) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sides[a] and sides[b]}
    got = {(r.a, r.b): r.jaccard for r in joins.jaccard_pairs(df, "k", "e", 0.6).collect()}
    assert got == {p: pytest.approx(j) for p, j in want.items() if j >= 0.6} and len(got) > 200
    pairs, copies = similarity.similar_sets(df, "k", "e", 0.6)
    reps = similarity.signed(df, "k", "e", 0.6).join(copies.where("id <> rep").select("id"), "id", "left_anti")
    assert 0 < pairs.count() < len(got) and similarity._candidates(reps, 0.6).count() < 1.5 * pairs.count() + 50


def test_copies_take_their_components_without_pairs(held_to_sql, spark):
    """Each document thrice: components as the SQL has them, and the links read are no more than those of the documents once."""
    rows = held_to_sql("near_clusters", documents="SELECT d.* REPLACE (doc_id + i AS doc_id) FROM (SELECT * FROM {} WHERE doc_id < 60) d, (SELECT unnest([0, 1000, 2000]) AS i)")
    assert len(rows) > 150
    df = spark.createDataFrame([(i, ["a", "b"]) for i in range(300)] + [(900, ["a", "b", "c"])], "k long, e array<string>")
    pairs, copies = similarity.similar_sets(df, "k", "e", 0.6)
    assert [(r.a, r.b) for r in pairs.collect()] == [(0, 900)] and copies.count() == 300
    assert {(r.node, r.component) for r in similarity.similar_components(df, "k", "e", 0.6).collect()} == {(i, 0) for i in [*range(300), 900]}


def test_clones_meet_as_all_grams_do(spark, monkeypatch):
    """Grams below, within and beyond the band over many documents, added up in small steps: what counting all grams gives; grams are sent packed."""
    monkeypatch.setattr(mining, "HELD", 50)
    rnd = random.Random(5)
    docs = [[rnd.choice("abcdef") for _ in range(rnd.randint(0, 40))] for _ in range(60)]
    docs += [d[: rnd.randint(1, len(d))] for d in docs if d] + [list("abcabcabc")] * 9
    df = spark.createDataFrame(list(enumerate(docs)), "k long, w array<string>")
    grams = [{tuple(d[i : i + 3]) for i in range(len(d) - 2)} for d in docs]
    for low, high in ((2, 6), (4, 12)):
        band = {g for g in set().union(*grams) if low <= sum(g in s for s in grams) <= high}
        want = {(a, b): (len(x), len(grams[a] & grams[b]) / len(grams[a] | grams[b])) for a in range(len(docs)) for b in range(a + 1, len(docs)) if len(x := grams[a] & grams[b] & band) >= 3}
        got = {(r.a, r.b): (r.shared, r.jaccard) for r in mining.clone_pairs(df, "k", "w", 3, low, high, 3).collect()}
        assert got == {p: (n, pytest.approx(j, abs=1e-6)) for p, (n, j) in want.items()} and len(got) > 10
    packed = mining._gram_ranges(df, "k", "w", 3, 12).selectExpr("sum(length(low)) AS bytes").first().bytes
    assert packed == 6 * sum(map(len, grams))  # six bytes a gram, however long its words
