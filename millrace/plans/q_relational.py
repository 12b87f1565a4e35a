"""Named queries: scans, searches, joins, aggregates, sets, merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.catalog import Tables, query
from millrace.functions.semantics import exact_sum, ilike_any, money, top_n, upper_median
from millrace.operators import joins, merge, scoring, search

def event_key():
    """The number in an event's JSON properties; null for junk."""
    return F.get_json_object("props", "$.k").try_cast("bigint")


SQL_KEY = "try_cast(json_extract_string(props, '$.k') AS BIGINT)"


@query("SRC-01", "FLT-03", "ORD-01", "ORD-02", sql="SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ring%' ORDER BY p_name, p_partkey LIMIT 50")
def named_search(t: Tables) -> DataFrame:
    """The first 50 parts with a pattern in their name (a top-k report)."""
    return search.search(t.part.select("p_partkey", "p_name"), ["p_name"], ["%ring%"], ["p_name", "p_partkey"], 50)


@query("FLT-01", "FLT-02", "FLT-05", "FLT-07", "FLT-08", sql="""
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority IS NOT NULL AND o_orderpriority NOT ILIKE '5-%' AND o_totalprice BETWEEN 1000 AND 200000 AND length(o_orderpriority) BETWEEN 4 AND 10""")
def filter_conjunction(t: Tables) -> DataFrame:
    """A conjunction built from optional predicates; all of it reaches the scan."""
    wanted = {"status": F.col("o_orderstatus") == "F", "known": F.col("o_orderpriority").isNotNull(), "not_low": ~F.col("o_orderpriority").ilike("5-%"), "price": F.col("o_totalprice").between(1000, 200000), "length": F.length("o_orderpriority").between(4, 10), "unused": None}
    return t.orders.where(reduce(lambda a, b: a & b, (p for p in wanted.values() if p is not None))).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("FLT-06", sql="SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def in_list_semi_join(t: Tables) -> DataFrame:
    """Membership in a list of any length is a semi join."""
    keys = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(keys, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("FLT-04", "SET-01", sql="""
SELECT entity, id, min(label) AS label FROM (
  SELECT 'part' AS entity, p_partkey::VARCHAR AS id, p_name AS label FROM part WHERE p_name ILIKE '%blue%' OR p_type ILIKE '%promo%'
  UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, s_name FROM supplier WHERE s_name ILIKE '%00001%'
  UNION ALL SELECT 'customer', c_custkey::VARCHAR, c_name FROM customer WHERE c_mktsegment ILIKE '%mach%' OR c_name ILIKE '%99%') GROUP BY 1, 2""")
def keyword_overview(t: Tables) -> DataFrame:
    """Keyword searches of several tables in one bundle."""
    return search.bundle({
        "part": (t.part.where(ilike_any(["p_name"], ["%blue%"]) | ilike_any(["p_type"], ["%promo%"])), F.col("p_partkey"), F.col("p_name")),
        "supplier": (t.supplier.where(ilike_any(["s_name"], ["%00001%"])), F.col("s_suppkey"), F.col("s_name")),
        "customer": (t.customer.where(ilike_any(["c_mktsegment"], ["%mach%"]) | ilike_any(["c_name"], ["%99%"])), F.col("c_custkey"), F.col("c_name")),
    })


@query("FLT-09", sql="""
WITH s AS (SELECT p_partkey, p_name, CASE WHEN p_partkey = -7 THEN 0 WHEN p_name ILIKE 'large%' THEN 1 WHEN p_size = 7 THEN 2 END AS stage FROM part)
SELECT p_partkey, p_name, stage FROM s WHERE stage = (SELECT min(stage) FROM s)""")
def cascade_lookup(t: Tables) -> DataFrame:
    """Exact id, else name, else size: the first stage that finds rows."""
    out = search.cascade(t.part, [F.col("p_partkey") == -7, F.col("p_name").ilike("large%"), F.col("p_size") == 7])
    return out.select("p_partkey", "p_name", "stage")


RULES = [("Metal", ["BOLT", "ANVIL", "RING"]), ("Small", ["SMALL", "WIDGET"]), ("Colour", ["RED", "BLUE", "GREEN"])]


@query("FLT-10", "AGG-02", sql="""
SELECT class, count(*) AS n FROM (SELECT CASE WHEN upper(p_name) LIKE '%BOLT%' OR upper(p_name) LIKE '%ANVIL%' OR upper(p_name) LIKE '%RING%' THEN 'Metal'
  WHEN upper(p_name) LIKE '%SMALL%' OR upper(p_name) LIKE '%WIDGET%' THEN 'Small' WHEN upper(p_name) LIKE '%RED%' OR upper(p_name) LIKE '%BLUE%' OR upper(p_name) LIKE '%GREEN%' THEN 'Colour' ELSE 'Other' END AS class FROM part) GROUP BY class""")
def classify_ordered(t: Tables) -> DataFrame:
    return t.part.groupBy(search.classify(F.col("p_name"), RULES).alias("class")).agg(F.count("*").alias("n"))


@query("FLT-11", "FN-02", sql="""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), lambda x: lower(x)) AS w FROM documents)
SELECT class, count(*) AS n FROM (SELECT CASE WHEN list_has_any(w, ['license', 'licensed']) THEN 'License' WHEN list_has_any(w, ['token', 'password', 'key']) THEN 'Secret' WHEN list_has_any(w, ['the', 'and']) THEN 'Prose' ELSE 'Other' END AS class FROM d) GROUP BY class""")
def classify_token_boundary(t: Tables) -> DataFrame:
    """Keywords match whole tokens, not parts of words."""
    rules = [("License", ["license", "licensed"]), ("Secret", ["token", "password", "key"]), ("Prose", ["the", "and"])]
    return t.documents.select(search.tokens(F.col("text")).alias("w")).groupBy(search.classify_tokens(F.col("w"), rules).alias("class")).agg(F.count("*").alias("n"))


@query("FLT-12", "FN-05", sql=f"""
SELECT event_type, op, count(*) AS n FROM (SELECT event_type, op, CASE op WHEN '<' THEN {SQL_KEY} < 50 WHEN '=' THEN {SQL_KEY} = 7 WHEN '!=' THEN {SQL_KEY} <> 7 ELSE true END AS ok
  FROM events, (VALUES ('<'), ('='), ('!='), ('~')) o(op)) WHERE ok GROUP BY 1, 2""")
def compare_operators(t: Tables) -> DataFrame:
    """Operators given as text; an unknown one holds."""
    from millrace.functions.scalar import compare

    bound = F.when(F.col("op") == "<", "50").otherwise("7")
    e = t.events.select("event_type", event_key().alias("k"), F.explode(F.array(*map(F.lit, ["<", "=", "!=", "~"]))).alias("op"))
    return e.where(compare(F.col("k"), F.col("op"), bound)).groupBy("event_type", "op").agg(F.count("*").alias("n"))


@query("FLT-16", sql="""
SELECT category, count(*) AS n FROM (SELECT CASE WHEN o_totalprice < 1000 THEN 'small' WHEN o_orderpriority LIKE '1-%' AND o_totalprice > 300000 THEN 'urgent_large' WHEN floor(o_totalprice) % 100 = 0 THEN 'round' ELSE 'other' END AS category FROM orders) GROUP BY 1""")
def categorise_numbers(t: Tables) -> DataFrame:
    p, c = F.col("o_totalprice"), F.col("o_orderpriority")
    rules = [("small", p < 1000), ("urgent_large", c.like("1-%") & (p > 300000)), ("round", F.floor(p) % 100 == 0)]
    return t.orders.groupBy(search.categorise(rules).alias("category")).agg(F.count("*").alias("n"))


@query("JON-01", sql="SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def inner_join_basic(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("JON-02", "JON-04", sql="""SELECT o_orderkey, l_linenumber, l_partkey, l_discount FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_discount < 0.05 AND o_orderpriority ILIKE '%urgent%' ORDER BY l_discount, o_orderkey, l_linenumber""")
def join_residual_sorted(t: Tables) -> DataFrame:
    """Equi-join with filters on both sides, which reach the scans, and a total order."""
    o = t.orders.where(F.col("o_orderpriority").ilike("%urgent%")).select("o_orderkey")
    l = t.lineitem.where("l_discount < 0.05D").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")  # noqa: E741
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "l_partkey", "l_discount").orderBy("l_discount", "o_orderkey", "l_linenumber")


@query("JON-03", "FN-10", sql=f"SELECT event_id, c_name, n_name FROM events JOIN customer ON c_custkey = {SQL_KEY} JOIN nation ON n_nationkey = c_nationkey")
def join_three_way_cast(t: Tables) -> DataFrame:
    """A key from JSON text, cast so that junk joins nothing."""
    e = t.events.select("event_id", event_key().alias("c_custkey"))
    return e.join(t.customer.select("c_custkey", "c_name", "c_nationkey"), "c_custkey").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("event_id", "c_name", "n_name")


@query("JON-05", sql="SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def anti_not_in(t: Tables) -> DataFrame:
    """Customers without an urgent order."""
    keys = t.orders.where("o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(keys, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("JON-06", "JON-07", sql="""SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def lookup_left_outer(t: Tables) -> DataFrame:
    """A chain of lookups that may find nothing."""
    c = t.customer.where("c_acctbal > 0").select("c_custkey", "c_name", "c_nationkey")
    out = t.orders.select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return out.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("o_orderkey", "c_name", "n_name", "r_name")


@query("JON-08", sql=f"""
SELECT key, source, count(*) AS refs FROM (SELECT c_custkey AS key, 'customer' AS source FROM customer UNION ALL SELECT o_custkey, 'orders' FROM orders
  UNION ALL SELECT user_id, 'events' FROM events UNION ALL SELECT {SQL_KEY}, 'event_props' FROM events UNION ALL SELECT s_suppkey, 'supplier' FROM supplier) WHERE key IS NOT NULL GROUP BY 1, 2""")
def star_crossref(t: Tables) -> DataFrame:
    """References to one key space from five places, as a union rather than a join on alternatives."""
    parts = [t.customer.select(F.col("c_custkey").alias("key"), F.lit("customer").alias("source")), t.orders.select("o_custkey", F.lit("orders")), t.events.select("user_id", F.lit("events")), t.events.select(event_key(), F.lit("event_props")), t.supplier.select("s_suppkey", F.lit("supplier"))]
    return reduce(DataFrame.union, parts).where("key IS NOT NULL").groupBy("key", "source").agg(F.count("*").alias("refs"))


@query("JON-09", sql="""SELECT a.p_partkey AS old_key, b.p_partkey AS new_key, CASE WHEN a.p_size = b.p_size THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence
FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_type = b.p_type AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey""")
def name_join_confidence(t: Tables) -> DataFrame:
    """Matches by name with a confidence from a second attribute."""
    a, b = t.part.alias("a"), t.part.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("p_name", "p_type", "p_brand")] + [F.col("a.p_partkey") < F.col("b.p_partkey")]
    return a.join(b, on).select(F.col("a.p_partkey").alias("old_key"), F.col("b.p_partkey").alias("new_key"), F.when(F.col("a.p_size") == F.col("b.p_size"), 1.0).otherwise(0.9).alias("confidence"))


@query("JON-10", "WIN-13", "FN-04", sql="""
WITH h AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS h FROM documents), u AS (SELECT h, min(doc_id) AS right_id FROM h WHERE source <> 'src0' GROUP BY h HAVING count(*) = 1)
SELECT doc_id AS left_id, right_id FROM h JOIN u USING (h) WHERE source = 'src0'""")
def unique_key_join(t: Tables) -> DataFrame:
    """Texts of one source that exactly one document elsewhere has."""
    h = t.documents.select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    left = h.where("source = 'src0'").select(F.col("doc_id").alias("left_id"), "h")
    right = h.where("source <> 'src0'").select(F.col("doc_id").alias("right_id"), "h")
    return joins.unique_key_join(left, right, "h").select("left_id", "right_id")


@query("JON-12", sql="""WITH d AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'))) AS w FROM documents), b AS (SELECT DISTINCT item_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'))) AS w FROM benchmark),
x AS (SELECT w, min(doc_id) AS doc_id FROM d GROUP BY 1 HAVING count(*) = 1), y AS (SELECT w, min(item_id) AS item_id FROM b GROUP BY 1 HAVING count(*) = 1), p AS (SELECT doc_id, item_id, count(*) AS shared FROM x JOIN y USING (w) GROUP BY 1, 2)
SELECT doc_id, arg_min(item_id, (-shared, item_id)) AS item_id, max(shared) AS shared FROM p GROUP BY 1""")
def unique_token_partners(t: Tables) -> DataFrame:
    """The benchmark item that shares most of the words which either side has in one place only."""
    words = lambda df, i: df.select(i, F.explode(F.array_distinct(search.tokens(F.col("text")))).alias("w"))
    return joins.shared_unique_tokens(words(t.documents, "doc_id"), words(t.benchmark, "item_id"), "doc_id", "item_id", "w")


@query("JON-11")
def snapshot_match(t: Tables) -> DataFrame:
    """Customers of two years matched one to one by seven strategies in order: names of those with an account, codes, their orders, signatures, the parts they bought, whom they trade with, sizes."""
    from millrace.operators import matching
    from millrace.plans.state import written

    c = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    bought = t.orders.select("o_orderkey", "o_custkey", "o_orderdate").join(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))

    def side(i: str, name, after: int) -> DataFrame:
        sets = bought.where(F.year("o_orderdate") >= after).groupBy("o_custkey").agg(F.collect_set("l_partkey").alias("parts"), F.collect_set("l_suppkey").alias("sellers"), F.collect_set(F.col("o_orderkey").cast("string")).alias("orders"))
        empty = F.array().cast("array<bigint>")
        of = c.join(sets, F.col("c_custkey") == F.col("o_custkey"), "left")
        return of.select(F.col("c_custkey").alias(i), name.alias("name"), F.when(F.col("c_acctbal") < 0, F.col("c_acctbal").cast("string")).alias("code"), F.when(F.col("c_nationkey") < 5, F.sha2(F.concat_ws("|", "c_nationkey", "c_name"), 256)).alias("signature"), F.coalesce("parts", empty).alias("parts"), F.coalesce("sellers", empty).alias("sellers"), F.array(F.col("c_nationkey").cast("bigint")).alias("places"), F.coalesce("orders", F.array().cast("array<string>")).alias("orders"), F.floor(F.col("c_acctbal")).alias("size"))

    old = written(side("old", F.when(F.col("c_nationkey") >= 12, F.col("c_name")), 1990))
    new = written(side("new", F.when(F.col("c_nationkey") >= 12, F.col("c_name")), 1993))
    strings = lambda df, i: df.select(i, F.explode("orders").alias("w"))
    strategies = [("name", matching.unique_key(old, new, "old", "new", "name", matching.NAME)), ("code", matching.unique_key(old, new, "old", "new", "code", matching.OPCODE)), ("strings", matching.unique_strings(strings(old, "old"), strings(new, "new"), "old", "new", "w")),
                  ("signature", matching.unique_key(old, new, "old", "new", "signature", matching.SIGNATURE)), ("sets", lambda rest: matching.similar_sets(rest, new, "old", "new", "parts")), ("calls", lambda rest: matching.neighbourhoods(rest, new, "old", "new", "sellers", "places")), ("size", lambda rest: matching.sizes(rest, new, "old", "new", "size"))]
    return joins.priority_match(old, new, "old", "new", strategies)


@query("JON-11")
def priority_match(t: Tables) -> DataFrame:
    """Documents matched one to one with benchmark items: by equal text, then by the number of words that either side has in one place only."""
    d = t.documents.select("doc_id", "text")
    b = t.benchmark.select("item_id", F.col("text").alias("item_text"))
    exact = d.join(b, F.col("text") == F.col("item_text")).select("doc_id", "item_id", F.lit(100.0).alias("score"))
    words = lambda df, i, c: df.select(i, F.explode(F.array_distinct(search.tokens(F.col(c), r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))).alias("w"))
    shared = joins.shared_unique_tokens(words(d, "doc_id", "text"), words(b, "item_id", "item_text"), "doc_id", "item_id", "w").select("doc_id", "item_id", F.col("shared").cast("double").alias("score"))
    return joins.priority_match(d, b, "doc_id", "item_id", [("exact", exact), ("unique_tokens", shared)])


@query("JON-15", sql="""SELECT a.p_partkey AS left_key, b.p_partkey AS right_key FROM part a JOIN part b
ON abs(b.p_retailprice - a.p_retailprice) < 0.002 * a.p_retailprice AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey""")
def range_bucket_join(t: Tables) -> DataFrame:
    """Near prices of a brand, on whichever side of a bucket's border they lie."""
    a = t.part.select(F.col("p_partkey").alias("left_key"), F.col("p_retailprice").alias("lp"), F.col("p_brand").alias("lb"))
    b = t.part.select(F.col("p_partkey").alias("right_key"), F.col("p_retailprice").alias("rp"), F.col("p_brand").alias("rb"))
    return joins.range_join(a, b, "lp", "rp", None, 0.002, F.col("left_key") < F.col("right_key"), [("lb", "rb")]).select("left_key", "right_key")


@query("JON-16", sql="""
WITH s AS (SELECT l_partkey, year(l_shipdate) AS y, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1, 2), a AS (SELECT * FROM s WHERE y = 1996), b AS (SELECT * FROM s WHERE y = 1997)
SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, CASE WHEN a.l_partkey IS NULL THEN 'added' WHEN b.l_partkey IS NULL THEN 'removed' WHEN a.q IS DISTINCT FROM b.q THEN 'changed' ELSE 'same' END AS action, a.q AS old_q, b.q AS new_q
FROM a FULL JOIN b ON a.l_partkey = b.l_partkey""")
def full_outer_compare(t: Tables) -> DataFrame:
    """What two years sold of each part."""
    from millrace.operators.compare import full_outer_compare as compare

    s = t.lineitem.where(F.year("l_shipdate").isin(1996, 1997)).groupBy("l_partkey", F.year("l_shipdate").alias("y")).agg(F.sum("l_quantity").cast("bigint").alias("q"))
    return compare(s.where("y = 1996"), s.where("y = 1997"), ["l_partkey"], ["q"])


@query("JON-17", sql=f"""
WITH p AS (SELECT DISTINCT user_id, {SQL_KEY} AS v FROM events WHERE event_type = 'purchase'), c AS (SELECT DISTINCT user_id, {SQL_KEY} AS v FROM events WHERE event_type = 'click'),
j AS (SELECT c.user_id AS reader, c.v AS value, p.user_id AS writer, CASE WHEN p.v = c.v AND p.user_id % 10 = c.user_id % 10 THEN 0 ELSE 1 END AS stage FROM c JOIN p ON c.v = p.v AND c.user_id <> p.user_id)
SELECT reader, value AS state_key, writer, stage FROM j WHERE stage = (SELECT min(stage) FROM j k WHERE k.reader = j.reader AND k.value = j.value)""")
def dependency_join(t: Tables) -> DataFrame:
    """Purchases that a click may depend on: of the same group of users if there are any, else any other."""
    pairs = lambda kind: t.events.where(F.col("event_type") == kind).select(F.col("user_id").alias("node"), event_key().alias("state_key"), event_key().alias("value")).where("state_key IS NOT NULL").distinct()
    same = (F.col("w.value") == F.col("r.value")) & (F.col("w.node") % 10 == F.col("r.node") % 10)
    return joins.dependencies(pairs("click"), pairs("purchase"), [same, F.lit(True)])


KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"]}
REFS = {"nation": ["n_regionkey"], "customer": ["c_nationkey"], "supplier": ["s_nationkey"], "orders": ["o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"]}
_vals = " UNION ".join(f"SELECT '{a}' AS \"table\", '{c}' AS \"column\", {c}::BIGINT AS value FROM {a} WHERE {c} > 0" for a, cs in REFS.items() for c in cs)
_ids = " UNION ".join(f"SELECT '{a}' AS target, {c}::BIGINT AS value FROM {a} WHERE {c} > 0" for a, cs in KEYS.items() for c in cs)


PARENTS = {"nation": ["n_regionkey"], "customer": ["c_nationkey"], "orders": ["o_custkey"], "lineitem": ["l_orderkey"]}
_parent_vals = " UNION ".join(f"SELECT '{a}' AS \"table\", '{c}' AS \"column\", {c}::BIGINT AS value FROM {a} WHERE {c} > 0" for a, cs in PARENTS.items() for c in cs)


@query("JON-19", sql=f"""
WITH v AS ({_parent_vals}), i AS ({_ids}), n AS (SELECT "table", "column", count(*) AS n_values FROM v GROUP BY 1, 2), m AS (SELECT v."table", v."column", target AS parent, count(*) AS matches FROM v JOIN i USING (value) WHERE v."table" <> target GROUP BY 1, 2, 3)
SELECT "table", "column", parent, matches, n_values FROM (SELECT *, row_number() OVER (PARTITION BY "table", "column" ORDER BY matches DESC, parent) AS r FROM m) JOIN n USING ("table", "column") WHERE r = 1 AND matches >= greatest(1, 0.3 * n_values)""")
def parent_tables(t: Tables) -> DataFrame:
    """The tables that fields of parents point to."""
    tables = {n: getattr(t, n) for n in {*PARENTS, *KEYS}}
    return joins.parents(joins.long_integers(tables, PARENTS), joins.long_integers(tables, KEYS))


@query("JON-18", sql=f"""
WITH v AS ({_vals}), i AS ({_ids}), n AS (SELECT "table", "column", count(*) AS n_values FROM v GROUP BY 1, 2), s AS (SELECT target, count(*) AS sz FROM i GROUP BY 1),
m AS (SELECT v."table", v."column", target, count(*) AS matches FROM v JOIN i USING (value) WHERE v."table" <> target GROUP BY 1, 2, 3),
c AS (SELECT m.*, n_values, sz, round_even(least(1.0, (matches / n_values) * (1 + least(matches, 100) / 100) / 2), 3) AS confidence FROM m JOIN n USING ("table", "column") JOIN s USING (target) WHERE matches >= 5 AND matches / n_values >= 0.5)
SELECT "table", "column", target, matches, n_values, confidence FROM (SELECT *, row_number() OVER (PARTITION BY "table", "column" ORDER BY confidence DESC, sz, target) AS r FROM c) WHERE r = 1""")
def fk_discovery(t: Tables) -> DataFrame:
    """Foreign keys found by containment of values."""
    tables = {n: getattr(t, n) for n in {*KEYS, *REFS}}
    return joins.foreign_keys(joins.long_integers(tables, REFS), joins.long_integers(tables, KEYS))


@query("JON-20", "AGG-21", sql="""
WITH p AS (SELECT c_custkey IN (SELECT o_custkey FROM orders) AS has_orders, c_custkey IN (SELECT user_id FROM events) AS has_events, c_acctbal > 5000 AS has_balance FROM customer)
SELECT source, count(*) FILTER (has) AS covered, count(*) AS total, round_even(100.0 * count(*) FILTER (has) / count(*), 1)::DOUBLE AS pct
FROM (SELECT 'has_orders' AS source, has_orders AS has FROM p UNION ALL SELECT 'has_events', has_events FROM p UNION ALL SELECT 'has_balance', has_balance FROM p) GROUP BY source""")
def profile_merge(t: Tables) -> DataFrame:
    """A profile merged from several sources, and how much each covers."""
    from millrace.operators.profile import coverage

    flag = lambda df, c, name: df.select(F.col(c).alias("c_custkey")).distinct().withColumn(name, F.lit(True))
    p = t.customer.select("c_custkey", (F.col("c_acctbal") > 5000).alias("has_balance")).join(flag(t.orders, "o_custkey", "has_orders"), "c_custkey", "left").join(flag(t.events, "user_id", "has_events"), "c_custkey", "left")
    return coverage(p, ["has_orders", "has_events", "has_balance"])


@query("JON-21", sql="""
SELECT p_partkey, list_filter([CASE WHEN p_name LIKE '%blue%' THEN 'Blue' END, CASE WHEN p_size > 40 THEN 'Large' END, CASE WHEN p_type = 'PROMO' THEN 'Promo' END], lambda x: x IS NOT NULL) AS classes FROM part
WHERE (p_name LIKE '%blue%')::INT + (p_size > 40)::INT + (p_type = 'PROMO')::INT > 1""")
def multi_class_members(t: Tables) -> DataFrame:
    return search.multi_class(t.part, "p_partkey", {"Blue": F.col("p_name").like("%blue%"), "Large": F.col("p_size") > 40, "Promo": F.col("p_type") == "PROMO"})


@query("JON-22", sql="""
WITH n AS (SELECT n_nationkey, n_name, n_nationkey % 2 AS side, n_nationkey // 2 AS pair, n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) AS rich, n_nationkey IN (SELECT s_nationkey FROM supplier) AS supplies FROM nation)
SELECT a.n_name AS a_name, b.n_name AS b_name, f AS feature FROM n a JOIN n b ON a.pair = b.pair AND a.side = 0 AND b.side = 1, (VALUES ('rich'), ('supplies')) x(f)
WHERE (f = 'rich' AND a.rich <> b.rich) OR (f = 'supplies' AND a.supplies <> b.supplies)""")
def asymmetric_pairs(t: Tables) -> DataFrame:
    """Partners that differ in a feature."""
    rich = t.customer.where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey")).distinct().withColumn("rich", F.lit(True))
    sup = t.supplier.select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("supplies", F.lit(True))
    n = t.nation.join(rich, "n_nationkey", "left").join(sup, "n_nationkey", "left").select("n_name", (F.col("n_nationkey") % 2).alias("side"), F.floor(F.col("n_nationkey") / 2).alias("pair"), F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.coalesce(f, F.lit(False)).alias("has")) for f in ("rich", "supplies")))).alias("f"))
    side = lambda s, p: n.where(F.col("side") == s).select("pair", F.col("n_name").alias(f"{p}_name"), F.col("f.feature").alias("feature"), F.col("f.has").alias(p))
    return side(0, "a").join(side(1, "b"), ["pair", "feature"]).where("a <> b").select("a_name", "b_name", "feature")


@query("JON-23", sql="""
WITH e AS (SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey)
SELECT a, b FROM e WHERE a < b AND EXISTS (SELECT 1 FROM e f WHERE f.a = e.b AND f.b = e.a)""")
def inversion_pairs(t: Tables) -> DataFrame:
    """Pairs of nations that sell to each other."""
    e = t.lineitem.select("l_orderkey", "l_suppkey").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return joins.inversions(e, "s_nationkey", "c_nationkey")


@query("JON-24", sql="""
WITH e AS (SELECT DISTINCT p_brand AS k, p_name AS x FROM part), n AS (SELECT k, count(*) AS n FROM e GROUP BY k),
s AS (SELECT a.k AS inner, b.k AS outer, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.k <> b.k GROUP BY 1, 2)
SELECT "inner", "outer", shared FROM s JOIN n i ON i.k = s."inner" JOIN n o ON o.k = s."outer" WHERE shared = i.n AND i.n < o.n AND shared >= greatest(3, 0.6 * i.n)""".replace("AS inner", 'AS "inner"').replace("AS outer", 'AS "outer"'))
def containment_pairs(t: Tables) -> DataFrame:
    """Brands whose parts all have a name that another brand has too."""
    return joins.contained_sets(t.part, "p_brand", "p_name")


ALL = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("AGG-01", sql=" UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS n FROM {n}" for n in ALL))
def table_stats(t: Tables) -> DataFrame:
    return reduce(DataFrame.unionByName, [getattr(t, n).agg(F.lit(n).alias("table"), F.count("*").alias("n")) for n in ALL])


@query("AGG-02", sql="SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type")
def group_count_desc(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("AGG-03", sql="""SELECT r_name, n_name, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def rollup_region_nation(t: Tables) -> DataFrame:
    by = t.orders.select("o_custkey", "o_totalprice").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return by.rollup("r_name", "n_name").agg(exact_sum(F.col("o_totalprice")).alias("revenue"))


@query("AGG-04", sql="SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def having_duplicates(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("AGG-05", "AGG-06", sql="""SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types, min(event_id) AS first_id, max(event_id) AS last_id, coalesce(sum(length(props)), 0)::BIGINT AS prop_chars, coalesce(sum(CASE WHEN event_type = 'none' THEN 1 END), 0)::BIGINT AS nothing FROM events""")
def distinct_counts(t: Tables) -> DataFrame:
    return t.events.agg(F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("types"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.coalesce(F.sum(F.length("props")), F.lit(0)).alias("prop_chars"), F.coalesce(F.sum(F.when(F.col("event_type") == "none", 1)), F.lit(0)).alias("nothing"))


@query("AGG-07", sql="SELECT event_type, count(*) FILTER (value >= 50) AS ok, count(*) FILTER (value < 50) AS low, count(*) FILTER (value < 50 AND user_id % 2 = 0) AS low_even FROM events GROUP BY 1")
def conditional_counts(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count_if(F.col("value") >= 50).alias("ok"), F.count_if(F.col("value") < 50).alias("low"), F.count_if((F.col("value") < 50) & (F.col("user_id") % 2 == 0)).alias("low_even"))


@query("AGG-08", "FN-12", sql="""SELECT c_mktsegment, count(*) AS members, count(CASE WHEN c_acctbal > 0 THEN 1 END) AS scored, round(sum(CASE WHEN c_acctbal > 0 THEN c_acctbal::DECIMAL(18,2) END)::DOUBLE / count(CASE WHEN c_acctbal > 0 THEN 1 END), 4) AS avg_balance, min(c_acctbal) AS min_balance, max(c_acctbal) AS max_balance FROM customer GROUP BY 1 ORDER BY avg_balance, c_mktsegment""")
def system_aggregate(t: Tables) -> DataFrame:
    pos = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("members"), F.count(pos).alias("scored"), F.round(F.sum(money(pos)).cast("double") / F.count(pos), 4).alias("avg_balance"), F.min("c_acctbal").alias("min_balance"), F.max("c_acctbal").alias("max_balance")).orderBy("avg_balance", "c_mktsegment")


@query("AGG-09", sql="""
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rank, sum(n) OVER (PARTITION BY p_brand) AS total FROM c)
SELECT p_brand, p_type, n, rank::INT AS rank, round(n / total, 6) AS ratio FROM r WHERE rank <= 5""")
def mode_topk(t: Tables) -> DataFrame:
    """The five commonest types of each brand, and their share."""
    c = t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("p_brand")))
    return top_n(c, ["p_brand"], 5, F.desc("n"), F.col("p_type")).select("p_brand", "p_type", "n", "rank", F.round(F.col("n") / F.col("total"), 6).alias("ratio"))


MARKERS = [("the", "en", 2), ("and", "en", 1), ("der", "de", 2), ("und", "de", 1), ("les", "fr", 2), ("est", "fr", 1), ("los", "es", 2), ("que", "es", 1), ("un", "es", 1), ("un", "fr", 1)]


@query("AGG-10", sql=f"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS w FROM documents), m(w, lang, weight) AS (VALUES {", ".join(f"('{w}', '{a}', {n})" for w, a, n in MARKERS)}),
s AS (SELECT doc_id, lang, sum(weight) AS x FROM w JOIN m USING (w) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY x DESC, lang) AS r, sum(x) OVER (PARTITION BY doc_id) AS total FROM s)
SELECT doc_id, lang AS winner, x::BIGINT AS weight, round(x / total, 6) AS confidence FROM r WHERE r = 1 AND x >= 3""")
def weighted_vote(t: Tables) -> DataFrame:
    """The language of each document by weighted marker words."""
    m = t.spark.createDataFrame(MARKERS, "w string, cand string, weight long")
    w = t.documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]+)"), 1)).alias("w"))
    v = search.weighted_vote(w.join(F.broadcast(m), "w"), "doc_id", "cand", "weight", 3)  # ten fixed rows
    return v.withColumn("confidence", F.round("confidence", 6))


@query("AGG-11", sql="""
WITH v AS (SELECT l_partkey, l_returnflag AS kind, CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS p FROM lineitem), g AS (SELECT l_partkey, kind, max(p) AS p, count(*) AS n FROM v GROUP BY 1, 2)
SELECT l_partkey, kind FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY p DESC, n DESC, kind) AS r FROM g) WHERE r = 1""")
def priority_vote(t: Tables) -> DataFrame:
    """Specific kinds beat votes."""
    v = t.lineitem.select("l_partkey", F.col("l_returnflag").alias("kind"), F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("p"))
    return search.priority_vote(v, "l_partkey", "kind", "p")


@query("AGG-12", "FN-13", sql="SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority))[1:3] AS priorities, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1")
def sample_sets(t: Tables) -> DataFrame:
    """Sorted sets, of which three are shown."""
    return t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("s")).select("o_custkey", F.slice("s", 1, 3).alias("priorities"), F.size("s").cast("long").alias("n"))


@query("AGG-28", sql="""
WITH s AS (SELECT event_id, user_id, event_type, CASE WHEN value >= 150 THEN 'HIGH' WHEN value >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM events WHERE event_type = 'error'), g AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS group_size FROM s)
SELECT event_id, severity, group_size, CASE WHEN group_size >= 10 AND severity = 'HIGH' THEN 'CRITICAL' WHEN group_size >= 10 AND severity = 'MEDIUM' THEN 'HIGH' WHEN group_size >= 5 AND severity = 'LOW' THEN 'MEDIUM' ELSE severity END AS escalated FROM g""")
def escalation(t: Tables) -> DataFrame:
    v = F.col("value")
    e = t.events.where("event_type = 'error'").select("event_id", "user_id", F.when(v >= 150, "HIGH").when(v >= 60, "MEDIUM").otherwise("LOW").alias("severity"))
    return scoring.escalate(e, ["user_id"], "severity").select("event_id", "severity", "group_size", "escalated")


@query("AGG-30", sql="SELECT l_returnflag, l_linestatus, quantile_disc(l_extendedprice, 0.5 ORDER BY l_extendedprice DESC) AS median FROM lineitem GROUP BY 1, 2".replace("quantile_disc(l_extendedprice, 0.5 ORDER BY l_extendedprice DESC)", "list_sort(list(l_extendedprice))[(count(*) // 2 + 1)::INT]"))
def upper_median_price(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(upper_median("l_extendedprice").alias("median"))


@query("SNK-09", sql="SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1")
def insert_ignore(t: Tables) -> DataFrame:
    """First writer wins."""
    return merge.first_writer(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SNK-06", "SNK-04", sql="SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def insert_replace(t: Tables) -> DataFrame:
    """Last writer wins."""
    return merge.last_writer(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SNK-05", sql=f"""
SELECT user_id, arg_max(event_type, event_id) AS name, arg_max({SQL_KEY}, event_id) FILTER (event_type = 'purchase') AS system, coalesce(arg_max(({SQL_KEY}), event_id) FILTER ({SQL_KEY} > 0), arg_min({SQL_KEY}, event_id)) AS size, max(value) AS confidence, bit_or({SQL_KEY}) AS flags, count(*) AS seen_count, min(event_id) AS created_at FROM events GROUP BY 1""")
def upsert_merge(t: Tables) -> DataFrame:
    """Events folded into one state a user, a rule a column: half of them exist already, the rest comes in."""
    e = t.events.select("user_id", "event_id", F.col("event_type").alias("name"), F.when(F.col("event_type") == "purchase", event_key()).alias("system"), event_key().alias("size"), F.col("value").alias("confidence"), event_key().alias("flags"), F.lit(1).alias("seen_count"), F.col("event_id").alias("created_at"))
    rules = {"name": "last_non_null", "system": "last_non_null", "size": "last_positive", "confidence": "max", "flags": "bit_or", "seen_count": "count", "created_at": "first"}
    return merge.upsert(None, e, ["user_id"], rules, ["event_id"])


@query("STR-06", sql="""SELECT p_partkey, CASE WHEN p_brand IN ('Brand#3', 'Brand#7') THEN 'compute' ELSE 'cached' END AS state, CASE WHEN p_brand NOT IN ('Brand#3', 'Brand#7') THEN length(p_name) END AS letters FROM part WHERE p_size < 10 OR p_brand IN ('Brand#3', 'Brand#7')
UNION ALL SELECT p_partkey, 'compute', NULL FROM part WHERE NOT (p_size < 10 OR p_brand IN ('Brand#3', 'Brand#7'))""")
def cached_lengths(t: Tables) -> DataFrame:
    """A cache by content: entries whose text changed since, or that it never had, are to be computed."""
    from millrace.plans.planner import cached

    p = t.part.select("p_partkey", "p_name", "p_size", "p_brand")
    changed = F.when(F.col("p_brand").isin("Brand#3", "Brand#7"), F.concat("p_name", F.lit("*"))).otherwise(F.col("p_name"))
    cache = p.where("p_size < 10").select("p_partkey", F.sha2("p_name", 256).alias("digest"), F.length("p_name").cast("bigint").alias("letters"))
    hits, misses = cached(p.select("p_partkey", F.sha2(changed, 256).alias("digest")), cache, "p_partkey", "digest")
    return hits.select("p_partkey", F.lit("cached").alias("state"), "letters").unionByName(misses.select("p_partkey", F.lit("compute").alias("state"), F.lit(None).cast("bigint").alias("letters")))


@query("FN-03", sql=r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace('v' || p_partkey || ' = NUM; STR ' || p_name || ' + a' || p_size || ' VARx ', '\s+', ' ', 'g'), '\b\d+\b', 'NUM', 'g'), '\b[av]\d+\b', 'VAR', 'g')) AS code FROM part""")
def normalised_code(t: Tables) -> DataFrame:
    """Statements made of parts without their comments, numbers, strings and variables."""
    from millrace.functions.scalar import normalise_code

    text = F.concat(F.lit("v"), "p_partkey", F.lit(" = 0x"), F.hex("p_partkey"), F.lit("; /* "), "p_type", F.lit("\n*/ \""), "p_brand", F.lit('" '), "p_name", F.lit("  +\ta"), "p_size", F.lit(" VARx // "), "p_brand")
    return t.part.select("p_partkey", normalise_code(text).alias("code"))


@query("FN-14", sql="""SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'none' ELSE substr(text, 1, 8) END AS head, CASE WHEN doc_id IS NULL OR doc_id = 0 THEN -1 ELSE doc_id END AS number, CASE WHEN text IS NULL OR text = '' THEN ['empty'] ELSE [lang] END AS list FROM documents""")
def defaults(t: Tables) -> DataFrame:
    """Defaults for what counts as missing: null, zero, empty texts and empty arrays."""
    from millrace.functions.semantics import falsy, or_default

    array = F.when(falsy(F.col("text"), "string"), F.array().cast("array<string>")).otherwise(F.array("lang"))
    return t.documents.select("doc_id", or_default(F.substring("text", 1, 8), F.lit("none"), "string").alias("head"), or_default(F.col("doc_id"), F.lit(-1).cast("bigint"), "number").alias("number"), or_default(array, F.array(F.lit("empty")), "array").alias("list"))


@query("STR-05", sql="""
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS seen_count, arg_max(substr(props, 1, 6), event_id) AS error_msg FROM events WHERE event_type = 'error' GROUP BY 1""")
def failure_ledger(t: Tables) -> DataFrame:
    """Errors deduplicated into a ledger with counters."""
    e = t.events.where("event_type = 'error'").select("user_id", F.struct("event_id", "ts").alias("at"), "props")
    out = merge.ledger(e, ["user_id"], "at", "props", cut=6)
    show = lambda c: F.date_format(F.col(f"{c}.ts"), "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("user_id", show("first_seen"), show("last_seen"), "seen_count", "error_msg")


@query("SET-02", sql="SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996 EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997")
def set_difference(t: Tables) -> DataFrame:
    y = lambda n: t.orders.where(F.year("o_orderdate") == n).select("o_custkey")
    return y(1996).subtract(y(1997))


@query("SET-03", sql="SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997")
def set_intersection(t: Tables) -> DataFrame:
    y = lambda n: t.orders.where(F.year("o_orderdate") == n).select("o_custkey")
    return y(1996).intersect(y(1997))


@query("SET-04", sql="""SELECT coalesce(a.k, b.k) AS key, CASE WHEN a.k IS NULL THEN 'unregistered' WHEN b.k IS NULL THEN 'not_run' ELSE 'both' END AS state
FROM (SELECT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT user_id AS k FROM events) b ON a.k = b.k""")
def registry_reconcile(t: Tables) -> DataFrame:
    a, b = t.customer.select(F.col("c_custkey").alias("key"), F.lit(1).alias("a")), t.events.select(F.col("user_id").alias("key")).distinct().withColumn("b", F.lit(1))
    return a.join(b, "key", "full").select("key", F.when(F.col("a").isNull(), "unregistered").when(F.col("b").isNull(), "not_run").otherwise("both").alias("state"))


@query("ORD-03", "ORD-04", sql="SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END, o_orderkey::VARCHAR) AS label FROM orders ORDER BY (o_orderstatus = 'F') DESC, label, o_orderkey")
def order_by_coalesce(t: Tables) -> DataFrame:
    """An order by computed keys."""
    label = F.coalesce(F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")), F.col("o_orderkey").cast("string"))
    return t.orders.select("o_orderkey", label.alias("label"), (F.col("o_orderstatus") == "F").alias("f")).orderBy(F.desc("f"), "label", "o_orderkey").drop("f")


@query("FN-01", "FN-06", "FN-15", "FN-11", sql="""
SELECT p_partkey, list_aggregate(list_transform(string_split(lower(replace(p_name, ' ', '_')), '_'), lambda w: upper(w[1]) || w[2:]), 'string_agg', '') AS pascal, substr(sha256(p_name), 1, 16) AS h16, substr(md5(p_name), 1, 8) AS m8,
 '0x' || lower(to_hex(4194304 + p_partkey)) AS address, (p_size > 0 AND (p_size & (p_size - 1)) = 0) AS pow2, bit_count(p_size)::INT AS ones, (p_partkey * 60) % 1440 >= 1320 OR (p_partkey * 60) % 1440 < 360 AS at_night FROM part""")
def scalar_functions(t: Tables) -> DataFrame:
    """Names, hashes, addresses, bits and daily windows."""
    from millrace.functions import scalar as s

    minute = (F.col("p_partkey") * 60) % 1440
    return t.part.select("p_partkey", s.pascal_case(F.regexp_replace("p_name", " ", "_")).alias("pascal"), s.short_hash(F.col("p_name")).alias("h16"), s.short_hash(F.col("p_name"), 8, "md5").alias("m8"), s.hex_address(s.to_address(F.col("p_partkey"), 0x400000)).alias("address"), s.is_flag(F.col("p_size")).alias("pow2"), s.flag_count(F.col("p_size")).alias("ones"), s.in_daily_window(minute, 1320, 360).alias("at_night"))


BREAKS = [("A", 0, 0), ("A", 500, 10), ("A", 1200, None), ("N", 0, 5), ("N", 900, -3)]


@query("FN-07", sql=f"""
WITH f(fam, shift) AS (VALUES ('A', 1000), ('N', 2000)), b(fam, index_from, off) AS (VALUES {", ".join(f"('{a}', {i}, {'NULL' if o is None else o})" for a, i, o in BREAKS)}),
r AS (SELECT l_orderkey, l_linenumber, l_returnflag AS fam, l_partkey AS idx FROM lineitem)
SELECT r.l_orderkey, r.l_linenumber, r.fam AS family, (r.idx + f.shift + b.off)::BIGINT AS mapped FROM r LEFT JOIN f ON f.fam = r.fam ASOF LEFT JOIN b ON r.fam = b.fam AND r.idx >= b.index_from""")
def remap_piecewise(t: Tables) -> DataFrame:
    """Keys moved by the shift of their family and the offset in force at their index; null where it isn't decided."""
    from millrace.functions.scalar import remap

    families = t.spark.createDataFrame([("A", 1000), ("N", 2000)], "family string, shift long")
    offsets = t.spark.createDataFrame(BREAKS, "family string, index_from long, offset long")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("family"), F.col("l_partkey").alias("idx"))
    return remap(rows, offsets, families).select("l_orderkey", "l_linenumber", "family", "mapped")
