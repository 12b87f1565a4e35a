"""Named queries: profiles, ordered analytics, scores, constraints, incremental comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.catalog import Tables, query
from millrace.functions.semantics import exact_sum, first_by
from millrace.operators import compare, profile, scoring
from millrace.plans.q_relational import SQL_KEY, event_key

NUMERIC = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount"]
_unp = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS v FROM lineitem" for c in NUMERIC)


@query("AGG-13", sql=f"""
WITH u AS ({_unp}), c AS (SELECT "column", v, count(*) AS n, CASE WHEN v = floor(v) THEN v::BIGINT END AS i FROM u GROUP BY 1, 2),
g AS (SELECT "column", sum(n)::BIGINT AS total, min(v) AS min, max(v) AS max, count(v) AS "distinct", coalesce(sum(n) FILTER (v = 0), 0)::BIGINT AS zeros, bool_and(v = floor(v)) AS is_integer, count(*) FILTER (i > 0 AND (i & (i - 1)) = 0) AS p2, count(*) FILTER (i > 0) AS pos, bit_count(bit_or(i)) AS bits FROM c GROUP BY 1),
t AS (SELECT "column", list(v ORDER BY r) AS top_values FROM (SELECT "column", v, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) AS r FROM c) WHERE r <= 10 GROUP BY 1)
SELECT "column", total, min, max, "distinct", zeros, is_integer, "distinct" BETWEEN 2 AND 64 AND "distinct" < 0.3 * total AS is_enum,
 is_integer AND min >= 0 AND ((p2 >= 2 AND p2 >= 0.6 * pos) OR (bits BETWEEN 2 AND 16 AND bits < "distinct" AND max < 65536)) AS is_flags, top_values FROM g JOIN t USING ("column")""")
def profile_numeric(t: Tables) -> DataFrame:
    return profile.numeric(t.lineitem.select(*NUMERIC), NUMERIC).drop("nulls", "top_counts", "samples")


@query("AGG-14", sql="""
WITH u AS (SELECT 'p_name' AS "column", p_name AS v FROM part UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL SELECT 'url', url FROM pages)
SELECT "column", count(*) AS total, count(DISTINCT v) AS "distinct", round(avg(length(v)), 6) AS avg_length, max(length(v))::INT AS max_length, count(*) FILTER (v = '') AS empty,
 CASE WHEN avg((regexp_matches(v, '[/\\\\.]'))::INT) > 0.5 THEN 'filepath' WHEN avg((length(v) > 80)::INT) > 0.3 THEN 'description' ELSE 'name' END AS kind FROM u GROUP BY 1""")
def profile_string(t: Tables) -> DataFrame:
    return profile.string(t.part, ["p_name", "p_brand"]).unionByName(profile.string(t.pages, ["url"])).withColumn("empty", F.col("empty").cast("bigint"))


@query("AGG-15", sql="SELECT 'embedding' AS \"column\", max(len(embedding))::INT AS max_length, count(DISTINCT embedding) AS \"distinct\", count(*) AS total FROM embeddings")
def profile_array(t: Tables) -> DataFrame:
    return profile.array(t.embeddings, ["embedding"])


ENUMS = [("part", "p_size"), ("lineitem", "l_linenumber"), ("nation", "n_regionkey"), ("customer", "c_nationkey"), ("embeddings", "label"), ("supplier", "s_nationkey")]
_enum = " UNION ".join(f"SELECT '{a}.{c}' AS field, {c}::BIGINT AS v FROM {a} WHERE {c} IS NOT NULL" for a, c in ENUMS)


@query("AGG-16", sql=f"""
WITH v AS ({_enum}), g AS (SELECT field, count(*) AS members, min(v) AS min, max(v) AS max, count(*) FILTER (v > 0 AND (v & (v - 1)) = 0) AS p, count(*) FILTER (v > 0) AS pos FROM v GROUP BY 1)
SELECT field, members, min, max, CASE WHEN pos >= 2 AND p >= 0.6 * pos THEN 'flags' WHEN min BETWEEN 0 AND 5 AND members >= 0.5 * (max - min + 1) THEN 'sequential' ELSE 'sparse' END AS kind,
 CASE WHEN min >= 0 AND max < 256 THEN 'uint8' WHEN min >= -128 AND max < 128 THEN 'int8' WHEN min >= 0 AND max < 65536 THEN 'uint16' WHEN min >= -32768 AND max < 32768 THEN 'int16' WHEN min >= 0 AND max < 4294967296 THEN 'uint32' ELSE 'int32' END AS width FROM g""")
def enum_inference(t: Tables) -> DataFrame:
    """The kind and width of integer columns."""
    from functools import reduce

    v = reduce(DataFrame.unionByName, [getattr(t, a).select(F.lit(f"{a}.{c}").alias("field"), F.col(c).cast("bigint").alias("v")) for a, c in ENUMS])
    return profile.enums(v, "field", "v")


FEATURES = {"number": r"[0-9]", "email": r"@", "url": r"https?://", "shout": r"[A-Z]{4}", "repeat": r"!!"}
_feat = ", ".join(f"('{k}', '{v}')" for k, v in FEATURES.items())


def _features():
    return {k: F.col("text").rlike(v) for k, v in FEATURES.items()}


@query("AGG-19", sql=f"SELECT lang, feature, count(*) AS n, round(avg(coalesce(regexp_matches(text, pat), false)::INT), 6) AS frequency FROM documents, (VALUES {_feat}) f(feature, pat) GROUP BY 1, 2")
def feature_prevalence(t: Tables) -> DataFrame:
    return profile.feature_prevalence(t.documents, _features(), "lang")


_one = {"a": "[aA]", "e": "[eE]", "b": "[bB]", "comma": ","}
_feat2 = ", ".join(f"('{k}', '{v}')" for k, v in _one.items())


@query("AGG-20", sql=f"""
WITH l AS (SELECT doc_id, lang, feature, coalesce(regexp_matches(text, pat), false) AS has FROM documents, (VALUES {_feat2}) f(feature, pat)),
c AS (SELECT lang, feature, count(*) AS n, avg(has::INT) AS f FROM l GROUP BY 1, 2), g AS (SELECT feature, avg(has::INT) AS g FROM l GROUP BY 1)
SELECT doc_id, feature, round(least(1.0, greatest(CASE WHEN n >= 3 THEN f ELSE 0 END, g)), 6) AS expected FROM l JOIN c USING (lang, feature) JOIN g USING (feature) WHERE NOT has AND least(1.0, greatest(CASE WHEN n >= 3 THEN f ELSE 0 END, g)) >= 0.5""")
def missing_features(t: Tables) -> DataFrame:
    """Features that a document lacks though most of its language have them."""
    return profile.missing_features(t.documents, "doc_id", {k: F.col("text").rlike(v) for k, v in _one.items()}, "lang")


@query("AGG-22", "UDF-04", sql="""
WITH o AS (SELECT o_custkey, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) FILTER (o_orderpriority LIKE '1-%') AS high FROM orders GROUP BY 1),
s AS (SELECT c_custkey, round(CASE WHEN c_acctbal < 0 THEN 10.0 ELSE (100 - least(100.0, c_acctbal / 100)) * 0.30 END + least(40.0, 5.0 * coalesce(failed, 0)) + least(15.0, 5.0 * coalesce(high, 0)) + (100 - least(100.0, coalesce(orders, 0)::DOUBLE)) * 0.15 + least(10.0, CASE WHEN orders IS NULL THEN 2.0 ELSE 0.0 END), 6) AS score FROM customer LEFT JOIN o ON o_custkey = c_custkey)
SELECT c_custkey, score::DOUBLE AS score FROM s WHERE score > 5 ORDER BY score DESC, c_custkey""")
def priority_score(t: Tables) -> DataFrame:
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"), F.count_if(F.col("o_orderpriority").like("1-%")).alias("high"))
    j = t.customer.join(o, "c_custkey", "left")
    conf = F.when(F.col("c_acctbal") >= 0, F.least(F.lit(100.0), F.col("c_acctbal") / 100))
    covered = F.least(F.lit(100.0), F.coalesce("orders", F.lit(0)).cast("double"))
    s = scoring.priority(conf, F.col("failed"), F.col("high"), covered, F.when(F.col("orders").isNull(), 1).otherwise(0))
    return j.select("c_custkey", F.round(s, 6).alias("score")).where("score > 5").orderBy(F.desc("score"), "c_custkey")


@query("AGG-23", sql="""
SELECT o_custkey, round(0.30 * least(100.0, 10.0 * count(*)) + 0.20 * least(100.0, 20.0 * count(DISTINCT o_orderpriority)) + 0.30 * 100.0 * count(*) FILTER (o_orderstatus <> 'F') / count(*) + 0.20 * least(100.0, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / 50000), 4)::DOUBLE AS score FROM orders GROUP BY 1""")
def conformance_score(t: Tables) -> DataFrame:
    n = F.count("*")
    s = scoring.conformance(10.0 * n, 20.0 * F.countDistinct("o_orderpriority"), 100.0 * F.count_if(F.col("o_orderstatus") != "F") / n, exact_sum(F.col("o_totalprice")) / 50000)
    return t.orders.groupBy("o_custkey").agg(F.round(s, 4).alias("score"))


@query("AGG-24", sql="""
WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE text <> ''), n AS (SELECT doc_id, ch, count(*) AS n FROM c GROUP BY 1, 2)
SELECT doc_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 4) AS entropy FROM n GROUP BY 1""")
def entropy(t: Tables) -> DataFrame:
    """Character entropy of every document."""
    return scoring.entropy(t.documents.where("text <> ''"), "doc_id", F.split("text", ""))


@query("AGG-29", "STR-08", sql="SELECT strftime(time_bucket(INTERVAL 1 minute, ts), '%Y-%m-%d %H:%M') AS bucket, count(*) AS n FROM events GROUP BY 1")
def tumbling_minute(t: Tables) -> DataFrame:
    return t.events.groupBy(F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("bucket"), "n")


@query("AGG-29", sql="SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS bucket, event_type, count(*) AS n, round(sum(value::DECIMAL(18,2))::DOUBLE, 2) AS total FROM events GROUP BY 1, 2")
def tumbling_hour(t: Tables) -> DataFrame:
    return t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(exact_sum(F.col("value")), 2).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH").alias("bucket"), "event_type", "n", "total")


_hist = "SELECT l_partkey, year(l_shipdate) AS y, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1, 2"
_events = f"""h AS ({_hist}), ys AS (SELECT y, row_number() OVER (ORDER BY y) AS n FROM (SELECT DISTINCT y FROM h)), g AS (SELECT l_partkey, y, n, q FROM (SELECT DISTINCT l_partkey FROM h) CROSS JOIN ys LEFT JOIN h USING (l_partkey, y)),
l AS (SELECT *, lag(q) OVER w AS was, count(q) OVER (PARTITION BY l_partkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM g WINDOW w AS (PARTITION BY l_partkey ORDER BY n)),
ev AS (SELECT l_partkey, y, CASE WHEN q IS NOT NULL AND was IS NULL THEN 'added' WHEN q IS NULL AND was IS NOT NULL THEN 'removed' ELSE 'modified' END AS action, q IS NOT NULL AND was IS NULL AND seen > 0 AS readded FROM l WHERE q IS DISTINCT FROM was)"""


def _history(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey", F.year("l_shipdate").cast("bigint").alias("y")).agg(F.sum("l_quantity").cast("bigint").alias("q"))


@query("WIN-01", "SRC-14", sql=f"WITH {_events} SELECT l_partkey, y, action, readded FROM ev")
def timeline_changes(t: Tables) -> DataFrame:
    """When each part's yearly sales appeared, changed and ended."""
    return compare.timeline(_history(t), ["l_partkey"], "y", "q")


@query("WIN-02", sql=f"""WITH {_events}, c AS (SELECT l_partkey, count(*) AS changes, round_even(count(*) / greatest((SELECT count(*) FROM ys) - 1, 1), 4)::DOUBLE AS volatility FROM ev GROUP BY 1)
SELECT l_partkey, changes, volatility, CASE WHEN volatility <= 0.15 THEN 'stable' WHEN volatility <= 0.40 THEN 'moderate' WHEN volatility <= 0.70 THEN 'volatile' ELSE 'highly_volatile' END AS stability FROM c""")
def volatility(t: Tables) -> DataFrame:
    h = _history(t)
    return compare.volatility(compare.timeline(h, ["l_partkey"], "y", "q"), ["l_partkey"], h.select("y").distinct().count())


_month = "SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY 1"


def _months(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(exact_sum(F.col("o_totalprice")).alias("total"))


@query("WIN-03", sql=f"WITH m AS ({_month}) SELECT month, total, round(avg(total) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving_avg FROM m")
def moving_avg_3(t: Tables) -> DataFrame:
    """Three-month averages: the window runs over one row a month."""
    return compare.moving_average(_months(t), "month", "total").withColumn("moving_avg", F.round("moving_avg", 2))


@query("WIN-04", sql=f"""WITH m AS ({_month}), f AS (SELECT arg_min(total, month) AS first, arg_max(total, month) AS last FROM m)
SELECT first, last, CASE WHEN last / greatest(first, 1) > 1.05 THEN 'growing' WHEN last / greatest(first, 1) < 0.95 THEN 'shrinking' ELSE 'stable' END AS trend FROM f""")
def first_last_trend(t: Tables) -> DataFrame:
    return compare.trend(_months(t), "month", "total")


@query("WIN-05", sql="""
WITH h AS (SELECT o_custkey, (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS m, arg_max(o_orderpriority, o_orderkey) AS label FROM orders GROUP BY 1, 2)
SELECT a.o_custkey, a.m, b.label AS old_label, a.label AS new_label FROM h a JOIN h b ON a.o_custkey = b.o_custkey AND a.m = b.m + 1 WHERE a.label <> b.label""")
def rename_detection(t: Tables) -> DataFrame:
    """Slots whose label differs from the month before."""
    h = t.orders.groupBy("o_custkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("m")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("label"))
    return compare.renames(h, ["o_custkey"], "m", "label")


_ord = "SELECT DISTINCT o_custkey, dense_rank() OVER (ORDER BY year(o_orderdate)) AS n FROM orders"


@query("WIN-06", sql=f"""WITH p AS ({_ord}), x AS (SELECT max(n) AS last FROM p), g AS (SELECT o_custkey, count(DISTINCT n) AS seen, max(n) AS last_seen FROM p GROUP BY 1)
SELECT o_custkey, seen, last_seen::INT AS last_seen, (last - last_seen)::INT AS gap, CASE WHEN last - last_seen >= 2 THEN 'high' WHEN last - last_seen >= 1 THEN 'medium' WHEN last >= 3 AND seen / last < 0.3 THEN 'low_presence' ELSE 'none' END AS risk FROM g, x""")
def gap_since_last(t: Tables) -> DataFrame:
    """Years since a customer's last order."""
    y = t.orders.select("o_custkey", F.year("o_orderdate").alias("y")).distinct()
    order = y.select("y").distinct().withColumn("n", F.dense_rank().over(Window.orderBy("y")))  # one row a year
    last = order.count()
    return compare.gaps(y.join(order, "y"), ["o_custkey"], "n", last, last)


@query("WIN-07", sql="""
WITH g AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (year(o_orderdate) >= 2000) AS recent, count(DISTINCT o_orderpriority) AS kinds, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY 1),
s AS (SELECT o_custkey, (CASE WHEN n >= 10 THEN 1.0 ELSE 0 END + CASE WHEN recent >= 3 THEN 1.5 ELSE 0 END + CASE WHEN recent > 0.3 * n THEN 0.5 ELSE 0 END + CASE WHEN kinds >= 4 THEN 1.0 ELSE 0 END + CASE WHEN total > 2000000 THEN 1.0 ELSE 0 END + CASE WHEN n = recent THEN 0.5 ELSE 0 END)::DOUBLE AS score FROM g)
SELECT o_custkey, score, CASE WHEN score >= 4 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS level FROM s WHERE score >= 1.5""")
def momentum_score(t: Tables) -> DataFrame:
    """Six additive factors."""
    g = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.year("o_orderdate") >= 2000).alias("recent"), F.countDistinct("o_orderpriority").alias("kinds"), exact_sum(F.col("o_totalprice")).alias("total"))
    c = F.col
    score, level, keep = compare.additive_score([F.when(c("n") >= 10, 1.0), F.when(c("recent") >= 3, 1.5), F.when(c("recent") > 0.3 * c("n"), 0.5), F.when(c("kinds") >= 4, 1.0), F.when(c("total") > 2000000, 1.0), F.when(c("n") == c("recent"), 0.5)], 1.5, [(4, "high"), (2, "medium")], "low")
    return g.where(keep).select("o_custkey", score.alias("score"), level.alias("level"))


@query("WIN-08", sql="""
WITH h AS (SELECT o_custkey, o_orderpriority AS f, o_orderstatus AS ty, year(o_orderdate) AS y, min(o_orderkey) AS k FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY ALL),
u AS (SELECT o_custkey, f, y, arg_min(ty, k) AS ty, min(k) AS k FROM h GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, y ORDER BY k) - 1 AS pos FROM u),
both_ AS (SELECT o_custkey FROM p GROUP BY 1 HAVING count(DISTINCT y) = 2), q AS (SELECT p.* FROM p JOIN both_ USING (o_custkey)), a AS (SELECT * FROM q WHERE y = 1996), b AS (SELECT * FROM q WHERE y = 1997),
j AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.f, b.f) AS field, a.pos AS op, b.pos AS np, a.ty AS ot, b.ty AS nt FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.f = b.f),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, op IS NOT NULL AND np IS NOT NULL ORDER BY op) AS x, row_number() OVER (PARTITION BY o_custkey, op IS NOT NULL AND np IS NOT NULL ORDER BY np) AS z FROM j)
SELECT o_custkey, field, CASE WHEN op IS NULL THEN 'added' WHEN np IS NULL THEN 'removed' WHEN ot <> nt THEN 'retyped' WHEN x <> z THEN 'reordered' WHEN op <> np THEN 'moved' ELSE 'same' END AS change FROM r""")
def positional_field_diff(t: Tables) -> DataFrame:
    """The sequence of priorities a customer used in two years, as fields with a type, compared by place."""
    h = t.orders.where(F.year("o_orderdate").isin(1996, 1997)).groupBy("o_custkey", F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("f")).agg(F.min("o_orderkey").alias("k"), F.min_by("o_orderstatus", "o_orderkey").alias("ty"))
    lists = h.groupBy("o_custkey", "y").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "f", "ty"))), lambda x: F.struct(x.f.alias("name"), x.ty.alias("type"))).alias("fields"))
    a, b = lists.where("y = 1996").drop("y"), lists.where("y = 1997").drop("y")
    both = lambda x, y: x.join(y.select("o_custkey"), "o_custkey", "left_semi")
    return compare.field_diff(both(a, b), both(b, a), "o_custkey")


_days = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS items FROM events GROUP BY 1, 2"


@query("WIN-09", "WIN-10", sql=f"""WITH d AS ({_days}), l AS (SELECT *, lag(items) OVER (PARTITION BY event_type ORDER BY day) AS prev FROM d)
SELECT day, event_type, items, prev, CASE WHEN prev >= 20 AND items = 0 THEN 'soft_zero' WHEN prev >= 20 AND items < 0.5 * prev THEN 'regression' ELSE 'ok' END AS regression FROM l""")
def prior_period_regression(t: Tables) -> DataFrame:
    d = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("items"))
    return compare.prior_period(d, ["event_type"], "day", "items")


@query("WIN-11", sql="""WITH i AS (SELECT event_type, event_id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM events)
SELECT event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS members FROM i GROUP BY event_type, g HAVING count(*) >= 3""")
def islands_stride(t: Tables) -> DataFrame:
    """Runs of consecutive events of a type."""
    return compare.stride_islands(t.events.select("event_type", "event_id"), ["event_type"], "event_id", F.lit(1))


@query("WIN-12", sql="""SELECT n_name, o_orderkey, rank::INT AS rank FROM (SELECT n_name, o_orderkey, row_number() OVER (PARTITION BY n_name ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) WHERE rank <= 10""")
def topn_per_group(t: Tables) -> DataFrame:
    """The ten largest orders of each nation."""
    from millrace.functions.semantics import top_n

    j = t.orders.select("o_orderkey", "o_custkey", "o_totalprice").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return top_n(j.select("n_name", "o_orderkey", "o_totalprice"), ["n_name"], 10, F.desc("o_totalprice"), F.col("o_orderkey")).select("n_name", "o_orderkey", "rank")


@query("WIN-14", sql="""
WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END AS d FROM events), s AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e)
SELECT user_id, max(held)::BIGINT AS deepest, arg_max(held, event_id)::BIGINT AS left_open FROM (SELECT user_id, event_id, run - least(0, min(run) OVER (PARTITION BY user_id ORDER BY event_id)) AS held FROM s) GROUP BY 1""")
def stateful_fold(t: Tables) -> DataFrame:
    """A depth that opens and closes in order and never falls below zero: the running sum less its running minimum."""
    d = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    w = Window.partitionBy("user_id").orderBy("event_id")
    s = t.events.select("user_id", "event_id", F.sum(d).over(w).alias("run"))
    held = s.select("user_id", "event_id", (F.col("run") - F.least(F.lit(0), F.min("run").over(w))).alias("held"))
    return held.groupBy("user_id").agg(F.max("held").alias("deepest"), F.max_by("held", "event_id").alias("left_open"))


@query("WIN-14", sql=f"""
WITH e AS (SELECT user_id, event_id, {SQL_KEY} % 8 AS lock, event_type IN ('view', 'click', 'signup') AS takes FROM events WHERE {SQL_KEY} IS NOT NULL), s AS (SELECT *, sum(CASE WHEN takes THEN 1 ELSE -1 END) OVER (PARTITION BY user_id, lock ORDER BY event_id) AS run FROM e),
h AS (SELECT *, run - least(0, min(run) OVER (PARTITION BY user_id, lock ORDER BY event_id)) AS depth FROM s), o AS (SELECT DISTINCT user_id, lock FROM e),
c AS (SELECT a.user_id, a.event_id, a.lock AS inner_lock, o.lock AS outer_lock FROM e a JOIN o ON o.user_id = a.user_id AND o.lock <> a.lock WHERE a.takes),
p AS (SELECT c.outer_lock, c.inner_lock, count(*) AS n FROM c ASOF JOIN h ON h.user_id = c.user_id AND h.lock = c.outer_lock AND c.event_id > h.event_id WHERE h.depth > 0 GROUP BY 1, 2)
SELECT outer_lock, inner_lock, n, EXISTS (SELECT 1 FROM p q WHERE q.outer_lock = p.inner_lock AND q.inner_lock = p.outer_lock) AS risk FROM p""")
def lock_order(t: Tables) -> DataFrame:
    """What is held while something else is taken, and where the other order occurs too."""
    e = t.events.select("user_id", "event_id", (event_key() % 8).alias("lock"), F.col("event_type").isin("view", "click", "signup").alias("takes")).where("lock IS NOT NULL")
    p = compare.held_pairs(e, "user_id", "event_id", "lock", "takes").groupBy(F.col("outer").alias("outer_lock"), F.col("inner").alias("inner_lock")).agg(F.count("*").alias("n"))
    back = p.select(F.col("inner_lock").alias("outer_lock"), F.col("outer_lock").alias("inner_lock"), F.lit(True).alias("back"))
    return p.join(back, ["outer_lock", "inner_lock"], "left").select("outer_lock", "inner_lock", "n", F.coalesce("back", F.lit(False)).alias("risk"))


@query("STR-09", sql="SELECT event_type AS state, next_state, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_state FROM events) WHERE next_state IS NOT NULL GROUP BY 1, 2")
def state_transitions(t: Tables) -> DataFrame:
    return compare.transitions(t.events.select("user_id", "event_type", "ts", "event_id"), ["user_id"], "event_type", "ts", "event_id")


_limits = """SELECT p_partkey, p_size - 10 AS alo, p_size + 10 AS ahi, CASE WHEN p_partkey % 3 <> 0 THEN [1, 2, 3 + p_partkey % 3] END AS am, CASE WHEN p_partkey % 5 <> 0 THEN 3 END AS ak, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey & 3 END AS ae,
CASE WHEN p_size > 5 THEN p_size - 5 END AS blo, p_size * 2 AS bhi, CASE WHEN p_partkey % 4 <> 0 THEN [2, 3 + p_partkey % 4] END AS bm, 6 AS bk, (p_partkey // 3) & 6 AS be FROM part"""


@query("FLT-14", sql=f"""WITH l AS ({_limits}), x AS (SELECT *, coalesce((ae & ak & bk) <> (be & ak & bk), false) AS clash, ak & bk & ~xor(ae, be) AS common FROM l)
SELECT p_partkey, CASE WHEN clash THEN 1 ELSE greatest(alo, blo) END::BIGINT AS both_lo, CASE WHEN clash THEN 0 ELSE least(ahi, bhi) END::BIGINT AS both_hi, list_sort(CASE WHEN am IS NULL THEN bm WHEN bm IS NULL THEN am ELSE list_intersect(am, bm) END) AS both_members,
coalesce(ak | bk, bk)::BIGINT AS both_mask, coalesce(ae | be, be)::BIGINT AS both_expected, CASE WHEN blo IS NOT NULL THEN least(alo, blo) END::BIGINT AS any_lo, greatest(ahi, bhi)::BIGINT AS any_hi,
CASE WHEN am IS NOT NULL AND bm IS NOT NULL THEN list_sort(list_distinct(list_concat(am, bm))) END AS any_members, common::BIGINT AS any_mask, (ae & common)::BIGINT AS any_expected FROM x""")
def constraint_algebra(t: Tables) -> DataFrame:
    """Two limits for each part, as one that holds both and as one that either satisfies."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    number = lambda c: c.cast("bigint")
    a = F.struct(number(size - 10).alias("lo"), number(size + 10).alias("hi"), F.when(k % 3 != 0, F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"), 3 + k % 3)).alias("members"), F.when(k % 5 != 0, F.lit(3).cast("bigint")).alias("mask"), F.when(k % 5 != 0, k.bitwiseAND(3)).alias("expected"))
    b = F.struct(F.when(size > 5, size - 5).alias("lo"), (size * 2).alias("hi"), F.when(k % 4 != 0, F.array(F.lit(2).cast("bigint"), 3 + k % 4)).alias("members"), F.lit(6).cast("bigint").alias("mask"), F.floor(k / 3).bitwiseAND(6).alias("expected"))
    p = t.part.select("p_partkey", a.alias("a"), b.alias("b"))
    both, either = scoring.intersect(F.col("a"), F.col("b")), scoring.union(F.col("a"), F.col("b"))
    named = lambda c, name: [(F.sort_array(c[f]) if f == "members" else c[f]).alias(f"{name}_{f}") for f in ("lo", "hi", "members", "mask", "expected")]
    return p.select("p_partkey", *named(both, "both"), *named(either, "any"))


@query("FLT-13", sql=f"""
WITH e AS (SELECT event_type, value, {SQL_KEY} AS k FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (coalesce(CASE event_type WHEN 'view' THEN value < 1 OR value > 100 WHEN 'click' THEN k NOT IN (1, 2, 3, 5, 8, 13) WHEN 'error' THEN (k & 3) <> 1 ELSE false END, false)) AS violations FROM e GROUP BY 1""")
def constraint_violations(t: Tables) -> DataFrame:
    """Values held against a range, a set and a mask."""
    rows = [("view", "range", 1.0, 100.0, None, None, None), ("click", "set", None, None, [1, 2, 3, 5, 8, 13], None, None), ("error", "bitmask", None, None, None, 3, 1)]
    c = t.spark.createDataFrame(rows, "event_type string, kind string, min_val double, max_val double, members array<bigint>, mask bigint, expected bigint")
    v = t.events.select("event_type", F.when(F.col("event_type") == "view", F.col("value")).otherwise(event_key().cast("double")).alias("value"))
    return scoring.violations(v, F.broadcast(c), ["event_type"]).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("violation").alias("violations"))


@query("FN-08", "FN-09", sql="SELECT event_id, true AS success, 6 AS fields_decoded, event_id AS id, CASE WHEN user_id % 2 = 0 THEN user_id & 65535 END AS user, (user_id % 4)::INT AS tail, '' AS error_message FROM events")
def bit_decode(t: Tables) -> DataFrame:
    """Events packed into bytes and decoded again by a schema, with optional and counted fields."""
    from millrace.functions.decode import FIELD, decode

    fields = [("bit", "has_user", 0, False, "", False, ""), ("bits", "n", 3, False, "", False, ""), ("flush", "pad", 0, False, "", False, ""), ("int64", "id", 0, False, "", False, ""), ("uint16", "user", 0, True, "has_user", False, ""), ("uint8", "tail", 0, False, "", True, "n")]
    schema = F.array(*(F.struct(*(F.lit(v).cast(k).alias(n) for v, (n, k) in zip(f, [("type", "string"), ("name", "string"), ("bit_size", "int"), ("is_optional", "boolean"), ("condition", "string"), ("is_array", "boolean"), ("array_size_field", "string")]))) for f in fields)).cast(f"array<{FIELD}>")
    n = F.col("user_id") % 4
    le = lambda c, size: F.concat(*(F.substring(F.lpad(F.hex(c), 2 * size, "0"), 2 * (size - i) - 1, 2) for i in range(size)))
    head = F.lpad(F.hex((F.when(F.col("user_id") % 2 == 0, 128).otherwise(0) + n * 16).cast("bigint")), 2, "0")
    packed = F.unhex(F.concat(head, le(F.col("event_id"), 8), F.when(F.col("user_id") % 2 == 0, le(F.col("user_id").bitwiseAND(65535), 2)).otherwise(""), F.repeat(F.lit("07"), n.cast("int"))))
    out = decode(t.events.select("event_id", packed.alias("data"), schema.alias("fields")), "data", "fields", ["event_id"])
    v = F.col("decoded_values")
    return out.select("event_id", "success", "fields_decoded", F.get(v["id"], F.lit(0)).cast("bigint").alias("id"), F.get(F.try_element_at(v, F.lit("user")), F.lit(0)).cast("bigint").alias("user"), F.size(v["tail"]).alias("tail"), "error_message")


@query("SET-05", "STR-02", "STR-03", sql="""
WITH a AS (SELECT doc_id, lang, sha256(coalesce(text, '')) AS h FROM documents WHERE source <> 'src3'), b AS (SELECT doc_id, CASE WHEN source = 'src7' THEN 'xx' ELSE lang END AS lang, sha256(CASE WHEN lang = 'de' THEN upper(coalesce(text, '')) ELSE coalesce(text, '') END) AS h FROM documents WHERE source <> 'src5')
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.lang IS DISTINCT FROM b.lang THEN 'renamed' WHEN a.h <> b.h THEN 'modified' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def change_detection(t: Tables) -> DataFrame:
    """Two snapshots of the documents, in which a source came, one went, one changed its label and a language its texts, compared by content hash."""
    text = F.coalesce("text", F.lit(""))
    a = t.documents.where("source <> 'src3'").select("doc_id", "lang", text.alias("text"))
    b = t.documents.where("source <> 'src5'").select("doc_id", F.when(F.col("source") == "src7", "xx").otherwise(F.col("lang")).alias("lang"), F.when(F.col("lang") == "de", F.upper(text)).otherwise(text).alias("text"))
    return compare.changes(a, b, "doc_id", F.sha2("text", 256), "lang")


@query("STR-04", "STR-16", sql="SELECT event_id, event_type FROM (SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 500) ORDER BY event_id")
def bounded_log(t: Tables) -> DataFrame:
    """The newest 500 entries of a log, oldest first (a bounded log)."""
    from millrace.streaming.flows import last_n

    return last_n(t.events.select("event_id", "event_type"), 500, "event_id")


@query("STR-01", "WIN-09", sql="SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_change(t: Tables) -> DataFrame:
    """The last event of each user."""
    return first_by(t.events, ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("SIM-11", sql="""
WITH o AS (SELECT o_orderkey, o_totalprice, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS lines, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN n = 0 THEN 'no_lines' END, CASE WHEN lines > 2 * o_totalprice THEN 'lines_exceed_total' END, CASE WHEN n > 0 AND lines < 0.5 * o_totalprice THEN 'lines_below_total' END], lambda x: x IS NOT NULL)) AS rule FROM o) GROUP BY 1""")
def consistency_checks(t: Tables) -> DataFrame:
    """Rules across two sources."""
    l = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(exact_sum(F.col("l_extendedprice")).alias("lines"), F.count("*").alias("n"))  # noqa: E741
    o = t.orders.select("o_orderkey", "o_totalprice").join(l, "o_orderkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rules = F.array_compact(F.array(F.when(F.col("n") == 0, "no_lines"), F.when(F.col("lines") > 2 * F.col("o_totalprice"), "lines_exceed_total"), F.when((F.col("n") > 0) & (F.col("lines") < 0.5 * F.col("o_totalprice")), "lines_below_total")))
    return o.select(F.explode(rules).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
