"""Named queries: graphs of nations that trade, and of suppliers and brands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.catalog import Tables, query
from millrace.operators import graph

#: Supplier's nation to customer's nation, counted over every line of every order.
EDGES = """e AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 WHERE s_nationkey <> c_nationkey GROUP BY 1, 2)"""
#: The same without what goes back: acyclic by construction.
DAG = EDGES + ", d AS (SELECT src, dst, weight FROM e WHERE src < dst)"
NODES = "n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"


#: Both once, for loops written out.
MEASURED = EDGES.replace("e AS (", "e AS MATERIALIZED (") + ", " + NODES.replace("n AS (", "n AS MATERIALIZED (")


def _edges(t: Tables) -> DataFrame:
    l = t.lineitem.select("l_orderkey", "l_suppkey")  # noqa: E741
    o = t.orders.select("o_orderkey", "o_custkey")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return graph.edge_list(j, "s_nationkey", "c_nationkey")


def _dag(t: Tables) -> DataFrame:
    return _edges(t).where("src < dst")


@query("GRF-01", sql=f"WITH {EDGES} SELECT src, dst, weight FROM e")
def graph_edges(t: Tables) -> DataFrame:
    return _edges(t)


@query("AGG-25", sql=f"WITH {EDGES}, {NODES} SELECT node, (SELECT count(*) FROM e WHERE src = node) AS out_degree, (SELECT count(*) FROM e WHERE dst = node) AS in_degree FROM n")
def graph_degree(t: Tables) -> DataFrame:
    return graph.degrees(_edges(t))


@query("AGG-25", sql=f"""WITH {EDGES}, {NODES}, g AS (SELECT node, (SELECT count(*) FROM e WHERE src = node) + (SELECT count(*) FROM e WHERE dst = node) AS d FROM n)
SELECT count(*) AS nodes, (SELECT count(*) FROM e) AS edges, round(avg(d), 6) AS avg_degree, max(d) AS max_degree, round((SELECT count(*) FROM e) / greatest(count(*) * (count(*) - 1), 1), 6) AS density FROM g""")
def graph_stats(t: Tables) -> DataFrame:
    return graph.stats(_edges(t))


@query("AGG-26", sql=f"""
WITH {EDGES}, x AS (SELECT a.n_regionkey AS from_class, b.n_regionkey AS to_class, src, weight FROM e JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey <> b.n_regionkey),
g AS (SELECT from_class, to_class, src, sum(weight) AS w FROM x GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY from_class, to_class ORDER BY w DESC, src) AS r FROM g)
SELECT from_class, to_class, sum(w)::BIGINT AS weight, list(src ORDER BY r) FILTER (r <= 5) AS gateways FROM r GROUP BY 1, 2""")
def cross_class_edges(t: Tables) -> DataFrame:
    """Trade between regions, with the nations that carry most of it."""
    labels = t.nation.select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("class"))
    return graph.cross_class_edges(_edges(t), labels, skip=-1)


@query("AGG-27", sql=f"WITH {EDGES} SELECT r_name, round(100.0 * avg((a.n_regionkey = r_regionkey OR b.n_regionkey = r_regionkey)::INT), 4) AS coupling FROM e JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst, region GROUP BY 1")
def coupling(t: Tables) -> DataFrame:
    """The share of edges that touch each region."""
    lab = t.nation.select("n_nationkey", "n_regionkey")
    e = _edges(t).join(lab.withColumnsRenamed({"n_nationkey": "src", "n_regionkey": "a"}), "src").join(lab.withColumnsRenamed({"n_nationkey": "dst", "n_regionkey": "b"}), "dst")
    total = e.agg(F.count("*").alias("total"))  # one row
    touched = e.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("r_regionkey")).groupBy("r_regionkey").agg(F.count("*").alias("n"))
    return t.region.join(touched, "r_regionkey", "left").join(F.broadcast(total)).select("r_name", F.round(100.0 * F.coalesce("n", F.lit(0)) / F.greatest("total", F.lit(1)), 4).alias("coupling"))


_pr = "p0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM n) AS r FROM n)"
for _i in range(1, 11):
    _pr += f""", p{_i} AS (SELECT n.node, 0.15 / (SELECT count(*) FROM n) + 0.85 * (coalesce(s.x, 0) + (SELECT coalesce(sum(r), 0) FROM p{_i - 1} WHERE node NOT IN (SELECT src FROM e)) / (SELECT count(*) FROM n)) AS r
 FROM n LEFT JOIN (SELECT dst, sum(p.r / o.k) AS x FROM e JOIN p{_i - 1} p ON p.node = e.src JOIN o ON o.src = e.src GROUP BY dst) s ON s.dst = n.node)"""


@query("GRF-02", sql=f"WITH {EDGES}, {NODES}, o AS (SELECT src, count(*) AS k FROM e GROUP BY 1), {_pr} SELECT node, round(r, 6) AS rank FROM p10")
def pagerank(t: Tables) -> DataFrame:
    """Ten rounds from a uniform start."""
    return graph.pagerank(_edges(t), rounds=10, tol=0).select("node", F.round("rank", 6).alias("rank"))


_hits = "h0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE AS hub, 1.0::DOUBLE AS authority FROM n)"
for _i in range(1, 51):
    _hits += f""", x{_i} AS MATERIALIZED (SELECT node, coalesce((SELECT sum(p.authority) FROM e JOIN h{_i - 1} p ON p.node = e.dst WHERE e.src = n.node), 0) AS h, coalesce((SELECT sum(p.hub) FROM e JOIN h{_i - 1} p ON p.node = e.src WHERE e.dst = n.node), 0) AS a FROM n),
h{_i} AS MATERIALIZED (SELECT node, h / sqrt((SELECT sum(h * h) FROM x{_i})) AS hub, a / sqrt((SELECT sum(a * a) FROM x{_i})) AS authority FROM x{_i})"""


@query("GRF-03", sql=f"WITH {MEASURED}, {_hits} SELECT node, round(hub, 4) AS hub, round(authority, 4) AS authority FROM h50")
def hits(t: Tables) -> DataFrame:
    out = graph.hits(_edges(t))
    return out.select("node", F.round("hub", 4).alias("hub"), F.round("authority", 4).alias("authority"))


@query("GRF-04", sql=f"""WITH RECURSIVE {MEASURED}, w(s, node, d) AS (SELECT node, node, 0 FROM n UNION SELECT w.s, e.dst, w.d + 1 FROM w JOIN e ON e.src = w.node WHERE w.d < 25), dist AS MATERIALIZED (SELECT s, node, min(d) AS d FROM w GROUP BY 1, 2),
g(s, node, d, sigma) AS (SELECT node, node, 0, 1.0::DOUBLE FROM n UNION ALL SELECT g.s, e.dst, g.d + 1, sum(g.sigma) FROM g JOIN e ON e.src = g.node JOIN dist ON dist.s = g.s AND dist.node = e.dst AND dist.d = g.d + 1 GROUP BY 1, 2, 3),
b AS (SELECT v.node, sum(v.sigma * t.sigma / st.sigma) AS x FROM g v JOIN g t ON t.s = v.node JOIN g st ON st.s = v.s AND st.node = t.node AND st.d = v.d + t.d WHERE v.node <> v.s AND t.node <> v.node GROUP BY 1)
SELECT node, round(coalesce(x, 0) / (SELECT count(*) FROM n), 6) AS score FROM n LEFT JOIN b USING (node)""")
def betweenness(t: Tables) -> DataFrame:
    """Over all sources."""
    e = _edges(t)
    return graph.betweenness(e, graph.nodes_of(e)).select("node", F.round("score", 6).alias("score"))


_votes = "c0 AS MATERIALIZED (SELECT node, node AS community FROM n)"
for _i in range(1, 31):
    _votes += f""", c{_i} AS MATERIALIZED (SELECT node, arg_min(community, (-w, community)) AS community FROM (SELECT node, community, sum(w) AS w FROM (SELECT u.a AS node, c.community, u.w FROM u JOIN c{_i - 1} c ON c.node = u.b
 UNION ALL SELECT node, community, 1 FROM c{_i - 1}) GROUP BY 1, 2) GROUP BY 1)"""


@query("GRF-05", sql=f"WITH {MEASURED}, u AS MATERIALIZED (SELECT a, b, sum(weight) AS w FROM (SELECT src AS a, dst AS b, weight FROM e UNION ALL SELECT dst, src, weight FROM e) GROUP BY 1, 2), {_votes} SELECT node, community FROM c30")
def communities(t: Tables) -> DataFrame:
    return graph.label_propagation(_edges(t))


@query("GRF-06", sql=f"""WITH RECURSIVE {EDGES}, r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)
SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1""")
def scc(t: Tables) -> DataFrame:
    return graph.scc(_edges(t))


@query("GRF-07", sql=f"""WITH RECURSIVE {DAG}, r(node, depth) AS (SELECT DISTINCT src, 0 FROM d WHERE src NOT IN (SELECT dst FROM d) UNION SELECT d.dst, r.depth + 1 FROM r JOIN d ON d.src = r.node WHERE r.depth < 30)
SELECT node, min(depth)::INT AS depth FROM r GROUP BY node""")
def bfs_depth(t: Tables) -> DataFrame:
    """Steps from the nodes without edges in."""
    e = _dag(t)
    return graph.bfs_depth(e, graph.roots_of(e))


@query("GRF-08", sql=f"WITH RECURSIVE {EDGES}, r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT src, dst FROM r WHERE src <> dst")
def closure(t: Tables) -> DataFrame:
    return graph.closure(_edges(t))


@query("GRF-14", sql=f"""WITH RECURSIVE {EDGES}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r(node, c) AS (SELECT a, a FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.node)
SELECT node, min(c) AS component FROM r GROUP BY node""")
def connected_components(t: Tables) -> DataFrame:
    return graph.components(_edges(t))


@query("GRF-09", "GRF-10", sql=f"""WITH RECURSIVE {DAG}, r(node, l) AS (SELECT node, 0 FROM (SELECT src AS node FROM d UNION SELECT dst FROM d) UNION SELECT d.src, r.l + 1 FROM r JOIN d ON d.dst = r.node WHERE r.l < 30)
SELECT node, max(l)::INT AS layer, false AS cyclic FROM r GROUP BY node""")
def layering(t: Tables) -> DataFrame:
    """Phases: a node follows when all it points to are placed."""
    return graph.layers(_dag(t))


@query("GRF-11", sql=f"""WITH RECURSIVE {DAG}, r(node, l) AS (SELECT node, 0 FROM (SELECT src AS node FROM d UNION SELECT dst FROM d) UNION SELECT d.src, r.l + 1 FROM r JOIN d ON d.dst = r.node WHERE r.l < 30)
SELECT node, max(l)::INT AS length FROM r GROUP BY node""")
def critical_path(t: Tables) -> DataFrame:
    return graph.critical_path(_dag(t))


@query("GRF-12", "GRF-18", sql=f"""WITH {EDGES} SELECT [src, dst] AS cycle FROM e WHERE src < dst AND EXISTS (SELECT 1 FROM e f WHERE f.src = e.dst AND f.dst = e.src)
UNION ALL SELECT [x.src, y.src, z.src] FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = y.dst AND z.dst = x.src WHERE x.src < y.src AND x.src < z.src AND y.src <> z.src""")
def short_cycles(t: Tables) -> DataFrame:
    return graph.short_cycles(_edges(t))


@query("GRF-11", sql=f"""WITH RECURSIVE {DAG}, m AS MATERIALIZED (SELECT * FROM d), r(node, l) AS (SELECT node, 0 FROM (SELECT src AS node FROM m UNION SELECT dst FROM m) UNION SELECT m.src, r.l + 1 FROM r JOIN m ON m.dst = r.node WHERE r.l < 30),
k AS MATERIALIZED (SELECT node, max(l) AS l FROM r GROUP BY node), f AS MATERIALIZED (SELECT m.src, min(m.dst) AS dst FROM m JOIN k a ON a.node = m.src JOIN k b ON b.node = m.dst WHERE a.l = b.l + 1 GROUP BY 1),
c(position, node) AS (SELECT 0, arg_min(node, (-l, node)) FROM k UNION ALL SELECT position + 1, dst FROM c JOIN f ON f.src = c.node) SELECT position, node FROM c""")
def critical_route(t: Tables) -> DataFrame:
    """The longest chain of nations itself."""
    return graph.critical_route(_dag(t))


@query("GRF-18", sql="""WITH w AS (SELECT DISTINCT l_partkey AS state_key, l_suppkey AS node, CASE WHEN l_discount = 0 THEN 'ends' ELSE 'begins' END AS role FROM lineitem WHERE l_discount >= 0)
SELECT * FROM w WHERE state_key IN (SELECT state_key FROM w GROUP BY 1 HAVING count(DISTINCT role) = 2)""")
def teardown_pairs(t: Tables) -> DataFrame:
    """Suppliers that end a part's discount, and those that begin one."""
    return graph.teardowns(t.lineitem.select(F.col("l_partkey").alias("state_key"), F.col("l_suppkey").alias("node"), F.col("l_discount").alias("value")))


@query("GRF-18", sql="""WITH e AS (SELECT user_id, event_id, event_type IN ('view', 'click') AS d FROM events), b AS (SELECT *, coalesce((lag(d) OVER (PARTITION BY user_id ORDER BY event_id) = d)::INT, 1) AS b FROM e),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM b) SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS steps FROM r GROUP BY user_id, run HAVING count(*) >= 4""")
def ping_pong_runs(t: Tables) -> DataFrame:
    """Where users' events go back and forth between two sides."""
    return graph.ping_pong(t.events.select("user_id", "event_id", F.col("event_type").isin("view", "click").alias("d")), "user_id", "event_id", "d")


#: Each nation's heaviest customer.
CHAIN = EDGES + ", c AS (SELECT src, arg_min(dst, (-weight, dst)) AS dst FROM e GROUP BY src)"


def _heaviest(t: Tables) -> DataFrame:
    return _edges(t).groupBy("src").agg(F.min_by("dst", F.struct(-F.col("weight"), F.col("dst"))).alias("dst"))


@query("GRF-16", "GRF-17", sql=f"""WITH RECURSIVE {CHAIN}, r(node, chain, done) AS (SELECT src, [src], false FROM c UNION ALL SELECT r.node, CASE WHEN c.dst IS NULL OR list_contains(r.chain, c.dst) THEN r.chain ELSE list_append(r.chain, c.dst) END, c.dst IS NULL OR list_contains(r.chain, c.dst)
 FROM r LEFT JOIN c ON c.src = r.chain[-1] WHERE NOT done AND len(chain) < 40) SELECT node, chain FROM r WHERE done""")
def hierarchy_walk(t: Tables) -> DataFrame:
    """From each nation along its heaviest customer until one repeats."""
    return graph.hierarchy(_heaviest(t), "src", "dst")


@query("GRF-12", sql=f"""WITH RECURSIVE {CHAIN}, k AS MATERIALIZED (SELECT * FROM c), r(path, closed) AS (SELECT [src], false FROM k UNION ALL SELECT CASE WHEN k.dst = r.path[1] THEN r.path ELSE list_append(r.path, k.dst) END, k.dst = r.path[1]
 FROM r JOIN k ON k.src = r.path[-1] WHERE NOT closed AND (k.dst = r.path[1] OR NOT list_contains(r.path, k.dst))) SELECT path AS cycle FROM r WHERE closed AND path[1] = list_min(path)""")
def cycles_of_any_length(t: Tables) -> DataFrame:
    """Where the heaviest customers lead back."""
    return graph.short_cycles(_heaviest(t), None)


@query("GRF-17", sql=f"""WITH RECURSIVE {CHAIN}, r(node, chain) AS (SELECT src, [src] FROM c UNION ALL SELECT r.node, list_append(r.chain, c.dst) FROM r JOIN c ON c.src = r.chain[-1] WHERE NOT list_contains(r.chain, c.dst) AND len(r.chain) < 6)
SELECT node, arg_max(chain, len(chain)) AS chain FROM r GROUP BY node""")
def first_edge_chains(t: Tables) -> DataFrame:
    return graph.first_edge_chains(_edges(t), F.struct(-F.col("weight"), F.col("dst")), 5)


@query("GRF-13", sql=f"""WITH RECURSIVE {CHAIN}, s AS (SELECT dst AS node FROM c WHERE dst NOT IN (SELECT src FROM c)), r(path, kind) AS (SELECT [src], 'open' FROM c WHERE src NOT IN (SELECT dst FROM c)
 UNION ALL SELECT list_append(r.path, c.dst), CASE WHEN list_contains(r.path, c.dst) THEN 'cycle' WHEN c.dst IN (SELECT node FROM s) THEN 'sink' ELSE 'open' END FROM r JOIN c ON c.src = r.path[-1] WHERE kind = 'open')
SELECT path, kind FROM r WHERE kind <> 'open'""")
def bounded_paths(t: Tables) -> DataFrame:
    """Paths from nations nobody prefers to where they end or repeat."""
    e = _heaviest(t)
    return graph.paths(e, graph.roots_of(e), 40)


@query("GRF-18", sql=f"""WITH {EDGES} SELECT 'handshake' AS kind, [src, dst] AS nodes FROM e WHERE src < dst AND EXISTS (SELECT 1 FROM e f WHERE f.src = e.dst AND f.dst = e.src)
UNION ALL SELECT 'handshake', [x.src, y.src, z.src] FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = y.dst AND z.dst = x.src WHERE x.src < y.src AND x.src < z.src AND y.src <> z.src
UNION ALL SELECT 'gate', [src] FROM e GROUP BY src HAVING count(*) >= 3""")
def graph_patterns(t: Tables) -> DataFrame:
    return graph.patterns(_edges(t))


@query("GRF-18", sql=f"""WITH RECURSIVE {CHAIN}, i AS (SELECT dst FROM c GROUP BY dst HAVING count(*) = 1), k AS (SELECT c.src, c.dst FROM c JOIN i USING (dst)),
r(path) AS (SELECT [src] FROM k WHERE src NOT IN (SELECT dst FROM c) UNION ALL SELECT list_append(path, k.dst) FROM r JOIN k ON k.src = path[-1])
SELECT arg_max(path, len(path)) AS chain FROM r GROUP BY path[1] HAVING max(len(path)) >= 3""")
def linear_chains(t: Tables) -> DataFrame:
    """Chains of nations that are each other's only link."""
    return graph.linear_chains(_heaviest(t))


@query("GRF-19", sql="""
WITH p AS (SELECT user_id, event_id, CASE WHEN event_type IN ('signup') THEN 'enter' WHEN event_type IN ('view', 'click') THEN 'browse' ELSE 'act' END AS phase FROM events)
SELECT phase AS state, next_state, count(*) AS n FROM (SELECT phase, lead(phase) OVER (PARTITION BY user_id ORDER BY event_id) AS next_state FROM p) WHERE next_state IS NOT NULL AND phase <> next_state GROUP BY 1, 2""")
def phase_machine(t: Tables) -> DataFrame:
    """Transitions between phases that events belong to."""
    from millrace.operators.compare import transitions

    e = F.col("event_type")
    p = t.events.select("user_id", "event_id", F.when(e == "signup", "enter").when(e.isin("view", "click"), "browse").otherwise("act").alias("phase"))
    return transitions(p, ["user_id"], "phase", "event_id").where("state <> next_state")
