"""Connected components over an edge table that may exceed any one machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import materialize


#: Members of a hot group are dealt into so many runs.
RUNS = 64


def in_runs(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(RUNS)).cast("int")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node that each node with an edge can reach.

    Parents hook on to the smallest grandparent among the neighbours and shortcut until nothing changes, which takes a number of rounds in
    the order of the logarithm of the number of nodes. Every round is written to the shared folder. Minima are aggregated before they
    are shuffled, so hubs do not gather their neighbours; children ask for their grandparent in runs, so that a hot parent is one row of each
    run; the joins over edges are left to the skew handling of adaptive execution.
    """
    e = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).where("u <> v").distinct(), "cc-edges")
    p = materialize(e.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("f"), F.col("node").alias("gf")), "cc-parents")
    while True:
        least = e.join(p.select(F.col("node").alias("v"), "gf"), "v").groupBy("u").agg(F.min("gf").alias("m"))
        own = p.join(least, p.node == least.u)
        proposals = own.select("node", F.least("f", "gf", "m").alias("f")).unionByName(own.select(F.col("f").alias("node"), F.col("m").alias("f")))
        parents = proposals.groupBy("node").agg(F.min("f").alias("f"))
        parents = materialize(parents.withColumn("run", in_runs("node")), "cc-up")
        up = parents.select("f", "run").distinct().join(parents.select(F.col("node").alias("f"), F.col("f").alias("gf")), "f")
        new = materialize(parents.join(up, ["f", "run"]).join(p.select("node", F.col("gf").alias("was")), "node").select("node", "f", "gf", (F.col("gf") != F.col("was")).alias("moved")), "cc-parents")
        p = new.select("node", "f", "gf")
        if not new.where("moved").limit(1).count():
            return p.select("node", F.col("gf").alias("root"))


def named_components(members: DataFrame, roots: DataFrame) -> DataFrame:
    """node, component_id: the least of all members (node, least) of a component by roots (node, root); nodes without a root are alone.

    The least goes up and the name back by runs of a component, so that none gathers in a task.
    """
    rooted = materialize(members.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"), in_runs("node").alias("run")), "cc-members")
    runs = rooted.groupBy("root", "run").agg(F.min("least").alias("least"))
    ids = runs.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(runs.select("root", "run").join(ids, "root"), ["root", "run"]).select("node", "component_id")
