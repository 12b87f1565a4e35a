"""Exact deduplication by a tree-merge of digest runs.

Every row belongs to a run (RUNS virtual partitions by a hash of its id and place). A run is reduced to one record for each digest: the
identifier that stays, the count. In each binomial round FAN_IN neighbouring runs exchange their records and merge; after ROUNDS rounds
one run holds each digest once. The way back is the same tree in one step: the records of the lowest runs fetch what their digest ended
up with, so that a row joins on (digest, run) and a group of any size is spread over the runs it came from.

A record's key is the SHA-256 of the normalised text together with its length and a second, independent hash, so that identifiers are
only merged for texts which agree in all three, at every level.

Defined results: a null text counts as empty; empty texts form one group. Of equal texts, the largest id stays ("largest") or the smallest
("smallest"); a null id is smaller than any. Of repeated rows
of one id exactly one is kept. Other columns are ignored by ``groups`` and carried by ``unique_documents``. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import LOWER, UPPER, ascii_lower, drop_rows, materialize, read, with_row_key

FAN_IN = 16
ROUNDS = 2
RUNS = FAN_IN**ROUNDS
KEY = ["digest", "len", "check"]


def digests(docs: DataFrame, doc_id: str, text: str, row: Column, normalise=ascii_lower) -> DataFrame:
    """rid, id, run and the digest columns of every row, written once."""
    norm = F.coalesce(F.col(text), F.lit(""))
    norm = normalise(norm) if normalise else norm
    out = (
        docs.select(row.alias("rid"), F.col(doc_id).alias("id"), norm.alias("t"))
        .select("rid", "id", F.pmod(F.xxhash64("rid"), F.lit(RUNS)).cast("int").alias("run"), F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").alias("len"), F.xxhash64("t").alias("check"))
    )
    return materialize(out, "op4-digests")


def tree_merge(rows: DataFrame, keep: str) -> tuple[DataFrame, DataFrame]:
    """The records of the lowest runs, and the one record of each digest that the rounds end with."""
    best = (F.max if keep == "largest" else F.min)("best").alias("best")
    # a total order: a null id is smaller than any, and rows of one id follow their place
    leaf = rows.select("run", *KEY, F.struct(F.col("id").isNotNull().alias("some"), "id", "rid").alias("best"))
    lowest = up = leaf.groupBy("run", *KEY).agg(best, F.count("*").alias("n"))
    for _ in range(ROUNDS):
        up = up.withColumn("run", F.shiftright("run", FAN_IN.bit_length() - 1)).groupBy("run", *KEY).agg(best, F.sum("n").alias("n"))
    return lowest.select("run", *KEY), up.select(*KEY, "best", "n")


def groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: str = "largest", row: Column | None = None, normalise=ascii_lower) -> DataFrame:
    """One row per row of docs: rid (row, by default a running number), id, digest (binary), keep_id, group_size, kept."""
    rows = digests(docs, doc_id, text, F.monotonically_increasing_id() if row is None else row, normalise)
    lowest, top = tree_merge(rows, keep)
    down = lowest.join(top, KEY)
    return rows.join(down, ["run", *KEY]).select("rid", "id", "digest", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("best.rid") == F.col("rid")).alias("kept"))


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of groups() over documents."""
    found = groups(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def unique_documents(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of docs that stay, all columns kept."""
    keyed, row = with_row_key(docs)
    found = groups(keyed, keep=keep, row=F.col(row))
    return drop_rows(keyed, row, found.where("NOT kept").select("rid"))


ORACLE = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
