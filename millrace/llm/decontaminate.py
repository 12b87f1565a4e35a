"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are sets of word shingles. Shingles are ordered by rarity: by how often the rarest of their words occurs in all
documents, which bounds their own frequency. A document that contains a whole window contains in particular its rarest shingle, so that
one is the window's necessary prefix (containment 1 needs a prefix of |window| - |window| + 1 = 1 element). Places of documents join the
prefixes on the shingle's rarest word, its anchor; the anchor's place in both gives where the window would have to begin, which bounds
position and length; then the shingle, and last the whole window, is compared word by word.

No row of the corpus is shuffled for the join: the windows come to the documents, in blocks of at most ``max_windows`` (a larger
benchmark takes more passes), and only verified hits are grouped, by row of the input.

Defined results: a null or empty text has no words, n_words 0 and no hits. Items without words have no windows; items with a null id
count as hits but not as items. Equal items or windows count once for each item id. Repeated rows and null ids of documents give a row
each. Other columns of either table are ignored. An empty table of documents gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import drop_rows, materialize, read, with_row_key, words

WINDOW = 10
SHINGLE = 3
MAX_BROADCAST_WINDOWS = 200_000
#: Stands at the end of every document; no shingle has this character.
END = "\x00"


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows of the items: win (its words), items (the ids that have it)."""
    w = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    return (
        w.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0))), lambda i: F.slice(F.col("w"), i + 1, window))).alias("win"))
        .groupBy("win")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def frequencies(docs_words: DataFrame, toks: DataFrame) -> DataFrame:
    """tok, df: how often the words of toks (written, distinct) occur in all documents; few enough of them come as a broadcast."""
    blocks = max(1, -(-toks.count() // (4 * MAX_BROADCAST_WINDOWS)))
    parts = []
    for b in range(blocks):
        mine = toks if blocks == 1 else toks.where(F.pmod(F.xxhash64("tok"), F.lit(blocks)) == b)
        parts.append(docs_words.select(F.explode("w").alias("tok")).join(F.broadcast(mine), "tok").groupBy("tok").agg(F.count("*").alias("df")))
    return F.broadcast(parts[0]) if blocks == 1 else reduce(DataFrame.unionByName, parts)


def prefixed(docs_words: DataFrame, windows: DataFrame, shingle: int) -> DataFrame:
    """The windows whose every word occurs in the documents: win, items, the anchor tok and its place off, the rarest shingle sh and its place at."""
    placed = windows.select("win", "items", F.posexplode("win").alias("off", "tok"))
    df = frequencies(docs_words, materialize(placed.select("tok").distinct(), "op1-words"))
    ranked = placed.join(df, "tok", "left").groupBy("win").agg(F.first("items").alias("items"), F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "tok", "off")).alias("m")).where("m.df > 0")
    at = F.least(F.col("m.off"), F.greatest(F.size("win") - shingle, F.lit(0)))
    return ranked.select("win", "items", F.col("m.tok").alias("tok"), F.col("m.off").alias("off"), at.alias("at"), F.slice("win", at + 1, F.lit(shingle)).alias("sh"))


def contamination(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, max_windows: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """One row per row of docs: its id, n_words, n_hit (words inside any occurrence of a window), spans (start and length of the occurrences, in order), items (sorted distinct ids)."""
    w = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("id"), words(F.col(text)).alias("w"))
    found = materialize(prefixed(w, item_windows(items, item_id, item_text, window), shingle), "op1-windows")
    blocks = max(1, -(-found.count() // max_windows))
    none = F.array().cast("array<string>")
    end = docs.sparkSession.range(1).select(none.alias("win"), F.lit(None).cast(found.schema["items"].dataType).alias("items"), F.lit(END).alias("tok"), F.lit(0).alias("off"), F.lit(0).alias("at"), none.alias("sh"))
    start, n = F.col("pos") - F.col("off"), F.size("w")
    same = lambda at, what: F.slice(F.col("w"), at + 1, F.size(what)) == F.col(what)
    hit = F.when(F.col("tok") == END, True).when((start < 0) | (start + F.size("win") > n), False).otherwise(same(start + F.col("at"), "sh") & same(start, "win"))
    parts = []
    for b in range(blocks):
        mine = found if blocks == 1 else found.where(F.pmod(F.xxhash64("tok"), F.lit(blocks)) == b)
        places = w.select("rid", "id", "w", F.posexplode(F.array_append("w", END)).alias("pos", "tok"))
        at = F.when(F.col("tok") != END, F.struct(start.alias("start"), F.size("win").alias("len")))
        parts.append(places.join(F.broadcast(mine.unionByName(end)), "tok").where(hit).select("rid", "id", n.cast("long").alias("n_words"), at.alias("at"), "items"))
    hits = reduce(DataFrame.unionByName, parts)
    one = hits.groupBy("rid", "id").agg(F.max("n_words").alias("n_words"), F.sort_array(F.collect_set("at")).alias("spans"), F.collect_set("items").alias("sets"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("spans", zero, lambda a, x: F.struct((a.n + F.greatest(F.lit(0), x.start + x.len - F.greatest(a.end, x.start))).alias("n"), F.greatest(a.end, x.start + x.len).alias("end")), lambda a: a.n)
    return one.select(F.col("id").alias(doc_id), "n_words", covered.cast("long").alias("n_hit"), "spans", F.sort_array(F.array_distinct(F.flatten("sets"))).alias("items"))


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of contamination() over documents and benchmark."""
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs without any window of the items, all columns kept."""
    keyed, row = with_row_key(docs)
    found = contamination(keyed, items, doc_id=row)
    return drop_rows(keyed, row, found.where("n_hit > 0").select(row))


W = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLE = f"""
WITH d AS (SELECT doc_id, {W} AS w FROM documents),
b AS (SELECT item_id, {W} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, len(w[s:s + 9]) AS n, array_to_string(w[s:s + 9], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT p.doc_id, p.s, p.n, win.item_id FROM places p JOIN win ON p.g = win.g AND p.n = win.n),
cov AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
