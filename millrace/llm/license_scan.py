"""License scan by an exact set-similarity join of licence templates with text blocks.

A template is a set of words; a text block is BLOCK consecutive words, one beginning every STRIDE words, so that any passage of up to
BLOCK - STRIDE words lies inside a block. A block matches when it holds at least THRESHOLD of a template's words. Words are ordered by
their frequency over all documents; a matching block must hold one of the |T| - ceil(THRESHOLD |T|) + 1 rarest words of T (its prefix).
Words of the documents join the prefixes; from the first prefix word that is found on, the rest of T must still reach the threshold
(position), and the block must have that many words (length); what is left is intersected exactly.

The short phrases that name a licence are templates of threshold 1 whose words stand consecutively; each is looked for by its rarest word.
The table of templates is a constant of this module and bounds what is broadcast.

Defined results: null texts count as empty and have no words or places. Repeated rows and null ids give a row each. score is the largest
containment found, 1 for a phrase, 0 where nothing matches. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._common import read, words

BLOCK, STRIDE, THRESHOLD = 64, 32, 0.8
END = "\x00"

#: Phrases that name a licence.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Opening sentences of public licences and their notices, at most BLOCK - STRIDE different words each.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
]


def template_rows(phrases=None, templates=None, threshold: float = THRESHOLD) -> list[tuple]:
    """(template number, label, words, need, phrase?)"""
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    rows = [(label, p.split(), len(p.split()), True) for p, label in phrases.items()]
    for label, t in templates:
        if len(ws := list(dict.fromkeys(t.split()))) > BLOCK - STRIDE:
            raise ValueError(f"template of {label} has more than {BLOCK - STRIDE} different words")
        rows.append((label, ws, math.ceil(round(threshold * len(ws), 9)), False))
    return [(i, *r) for i, r in enumerate(rows)]


def frequencies(w: DataFrame, toks: list[str]) -> dict[str, int]:
    """Occurrences over all documents of the templates' words: as many rows as these have words."""
    spark = w.sparkSession
    known = spark.createDataFrame([(t,) for t in toks], "tok string")
    rows = w.select(F.explode("w").alias("tok")).join(F.broadcast(known), "tok").groupBy("tok").agg(F.count("*").alias("n")).collect()
    return {r.tok: r.n for r in rows}


def prefixes(spark: SparkSession, rows: list[tuple], df: dict[str, int]) -> DataFrame:
    """tok, template, label, ws, need, phrase, off: place of tok in a phrase, or rank of tok in the frequency order of a template."""
    out = []
    for i, label, ws, need, phrase in rows:
        order = sorted(range(len(ws)), key=lambda k: (df.get(ws[k], 0), ws[k], k))
        if phrase:
            out.append((ws[order[0]], i, label, ws, need, True, order[0]))
        else:
            ranked = [ws[k] for k in order]
            out += [(ranked[r], i, label, ranked, need, False, r) for r in range(len(ws) - need + 1)]
    out.append((END, -1, None, [], 0, False, 0))
    return spark.createDataFrame(out, "tok string, template int, label string, ws array<string>, need int, phrase boolean, off int")


def license_places(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", phrases=None, templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id, n_words, places (start words of the phrases, with their label), blocks (number, label and containment of matching blocks)."""
    spark = docs.sparkSession
    rows = template_rows(phrases, templates, threshold)
    w = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("id"), words(F.col(text)).alias("w"))
    df = frequencies(w, sorted({t for r in rows for t in r[2]}))
    marks = prefixes(spark, rows, df)
    n, pos = F.size("w"), F.col("pos")
    seen = w.select("rid", "id", "w", F.posexplode(F.array_append("w", END)).alias("pos", "tok")).join(F.broadcast(marks), "tok")
    start = pos - F.col("off")
    here = F.when(F.col("tok") == END, True).when(F.col("phrase"), (start >= 0) & (start + F.size("ws") <= n) & (F.slice(F.col("w"), start + 1, F.size("ws")) == F.col("ws"))).otherwise(n >= F.col("need"))
    # the one or two blocks that hold a place; the last block of a text is the one its last word begins or lies in first
    last = F.greatest(F.ceil((n - BLOCK) / STRIDE), F.lit(0)).cast("int")
    first_block = F.greatest(F.floor((pos - BLOCK) / STRIDE).cast("int") + 1, F.lit(0))
    last_block = F.least(F.floor(pos / STRIDE).cast("int"), last)
    blocks = F.when(~F.col("phrase") & (F.col("tok") != END), F.sequence(F.least(first_block, last_block), last_block)).otherwise(F.array(F.lit(-1)))
    # from rank off on, the words left must reach the threshold: true of every prefix word, and exact only in the intersection
    common = F.size(F.array_intersect("ws", F.slice(F.col("w"), F.col("block") * STRIDE + 1, BLOCK)))
    cand = seen.where(here).withColumn("block", F.explode(blocks)).withColumn("common", F.when(F.col("block") >= 0, common).otherwise(0)).where((F.col("block") < 0) | (F.col("common") >= F.col("need")))
    place = F.when(F.col("phrase"), F.struct(start.alias("start"), "label", "template"))
    block = F.when(F.col("block") >= 0, F.struct("block", "label", (F.col("common") / F.size("ws")).alias("containment")))
    one = cand.select("rid", "id", n.cast("long").alias("n_words"), place.alias("place"), block.alias("b")).groupBy("rid", "id").agg(F.max("n_words").alias("n_words"), F.sort_array(F.collect_set("place")).alias("places"), F.sort_array(F.collect_set("b")).alias("blocks"))
    return one.select(F.col("id").alias(doc_id), "n_words", "places", "blocks")


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of license_places() over documents."""
    found = license_places(read(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    every = F.array_sort(F.array_distinct(F.concat("places.label", "blocks.label")))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").cast("long").alias("first_word"), F.array_max("places.start").cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))).alias("score"),
    )


def _oracle() -> str:
    from millrace.llm.decontaminate import W

    ts = template_rows()
    vals = lambda phrase: ", ".join(f"({i}, '{label}', [{', '.join(repr(x) for x in ws)}], {need})" for i, label, ws, need, p in ts if p == phrase)
    return f"""
WITH d AS (SELECT doc_id, {W} AS w FROM documents),
ph(template, label, ws, need) AS (VALUES {vals(True)}),
tp(template, label, ws, need) AS (VALUES {vals(False)}),
s AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d),
places AS (SELECT doc_id, s - 1 AS start, label FROM s, ph WHERE s.w[s:s + need - 1] = ph.ws),
base AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
bl AS (SELECT doc_id, list_distinct(w[b * {STRIDE} + 1:b * {STRIDE} + {BLOCK}]) AS g
       FROM (SELECT doc_id, w, unnest(range(0, greatest(ceil((len(w) - {BLOCK}) / {STRIDE}), 0)::BIGINT + 1)) AS b FROM d WHERE len(w) > 0)),
m AS (SELECT doc_id, label, len(list_intersect(g, ws)) / len(ws) AS c FROM bl, tp WHERE len(list_intersect(g, ws)) >= need),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM m UNION ALL SELECT doc_id, label FROM places) GROUP BY doc_id),
sc AS (SELECT doc_id, max(c) AS c FROM m GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(sc.c, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN sc USING (doc_id)
"""


ORACLE = _oracle()
