"""Best-fit packing of documents into sequences with vector capacities.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared lengths of its pieces). Pieces, the largest
first, go to the open sequence that holds them under every capacity and fits best: the one whose weighted residual vector has the smallest
norm after placement ("norm"), or whose residual has the largest weighted dot product with the demand ("dot"). A piece that fits none
opens a sequence.

Pieces are dealt by hash into groups of about GROUP pieces, which are packed apart; only lengths travel. A group leaves a few sequences
open at most, so that what is lost against packing all at once is some sequences in each GROUP pieces. Pieces that fill a sequence take one.

Defined results: a null or empty text is one document of the end id alone. Repeated rows and null ids are documents of their own. A
document longer than a sequence is cut, the first piece being the short one. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._common import materialize, read, ship, spread, with_row_key
from millrace.llm.byte_bpe import encoder, in_chunks, vocabulary

TOKENS, END_ID = 2048, 0
GROUP = 20_000
WEIGHTS = (1.0, 1e-3, 1e-3)


def piece_lengths(n: int, tokens: int = TOKENS) -> list[int]:
    """The lengths that a document of n tokens is cut into."""
    first = n % tokens or tokens
    return [first, *[tokens] * ((n - first) // tokens)] if n > tokens else [n]


def pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokens: int = TOKENS, vocab: str | None = None, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked, ids (little-endian unsigned 32-bit) of every piece."""
    path = vocab or vocabulary()

    def of(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids, texts = b.column("id"), b.column("t")
            for some in in_chunks([len(x.as_buffer()) if x.is_valid else 0 for x in texts]):
                rows = []
                for i, raw in zip(some, encoder(path).encode(texts.slice(some.start, len(some)).to_pylist())):
                    raw, start = raw + end, 0
                    for k, n in enumerate(piece_lengths(len(raw) // 4, tokens)):
                        part = raw[4 * start : 4 * (start + n)]
                        rows.append((ids[i].as_py(), k, start, n, zlib.crc32(part), part if keep_ids else None))
                        start += n
                cols = list(zip(*rows))
                arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    arrays, names = [*arrays, pa.array(cols[5], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    return spread(rows).mapInArrow(of, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def best_fit(lengths, tokens: int = TOKENS, documents: int | None = None, attention: int | None = None, weights=WEIGHTS, rule: str = "norm"):
    """The sequence of each piece and its place there, as arrays. Without limits of their own, documents and attention cost are bounded by what tokens allow."""
    import numpy as np

    lengths = np.asarray(lengths, np.int64)
    cap = np.array([tokens, documents or tokens, attention or tokens * tokens], np.float64)
    if len(lengths) and (lengths.max() > cap[0] or (lengths.astype(float) ** 2).max() > cap[2]):
        raise ValueError("a piece exceeds the capacity of an empty sequence")
    scale = np.asarray(weights) / cap**2
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    size = 1024
    open_id, rest = np.zeros(size, np.int64), np.zeros((3, size))
    n_open, made = 0, 0
    order = np.argsort(-lengths, kind="stable")
    smallest = int(lengths.min()) if len(lengths) else 0
    for i in order.tolist():
        n = int(lengths[i])
        need = (float(n), 1.0, float(n) * n)
        r = rest[:, :n_open]
        fits = np.flatnonzero((r[0] >= need[0]) & (r[1] >= need[1]) & (r[2] >= need[2]))
        if len(fits):
            left = r[:, fits]
            if rule == "norm":
                k = fits[np.argmin(scale[0] * (left[0] - need[0]) ** 2 + scale[1] * (left[1] - need[1]) ** 2 + scale[2] * (left[2] - need[2]) ** 2)]
            else:
                k = fits[np.argmax(scale[0] * left[0] * need[0] + scale[1] * left[1] * need[1] + scale[2] * left[2] * need[2])]
        else:
            if n_open == size:
                size *= 2
                open_id, rest = np.resize(open_id, size), np.hstack([rest, np.zeros_like(rest)])
            k, n_open = n_open, n_open + 1
            open_id[k], rest[:, k] = made, cap
            made += 1
        bins[i], places[i] = open_id[k], cap[0] - rest[0, k]
        rest[:, k] -= need
        if rest[0, k] < smallest or rest[1, k] < 1 or rest[2, k] < smallest * smallest:  # nothing more fits: the last open one takes its place
            n_open -= 1
            open_id[k], rest[:, k] = open_id[n_open], rest[:, n_open]
    return bins, places


def pack(rows: DataFrame, *, tokens: int = TOKENS, documents: int | None = None, attention: int | None = None, weights=WEIGHTS, rule: str = "norm", group: int = GROUP) -> DataFrame:
    """rows (written pieces with a column length) with sequence_id and offset."""
    ship(rows.sparkSession)
    if group >= 1 << 18:
        raise ValueError("a group's sequences have 20 bits of their ids")
    groups = max(1, -(-rows.count() // group))

    def of(key, table):
        import numpy as np
        import pyarrow as pa

        lengths = table.column("length").to_numpy()
        bins, places = best_fit(lengths, tokens, documents, attention, weights, rule)
        first = (key[0].as_py() << 40) + (key[1].as_py() << 20)
        out = table.drop_columns(["grp", "part"]).append_column("sequence_id", pa.array(np.int64(first) + bins))
        return out.append_column("offset", pa.array(places))

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", sequence_id long, offset long"
    keyed, row = with_row_key(rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(groups))))
    # repeated rows fall into one group, which is dealt out by place
    crowded = materialize(keyed.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > 2 * group).select("grp", F.ceil(F.col("n") / group).alias("parts")), "op8-crowded")
    if crowded.limit(1).count():
        part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(row), F.col("parts")))
        keyed = keyed.join(crowded, "grp", "left").withColumn("part", part)
    else:
        keyed = keyed.withColumn("part", F.lit(0).cast("long"))
    return keyed.select(*rows.columns, "grp", "part").groupBy("grp", "part").applyInArrow(of, schema)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's pieces of documents in sequences."""
    return packed(read(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    return pack(materialize(pieces(docs), "op8-pieces"))
