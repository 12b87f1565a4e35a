"""Near-duplicates of a stated similarity by wide SimHash signatures, pivot tables and bucket-wise spanning forests.

Two texts are linked if the exact Jaccard similarity of their sets of 5-word shingles is ``threshold`` or more; what follows finds candidates.
A text's signature has BITS bits voted by its distinct shingles; the share of differing bits of two texts estimates the angle
between their shingle sets, and with the sets' sizes their Jaccard similarity; the least angle for ``threshold - SLACK`` is a radius in bits.
Candidates share one of TABLES keys, each of BAND minima of hashes of the shingles: texts of similarity J share a key with probability
1 - (1 - J**BAND)**TABLES, wherever they differ (0.9996 at 0.8). Within a key, the distances to PIVOTS reference signatures are precomputed; pairs whose
largest coordinate difference exceeds the radius are discarded, survivors are compared, and what links becomes a spanning forest: no
connection is lost, and a group of any size gives fewer links than it has members. Keys with more than CROWD members are dealt into blocks
of about CROWD, DEALS times over; what that connects is one component. Only rows outside the key's largest component then meet the others,
block by block: every pair under a key is compared or connected already, and a family of any size costs about its length.

Texts of one signature are one class with its smallest id; classes join into components over all keys' forests.

The candidates' forests join into loose groups; within a group all pairs not connected yet are compared, first by signature, then by
their shingle sets, and what is similar joins into components. The estimate's standard deviation is about 0.025 at 0.8, so that a margin of
SLACK loses next to nothing.

Defined results: texts without words share one class. A text of fewer words than a shingle is one shingle. Null ids are never the smallest
unless all of a component are null. Repeated rows give a row each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._common import drop_rows, fresh, materialize, ship, spread, with_row_key
from millrace.llm.graph import components, named_components

SHINGLE, THRESHOLD = 5, 0.8
TABLES, BAND, SLACK = 20, 5, 0.2
WORDS = 16
BITS = 64 * WORDS
PIVOTS, CROWD, GROUP, RUNS, DEALS, FILTER = 16, 4096, 512, 64, 2, 1 << 20


def radius(threshold: float) -> int:
    """The bits by which signatures of sets of that Jaccard similarity and equal size differ on average."""
    return round(BITS * math.acos(min(1.0, 2 * threshold / (1 + threshold))) / math.pi)


def mixed(x, words: int):
    """For each 64-bit value so many independent ones: an array of rows of words."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = x[:, None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def vote(hashes, words: int):
    """The signature of 64 * words bits that the hashes vote, as bytes."""
    import numpy as np

    total = np.zeros(64 * words, np.int64)
    for i in range(0, len(hashes), 255):
        bits = np.unpackbits(mixed(hashes[i : i + 255], words).view(np.uint8), axis=1)
        total += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(hashes))


def shingles(words, n: int):
    """Hashes of the distinct n-word shingles of an array of word hashes; of all words if there are fewer."""
    import numpy as np

    n = min(n, len(words))
    with np.errstate(over="ignore"):
        h = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            h = (h ^ words[k : len(words) - n + 1 + k]) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
    return np.unique(h)


def minima(hashes):
    """TABLES keys of a set of hashes: each of BAND minima under fixed permutations of the 64-bit values."""
    import numpy as np

    n = TABLES * BAND
    turn = mixed(np.array([1 << 40], np.uint64), 2 * n)[0]
    least = np.full(n, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 1024):
            least = np.minimum(least, ((hashes[i : i + 1024] ^ turn[:n, None]) * (turn[n:, None] | np.uint64(1))).min(1))
        key = np.zeros(TABLES, np.uint64)
        for part in least.reshape(BAND, TABLES):
            key = (key ^ part) * np.uint64(0x9FB21C651E98DF25)
            key ^= key >> np.uint64(29)
    return key.view(np.int64)


def shingle_set(data: bytes):
    """The sorted hashes of the distinct shingles of a UTF-8 text."""
    import numpy as np
    from xxhash import xxh64_intdigest

    ws = data.lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    return shingles(np.fromiter(map(xxh64_intdigest, ws), np.uint64, len(ws)), SHINGLE)


def sketch(data: bytes) -> tuple[bytes, list[int], int]:
    """The signature of a UTF-8 text, its TABLES keys, and the number of its distinct shingles."""
    own = shingle_set(data)
    if not len(own):
        return bytes(BITS // 8), [0] * TABLES, 0
    return vote(own, WORDS).tobytes(), minima(own).tolist(), len(own)


def references():
    """PIVOTS fixed reference signatures, as rows of 64-bit words."""
    import numpy as np

    return mixed(np.arange(1, PIVOTS + 1, dtype=np.uint64) << np.uint64(32), WORDS)


SWEEP = 64


def jaccard(a, b) -> float:
    """The similarity of two sorted arrays without repetitions; two empty ones are alike."""
    import numpy as np

    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(a, b)
    common = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return common / (len(a) + len(b) - common)


def forest(keys, nodes, signatures, sizes, threshold: float, sets=None, labels=None) -> list[tuple]:
    """Links (a, b) that connect what all links of estimated similarity threshold under equal keys connect. keys are sorted; signatures are rows of words.

    With sets, the sorted shingle hashes of each row, all links of exact similarity threshold; the estimate, less SLACK, only passes over pairs.
    Rows of one key with equal labels count as connected already.

    Rows are compared with the next SWEEP - 1 of their key; pairs that are connected already are skipped. In a longer run, every row outside
    its largest component is then compared with all rows outside its own: a run that is one family costs about its length, one of
    strangers its square, which is why runs are bounded. Of two components that join the smaller is renamed.
    """
    import numpy as np

    n, least = len(keys), threshold if sets is None else threshold - SLACK
    most = radius(least)
    ends = np.searchsorted(keys, keys, side="right")
    table = np.stack([np.bitwise_count(signatures ^ p).sum(1, dtype=np.int32) for p in references()], axis=1)
    label = np.arange(n)
    members: dict[int, list[int]] = {}
    out = []

    def join(p, q):
        one, two = members.pop(p, [p]), members.pop(q, [q])
        if len(one) < len(two):
            one, two, p = two, one, q
        label[two] = p
        one += two
        members[p] = one

    if labels is not None:
        first: dict[tuple, int] = {}
        for i, k in enumerate(zip(keys.tolist(), labels)):
            if (j := first.setdefault(k, i)) != i:
                join(int(label[j]), i)

    def alike(x, y):
        """Which pairs of rows are similar: first by the largest coordinate difference, then by their distance."""
        ok = np.flatnonzero(np.abs(table[x] - table[y]).max(1) <= most)
        x, y = x[ok], y[ok]
        apart = np.bitwise_count(signatures[x] ^ signatures[y]).sum(1, dtype=np.int32)
        p, q = sizes[x], sizes[y]
        common = np.cos(np.pi / BITS * apart) * np.sqrt(p * q)
        good = (apart <= most) & (common >= least * (p + q - common))
        return x[good], y[good]

    def connect(x, y):
        for a, b in zip(x.tolist(), y.tolist()):
            p, q = int(label[a]), int(label[b])
            if p != q and (sets is None or jaccard(sets[a], sets[b]) >= threshold):
                out.append((nodes[a], nodes[b]))
                join(p, q)

    i = np.arange(n)
    for d in range(1, SWEEP):
        i = i[i + d < ends[i]]
        if not len(i):
            break
        a = i[label[i] != label[i + d]]
        for s in range(0, len(a), 65536):
            connect(*alike(a[s : s + 65536], a[s : s + 65536] + d))
    lo = 0
    while lo < n:
        hi = int(ends[lo])
        if hi - lo > SWEEP:
            names, count = np.unique(label[lo:hi], return_counts=True)
            largest = names[count.argmax()]
            anchor = lo + int(np.flatnonzero(label[lo:hi] == largest)[0])
            for x in (lo + np.flatnonzero(label[lo:hi] != largest)).tolist():
                if label[x] != label[anchor]:
                    y = lo + np.flatnonzero(label[lo:hi] != label[x])
                    for s in range(0, len(y), 65536):
                        part = y[s : s + 65536]
                        connect(*alike(np.full(len(part), x), part))
        lo = hi
    return out


def bucket_links(rows: DataFrame, threshold: float) -> DataFrame:
    """a, b: the forests of rows (key, node, sig, n, shingles for exact links, and root where some are connected already), a key in one task."""
    ship(rows.sparkSession)
    exact, rooted = "shingles" in rows.columns, "root" in rows.columns

    def of(batches):
        import numpy as np
        import pyarrow as pa

        held = None
        ends = object()

        def links(t):
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint64).reshape(-1, WORDS)
            sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()] if exact else None
            found = forest(t.column("key").to_numpy(), t.column("node").to_pylist(), sig, t.column("n").to_numpy().astype(float), threshold, sets, t.column("root").to_pylist() if rooted else None)
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        for b in _and_then(batches, ends):
            if b is ends:
                if held is not None:
                    yield links(held)
                return
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            keys = t.column("key").to_numpy()
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last key may go on
            if whole:
                yield links(t.slice(0, whole))
            held = t.slice(whole)

    return rows.repartition("key").sortWithinPartitions("key", "node").select("key", "node", "sig", "n", *(c for c in ("shingles", "root") if c in rows.columns)).mapInArrow(of, "a binary, b binary")


def _and_then(items, last):
    yield from items
    yield last


def all_links(rows: DataFrame, threshold: float, bound: int) -> DataFrame:
    """a, b: links that connect what all links under the keys of rows (as of bucket_links) connect; no task holds more than about 2 * bound rows of a key.

    A key of more rows is dealt into blocks, DEALS times by different hashes. A family falls into few components that way, mostly one. Then
    whatever is outside the largest component of its key meets the rest of it: blocks of outsiders two by two, and each with each block of
    the largest. Keys that are one component by then cost nothing more.
    """
    sizes = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bound).select("key", F.ceil(F.col("n") / bound).cast("int").alias("blocks")), "op2-crowded")
    if not sizes.limit(1).count():
        return bucket_links(rows, threshold)
    hands = rows.join(sizes, "key").withColumn("deal", F.explode(F.array(*map(F.lit, range(DEALS)))))
    hands = hands.withColumn("key", F.xxhash64("key", "deal", F.pmod(F.xxhash64("node", "key", "deal"), F.col("blocks"))))
    found = materialize(bucket_links(rows.join(sizes, "key", "left_anti").unionByName(hands.select(*rows.columns)), threshold).distinct(), "op2-links")
    crowded = rows.join(sizes, "key", "left_semi").select("key", "node")
    labelled = materialize(crowded.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node")), "op2-labelled")
    parts = labelled.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("inside"), F.sum("n").alias("n"))
    left = materialize(parts.where("n > inside").select("key", "main", F.ceil(F.col("inside") / bound).cast("int").alias("mains"), F.ceil((F.col("n") - F.col("inside")) / bound).cast("int").alias("others")), "op2-left")
    met = rows.join(labelled.join(left, "key"), ["key", "node"]).withColumn("outside", F.col("root") != F.col("main"))
    met = met.withColumn("own", F.pmod(F.xxhash64("node", "key"), F.when(F.col("outside"), F.col("others")).otherwise(F.col("mains"))).cast("int"))
    # the keys under which a row meets others: (kind, i, j) of an outsider's own and another block, of its and a main block, of a main row's and an outsiders' block
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    meeting = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    own = F.col("own")
    among = F.transform(F.filter(upto("others"), lambda x: (x != own) | (F.col("others") == 1)), lambda x: meeting(0, F.least(own, x), F.greatest(own, x)))
    outsider = F.concat(among, F.transform(upto("mains"), lambda x: meeting(1, own, x)))
    main = F.transform(upto("others"), lambda x: meeting(1, x, own))
    met = met.withColumn("at", F.explode(F.when(F.col("outside"), outsider).otherwise(main))).withColumn("key", F.xxhash64("key", "at.kind", "at.i", "at.j"))
    return found.unionByName(bucket_links(met.select(*rows.columns, "root"), threshold))


def links(classes: DataFrame, threshold: float) -> DataFrame:
    """a, b: links between classes (node, sig, n, keys) of that estimated similarity."""
    under = classes.select("node", F.posexplode("keys").alias("t", "k")).select("node", F.xxhash64("t", "k").alias("key"))
    # most keys are one class's own and link nothing: signatures go to the others alone
    common = under.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = materialize(under.join(common, "key", "left_semi"), "op2-shared")
    return all_links(shared.join(classes.select("node", "sig", "n"), "node"), threshold, CROWD).distinct()


def near_only(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """rows without most of those whose value of column isn't in wanted, so that a join with wanted moves few others.

    A broadcast of bits by hash, 16 for each row of wanted, lets each of its values pass and 1 of 16 others. Beyond FILTER words of bits all rows pass.
    """
    size = max(1, wanted.count() // 4)
    if size > FILTER:
        return rows
    place = F.pmod(F.xxhash64(column), F.lit(64 * size))
    word, held, bit = fresh("word", rows.columns), fresh("held", rows.columns), F.pmod(place, F.lit(64)).cast("int")
    bits = wanted.select(F.shiftright(place, 6).alias(word), bit.alias("bit")).groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias(held))
    return rows.withColumn(word, F.shiftright(place, 6)).join(F.broadcast(bits), word).where(F.getbit(F.col(held), bit) == 1).select(*rows.columns)


def exact_links(classes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """a, b: links between classes (node, sig, n, keys, rid) of exact similarity threshold. texts (rid, t) has the texts.

    Whatever connects over candidates is compared among itself, so that no link depends on the chain by which the candidates met. Shingle
    sets are longer than texts, so they are made again for these rows alone.
    """
    groups = components(links(classes.select("node", "sig", "n", "keys"), threshold - SLACK))
    members = materialize(groups.join(classes.select("node", "sig", "n", "rid"), "node"), "op2-groups")
    found = members.join(near_only(texts, members, "rid"), "rid").select(F.xxhash64("root").alias("key"), "node", "sig", "n", "t")

    def of(batches):
        import pyarrow as pa

        for b in batches:
            sets = pa.array([shingle_set(x.as_buffer().to_pybytes() if x.is_valid else b"").tobytes() for x in b.column("t")], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], sets], ["key", "node", "sig", "n", "shingles"])

    sets = found.mapInArrow(of, T.StructType([*found.schema.fields[:4], T.StructField("shingles", T.BinaryType())]))
    return all_links(materialize(sets, "op2-sets"), threshold, GROUP).distinct()


def similar_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, row: Column | None = None) -> DataFrame:
    """One row per row of docs: rid (row, by default a running number), id, component_id (the smallest id of the component).

    docs are read twice, so that row has to name a row the same each time (as with_row_key does); numbered here, they are written first.
    """
    ship(docs.sparkSession)

    def of(batches):
        import pyarrow as pa

        for b in batches:
            found = [sketch(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in b.column("t")]
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("id"), pa.array([s for s, _, _ in found], pa.binary()), pa.array([k for _, k, _ in found], pa.list_(pa.int64())), pa.array([n for _, _, n in found], pa.int32())], ["rid", "id", "sig", "keys", "n"])

    src = docs.select((F.monotonically_increasing_id() if row is None else row).alias("rid"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    src = materialize(src, "op2-rows") if row is None else src
    sketched = spread(src).mapInArrow(of, T.StructType([*src.schema.fields[:2], T.StructField("sig", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("n", T.IntegerType())]))
    rows = materialize(sketched.withColumns({"node": F.unhex(F.md5("sig")), "run": F.pmod(F.xxhash64("rid"), F.lit(RUNS)).cast("int")}), "op2-sketches")
    first = F.min(F.struct(F.xxhash64("rid").alias("h"), "rid", "sig", "keys", "n")).alias("first")
    runs = rows.groupBy("node", "run").agg(F.min("id").alias("least"), first)
    classes = materialize(runs.groupBy("node").agg(F.min("least").alias("least"), F.min("first").alias("first")).select("node", "least", "first.sig", "first.keys", "first.n", "first.rid"), "op2-classes")
    roots = components(exact_links(classes, src.select("rid", "t"), threshold))
    named = rows.select("node", "run").distinct().join(named_components(classes.select("node", "least"), roots), "node")
    return rows.join(named, ["node", "run"]).select("rid", "id", "component_id")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that stay, all columns kept: of every component the row with the smallest id, of repeated ids the first by place."""
    keyed, row = with_row_key(docs)
    found = materialize(similar_documents(keyed, threshold=threshold, row=F.col(row)), "op2-components")
    first = F.min(F.struct(F.col("id").isNull(), "id", "rid")).alias("first")
    runs = found.groupBy("component_id", F.pmod(F.xxhash64("rid"), F.lit(RUNS)).alias("run")).agg(first)
    stays = runs.groupBy("component_id").agg(F.min("first").alias("first")).select(F.col("first.rid").alias("rid"))
    return drop_rows(keyed, row, found.join(stays, "rid", "left_anti").select("rid"))
