"""Exact and near duplicates against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from millrace.llm import exact_dedup, simhash
from millrace.llm.graph import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[(t or "").translate(LOW)].append(i)
    keep = {k: max((i for i in v if i is not None), default=None) for k, v in by.items()}
    return sorted(((i, keep[n := (t or "").translate(LOW)], len(by[n]), hashlib.sha256(n.encode()).hexdigest()) for i, t in rows), key=repr)


def test_exact_groups(documents, odd_rows):
    got = exact_dedup.groups(documents(odd_rows)).collect()
    assert sorted(((r.id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in got), key=repr) == exact(odd_rows)
    kept = defaultdict(int)
    for r in got:
        kept[bytes(r.digest)] += r.kept
        assert not r.kept or r.id == r.keep_id
    assert set(kept.values()) == {1}


def test_exact_smallest_and_hot_group(documents):
    rows = [(i, "Same") for i in range(500)] + [(1000 + i, f"t{i % 50}") for i in range(100)]
    got = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.groups(documents(rows), keep="smallest").collect()}
    assert got[7] == (0, 500, False) and got[0] == (0, 500, True) and got[1050] == (1000, 2, False)


def test_unique_documents(documents, odd_rows):
    d = documents(odd_rows)
    out = exact_dedup.unique_documents(d)
    assert out.columns == d.columns and out.count() == len({(t or "").translate(LOW) for _, t in odd_rows})
    assert documents([]).count() == 0 and exact_dedup.unique_documents(documents([])).count() == 0


def brute_fingerprint(t, n=3):
    ws = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (t or "").translate(LOW)).split(" ") if w]
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + n]) for i in range(max(len(ws) - n, 0) + 1)]
    hs = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints(odd_rows):
    rnd = random.Random(1)
    texts = [t for _, t in odd_rows if not t or len(t) < 1000] + [" ".join(rnd.choice("ab CD é x  y".split(" ")) for _ in range(rnd.randint(0, 30))) for _ in range(50)]
    for t in texts:
        assert simhash.fingerprint((t or "").encode()) & (2**64 - 1) == brute_fingerprint(t)


def linked(fps, radius=2):
    """Component of each fingerprint by comparing all."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = sorted(root)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in fs}


@pytest.mark.parametrize("crowd", [64, 3])
def test_links_lose_nothing(spark, monkeypatch, crowd):
    """Close fingerprints planted around centres; with a small bound the keys are divided, with the same links."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rnd = random.Random(2)
    fps = set()
    for _ in range(25):
        c = rnd.getrandbits(64)
        for _ in range(8):
            x = c
            for _ in range(rnd.randint(0, 3)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps |= {0, 1, 3, 7, 2**64 - 1}
    signed = {simhash.signed(x) for x in fps}
    got = {tuple(sorted((r.a, r.b))) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {tuple(sorted((a, b))) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert got == want


def test_near_duplicates(documents, odd_rows):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice(["red", "blue", "green", "x", "y", "z"]) + str(rnd.randrange(30)) for _ in range(400)) for _ in range(6)]
    rows = list(odd_rows)
    for k, b in enumerate(base):
        w = b.split()
        for j in range(6):
            v = list(w)
            v[rnd.randrange(400)] = f"changed{j % 4}"
            rows.append((100 * (k + 1) + j, " ".join(v)))
    got = simhash.near_duplicates(documents(rows)).collect()
    by_fp = linked({r.fp for r in got})
    least = {}
    for r in got:
        if r.id is not None:
            least[by_fp[r.fp]] = min(least.get(by_fp[r.fp], r.id), r.id)
    assert len(got) == len(rows) and all(r.component_id == least.get(by_fp[r.fp]) for r in got)
    assert len(set(by_fp.values())) < len({r.fp for r in got})  # some are linked


def test_one_of_each(documents, odd_rows):
    d = documents(odd_rows)
    out = simhash.one_of_each(d)
    assert out.columns == d.columns
    fps = linked({simhash.fingerprint((t or "").encode()) for _, t in odd_rows})
    assert out.count() == len(set(fps.values()))
    assert simhash.one_of_each(documents([])).count() == 0


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_group_of_copies(documents):
    rows = [(i, "the same words again and again") for i in range(2000)] + [(5000, "another text of other words")]
    got = simhash.near_duplicates(documents(rows)).groupBy("component_id").agg(F.count("*").alias("n")).collect()
    assert sorted((r.component_id, r.n) for r in got) == [(0, 2000), (5000, 1)]
