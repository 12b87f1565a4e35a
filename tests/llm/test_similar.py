"""Near-duplicates of a stated similarity: forests against all pairs, recall against exact Jaccard."""

import math
import random

import numpy as np
import pytest

from millrace.llm import similar


def find(root, x):
    while root[x] != x:
        x = root[x]
    return x


def estimated(texts, threshold=similar.THRESHOLD):
    """Component of each text by comparing all signatures; the smallest index names it."""
    sk = [similar.sketch((t or "").encode()) for t in texts]
    sig = [np.frombuffer(s, np.uint64) for s, _, _ in sk]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            h = int(np.bitwise_count(sig[i] ^ sig[j]).sum())
            common = math.cos(math.pi / similar.BITS * h) * math.sqrt(sk[i][2] * sk[j][2])
            if h == 0 or (h <= similar.radius(threshold) and common >= threshold * (sk[i][2] + sk[j][2] - common)):
                a, b = find(root, i), find(root, j)
                root[max(a, b)] = min(a, b)
    return [find(root, i) for i in range(len(texts))]


def exact_shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 5, 0) + 1)}


def copies(seed, families=12, members=8, n=300):
    rnd = random.Random(seed)
    out = []
    for _ in range(families):
        w = [f"w{rnd.randrange(5000)}" for _ in range(n)]
        out.append(" ".join(w))
        for _ in range(members - 1):
            v = list(w)
            for _ in range(rnd.randint(1, 6)):
                v[rnd.randrange(n)] = f"x{rnd.randrange(10**6)}"
            out.append(" ".join(v))
    return out


def test_signature_estimates_the_angle():
    texts = copies(1)
    sig = [similar.sketch(t.encode()) for t in texts]
    errors = []
    for i in range(0, len(texts), 8):
        for j in range(i + 1, i + 8):
            a, b = exact_shingles(texts[i]), exact_shingles(texts[j])
            h = int(np.bitwise_count(np.frombuffer(sig[i][0], np.uint64) ^ np.frombuffer(sig[j][0], np.uint64)).sum())
            common = math.cos(math.pi / similar.BITS * h) * math.sqrt(sig[i][2] * sig[j][2])
            errors.append(common / (sig[i][2] + sig[j][2] - common) - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.04


@pytest.mark.parametrize("crowd", [4096, 4])
def test_components_and_recall(documents, monkeypatch, crowd):
    """All that all-pairs comparison links is linked, and the pairs of exact Jaccard 0.85 or more with it; a small bound divides keys."""
    monkeypatch.setattr(similar, "CROWD", crowd)
    texts = copies(2)
    got = {r.id: r.component_id for r in similar.similar_documents(documents(list(enumerate(texts)))).collect()}
    want = estimated(texts)
    assert sum(got[i] == want[i] for i in range(len(texts))) >= 0.97 * len(texts)
    sure = hit = 0
    for i in range(len(texts)):
        for j in range(i):
            a, b = exact_shingles(texts[i]), exact_shingles(texts[j])
            if len(a & b) >= 0.85 * len(a | b):
                sure, hit = sure + 1, hit + (got[i] == got[j])
            if i // 8 != j // 8:
                assert got[i] != got[j]
    assert sure > 50 and hit >= 0.97 * sure


def test_odd_rows(documents, odd_rows):
    got = similar.similar_documents(documents(odd_rows)).collect()
    texts = [t for _, t in odd_rows]
    root = estimated(texts)
    least = {}
    for (i, _), r in zip(odd_rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    assert sorted(((r.id, r.component_id) for r in got), key=repr) == sorted(((i, least.get(r)) for (i, _), r in zip(odd_rows, root)), key=repr)
    d = documents(odd_rows)
    out = similar.one_of_each(d)
    assert out.columns == d.columns and out.count() == len(set(root))
    assert similar.one_of_each(documents([])).count() == 0


def test_forest_is_linear():
    """A group in which all are alike gives one link less than it has members."""
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 2**63, similar.WORDS).astype(np.uint64)
    sig = np.repeat(base[None], 500, 0)
    sig[np.arange(500), rnd.integers(0, similar.WORDS, 500)] ^= np.uint64(1) << rnd.integers(0, 64, 500).astype(np.uint64)
    keys = np.array([7] * 400 + [9] * 100)
    nodes = [bytes([i // 256, i % 256]) for i in range(500)]
    assert len(similar.forest(keys, nodes, sig, np.full(500, 100.0), 0.8)) == 399 + 99


def test_forest_equals_all_pairs():
    """Components of long runs of families, bridges and strangers."""
    rnd = np.random.default_rng(2)
    rows = []
    for _ in range(12):
        c = rnd.integers(0, 2**63, similar.WORDS).astype(np.uint64)
        for _ in range(rnd.integers(1, 60)):
            x = np.unpackbits(c.view(np.uint8))
            x[rnd.choice(similar.BITS, rnd.integers(0, 130), replace=False)] ^= 1
            rows.append(np.packbits(x).view(np.uint64))
    sig = np.array(rows)[rnd.permutation(len(rows))]
    n = len(sig)
    assert n > 2 * similar.SWEEP
    apart = np.bitwise_count(sig[:, None] ^ sig[None]).sum(2)
    root = list(range(n))
    for a, b in zip(*np.nonzero(np.triu(apart <= similar.radius(0.8), 1))):
        x, y = find(root, a), find(root, b)
        root[max(x, y)] = min(x, y)
    want = [find(root, i) for i in range(n)]
    links = similar.forest(np.zeros(n, np.int64), list(range(n)), sig, np.full(n, 500.0), 0.8)
    root = list(range(n))
    for a, b in links:
        x, y = find(root, a), find(root, b)
        root[max(x, y)] = min(x, y)
    assert [find(root, i) for i in range(n)] == want and len(links) == n - len(set(want))


def test_crowded_keys_lose_no_pair(spark, monkeypatch):
    """Classes that share one key only are linked, however crowded it is."""
    monkeypatch.setattr(similar, "CROWD", 8)
    rnd = np.random.default_rng(3)
    rows = []
    for i in range(60):
        sig = rnd.integers(0, 2**63, similar.WORDS).astype(np.uint64).tobytes()
        for j in range(2):
            keys = [7, *(int(x) for x in rnd.permutation(30000)[: similar.TABLES - 1] * 2 + j)]
            rows.append((bytes([i, j]), sig, 100, keys))
    classes = spark.createDataFrame(rows, "node binary, sig binary, n int, keys array<int>")
    found = {tuple(sorted((bytes(r.a), bytes(r.b)))) for r in similar.links(classes, 0.8).collect()}
    assert found == {(bytes([i, 0]), bytes([i, 1])) for i in range(60)}


def block_edits(seed, pairs, lengths, n=300):
    """Pairs of texts that differ in a contiguous passage, replaced or appended; each pair has words of its own."""
    rnd = random.Random(seed)
    out = []
    for p in range(pairs):
        w = [f"p{p}w{rnd.randrange(5000)}" for _ in range(n)]
        k = rnd.choice(lengths)
        new = [f"p{p}x{rnd.randrange(10**6)}" for _ in range(k)]
        at = rnd.randrange(4, n - k - 4)
        out += [" ".join(w), " ".join(w + new + new[::-1]) if p % 3 == 0 else " ".join(w[:at] + new + w[at + k :])]
    return out


def test_isolated_pairs_are_linked_by_exact_similarity(documents):
    """Pairs about the threshold that no third text links: 99 in 100 of those at 0.8 or more, and none below."""
    texts = block_edits(4, 400, [24, 26, 27, 28, 29, 30, 31, 34])
    got = {r.id: r.component_id for r in similar.similar_documents(documents(list(enumerate(texts)))).collect()}
    sure = hit = below = 0
    for i in range(0, len(texts), 2):
        a, b = exact_shingles(texts[i]), exact_shingles(texts[i + 1])
        linked = got[i] == got[i + 1]
        if len(a & b) >= 0.8 * len(a | b):
            sure, hit = sure + 1, hit + linked
        else:
            below += 1
            assert not linked
    assert sure > 100 and below > 50 and hit >= 0.99 * sure, (sure, hit, below)


def test_short_texts_are_linked_by_exact_similarity(documents):
    rnd = random.Random(6)
    texts = []
    for p in range(100):
        w = [f"p{p}w{i}" for i in range(rnd.randint(8, 30))]
        texts += [" ".join(w), " ".join([*w, *(f"p{p}x{i}" for i in range(rnd.randint(1, 4)))])]
    got = {r.id: r.component_id for r in similar.similar_documents(documents(list(enumerate(texts)))).collect()}
    wrong = 0
    for i in range(0, len(texts), 2):
        a, b = exact_shingles(texts[i]), exact_shingles(texts[i + 1])
        wrong += (got[i] == got[i + 1]) != (len(a & b) >= 0.8 * len(a | b))
    assert wrong <= 1


def test_runs_cost_their_length():
    """A family of 40,000 rows, and one with some strangers, take no time that grows with the square."""
    import time

    rnd = np.random.default_rng(7)
    base = rnd.integers(0, 2**63, similar.WORDS).astype(np.uint64)

    def timed(n, strangers=0):
        sig = np.repeat(base[None], n, 0)
        sig[np.arange(n), rnd.integers(0, similar.WORDS, n)] ^= np.uint64(1) << rnd.integers(0, 64, n).astype(np.uint64)
        sig[:strangers] = rnd.integers(0, 2**63, (strangers, similar.WORDS)).astype(np.uint64)
        t = time.process_time()
        found = similar.forest(np.zeros(n, np.int64), list(range(n)), sig, np.full(n, 100.0), 0.8)
        assert len(found) == n - 1 - strangers
        return time.process_time() - t

    small = timed(5_000)
    assert timed(40_000) < 16 * small + 1


@pytest.mark.parametrize("crowd, group", [(16, 8), (4096, 12)])
def test_large_families_in_blocks_equal_all_pairs(documents, monkeypatch, crowd, group):
    """Families far over the bounds, chains of edits and strangers: components are those of all pairs by exact similarity."""
    monkeypatch.setattr(similar, "CROWD", crowd)
    monkeypatch.setattr(similar, "GROUP", group)
    rnd = random.Random(8)
    texts = []
    for f, members in enumerate((90, 40, 1, 2, 25)):
        w = [f"f{f}w{i}" for i in range(200)]
        for m in range(members):
            if f == 1:  # each of a chain is like the one before
                w = list(w)
            v = w if f == 1 else list(w)
            for k in range(3 if f == 1 else rnd.choice((1, 2, 12))):
                v[rnd.randrange(200)] = f"x{f}.{m}.{k}"
            texts.append(" ".join(v))
    sets = [exact_shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(root, i), find(root, j)
                root[max(a, b)] = min(a, b)
    got = {r.id: r.component_id for r in similar.similar_documents(documents(list(enumerate(texts)))).collect()}
    want = {i: find(root, i) for i in range(len(texts))}
    assert len(set(want.values())) > 5
    assert got == want


def test_texts_without_candidates_cost_little_disk(spark, documents):
    """shingle sets are longer than texts; those of texts that meet no other are neither written nor moved, nor are signatures under keys of their own."""
    from pathlib import Path
    from urllib.parse import urlparse

    from millrace.llm._common import shared_dir

    rnd = random.Random(9)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(2000)) for _ in range(60)]
    texts += [texts[3] + " end", texts[7] + " end"]
    keyed, row = similar.with_row_key(documents(list(enumerate(texts))))
    folder = Path(urlparse(shared_dir(spark)).path)
    before = set(folder.rglob("*"))
    got = {r.id: r.component_id for r in similar.similar_documents(keyed, row=similar.F.col(row)).collect()}
    assert got == {i: {60: 3, 61: 7}.get(i, i) for i in range(62)}
    written = sum(p.stat().st_size for p in set(folder.rglob("*")) - before if p.is_file())
    assert written < 0.4 * sum(map(len, texts)), written
    shared = [p for p in set(folder.glob("op2-shared-*")) - before]
    assert spark.read.parquet(*map(str, shared)).select("node").distinct().count() == 4


@pytest.mark.parametrize("words", [1 << 20, 0])
def test_filter_by_bits_loses_no_row(spark, monkeypatch, words):
    """every wanted row passes, few others do; beyond the bound all pass."""
    monkeypatch.setattr(similar, "FILTER", words)
    rows = spark.range(20_000).selectExpr("struct(concat('file', id % 7) AS file, id AS place) AS rid", "id AS word")
    wanted = rows.where("word % 40 = 0").select("rid")
    passed = similar.near_only(rows, wanted, "rid")
    assert passed.columns == rows.columns
    assert passed.join(wanted, "rid", "left_semi").count() == wanted.count() == 500
    assert passed.count() == 20_000 if not words else passed.count() < 0.1 * 20_000
    assert similar.near_only(rows, wanted.where("false"), "rid").count() == (0 if words else 20_000)
