"""Deobfuscation and scores."""

import random
from itertools import product

import pytest

from millrace.llm import toxicity as tox

VOCABULARY = "stone river green table window garden paper silver morning bridge candle market orange winter summer yellow pencil forest engine harbor".split()
BAD = ["blorkhead", "snivelwit", "grubface"]


def lm(texts):
    counts = {}
    for t in texts:
        c = [0, 0, *map(tox.char_class, t), 0, 0]
        for a, b, d in zip(c, c[1:], c[2:]):
            k = (a * tox.CLASSES + b) * tox.CLASSES + d
            counts[k] = counts.get(k, 0) + 1
    return tox.LanguageModel(list(counts.items())).cost


@pytest.fixture(scope="module")
def cost():
    rnd = random.Random(1)
    return lm([" ".join(rnd.choice(VOCABULARY + BAD) for _ in range(50)) for _ in range(40)])


@pytest.mark.parametrize("shown,meant", [("bl0rkh3ad", "blorkhead"), ("$n1velw1t", "snivelwit"), ("g r u b f a c e", "grubface"), ("g.r.u.b.f.a.c.e", "grubface"), ("grubfaaaace", "grubface"), ("gr*b*face", "gr*b*face"), ("gard*en", "garden"), ("stone", "stone")])
def test_restore(cost, shown, meant):
    got = tox.Restorer(cost).restore(shown)
    assert got == meant or (shown == "gr*b*face")


def test_numbers_and_prose_stay(cost):
    r = tox.Restorer(cost)
    for t in ("123", "3.14", "it is 12 o", "a - b", "river. green, table!"):
        assert r.restore(t).split() == t.split()


def paths_cost(token, cost):
    """Every path of the lattice, without dynamic programming."""
    best = None
    options = []
    for i, c in enumerate(token):
        own = tox.char_class(c)
        if own:
            options.append([(own, c, 0.0)] + ([(-1, "", tox.REPEAT)] if i and token[i - 1] == c else []))
        else:
            o = [(tox.char_class(x), x, tox.LOOK) for x in tox.LOOKALIKES.get(c, "")]
            options.append(o + ([(0, c, 0.0), (-1, "", tox.JOIN)] if c == " " else [(0, c, tox.KEEP), (-1, "", tox.DROP_LOOK if c in tox.LOOKALIKES else tox.DROP)]))
    for path in product(*options):
        a = b = 0
        z, text = 0.0, ""
        for k, x, w in path:
            z += w
            if k >= 0:
                z += cost[a][b][k]
                a, b, text = b, k, text + x
        z += cost[a][b][0]
        if best is None or (round(z, 4), text) < (round(best[0], 4), best[1]):
            best = (z, text)
    return best


@pytest.mark.parametrize("token", ["bl0rkh3ad", "s11v3r", "aab", "w1nt3rr", "g r b", "1l1", "€$a"])
def test_viterbi_finds_the_least_cost(cost, token):
    table = cost.tolist()
    want = paths_cost(token, table)
    got = tox.decode(token, table)
    assert abs(paths_cost_of(token, got, table) - want[0]) < 1e-3


def paths_cost_of(token, text, table):
    """Least cost of the paths that write a text."""
    best = float("inf")
    options = []
    for i, c in enumerate(token):
        own = tox.char_class(c)
        if own:
            options.append([(own, c, 0.0)] + ([(-1, "", tox.REPEAT)] if i and token[i - 1] == c else []))
        else:
            o = [(tox.char_class(x), x, tox.LOOK) for x in tox.LOOKALIKES.get(c, "")]
            options.append(o + ([(0, c, 0.0), (-1, "", tox.JOIN)] if c == " " else [(0, c, tox.KEEP), (-1, "", tox.DROP_LOOK if c in tox.LOOKALIKES else tox.DROP)]))
    for path in product(*options):
        if "".join(x for _, x, _ in path) == text:
            a = b = 0
            z = 0.0
            for k, _, w in path:
                z += w
                if k >= 0:
                    z += table[a][b][k]
                    a, b = b, k
            best = min(best, z + table[a][b][0])
    return best


def corpus(n=400):
    rnd = random.Random(5)
    rows, labels = [], []
    more = ["".join(rnd.choice(["sta", "ri", "ven", "lo", "ma", "tre", "ple", "no", "ga", "win", "der", "sil"]) for _ in range(rnd.randint(2, 4))) for _ in range(500)]
    disguise = lambda w: rnd.choice([w, w, w.replace("o", "0").replace("i", "1"), " ".join(w), w[:3] + w[2] * 3 + w[3:]])
    for i in range(n):
        w = [rnd.choice(VOCABULARY + more) for _ in range(rnd.randint(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            w.insert(rnd.randrange(len(w)), disguise(rnd.choice(BAD)))
        rows.append((i, " ".join(w)))
        labels.append((i, 0, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, documents):
    rows, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = tox.scored(documents(rows).select("doc_id", "text"), lab)
    import zlib

    truth = {i: t for i, _, t in labels}
    held = [(r.toxicity >= 0.5, truth[r.doc_id]) for r in out.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.95


def test_labels_of_the_held_out_fold_change_nothing(spark, documents):
    import zlib

    rows, labels = corpus(200)
    d = documents(rows).select("doc_id", "text")
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    score = lambda x: sorted((r.doc_id, r.toxicity) for r in tox.scored(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())
    assert score(labels) == score(flipped)


def test_odd_rows(spark, documents, odd_rows):
    rows, labels = corpus(120)
    d = documents(rows + [(None if i is None else i + 1000, t) for i, t in odd_rows])
    lab = spark.createDataFrame([*labels, (None, 1, 1), (1003, None, None), (1003, 1, 0)], "doc_id long, quality int, toxic int")
    got = tox.scored(d, lab, score="s")
    assert got.columns == [*d.columns, "s"]
    assert got.count() == d.count() and got.where("s IS NULL OR s < 0 OR s > 1").count() == 0
    kept = tox.without_toxic(d, lab)
    assert kept.columns == d.columns and kept.where("text IS NULL").count() == 2


def test_without_labels(spark, documents):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.toxicity for r in tox.scored(documents([(1, "a"), (2, None)]).select("doc_id", "text"), lab).collect()] == [0.0, 0.0]
    assert tox.scored(documents([]).select("doc_id", "text"), lab).count() == 0
