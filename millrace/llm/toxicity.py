"""Toxicity by noisy-channel deobfuscation: restore what a text disguises, then score the restored text.

A character trigram model is counted over all documents. A suspicious token (a look-alike between or before letters, a letter three times
in a row, single characters set apart) becomes a lattice: a character may stand for itself, for the letters it looks like, for nothing if
it is no letter, or repeat the letter before. Viterbi decoding finds the path of least cost under channel and language model, over states
of the last two letters. The restored text is scored by a logistic regression over words and parts of words, each by whether one, two or
three of its different words have it.

The classifier is fitted on at most ``sample`` labelled rows, those with the smallest hash of their id; the language model takes every
document. Labels come only from rows whose crc32(doc_id as text) mod FOLDS is not 0. Only the text is an input of a score.

Defined results: a null text counts as empty and gets the score of a text without features. Repeated rows and null ids give a row each
(null ids are held out and never learned from); other columns are ignored by scores. Without labels of both classes every score is 0.
An empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._common import fresh, kept, materialize, read, ship

FOLDS = 5
SAMPLE = 20_000
FEATURES = 2048
LEVELS = 3
GRAMS = (4, 5, 6)
CLASSES = 64

#: What characters of leetspeak look like.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i", "§": "s", "¥": "y"}
#: Costs in nats of the channel: a look-alike, a character that stands for nothing (one that looks like a letter seldom does), a space that does, a repetition, a kept symbol.
LOOK, DROP, DROP_LOOK, JOIN, REPEAT, KEEP = 1.5, 3.0, 9.0, 1.0, 1.0, 4.0
#: A feature must be more frequent among toxic documents than chance by so many standard deviations.
DEVIATIONS = 6.0

_LETTER = r"[^\W\d_]"
_LOOK = "[" + re.escape("".join(LOOKALIKES)) + "]"
#: Tokens that are decoded hold one of these, and so are runs of single characters.
TRIGGER = re.compile(rf"{_LETTER}[\d@$!|+€£(¡§¥*._~^-]+{_LETTER}|^{_LOOK}+{_LETTER}|({_LETTER})\1\1").search
SPACED = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")
WORD = re.compile(rf"{_LETTER}+")
MEMO = 100_000


def char_class(c: str) -> int:
    """0 for what is no letter, 1..26 for a-z, then the letters of Latin-1, and one class for all others."""
    if not c.isalpha():
        return 0
    o = ord(c)
    if 97 <= o <= 122:
        return o - 96
    return 27 + o - 0xDF if 0xDF <= o <= 0xFF else CLASSES - 1


def count_trigrams(docs: DataFrame, text: str) -> list[tuple[int, int]]:
    """Counts of class trigrams over all texts, at most CLASSES**3 rows."""

    def of(batches):
        import numpy as np
        import pyarrow as pa

        table = np.array([char_class(chr(i)) for i in range(0x250)] + [CLASSES - 1], np.int64)
        total = np.zeros(CLASSES**3, np.int64)
        for b in batches:
            texts = b.column("t")
            for i in range(0, len(texts), 256):
                s = "\n\n".join(("", *(t or "" for t in texts.slice(i, 256).to_pylist()), "")).lower()
                c = table[np.minimum(np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32), 0x250)]
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    return [(r.code, r.n) for r in docs.select(F.col(text).alias("t")).mapInArrow(of, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()]


class LanguageModel:
    """Costs of a class after two others: trigrams smoothed by bigrams, and these by single classes."""

    def __init__(self, counts: list[tuple[int, int]], weight: float = 5.0):
        import numpy as np

        n3 = np.zeros(CLASSES**3)
        for code, n in counts:
            n3[code] = n
        n3 = n3.reshape(CLASSES, CLASSES, CLASSES)
        n2, n1 = n3.sum(0), n3.sum((0, 1))
        p1 = (n1 + 1) / (n1 + 1).sum()
        p2 = (n2 + weight * p1) / (n2.sum(1, keepdims=True) + weight)
        p3 = (n3 + weight * p2[None]) / (n3.sum(2, keepdims=True) + weight)
        self.cost = -np.log(p3).astype(np.float32)


def decode(token: str, cost) -> str:
    """The text of least cost that a lower-case token may stand for. cost: of a class after two, as nested lists or an array."""
    states = {(0, 0): (0.0, "")}
    for i, c in enumerate(token):
        own = char_class(c)
        # (class, or -1 for nothing; what is written; channel cost)
        if own:
            ways = [(own, c, 0.0)]
            if i and token[i - 1] == c:
                ways.append((-1, "", REPEAT))
        else:
            ways = [(char_class(x), x, LOOK) for x in LOOKALIKES.get(c, "")]
            ways += [(0, c, 0.0), (-1, "", JOIN)] if c == " " else [(0, c, KEEP), (-1, "", DROP_LOOK if c in LOOKALIKES else DROP)]
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (z, text) in states.items():
            row = cost[a][b]
            for k, x, w in ways:
                if k < 0:
                    key, total, out = (a, b), z + w, text
                else:
                    key, total, out = (b, k), z + w + row[k], text + x
                if key not in new or (total, out) < new[key]:
                    new[key] = (total, out)
        states = new
    return min((z + cost[a][b][0], text) for (a, b), (z, text) in states.items())[1]


class Restorer:
    """Restored words of texts under a language model."""

    def __init__(self, cost):
        self.cost = cost.tolist()

    def restore(self, text: str) -> str:
        """The text with what is suspicious decoded."""
        out = " ".join(decode(t, self.cost) if TRIGGER(t) else t for t in text.lower().split())
        return SPACED.sub(lambda m: decode(m[0], self.cost), out)

    def token_words(self, token: str) -> list[str]:
        """The words of a lower-case token."""
        return WORD.findall(decode(token, self.cost) if TRIGGER(token) else token)

    def tokens(self, text: str | None) -> set[str]:
        """The different tokens of a text, and those that runs of single characters decode to."""
        if not text:
            return set()
        low = text.lower()
        out = set(low.split())
        for m in SPACED.finditer(low):
            out.update(decode(m[0], self.cost).split())
        return out

    def words(self, text: str | None) -> set[str]:
        return {w for t in self.tokens(text) for w in self.token_words(t)}


def grams(word: str) -> list[str]:
    """The word with its bounds, and its parts."""
    s = f"^{word}$"
    return list(dict.fromkeys([s, *(s[i : i + n] for n in GRAMS for i in range(len(s) - n + 1))]))


class Scorer:
    """Scores of restored texts. A feature (gram, level) holds if at least `level` different words have the gram."""

    def __init__(self, weights: dict[str, list[float]], bias: float, restorer: Restorer | None = None):
        self.weights, self.bias, self.restorer = weights, bias, restorer
        self.begins = {g[: GRAMS[0]] for g in weights}
        self.memo: dict[str, tuple] = {}

    def word_hits(self, word: str) -> list[str]:
        """The features of a word."""
        s, n = f"^{word}$", GRAMS[0]
        begins = self.begins
        if len(s) > n and not any(s[i : i + n] in begins for i in range(len(s) - n + 1)):
            return []
        return [g for g in grams(word) if g in self.weights]

    def counts(self, tokens: set[str]) -> dict[str, int]:
        """How many different words of a text have each gram; what a token has is kept, for at most MEMO tokens."""
        memo, words = self.memo, {}
        for t in tokens:
            h = memo.get(t)
            if h is None:
                if len(memo) >= MEMO:
                    memo.clear()
                h = memo[t] = tuple((w, g) for w in self.restorer.token_words(t) if (g := self.word_hits(w)))
            if h:
                words.update(h)
        return counted(words.values())

    def value(self, counts: dict[str, int]) -> float:
        z = self.bias + math.fsum(w for g, n in counts.items() for w in self.weights[g][:n])
        return 1 / (1 + math.exp(-z)) if z > -500 else 0.0

    def score(self, text: str | None) -> float:
        return self.value(self.counts(self.restorer.tokens(text)))


def counted(hits) -> dict[str, int]:
    out: dict[str, int] = {}
    for gs in hits:
        for g in gs:
            out[g] = out.get(g, 0) + 1
    return out


def fit_logistic(rows: list[tuple[list[int], int]], n: int, l2: float = 1e-4, rounds: int = 1500) -> tuple[list[float], float]:
    """Weights (none negative: a feature is evidence for toxicity or nothing) and bias of a logistic regression over sets of features, by gradient steps with momentum."""
    import numpy as np

    y = np.array([t for _, t in rows], float)
    at = np.array([i for i, (h, _) in enumerate(rows) for _ in h], np.int64)
    f = np.array([x for h, _ in rows for x in h], np.int64)
    df = np.maximum(np.bincount(f, minlength=n), 1)
    w, b, vw, vb = np.zeros(n), math.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)), np.zeros(n), 0.0
    for _ in range(rounds):
        z = b + np.bincount(at, w[f], minlength=len(y))
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gw = np.bincount(f, e[at], minlength=n) / df + l2 * w  # each feature steps by its own documents' mean error
        vw, vb = 0.8 * vw - 0.4 * gw, 0.8 * vb - 0.4 * e.mean()
        w, b = np.maximum(w + vw, 0), b + vb
        vw[w == 0] = 0
    return w.tolist(), float(b)


def train(docs: DataFrame, labels: DataFrame, cost, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> tuple[dict[str, list[float]], float]:
    """The weights of the selected grams, one a level, and the bias."""
    learn = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & (F.crc32(F.col(doc_id).cast("string")) % FOLDS != 0))
    picked = learn.select(doc_id, F.col(label).cast("int").alias("y")).orderBy(F.xxhash64(doc_id), doc_id, "y").limit(sample)

    def restored(batches):
        import pyarrow as pa

        r = Restorer(cost)
        for b in batches:
            words = [sorted(r.words(t)) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(words, pa.list_(pa.string()))], ["y", "words"])

    rows = docs.select(F.col(doc_id), F.col(text).alias("t")).join(F.broadcast(picked), doc_id).select("y", "t")
    # near copies would pass their chance words off as frequent: what agrees in three minima of hashes counts as one document
    least = lambda salt: F.array_min(F.transform("words", lambda w: F.xxhash64(w, F.lit(salt))))
    known = materialize(rows.mapInArrow(restored, "y int, words array<string>").dropDuplicates(["y", "words"]).withColumn("like", F.xxhash64(least(1), least(2), least(3))), "op5-sample")
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not toxic or toxic == n:
        return {}, -math.inf
    by_word = known.select("y", "like", F.explode("words").alias("w")).groupBy("w").agg(F.sum("y").alias("t"), F.count("*").alias("n"), F.countDistinct(F.when(F.col("y") == 1, F.col("like"))).alias("d"))
    s = F.concat(F.lit("^"), "w", F.lit("$"))
    size = F.length("w") + 2
    parts_of = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(size - k + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(k)))
    parts = [F.when(size >= k, parts_of(k)).otherwise(F.array().cast("array<string>")) for k in GRAMS]
    by_gram = by_word.select("t", "n", "d", F.explode(F.array_distinct(F.concat(F.array(s), *parts))).alias("g")).groupBy("g").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.sum("d").alias("d"))
    rate = toxic / n
    odds = F.log(((F.col("t") + 0.5 * rate) / (F.col("n") - F.col("t") + 0.5 * (1 - rate))) * ((1 - rate) / rate))
    above = (F.col("t") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    chosen = [r.g for r in by_gram.where(F.col("d") >= max(5, toxic // 200)).where((odds > 1) & (above >= DEVIATIONS)).orderBy(F.desc(odds * F.sqrt("t")), "g").limit(FEATURES).collect()]
    number = {g: i for i, g in enumerate(chosen)}

    def incidence(batches):
        import pyarrow as pa

        scorer = Scorer(dict.fromkeys(number, []), 0.0)
        for b in batches:
            hits = []
            for w in b.column("words").to_pylist():
                n = counted(map(scorer.word_hits, w))
                hits.append(sorted(number[g] * LEVELS + k for g, c in n.items() for k in range(min(c, LEVELS))))
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(hits, pa.list_(pa.int32()))], ["y", "hits"])

    seen = [(r.hits, r.y) for r in known.mapInArrow(incidence, "y int, hits array<int>").collect()]
    weights, bias = fit_logistic(sorted(seen), len(chosen) * LEVELS)
    return {g: weights[i * LEVELS : (i + 1) * LEVELS] for g, i in number.items()}, bias


def scored(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, score: str = "toxicity") -> DataFrame:
    """docs with a column score, 0 to 1."""
    import hashlib

    ship(docs.sparkSession)
    cost = LanguageModel(count_trigrams(docs, text)).cost
    weights, bias = train(docs, labels, cost, doc_id=doc_id, text=text, label=label, sample=sample)
    key = hashlib.sha256(cost.tobytes() + repr(sorted(weights.items())).encode()).hexdigest()
    at = docs.columns.index(text)

    def of(batches):
        import pyarrow as pa

        scorer = kept(key, lambda: Scorer(weights, bias, Restorer(cost)))
        for b in batches:
            scores = pa.array([scorer.score(t.as_py()) for t in b.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], [*(f"c{i}" for i in range(b.num_columns)), "toxicity"])

    names = [f"c{i}" for i in range(len(docs.columns))]  # extra columns may clash
    out = docs.toDF(*names).mapInArrow(of, ", ".join(f"{n} {t}" for n, (_, t) in zip(names, docs.dtypes)) + ", toxicity double")
    return out.toDF(*docs.columns, score)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's scores of documents."""
    out = scored(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == 0
    return out.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score stays below 0.5, all columns kept."""
    name = fresh("toxicity", docs.columns)
    return scored(docs, labels, score=name).where(F.col(name) < 0.5).drop(name)
