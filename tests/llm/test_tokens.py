"""Token counts, token files and packing against the libraries."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.llm import packing, perfect_hash, token_counts, token_files
from millrace.llm.byte_bpe import Encoder, vocabulary

public = pytest.importorskip("public_tokenizers")
ALPHABET = "ab eT.\n\t'!1²é漢ß\U0001f600\x00\x1c\u0085\xa0▁<|>s/"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def encode():
    return Encoder(vocabulary()).encode


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    return token_counts.Counter(path), sentencepiece.SentencePieceProcessor(model_file=path)


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.one_of(st.text(), st.text(ALPHABET, max_size=40), st.text("the and of ing  \n", max_size=60)))
def test_counts_equal_the_library(pieces, text):
    own, library = pieces
    assert own.count(text) == len(library.encode(text))


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.one_of(st.text(), st.text(ALPHABET, max_size=40), st.just("a<|endoftext|>b"), st.just(" the 12 can't  x\n\n y")))
def test_ids_equal_the_library(tokenizer, encode, text):
    assert np.frombuffer(encode([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_memo_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr("millrace.llm.byte_bpe.MEMO", 20)
    e = Encoder(vocabulary())
    texts = [f"word{i} and more{i % 7} words" for i in range(60)]
    for _ in range(2):
        for t in texts:
            assert np.frombuffer(e.encode([t])[0], "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert len(e.memo) < 60


def test_token_counts(documents, odd_rows, pieces):
    got = token_counts.token_counts(documents(odd_rows), public.path("piece_bpe_32k.model")).collect()
    key = lambda x: repr(x)
    want = [(i, len((t or "").encode()), n := len(pieces[1].encode(t or "")), n > 4096) for i, t in odd_rows]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert token_counts.token_counts(documents([]), public.path("piece_bpe_32k.model")).count() == 0


def test_round_trip(spark, documents, odd_rows, tokenizer, tmp_path):
    rnd = random.Random(1)
    rows = odd_rows + [(100 + i, " ".join(rnd.choice("some words to write".split()) for _ in range(rnd.randint(0, 40)))) for i in range(300)]
    got = token_files.round_trip(documents(rows, 5), f"file://{tmp_path}/ids").collect()
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == sorted(w for w in want if w[0] is not None)
    assert sorted(tuple(r)[1:] for r in got) == sorted(w[1:] for w in want)
    assert token_files.round_trip(documents([]), f"file://{tmp_path}/none").count() == 0


def test_lookup_of_absent_keys(spark, documents, tmp_path):
    folder = f"file://{tmp_path}/ids"
    entries = token_files.write_shards(documents([(i, "a b") for i in range(50)]), folder)
    index = token_files.write_index(entries, folder)
    asked = entries.selectExpr("id", "nth", "key + 12345 AS key")
    assert token_files.lookup(asked, index, folder).where("found").count() == 0
    assert token_files.lookup(entries, index, folder).where("found").count() == 50


def test_perfect_hash():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20000):
        keys = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        ix = perfect_hash.Index(perfect_hash.build(keys, np.arange(len(keys)) % 9, np.arange(len(keys)) * 7, np.arange(len(keys)) + 1))
        found, ok = ix.find(keys)
        assert ok.all() and (found["offset"] == np.arange(len(keys)) * 7).all() and (found["shard"] == np.arange(len(keys)) % 9).all()
    assert not ix.find(rnd.integers(0, 2**63, 1000).astype(np.uint64))[1].any()


def test_perfect_hash_leftovers(monkeypatch):
    monkeypatch.setattr(perfect_hash, "LEVELS", 1)
    keys = np.arange(100, dtype=np.uint64)
    found, ok = perfect_hash.Index(perfect_hash.build(keys, keys, keys, keys)).find(keys)
    assert ok.all() and (found["n"] == keys).all()


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_constraints(rule):
    rnd = np.random.default_rng(2)
    lengths = rnd.integers(1, 1000, 3000)
    bins, places = packing.best_fit(lengths, 2048, documents=5, attention=1_500_000, rule=rule)
    assert np.bincount(bins, lengths).max() <= 2048 and np.bincount(bins).max() <= 5 and np.bincount(bins, lengths.astype(float) ** 2).max() <= 1_500_000
    check_gapless(bins, places, lengths)


def check_gapless(bins, places, lengths):
    at = {}
    for b, p, n in sorted(zip(bins, places, lengths)):
        assert p == at.get(b, 0)
        at[b] = p + n


def test_best_fit_is_tight():
    lengths = np.minimum(2047, np.random.default_rng(3).lognormal(6.2, 0.9, 20000).astype(int) + 1)
    bins, places = packing.best_fit(lengths)
    assert bins.max() + 1 <= 1.005 * (-(-lengths.sum() // 2048)) + 1
    check_gapless(bins, places, lengths)
    assert packing.best_fit([])[0].tolist() == []
    with pytest.raises(ValueError):
        packing.best_fit([3000])


def test_packed_documents(documents, odd_rows, tokenizer):
    rows = odd_rows + [(200 + i, "word " * (i * 37 % 900)) for i in range(100)]
    got = packing.packed(documents(rows)).collect()
    want = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)] if len(ids) > 2048 else [0, len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    check_gapless([r.sequence_id for r in got], [r.offset for r in got], [r.length for r in got])
    size = {}
    for r in got:
        size[r.sequence_id] = size.get(r.sequence_id, 0) + r.length
    assert max(size.values()) <= 2048 and len(size) <= -(-sum(size.values()) // 2048) + 1
    assert packing.packed(documents([])).count() == 0


def test_packing_in_groups(spark):
    rows = spark.createDataFrame([(i, 0, (i * 7919) % 2000 + 1) for i in range(4000)], "doc_id long, piece int, length long")
    got = packing.pack(rows, group=500).collect()
    check_gapless([r.sequence_id for r in got], [r.offset for r in got], [r.length for r in got])
    assert len({r.sequence_id for r in got}) <= 1.02 * sum(r.length for r in got) / 2048 + 9


def test_ids_of_pieces(documents):
    r = packing.pieces(documents([(1, "hello world")]), keep_ids=True).first()
    assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length


def test_keys_that_share_a_hash():
    """Keys equal in the first hash are told apart by the second; equal in both they are refused."""
    keys = np.repeat(np.arange(200, dtype=np.uint64), 2)
    second = np.arange(400, dtype=np.uint64)
    ix = perfect_hash.Index(perfect_hash.build(keys, second, second * 3, second + 1, second))
    found, ok = ix.find(keys, second)
    assert ok.all() and (found["offset"] == second * 3).all()
    assert not ix.find(keys, second + 1000)[1].any()
    with pytest.raises(ValueError):
        perfect_hash.build(keys, second, second, second, np.zeros(400, np.uint64))


def test_a_missing_document_is_an_error(documents, tmp_path, monkeypatch):
    """What the index doesn't find stops the round trip."""
    whole = token_files.write_index
    monkeypatch.setattr(token_files, "write_index", lambda entries, folder: whole(entries.where("id <> 7"), folder))
    with pytest.raises(Exception, match="is not in the index"):
        token_files.round_trip(documents([(i, "a b") for i in range(20)]), f"file://{tmp_path}/ids").collect()


def test_an_id_of_many_rows_goes_over_shards(spark, documents, tokenizer, tmp_path):
    """Rows of one id and of none, spread over shards, are numbered through and each found."""
    rnd = random.Random(3)
    rows = [(5, " ".join(rnd.choice("abcdefgh") for _ in range(30))) for _ in range(300)] + [(None, f"{rnd.random()} x") for _ in range(200)] + [(i, "t") for i in range(10, 40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = f"file://{tmp_path}/ids"
        entries = token_files.write_shards(documents(rows, 4), folder)
        assert entries.where("id = 5").select("shard").distinct().count() > 1
        got = sorted((r.id is not None, r.id or 0, r.nth, r.shard, r.offset) for r in entries.collect())
        assert [g[2] for g in got if g[:2] == (True, 5)] == list(range(300)) and [g[2] for g in got if not g[0]] == list(range(200))
        assert [g[3:] for g in got] == sorted(g[3:] for g in got)
        back = token_files.round_trip(documents(rows, 4), f"file://{tmp_path}/again").collect()
        assert len(back) == len(rows) and sum(r.n_tokens for r in back) == sum(len(tokenizer.encode(t).ids) + 1 for _, t in rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_packing_of_repeated_rows(spark):
    """Rows that repeat a thousand times are dealt into groups of their own."""
    rows = spark.createDataFrame([(None, 0, 700)] * 3000 + [(i, 0, 100 + i % 50) for i in range(500)], "doc_id long, piece int, length long")
    got = packing.pack(rows, group=200).collect()
    assert len(got) == 3500
    check_gapless([r.sequence_id for r in got], [r.offset for r in got], [r.length for r in got])
    assert len({r.sequence_id >> 20 for r in got if r.doc_id is None}) > 5
    size = {}
    for r in got:
        size[r.sequence_id] = size.get(r.sequence_id, 0) + r.length
    assert max(size.values()) <= 2048


def test_thinned_memory_keeps_ids(monkeypatch):
    """Pieces that go and come back get the library's ids."""
    import numpy as np
    from tokenizers import Tokenizer

    from millrace.llm import byte_bpe

    monkeypatch.setattr(byte_bpe, "MEMO", 60)
    e, library = byte_bpe.Encoder(byte_bpe.vocabulary()), Tokenizer.from_file(byte_bpe.vocabulary())
    for k in range(40):
        texts = [f"the common words of chunk {k} and rare{k * j}thing {j}" for j in range(k % 9)] + [None, ""]
        got = [np.frombuffer(r, "<u4").tolist() for r in e.encode(texts)]
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
