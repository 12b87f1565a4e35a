"""WARC archives and the shard store."""

import base64
import gzip
import hashlib
import io
import random
import uuid

import pytest
from py4j.protocol import Py4JJavaError

from millrace.llm import shards, warc


@pytest.fixture
def pages(spark, tmp_path):
    def make(rows):
        path = f"{tmp_path}/pages{uuid.uuid4().hex}"
        spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, revisit string, __row string").repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make


def brute(rows, least=0):
    keep = {}
    for i, _, h in rows:
        keep.setdefault(h or "", []).append(i)
    best = {k: max((i for i in v if i is not None), default=None) for k, v in keep.items()}
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        revisit = len(p) >= least and best[h or ""] != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", best[h or ""] if revisit else None))
    return sorted(out, key=repr)


def round_trip(df, folder, **kw):
    return sorted((tuple(r) for r in warc.read_archives(warc.write_archives(df, folder, **{k: v for k, v in kw.items() if k == "min_bytes"}), folder, **{k: v for k, v in kw.items() if k == "span"}).collect()), key=repr)


ROWS = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nX: y", "<p>x</p>"), (3, None, None), (4, "", ""), (5, "http://c/", "é" * 50_000), (6, "u", "WARC/1.1\r\n\r\n"), (None, "n", "<p>x</p>"), (7, "u", "".join(chr(32 + i % 90) for i in range(300_000)))]


@pytest.mark.parametrize("span", [1 << 22, 997])
def test_round_trip(pages, tmp_path, span):
    """Whatever the ranges, every record is owned once."""
    rnd = random.Random(1)
    rows = ROWS + [(100 + i, f"http://{i}/", rnd.choice(["<a>", "<b>", f"<c>{rnd.random()}"]) * rnd.randint(1, 40)) for i in range(150)]
    assert round_trip(pages(rows), f"file://{tmp_path}/w", span=span) == brute(rows)


def test_small_payloads_and_empty_table(pages, tmp_path):
    assert round_trip(pages(ROWS), f"file://{tmp_path}/a", min_bytes=5) == brute(ROWS, 5)
    assert round_trip(pages([]), f"file://{tmp_path}/b") == []


def test_repeated_ids(pages, tmp_path):
    got = round_trip(pages([(1, "a", "same"), (1, "b", "same"), (2, "c", "other")]), f"file://{tmp_path}/w")
    assert [(r[0], r[3], r[4]) for r in got] == [(1, "response", None), (1, "revisit", 1), (2, "response", None)]


def test_a_record_within_a_payload_is_not_taken_for_one():
    """A payload that holds a whole archive, stored without compression so that its magic shows."""
    other = str(uuid.uuid4())
    inner = warc.page_record(66, "u", "inner", None, False, other) * 2
    archive = str(uuid.uuid4())
    plain = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Warcinfo-ID: <urn:uuid:" + archive.encode() + b">\r\nContent-Length: %d\r\n\r\n" % len(inner) + inner + b"\r\n\r\n"
    data = gzip.compress(plain, 0, mtime=0) + warc.page_record(7, "u", "last", None, False, archive)
    assert warc.MAGIC in data[20:]
    for cut in range(0, len(data), 13):
        n = len(list(warc.records_in(io.BytesIO(data), len(data), 0, cut, archive))) + len(list(warc.records_in(io.BytesIO(data), len(data), cut, len(data), archive)))
        assert n == 2


def test_archives_are_plain_gzip_warc(pages, tmp_path):
    warc.write_archives(pages(ROWS), f"file://{tmp_path}/w").collect()
    files = list((tmp_path / "w").glob("*.warc.gz"))
    text = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert text.count(b"WARC/1.1\r\nWARC-Type: response") + text.count(b"WARC/1.1\r\nWARC-Type: revisit") == len(ROWS)


def test_damage_is_noticed():
    good = warc.page_record(1, "u", "payload", None, False, "a")
    content = gzip.decompress(good).replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n")
    with pytest.raises(ValueError):
        warc.parsed(content)


# shards


def rows_of(n, size=200, first=0):
    return [(first + i, f"{i} " + "x" * (size + i % 50)) for i in range(n)]


def test_append_and_compact(spark, documents, tmp_path):
    store = shards.Store(spark, f"file://{tmp_path}/s")
    store.append(documents(rows_of(400)), arrival=5000)
    before = store.manifest().collect()
    assert len(before) > 10 and sum(r.rows for r in before) == 400
    assert store.compact(target=30_000) == 2
    after = store.manifest().collect()
    assert len(after) < len(before) and sum(r.rows for r in after) == 400 and sum(r.bytes for r in after) == sum(r.bytes for r in before) and sum(r.runs for r in after) == len(before)
    assert sorted((r.doc_id, r.text) for r in store.rows().collect()) == sorted(rows_of(400))
    assert sorted((r.doc_id, r.text) for r in store.rows(1).collect()) == sorted(rows_of(400))  # the old version still reads
    store.append(documents(rows_of(100, first=1000)), arrival=5000)
    assert store.version() == 3 and store.rows().count() == 500
    store.compact(target=30_000)
    assert store.rows().count() == 500 and store.rows().select("doc_id").distinct().count() == 500


def test_a_version_is_committed_once(spark, documents, tmp_path):
    store = shards.Store(spark, f"file://{tmp_path}/s")
    store.append(documents(rows_of(20)))
    other = store.manifest(1).limit(0)
    with pytest.raises(Py4JJavaError):
        store.commit(other, 1)
    assert store.version() == 1 and store.rows().count() == 20


def test_two_writers(spark, documents, tmp_path):
    """Both begin from version 1; the second to commit fails, and the first's rows are whole."""
    one, two = (shards.Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    one.append(documents(rows_of(50)), arrival=2000)
    two.version = lambda: 1
    one.append(documents(rows_of(30, first=100)), arrival=2000)
    with pytest.raises(Py4JJavaError):
        two.append(documents(rows_of(40, first=200)), arrival=2000)
    assert sorted((r.doc_id, r.text) for r in one.rows().collect()) == sorted(rows_of(50) + rows_of(30, first=100))


def test_odd_rows_and_empty_table(spark, documents, odd_rows, tmp_path):
    store = shards.Store(spark, f"file://{tmp_path}/s")
    store.append(documents(odd_rows), arrival=1000)
    store.compact()
    assert sorted(((r.doc_id, r.text) for r in store.rows().collect()), key=repr) == sorted(odd_rows, key=repr)
    none = shards.Store(spark, f"file://{tmp_path}/none")
    none.append(documents([]))
    assert none.compact() == 1 and none.rows() is None and none.manifest().count() == 0


def test_merges_stay_within_tiers(spark, tmp_path):
    store = shards.Store(spark, f"file://{tmp_path}/s")
    sizes = [1 << 20] * 4 + [20 << 20] * 3 + [100 << 20]
    m = spark.createDataFrame([(i, str(i), 0, 1, b, 1) for i, b in enumerate(sizes)], shards.MANIFEST)
    m = m.withColumn("tier", shards.tier(m["bytes"]))
    plan = {r.shard: r.lead for r in store.plan(m).collect()}
    assert {plan[i] for i in range(4)} == {0} and {plan[i] for i in (4, 5, 6)} == {4} and 7 not in plan


class Counting(io.BytesIO):
    got = 0

    def read(self, n=-1):
        data = super().read(n)
        Counting.got += len(data)
        return data


def test_long_headers_and_bytes_read(pages, tmp_path):
    """Headers beyond any buffer, urls beyond a range; every byte is fetched about once."""
    rows = [(0, "http://a/", "first"), (1, "http://" + "".join(random.Random(1).choices("abcdefghij/", k=3_000_000)), "second"), (2, "http://b/", "third")]
    assert round_trip(pages(rows), f"file://{tmp_path}/w") == brute(rows)
    assert round_trip(pages(rows), f"file://{tmp_path}/v", span=100_000) == brute(rows)
    archive = str(uuid.uuid4())
    data = b"".join(warc.page_record(i, f"http://{i}/", f"payload {i} " * 50, None, False, archive) for i in range(4000))
    Counting.got = 0
    assert len(list(warc.records_in(Counting(data), len(data), 0, len(data), archive))) == 4000
    assert Counting.got < 1.2 * len(data)


def test_lost_records_are_an_error(spark, pages, tmp_path):
    """A member that is damaged, or an archive that is cut off, stops the reader."""
    folder = tmp_path / "w"
    archives = warc.write_archives(pages([(i, f"u{i}", f"text {i} " * 30) for i in range(60)]), f"file://{folder}")
    file = next(folder.glob("*.warc.gz"))
    data = bytearray(file.read_bytes())
    data[len(data) // 2] ^= 0xFF
    file.write_bytes(data)
    with pytest.raises(Exception, match="damaged|doesn't match"):
        warc.read_archives(archives, f"file://{folder}")


def test_columns_named_as_the_stores(spark, tmp_path):
    """Documents may have columns of the store's names; all come back."""
    docs = spark.createDataFrame([(i, f"{i} text", f"s{i}", f"n{i}", i) for i in range(40)], "doc_id long, text string, millrace_shard string, Millrace_Shard_ string, name int")
    store = shards.Store(spark, f"file://{tmp_path}/s")
    store.append(docs, arrival=50)
    assert store.compact(target=200) == 2
    back = store.rows()
    assert set(docs.columns) < set(back.columns) and len(back.columns) == 6
    assert sorted(map(tuple, back.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    with pytest.raises(ValueError):
        store.append(docs.drop("name"))


def test_a_job_merges_a_batch(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "BATCH", 3)
    store = shards.Store(spark, f"file://{tmp_path}/s")
    store.append(documents(rows_of(300)), arrival=2000)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("compact", "compaction")
    store.compact(target=9000)
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("compact") if (i := tracker.getJobInfo(j)) for s in i.stageIds if tracker.getStageInfo(s)]
    spark.sparkContext.setJobGroup("", "")
    assert tasks.count(3) >= 2  # a task a file
    merged = store.manifest().where("runs > 1").collect()
    assert len(merged) > 3 and all(r.bytes < 9000 + 2 * 2000 for r in merged)
    for r in merged:
        assert len(list((tmp_path / "s" / "data" / f"{shards.SHARD}={r.name}").glob("*.parquet"))) == 1
    assert sorted((r.doc_id, r.text) for r in store.rows().collect()) == sorted(rows_of(300))
