"""WARC archives of pages: a writer with revisit records and a splittable reader.

Writer: every record is a gzip member of its own. Of equal payloads the page with the largest id is written as a response, the others as
revisits that refer to it and hold the HTTP headers alone (profile identical-payload-digest). A task writes one archive under a name that no
other attempt uses; the committed table of archives says which are valid.

Reader: archives are cut into byte ranges. A task looks for the gzip magic from the start of its range on, and takes a candidate for a
member when its first bytes decode to a WARC header that names this archive's warcinfo record; it then owns every record that starts
inside the range and reads the last one beyond its end. Behind a member it goes on without a search, from one buffer. Payloads are hashed
again and held against the header's digest, and the number of records of an archive against the number written.

Defined results: a null html is an empty payload; empty payloads are equal to one another. Null page ids are smaller than any other; of
repeated ids one row of equal payloads is the response. A null url leaves the target URI out. Other columns are ignored; an empty table
gives no archives and no rows. Payloads below min_bytes are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._common import materialize, new_path, read, ship, with_row_key
from millrace.llm._files import make_dir, random_access, write_to
from millrace.llm.exact_dedup import groups

RANGE = 4 << 20
MIN_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK, STEP = 1 << 18, 1 << 14
#: Ranges are dealt among so many tasks at most.
READERS = 20_000


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record as a gzip member."""
    import gzip

    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def http_head(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_record(page_id, url, html, refers_to, revisit: bool, archive: str) -> bytes:
    payload = (html or "").encode()
    fields = [("WARC-Record-ID", f"<urn:millrace:page:{page_id}>"), ("WARC-Date", DATE), ("WARC-Warcinfo-ID", f"<urn:uuid:{archive}>"), ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload))]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:millrace:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields.append(("Content-Type", "application/http;msgtype=response"))
    return record("revisit" if revisit else "response", fields, http_head(len(payload)) + (b"" if revisit else payload))


def write_archives(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write pages as archives in folder. Returns the committed archives: file, bytes, records."""
    make_dir(folder)

    def of(batches):
        import pyarrow as pa

        archive = str(uuid.uuid4())
        out, size, n = None, 0, 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("id", "url", "html", "keep_id", "revisit"))):
                if out is None:
                    out = write_to(f"{folder}/{archive}.warc.gz")
                    size += out.write(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{archive}>"), ("WARC-Date", DATE), ("WARC-Warcinfo-ID", f"<urn:uuid:{archive}>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                size += out.write(page_record(*r[:4], bool(r[4]), archive))
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{archive}.warc.gz"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["file", "bytes", "records"])

    ship(pages.sparkSession)
    keyed, row = with_row_key(pages)
    kinds = groups(keyed, doc_id=page_id, text=html, row=F.col(row), normalise=None).select(F.col("rid").alias("__key"), "keep_id", (~F.col("kept")).alias("revisit"))
    mine = keyed.select(F.col(row).alias("__key"), F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = mine.join(kinds, "__key").select("id", "url", "html", F.col("keep_id").cast("long").alias("keep_id"), "revisit")
    rows = rows.withColumn("revisit", F.col("revisit") & (F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes))
    return materialize(rows.mapInArrow(of, "file string, bytes long, records long"), "op7-archives")


class _Reader:
    """Bytes of a file. What is read forward comes from one buffer, so that each byte is fetched about once."""

    def __init__(self, f, size: int):
        self.f, self.size, self.begin, self.data = f, size, 0, b""

    def at(self, place: int, n: int = STEP) -> bytes:
        """n bytes (STEP at most) from a place on; fewer only at the end of the file."""
        i = place - self.begin
        if i < 0 or len(self.data) - i < min(n, self.size - place):
            self.f.seek(place)
            self.begin, self.data, i = place, self.f.read(max(0, min(CHUNK, self.size - place))), 0
        return self.data[i : i + n]


def member(r: _Reader, at: int, archive: str):
    """The member that starts at a place: its content and the place behind it; None if there is none of this archive. A header may have any length."""
    import zlib

    d, place, checked = zlib.decompressobj(31), at, False
    parts = bytearray()
    while not d.eof:
        data = r.at(place)
        if not data:
            return None
        place += len(data)
        before = len(parts)
        try:
            parts += d.decompress(data)
        except zlib.error:
            return None
        if not checked:
            if not parts.startswith(b"WARC/1."[: len(parts)]):
                return None
            end = parts.find(b"\r\n\r\n", max(0, before - 3))
            if end >= 0:
                if f"WARC-Warcinfo-ID: <urn:uuid:{archive}>".encode() not in parts[:end].split(b"\r\n"):
                    return None
                checked = True
    return (bytes(parts), place - len(d.unused_data)) if checked else None


def starts(r: _Reader, begin: int, end: int):
    """Places of the gzip magic in a byte range."""
    place = begin
    while place < end:
        data = r.at(place)
        i = data.find(MAGIC)
        while i >= 0 and place + i < end:
            if len(data) <= i + 3 or not data[i + 3] & 0xE0:  # reserved flags are 0
                yield place + i
            i = data.find(MAGIC, i + 1)
        if len(data) < STEP:
            return
        place += STEP - len(MAGIC) + 1


def records_in(f, size: int, begin: int, end: int, archive: str):
    """The content of every record that starts in a byte range of an archive."""
    r, at = _Reader(f, size), begin
    while at < end:
        found = None
        for place in starts(r, at, end):
            if found := member(r, place, archive):
                break
        if not found:
            return
        yield found[0]
        at = found[1]


def parsed(content: bytes) -> tuple | None:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record; None for warcinfo."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    if fields["WARC-Type"] == "warcinfo":
        return None
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda uri: None if (x := uri.strip("<>").rpartition(":")[2]) == "None" else int(x)
    if fields["WARC-Type"] == "response" and (len(payload) != n or sha1_base32(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its header")
    return number(fields["WARC-Record-ID"]), n, digest, fields["WARC-Type"], number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None


def read_archives(archives: DataFrame, folder: str, span: int = RANGE) -> DataFrame:
    """Every page record of the archives (file, bytes, records), written: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Raises if an archive gives another number of records than were written to it.
    """

    def of(batches):
        import pyarrow as pa

        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for b in batches:
            for file, size, begin in zip(*(b.column(c).to_pylist() for c in ("file", "bytes", "begin"))):
                with random_access(f"{folder}/{file}") as f:
                    rows = [(file, *x) for c in records_in(f, size, begin, min(size, begin + span), file.removesuffix(".warc.gz")) if (x := parsed(c))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["file", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    tasks = archives.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / span)), F.lit(0))).first()[0]
    ranges = archives.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(span).cast("long"))).alias("begin"))
    dealt = ranges.repartition(max(1, min(tasks, READERS)))  # a number of their own: ranges are a few bytes each, by which they would all be put into one task
    found = materialize(dealt.mapInArrow(of, "file string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"), "op7-records")
    got = found.groupBy("file").agg(F.count("*").alias("got"))
    wrong = archives.join(got, "file", "left").where(F.col("records") != F.coalesce("got", F.lit(0))).select("file", "records", F.coalesce("got", F.lit(0)).alias("got")).limit(3).collect()
    if wrong:
        raise ValueError("archives damaged: " + "; ".join(f"{r.file} has {r.got} of {r.records} records" for r in wrong))
    return found.drop("file")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of pages written to archives and read back."""
    folder = new_path(spark, "op7-archives")
    return read_archives(write_archives(read(spark, sf_dir, "pages"), folder), folder)


_QUINT = "('0x' || substr(h, {0}, 5))::BIGINT"
_CHARS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({_QUINT.format(5 * i + 1)} >> {s}) & 31)::BIGINT, 1)" for i in range(8) for s in (15, 10, 5, 0))
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT page_id, x, h, max(page_id) OVER (PARTITION BY x) AS keep FROM p)
SELECT page_id, strlen(x)::BIGINT AS payload_bytes, {_CHARS} AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM g
"""
