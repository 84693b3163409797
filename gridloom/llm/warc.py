"""WARC archives of pages, written with an index first and read back by coalesced byte ranges.

Writing: digests of all payloads are grouped to find those that several pages share; of a payload of at
least `least` bytes the page with the largest id becomes the `response` record, others `revisit`
records that refer to it. Tasks write archives straight from the scan, one gzip member a record,
and roll over at `ROLL` bytes; what they return is the index: file, offset, length, url and digest
of each record, and which page it is of. The index is a table in the shared folder. A task that is run again writes
files of other names; only those that the index names are ever read.

Reading: `ranges` takes any selection of the index (by url, digest, page) and deals it by file and by
spans of `SPAN` bytes; a task sorts its records by offset and reads neighbours with no more than
`GAP` bytes between them at once. Records are parsed, unpacked and checked against their digest.

Files go through pyarrow's file systems, so the shared folder may be a mount, HDFS or an object store.

Defined results for odd rows: null html is an empty payload; a null id is written as none, is never
preferred to another and is referred to as null; rows that repeat an id and a payload are response or
revisit together (each row that has the largest id is a response); a null url is empty; characters
that a header line cannot hold are written as %XX, the index keeps the url itself; other columns are ignored; an empty
table gives no archives and an empty index.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._shared import materialise, shared_dir

#: Bytes of an archive before the next begins; of a span dealt to a reader; of a gap that is read over; payloads that may be revisited; shared digests that may be broadcast.
ROLL, SPAN, GAP, LEAST, FEW = 1 << 30, 16 << 20, 64 << 10, 1000, 200_000
DATE = "2026-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if ":/" in path else (pyarrow.fs.LocalFileSystem(), path)


def _line(s: str) -> str:
    """s as a header line can hold it."""
    return quote(s, safe="".join(chr(c) for c in range(0x21, 0x7F) if c != 0x25)) if s else s


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record as a gzip member. Revisits hold no payload, but its length and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
        f"Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse(member: bytes) -> dict:
    """A record's fields; the payload of a response is checked against its digest and length."""
    unpack = zlib.decompressobj(31)
    data = unpack.decompress(member) + unpack.flush()
    if not unpack.eof or unpack.unused_data:
        raise ValueError("not one whole record")
    head, rest = data.split(b"\r\n\r\n", 1)
    version, *lines = head.decode().split("\r\n")
    named = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(named["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("malformed record")
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    digest, revisit = named["WARC-Payload-Digest"].removeprefix("sha1:"), named["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record of page {named['Page-ID']} does not match its digest")
    whole = lambda s: int(s) if s else None
    return {
        "page_id": whole(named["Page-ID"]), "url": named["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": named["WARC-Type"],
        "refers_to": whole(named.get("Refers-To-Page-ID", "")), "payload": None if revisit else payload,
    }


def _writer(folder: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        out, at, name = None, 0, ""
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    payload = (r["html"] or "").encode()
                    data = record(r["page_id"], r["url"], payload, r["digest"], r["refers_to"], r["revisit"])
                    if out is None or at >= roll:
                        if out is not None:
                            out.close()
                        name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(data)
                    rows.append({"file": f"{folder}/{name}", "offset": at, "length": len(data), "url": r["url"], "digest": r["digest"], "page_id": r["page_id"], "record_type": "revisit" if r["revisit"] else "response"})
                    at += len(data)
                fields = [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())]
                yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))
        finally:
            if out is not None:
                out.close()

    return run


def _payload() -> Column:
    return F.coalesce("html", F.lit("")).cast("binary")


def write(pages: DataFrame, *, least: int = LEAST, roll: int = ROLL) -> DataFrame:
    """Write every page to archives in the shared folder; the index of their records, itself a written table."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), "html")
    # sha-256 tells payloads apart; sha-1 is the record's digest
    shared = rows.where(F.octet_length(_payload()) >= least).groupBy(F.sha2(_payload(), 256).alias("key"))
    shared = materialise(shared.agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"), "shared-payloads")
    side = F.broadcast(shared) if shared.count() <= FEW else shared.hint("merge")
    rows = rows.withColumn("key", F.sha2(_payload(), 256)).join(side.withColumn("is_shared", F.lit(True)), "key", "left")
    rows = rows.withColumn("revisit", F.coalesce(F.col("is_shared") & ~F.col("page_id").eqNullSafe(F.col("refers_to")), F.lit(False)))
    rows = rows.select("page_id", "url", "html", F.sha1(_payload()).alias("digest"), "refers_to", "revisit")
    folder = f"{shared_dir(spark)}/gridloom-warc-{uuid.uuid4().hex}"
    fs, base = _open(folder)
    fs.create_dir(base)
    return materialise(rows.mapInArrow(_writer(folder, roll), INDEX), "warc-index")


def coalesced(places: list[tuple[int, int]], gap: int = GAP) -> list[tuple[int, int]]:
    """(start, end) of the reads that cover sorted (offset, length) places, neighbours within `gap` bytes together."""
    out: list[list[int]] = []
    for offset, length in places:
        if out and offset - out[-1][1] <= gap:
            out[-1][1] = max(out[-1][1], offset + length)
        else:
            out.append([offset, offset + length])
    return [(a, b) for a, b in out]


def _reader(gap: int, payloads: bool):
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = _open(r["file"])
                places = sorted({(x["offset"], x["length"]) for x in r["places"]})
                reads, found = iter(coalesced(places, gap)), []
                start, end, data = 0, -1, b""
                with fs.open_input_file(path) as f:
                    for offset, length in places:
                        if offset >= end:
                            start, end = next(reads)
                            f.seek(start)
                            data = f.read(end - start)
                        found.append(parse(data[offset - start : offset - start + length]))
                if not payloads:
                    found = [x | {"payload": None} for x in found]
                yield pa.RecordBatch.from_pylist(found, pa.schema(list(zip(names, kinds, strict=True))))

    return run


def read(index: DataFrame, *, span: int = SPAN, gap: int = GAP, payloads: bool = True) -> DataFrame:
    """The records that a selection of the index names, each once: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, payload (null for revisits, or if `payloads` is false).

    A row of the reading tasks holds the places of one span of one file, so at most `span` bytes
    and the record that crosses its end.
    """
    at = index.groupBy("file", F.floor(F.col("offset") / span).alias("span")).agg(F.collect_set(F.struct("offset", "length")).alias("places"))
    tasks = max(1, at.sparkSession.sparkContext.defaultParallelism)
    return at.repartition(tasks, "file", "span").mapInArrow(_reader(gap, payloads), RECORD)


def report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from the archives."""
    got = read(write(pages), payloads=False)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the archives of a folder's `pages`."""
    return write(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p),
t AS (SELECT *, payload_bytes >= 1000 AND page_id IS DISTINCT FROM top AS again FROM m)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN top END AS refers_to FROM t
"""
