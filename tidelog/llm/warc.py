"""WARC archives of web pages, written and read as a chunked record table.

Payloads travel as (record, chunk number, bytes) rows of at most CHUNK bytes, cut at the scan, before anything is
shuffled, so that no shuffle and no worker holds a whole record: the writer streams chunks into one gzip member per record,
the reader streams archives back into chunk rows that carry the digest and length so far. An archive of ROLL bytes is
followed by another one. Of records
with equal payloads of MIN_REVISIT bytes or more, the one with the largest page_id is a response, others
are revisits of it without a payload of their own.

Archives are written by tasks under names of their own, renamed when whole, and only names that a
finished task reported are read; a task that is lost or repeated leaves nothing that counts.

Defined results: null html is an empty payload; a null url is empty; rows that repeat a page_id give
records each; with a null page_id a record has the id `null`, and is a response if no page of its group
has an id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, ship, table

CHUNK = 256 * 1024
MIN_REVISIT = 1000
#: Bytes from which on an archive takes no further record.
ROLL = 1_000_000_000
DATE = "2024-01-01T00:00:00Z"
LEVEL = 1
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"


def record_plan(pages: DataFrame) -> DataFrame:
    """(page_id, url, record, payload, bytes, sha1): a record each row."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.monotonically_increasing_id().alias("record"), payload.alias("payload"))
    return rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))


def revisits(plan: DataFrame) -> DataFrame:
    """(page_id, sha1, refers_to) of the records that revisit another; payloads are left at the scan."""
    narrow = plan.where(F.col("bytes") >= MIN_REVISIT).select("page_id", "sha1")
    # Counted before the shuffle; only groups of several distinct ids go on, as narrow rows.
    groups = narrow.groupBy("sha1").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1 AND target IS NOT NULL")
    return narrow.join(groups, "sha1").where(~F.col("page_id").eqNullSafe(F.col("target"))).select("page_id", "sha1", F.col("target").alias("refers_to")).distinct()


def chunk_rows(plan: DataFrame) -> DataFrame:
    """(page_id, url, bytes, sha1, refers_to, chunk, data): a row for each chunk, a record's chunks together and in order; a
    revisit has one, empty; refers_to is null for responses."""
    cut = plan.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("bytes") / CHUNK).cast("int")) - 1)))
    cut = cut.select("page_id", "url", "record", "bytes", "sha1", "chunk", F.substring("payload", F.col("chunk") * CHUNK + 1, F.lit(CHUNK)).alias("data"))
    r = revisits(plan).select(F.col("page_id").alias("r_id"), F.col("sha1").alias("r_sha1"), "refers_to")
    known = cut.join(r, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("sha1") == F.col("r_sha1")), "left")
    known = known.where(F.col("refers_to").isNull() | (F.col("chunk") == 0)).withColumn("data", F.when(F.col("refers_to").isNull(), F.col("data")).otherwise(F.lit(b"")))
    # A record's chunks come from one task of the scan and share the join's keys, so they are in one partition.
    return known.sortWithinPartitions("record", "chunk").select("page_id", "url", "bytes", "sha1", "refers_to", "chunk", "data")


def _open(uri: str, mode: str):
    """A stream of a store that pyarrow knows: the shared folder's."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    if mode == "w":
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store, path, store.open_output_stream(path, compression=None)
    return store, path, store.open_input_stream(path, compression=None)


def _record_id(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record_head(page_id, url: str, size: int, sha1: str, refers_to) -> bytes:
    """The header of a record, and the HTTP header its block begins with."""
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    uri = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Payload-Length: {size}"]
    lines += [f"WARC-Payload-Digest: {digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(HTTP) + (size if refers_to is None else 0)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + HTTP


def write_archives(chunks: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Writes archives from `chunk_rows`, each of one task and about `roll` bytes; returns (path, records)."""
    ship(chunks.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store = path = out = gz = final = None
        records = written = archives = 0

        def whole() -> pd.DataFrame:
            out.close()
            store.move(path, path.removesuffix(".open"))
            return pd.DataFrame({"path": [final], "records": [records]})

        for pdf in batches:
            pdf = pdf.astype({"page_id": "Int64", "refers_to": "Int64"})
            for page_id, url, size, sha1, refers_to, chunk, data in zip(pdf["page_id"], pdf["url"], pdf["bytes"], pdf["sha1"], pdf["refers_to"], pdf["chunk"], pdf["data"]):
                if chunk == 0:
                    if out is not None and written >= roll:
                        yield whole()
                        out, records, written, archives = None, 0, 0, archives + 1
                    if out is None:
                        final = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{archives}.warc.gz"
                        store, path, out = _open(final + ".open", "w")
                    page_id, refers_to = (None if x is pd.NA else int(x) for x in (page_id, refers_to))
                    gz, left = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0 if refers_to is not None else int(size)
                    written += out.write(gz.compress(record_head(page_id, url, int(size), sha1, refers_to)))
                    records += 1
                written += out.write(gz.compress(data))
                left -= len(data)
                if left <= 0:
                    written += out.write(gz.compress(b"\r\n\r\n") + gz.flush())
        if out is not None:
            yield whole()

    return chunks.mapInPandas(run, "path string, records long")


def _members(stream) -> Iterator[bytes]:
    """The bytes of a gzip stream of many members, in pieces."""
    gz, data = zlib.decompressobj(31), b""
    while True:
        if not data and not (data := stream.read(1 << 18)):
            return
        got = gz.decompress(data, 1 << 18)
        data = gz.unconsumed_tail
        if got:
            yield got
        if gz.eof:
            data, gz = gz.unused_data, zlib.decompressobj(31)


def read_records(stream) -> Iterator[tuple[dict[str, str], int, bytes, int, str, bool]]:
    """(header, chunk, bytes, length so far, SHA-1 so far, last) for each payload chunk of an archive."""
    pieces, held = _members(stream), bytearray()

    def until(mark: bytes) -> bytes:
        while (at := held.find(mark)) < 0:
            held.extend(next(pieces))
        got = bytes(held[:at])
        del held[: at + len(mark)]
        return got

    def take(n: int) -> bytes:
        while len(held) < n:
            held.extend(next(pieces))
        got = bytes(held[:n])
        del held[:n]
        return got

    while True:
        try:
            if not held:
                held.extend(next(pieces))
        except StopIteration:
            return
        lines = until(b"\r\n\r\n").decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        header = dict(x.split(": ", 1) for x in lines[1:])
        left = int(header["Content-Length"])
        left -= len(until(b"\r\n\r\n")) + 4  # the HTTP header
        sha1, chunk, length = hashlib.sha1(), 0, 0
        while True:
            data = take(min(CHUNK, left))
            left -= len(data)
            length += len(data)
            sha1.update(data)
            yield header, chunk, data, length, sha1.hexdigest(), left == 0
            chunk += 1
            if not left:
                break
        if take(4) != b"\r\n\r\n":
            raise ValueError("a WARC record does not end as it should")


def read_archives(archives: DataFrame, with_data: bool = True) -> DataFrame:
    """Chunk rows of the archives named in column path: page_id, url, record_type, refers_to, header_digest, chunk, length and
    digest so far, last, and the bytes if asked for."""
    ship(archives.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def number(x: str | None):
            return None if x is None or x == "<urn:page:null>" else int(x[len("<urn:page:") : -1])

        def frame(rows: list[tuple]) -> pd.DataFrame:
            got = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "header_digest", "header_length", "chunk", "length", "digest", "last", "data"])
            return got.astype({"page_id": "Int64", "refers_to": "Int64", "header_length": "Int64"})

        for pdf in batches:
            for uri in pdf["path"]:
                rows, size = [], 0
                _, _, stream = _open(uri, "r")
                with stream:
                    for header, chunk, data, length, digest, last in read_records(stream):
                        told = base64.b32decode(header["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        extra = header.get("WARC-Payload-Length")
                        rows.append((number(header["WARC-Record-ID"]), header.get("WARC-Target-URI", ""), header["WARC-Type"], number(header.get("WARC-Refers-To")), told, None if extra is None else int(extra), chunk, length, digest, last, data if with_data else None))
                        size += len(data) if with_data else 100
                        if size > 8_000_000 or len(rows) > 10_000:
                            yield frame(rows)
                            rows, size = [], 0
                yield frame(rows)

    return archives.select("path").mapInPandas(run, "page_id long, url string, record_type string, refers_to long, header_digest string, header_length long, chunk int, length long, digest string, last boolean, data binary")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    made = scratch.write(write_archives(chunk_rows(record_plan(table(spark, sf_dir, "pages"))), scratch.path("archives")), "manifest")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    read = read_archives(made.repartition(parts), with_data=False).where("last")
    response = F.col("record_type") == "response"
    checked = F.when(response & (F.col("digest") != F.col("header_digest")), F.raise_error(F.lit("a payload does not match its digest"))).otherwise(F.col("header_digest"))
    return read.select("page_id", F.when(response, F.col("length")).otherwise(F.col("header_length")).alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
s AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS target FROM s)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> target THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> target THEN target END AS refers_to
FROM g
"""
