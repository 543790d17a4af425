"""Binary logs as DataFrames: write-ahead log, record log, state image, batch commands.

Files are read with the binaryFile source, so any store that Spark reads will do, one task a file; a log file is
small by design. Decoders are generators over bytes. Damage at a log's end ends it; damage before the end of a
record log is an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidelog.schema import MAX_BATCH_OPS, MAX_KEY_BYTES, MAX_VALUE_BYTES, CorruptRecord
from tidelog.shared import ship

# Fixed values of the formats.
RECORD_MAGIC, RECORD_VERSION = b"KCB1", 1
#: Of replicated logs and their snapshots (fixed values): magic bytes, version, the largest command.
RAFT_LOG_MAGIC, SNAPSHOT_MAGIC, RAFT_VERSION, MAX_COMMAND = b"KCRL", b"KCSN", 1, 64 * 1024 * 1024
TOMBSTONE, CONTINUES = 1, 2
COMMAND_VERSION = 1
IMAGE_VERSION = 1


def put_varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    """(number, place after it); IndexError past the end."""
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7
        if shift > 63:
            raise ValueError("varint too long")


Op = tuple[bytes, bytes | None]


def wal_record(first_seq: int, ops: list[Op]) -> bytes:
    body = bytearray(put_varint(first_seq) + put_varint(len(ops)))
    for key, value in ops:
        body += bytes([value is not None]) + put_varint(len(key)) + key
        if value is not None:
            body += put_varint(len(value)) + value
    checked = struct.pack("<I", len(body)) + bytes(body)
    return struct.pack("<I", zlib.crc32(checked)) + checked


def wal_ops(data: bytes) -> Iterator[tuple[int, bytes, bytes | None, int, int, int]]:
    """(seq, key, value, batch first seq, place in batch, batch size) of whole batches, up to the first bad record."""
    at = 0
    while at + 8 <= len(data):
        crc, size = struct.unpack_from("<II", data, at)
        end = at + 8 + size
        if not size or end > len(data) or zlib.crc32(data[at + 4 : end]) != crc:
            return
        try:
            ops, (first, place) = [], get_varint(data, at + 8)
            count, place = get_varint(data, place)
            for _ in range(count):
                kind, place = data[place], place + 1
                n, place = get_varint(data, place)
                key, place = data[place : place + n], place + n
                value = None
                if kind == 1:
                    m, place = get_varint(data, place)
                    value, place = data[place : place + m], place + m
                    if m > MAX_VALUE_BYTES:
                        return
                if kind > 1 or not 0 < n <= MAX_KEY_BYTES or place > end:
                    return
                ops.append((key, value))
        except (IndexError, ValueError):
            return
        for i, (key, value) in enumerate(ops):
            yield first + i, key, value, first, i, len(ops)
        at = end


def record_header() -> bytes:
    return RECORD_MAGIC + struct.pack("<HH", RECORD_VERSION, 0)


def record(key: bytes, value: bytes | None, continues: bool = False) -> bytes:
    flags = (TOMBSTONE if value is None else 0) | (CONTINUES if continues else 0)
    body = struct.pack("<iiB", len(key), len(value or b""), flags) + key + (value or b"")
    return struct.pack("<I", zlib.crc32(body)) + body


def record_ops(data: bytes, file: str = "") -> Iterator[tuple[int, bytes, bytes | None, int, int, int]]:
    """(seq, key, value, batch, place in batch, batch size); seq counts records. A batch without its last record is dropped; a bad
    record with others after it is an error, at the end it ends the log."""
    if len(data) < 8:
        return
    if data[:4] != RECORD_MAGIC or struct.unpack_from("<H", data, 4)[0] != RECORD_VERSION:
        raise CorruptRecord("not a record log of this version", file, 0)
    at, seq, batch, held = 8, 0, 0, []
    while at + 13 <= len(data):
        crc, n, m, flags = struct.unpack_from("<IiiB", data, at)
        end = at + 13 + n + m
        fits = 0 < n <= MAX_KEY_BYTES and 0 <= m <= MAX_VALUE_BYTES and not flags & ~3 and not (flags & TOMBSTONE and m)
        if not fits or end > len(data):
            return
        if zlib.crc32(data[at + 4 : end]) != crc:
            if end < len(data):
                raise CorruptRecord("checksum mismatch", file, at)
            return
        held.append((data[at + 13 : at + 13 + n], None if flags & TOMBSTONE else data[at + 13 + n : end]))
        if not flags & CONTINUES:
            for i, (key, value) in enumerate(held):
                seq += 1
                yield seq, key, value, batch, i, len(held)
            batch, held = batch + 1, []
        at = end


def encode_command(ops: list[Op]) -> bytes:
    out = bytearray(struct.pack("<Hi", COMMAND_VERSION, len(ops)))
    for key, value in ops:
        out += struct.pack("<Bi", value is not None, len(key)) + key
        if value is not None:
            out += struct.pack("<i", len(value)) + value
    return bytes(out)


def decode_command(data: bytes) -> list[Op]:
    try:
        version, count = struct.unpack_from("<Hi", data)
        if version != COMMAND_VERSION or not 0 <= count <= MAX_BATCH_OPS:
            raise CorruptRecord("bad command header")
        ops, at = [], 6
        for _ in range(count):
            kind, n = struct.unpack_from("<Bi", data, at)
            key, at = data[at + 5 : at + 5 + n], at + 5 + n
            value = None
            if kind:
                (m,) = struct.unpack_from("<i", data, at)
                value, at = data[at + 4 : at + 4 + m], at + 4 + m
                if len(value) != m:
                    raise CorruptRecord("command cut short")
            if n < 1 or len(key) != n or kind > 1:
                raise CorruptRecord("bad command entry")
            ops.append((key, value))
    except struct.error as e:
        raise CorruptRecord("command cut short") from e
    if at != len(data):
        raise CorruptRecord("bytes after the command")
    return ops


def encode_image(pairs: list[tuple[bytes, bytes]]) -> bytes:
    out = bytearray(struct.pack("<H", IMAGE_VERSION))
    for key, value in pairs:
        out += struct.pack("<i", len(key)) + key + struct.pack("<i", len(value)) + value
    return bytes(out + struct.pack("<iq", -1, len(pairs)))


def image_pairs(data: bytes, file: str = "") -> Iterator[tuple[bytes, bytes]]:
    """The pairs of a state image; the closing count must agree."""
    at, seen = 2, 0
    try:
        while True:
            (n,) = struct.unpack_from("<i", data, at)
            at += 4
            if n < 0:
                if struct.unpack_from("<q", data, at)[0] != seen:
                    raise CorruptRecord("image holds another number of pairs", file, at)
                return
            key, at = data[at : at + n], at + n
            (m,) = struct.unpack_from("<i", data, at)
            value, at = data[at + 4 : at + 4 + m], at + 4 + m
            seen += 1
            yield key, value
    except struct.error as e:
        raise CorruptRecord("image cut short", file, at) from e


def encode_config(voters: list[str], outgoing: list[str], learners: list[str], version: int = 2) -> bytes:
    """Version 2 has learners."""

    def names(of: list[str]) -> bytes:
        return struct.pack("<i", len(of)) + b"".join(put_varint(len(x.encode())) + x.encode() for x in of)

    return struct.pack("<H", version) + names(voters) + bytes([bool(outgoing)]) + (names(outgoing) if outgoing else b"") + (names(learners) if version > 1 else b"")


def decode_config(data: bytes) -> tuple[list[str], list[str], list[str]]:
    (version,) = struct.unpack_from("<H", data)
    if version not in (1, 2):
        raise CorruptRecord(f"configuration version {version}")

    def names(at: int) -> tuple[list[str], int]:
        (n,) = struct.unpack_from("<i", data, at)
        at, out = at + 4, []
        for _ in range(n):
            size, at = get_varint(data, at)
            out.append(data[at : at + size].decode())
            at += size
        return out, at

    voters, at = names(2)
    joint, at = data[at], at + 1
    outgoing, at = names(at) if joint else ([], at)
    learners, at = names(at) if version > 1 else ([], at)
    return voters, outgoing, learners


def raft_log_header(snapshot_index: int = 0, snapshot_term: int = 0) -> bytes:
    return RAFT_LOG_MAGIC + struct.pack("<HHqq", RAFT_VERSION, 0, snapshot_index, snapshot_term)


def raft_entry(index: int, term: int, kind: int, command: bytes) -> bytes:
    body = struct.pack("<qqBi", index, term, kind, len(command)) + command
    return struct.pack("<I", zlib.crc32(body)) + body


def raft_entries(data: bytes, file: str = "") -> Iterator[tuple[int, int, int, bytes]]:
    """(index, term, kind, command) of a replicated log, up to the first torn or damaged entry or gap."""
    if len(data) < 24:
        return
    version, _, index, term = struct.unpack_from("<HHqq", data, 4)
    if data[:4] != RAFT_LOG_MAGIC or version != RAFT_VERSION or index < 0 or term < 0:
        raise CorruptRecord("not a replicated log", file, 0)
    at = 24
    while at + 25 <= len(data):
        crc, found, term, kind, size = struct.unpack_from("<IqqBi", data, at)
        end = at + 25 + size
        if not 0 <= size <= MAX_COMMAND or end > len(data) or kind > 2 or zlib.crc32(data[at + 4 : end]) != crc or found != index + 1:
            return
        yield found, term, kind, data[at + 25 : end]
        index, at = found, end


def encode_snapshot(index: int, term: int, config: bytes, payload: bytes) -> bytes:
    """A state machine's snapshot: a header and a payload, each with a checksum."""
    header = SNAPSHOT_MAGIC + struct.pack("<HHqqiq", RAFT_VERSION, 0, index, term, len(config), len(payload))
    return header + struct.pack("<I", zlib.crc32(header)) + config + struct.pack("<I", zlib.crc32(payload)) + payload


def decode_snapshot(data: bytes, file: str = "") -> tuple[int, int, bytes, bytes]:
    """(index, term, config, payload); lengths are trusted only after the header's checksum, the payload only after its own."""
    if len(data) < 40 or data[:4] != SNAPSHOT_MAGIC or struct.unpack_from("<I", data, 36)[0] != zlib.crc32(data[:36]):
        raise CorruptRecord("bad snapshot header", file, 0)
    version, _, index, term, of_config, of_payload = struct.unpack_from("<HHqqiq", data, 4)
    start = 40 + of_config + 4
    if version != RAFT_VERSION or of_config < 0 or of_payload < 0 or start + of_payload > len(data):
        raise CorruptRecord("snapshot cut short", file, 40)
    payload = data[start : start + of_payload]
    if zlib.crc32(payload) != struct.unpack_from("<I", data, start - 4)[0]:
        raise CorruptRecord("a snapshot's payload does not match its checksum", file, start)
    return index, term, data[40 : 40 + of_config], payload


def _read(spark: SparkSession, path: str, rows, schema: str) -> DataFrame:
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame(list(rows(bytes(content), file)), columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


_OPS = "file string, seq bigint, kind tinyint, key binary, value binary, batch_id bigint, batch_pos int, batch_size int"


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """Op log rows of write-ahead logs, whole batches only."""
    return _read(spark, path, lambda data, file: ((file, s, v is not None, k, v, b, i, n) for s, k, v, b, i, n in wal_ops(data)), _OPS)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Op log rows of record logs, whole batches only."""
    return _read(spark, path, lambda data, file: ((file, s, v is not None, k, v, b, i, n) for s, k, v, b, i, n in record_ops(data, file)), _OPS)


def read_image(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value) of state images."""
    return _read(spark, path, lambda data, file: ((file, k, v) for k, v in image_pairs(data, file)), "file string, key binary, value binary")


def read_raft_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, index, term, entry_kind, command) of replicated logs."""
    return _read(spark, path, lambda data, file: ((file, *e) for e in raft_entries(data, file)), "file string, index bigint, term bigint, entry_kind tinyint, command binary")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(file, index, term, key, value) of snapshots whose payload is a state image."""

    def rows(data: bytes, file: str):
        index, term, _, payload = decode_snapshot(data, file)
        return ((file, index, term, k, v) for k, v in image_pairs(payload, file))

    return _read(spark, path, rows, "file string, index bigint, term bigint, key binary, value binary")
