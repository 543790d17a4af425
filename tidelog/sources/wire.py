"""Requests and replies of the wire protocol as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of a request (fixed values).
MAX_ARGUMENTS, MAX_BULK, MAX_INLINE = 1_048_576, 512 * 1024 * 1024, 64 * 1024


class ProtocolError(Exception):
    pass


def parse_request(data: bytes, at: int = 0) -> tuple[list[bytes], int] | None:
    """(arguments, place after them) of the request at `at`, None while incomplete."""
    end = data.find(b"\r\n", at)
    if data[at : at + 1] != b"*":
        end = data.find(b"\n", at)
        if end < 0:
            if len(data) - at > MAX_INLINE:
                raise ProtocolError("too big inline request")
            return None
        return data[at:end].split(), end + 1
    if end < 0:
        return None
    count, at = _number(data[at + 1 : end], MAX_ARGUMENTS, "invalid multibulk length"), end + 2
    args = []
    for _ in range(max(0, count)):
        end = data.find(b"\r\n", at)
        if end < 0:
            return None
        if data[at : at + 1] != b"$":
            raise ProtocolError("expected '$'")
        size, at = _number(data[at + 1 : end], MAX_BULK, "invalid bulk length"), end + 2
        if size < 0:
            raise ProtocolError("invalid bulk length")
        if len(data) < at + size + 2:
            return None
        args.append(data[at : at + size])
        at += size + 2
    return args, at


def _number(data: bytes, most: int, error: str) -> int:
    try:
        n = int(data)
    except ValueError:
        raise ProtocolError(error) from None
    if n > most:
        raise ProtocolError(error)
    return n


def write_reply(reply) -> bytes:
    """None, int, bytes or str (bulk), list (array), ("+", text) simple, ("-", text) error."""
    if reply is None:
        return b"$-1\r\n"
    if isinstance(reply, bool | int):
        return b":%d\r\n" % reply
    if isinstance(reply, tuple):
        return reply[0].encode() + reply[1].encode() + b"\r\n"
    if isinstance(reply, list):
        return b"*%d\r\n" % len(reply) + b"".join(write_reply(x) for x in reply)
    data = reply.encode() if isinstance(reply, str) else reply
    return b"$%d\r\n" % len(data) + data + b"\r\n"


def inline_arguments(line: Column) -> Column:
    """Arguments of an inline request."""
    trimmed = F.btrim(line, F.lit(" \t\r\n"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \t]+"))


def bulk(value: Column) -> Column:
    """A bulk reply as text, null for null."""
    return F.when(value.isNull(), F.lit("$-1\r\n")).otherwise(F.concat(F.lit("$"), F.octet_length(value).cast("string"), F.lit("\r\n"), value, F.lit("\r\n")))
