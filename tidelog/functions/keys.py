"""Keys: prefix bounds, size checks, text views, humanised sizes, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.schema import MAX_KEY_BYTES, MAX_VALUE_BYTES, TooLarge


def prefix_upper_bound(prefix: bytes) -> bytes | None:
    """The least key above every key with the prefix; None where there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def check_sizes(key: bytes, value: bytes | None) -> None:
    if not 0 < len(key) <= MAX_KEY_BYTES:
        raise TooLarge(f"a key has 1 to {MAX_KEY_BYTES} bytes, not {len(key)}")
    if value is not None and len(value) > MAX_VALUE_BYTES:
        raise TooLarge(f"a value has at most {MAX_VALUE_BYTES} bytes, not {len(value)}")


def valid_sizes(key: Column, value: Column) -> Column:
    """True for rows whose key and value are within their limits."""
    size = F.octet_length(key)
    return size.between(1, MAX_KEY_BYTES) & F.coalesce(F.octet_length(value) <= MAX_VALUE_BYTES, F.lit(True))


def require_sizes(ops: DataFrame) -> DataFrame:
    """The ops; a row beyond the limits fails the job that reads it."""
    bad = F.raise_error(F.concat(F.lit("key or value out of limits: "), F.octet_length("key").cast("string")))
    return ops.withColumn("key", F.when(valid_sizes(F.col("key"), F.col("value")), F.col("key")).otherwise(bad.cast(ops.schema["key"].dataType)))


def to_text(data: Column) -> Column:
    """Bytes as UTF-8 text, bad bytes replaced."""
    return F.make_valid_utf8(data.cast("string"))


def to_bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def parse_integer(text: Column) -> Column:
    """A 64-bit integer with optional white space and sign, or null. Empty text is 0 for counters: see `counter_value`."""
    return F.when(text.rlike(r"^[ \t\n\x0b\f\r]*[+-]?[0-9]+[ \t\n\x0b\f\r]*\z"), F.btrim(text, F.lit(" \t\n\x0b\f\r")).try_cast("bigint"))


def counter_value(text: Column) -> Column:
    """What a counter command starts from: 0 for an absent or empty value, null for one that is no integer."""
    return F.when(text.isNull() | (text == ""), F.lit(0).cast("bigint")).otherwise(parse_integer(text))


def humanised(size: Column) -> Column:
    """Bytes as B, KiB, MiB or GiB."""
    size = size.cast("double")
    return (
        F.when(size < 1024, F.format_string("%.0f B", size))
        .when(size < 1024**2, F.format_string("%.1f KiB", size / 1024))
        .when(size < 1024**3, F.format_string("%.1f MiB", size / 1024**2))
        .otherwise(F.format_string("%.2f GiB", size / 1024**3))
    )


def payload(key: Column, size: int) -> Column:
    """A deterministic value: the key, a bar, and letters in a cycle, up to `size` characters."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.substring(F.concat(key, F.lit("|"), F.repeat(F.lit(letters), size // len(letters) + 1)), 1, size)
