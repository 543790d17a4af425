"""Point, range, prefix, glob and paginated reads, and the read-only commands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.glob import matches
from tidelog.operators.views import as_of, current
from tidelog.schema import SCAN_CAP, SCAN_COUNT
from tidelog.shared import stable


def get(log: DataFrame, key, snapshot: int | None = None) -> DataFrame:
    """(key, value) of one key, no row if absent. The key filter runs before versions are compared."""
    rows = log.where(F.col("key") == F.lit(key))
    return (current(rows) if snapshot is None else as_of(rows, snapshot)).select("key", "value")


def in_range(rows: DataFrame, start=None, end=None) -> DataFrame:
    """Rows with start <= key < end; None is unbounded."""
    if start is not None:
        rows = rows.where(F.col("key") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("key") < F.lit(end))
    return rows


def scan(log: DataFrame, start=None, end=None, snapshot: int | None = None, limit: int | None = None) -> DataFrame:
    """Live pairs of a half-open range in key order. Bounds prune files before versions are compared."""
    rows = in_range(log, start, end)
    live = (current(rows) if snapshot is None else as_of(rows, snapshot)).select("key", "value").orderBy("key")
    return live if limit is None else live.limit(limit)


def scan_prefix(log: DataFrame, prefix, snapshot: int | None = None) -> DataFrame:
    """Live pairs whose key begins with the prefix, in key order."""
    rows = log.where(F.startswith(F.col("key"), F.lit(prefix)))
    return (current(rows) if snapshot is None else as_of(rows, snapshot)).select("key", "value").orderBy("key")


def keys(log: DataFrame, pattern: str) -> DataFrame:
    """Live keys that match a glob, in order. Values are never read."""
    slim = log.where(matches(F.col("key"), pattern)).select("key", "seq", "kind", F.lit(None).cast("string").alias("value"))
    return current(slim).select("key").orderBy("key")


def scan_page(live: DataFrame, cursor: str | None, pattern: str | None = None, count: int = SCAN_COUNT) -> tuple[str | None, list]:
    """One page of live keys after the cursor, and the next cursor (None at the end). count counts matches."""
    count = max(1, min(count, SCAN_CAP))
    rows = live.select("key")
    if cursor is not None:
        rows = rows.where(F.col("key") > F.lit(cursor))
    if pattern is not None:
        rows = rows.where(matches(F.col("key"), pattern))
    found = [r["key"] for r in rows.orderBy("key").limit(count).collect()]
    return (found[-1] if len(found) == count else None), found


def pages(live: DataFrame, count: int, pattern: str | None = None) -> DataFrame:
    """Every page at once: (page, pos, key), pages from 0. Ranks come from a range sort with offsets per partition, not from one global window."""
    rows = live.select("key") if pattern is None else live.select("key").where(matches(F.col("key"), pattern))
    return ranked(rows, "key").select(F.floor(F.col("rank") / count).cast("bigint").alias("page"), (F.col("rank") % count).cast("bigint").alias("pos"), "key")


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `rank` from 0 in the given order: a range sort, then offsets by the sizes of its partitions.

    No task ranks all rows; only one count a partition reaches the driver. The sorted rows are checkpointed, so
    that ranks and counts come from the same partitions even if an executor is lost.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = stable(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33).cast("int"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    below, pairs = 0, []
    for r in at.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        pairs += [F.lit(r["p"]), F.lit(below)]
        below += r["n"]
    if not pairs:
        return rows.withColumn("rank", F.lit(0).cast("bigint"))
    return at.withColumn("rank", (place + F.create_map(*pairs)[part]).cast("bigint")).drop("__at")


def mget(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (pos, key): (pos, key, value), null for misses, duplicates kept. Only asked-for keys are resolved."""
    asked = log.join(wanted.select("key").distinct(), "key", "left_semi")
    return wanted.join(current(asked).select("key", "value"), "key", "left").select("pos", "key", "value")


def exists(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """(n): how many of the asked-for keys are live, duplicates counted."""
    asked = current(log.join(wanted.select("key").distinct(), "key", "left_semi")).select("key")
    return wanted.join(asked, "key", "left_semi").agg(F.count("*").alias("n"))


def deletions(log: DataFrame, wanted: DataFrame, first_seq: int) -> tuple[DataFrame, DataFrame]:
    """DEL: the count of `exists`, and a tombstone for every asked-for key (pos, key), absent ones too."""
    ops = wanted.select("key", (F.lit(first_seq) + F.col("pos")).alias("seq"), F.lit(0).cast("tinyint").alias("kind"), F.lit(None).cast(log.schema["value"].dataType).alias("value"))
    return exists(log, wanted), ops


def strlen(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """Byte lengths, 0 for absent keys."""
    return mget(log, wanted).select("pos", "key", F.coalesce(F.octet_length("value"), F.lit(0)).cast("bigint").alias("n_bytes"))


def types(log: DataFrame, wanted: DataFrame) -> DataFrame:
    return mget(log, wanted).select("pos", "key", F.when(F.col("value").isNull(), "none").otherwise("string").alias("type"))


def dbsize(log: DataFrame) -> DataFrame:
    """Exact number of live keys."""
    return current(log.select("key", "seq", "kind", F.lit(None).cast("string").alias("value"))).agg(F.count("*").alias("n"))


def dbsize_bound(log: DataFrame) -> DataFrame:
    """All versions and tombstones: an upper bound that needs no shuffle of keys."""
    return log.agg(F.count("*").alias("n"))
