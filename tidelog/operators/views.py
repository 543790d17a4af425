"""Views of an op log (key, seq, kind, value): current state, state as of a sequence, history.

The newest visible version of a key decides; a tombstone hides what is older. `max_by` combines on the map
side, so a hot key costs one row a task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.schema import PUT


def newest(log: DataFrame) -> DataFrame:
    """key, seq, kind, value of each key's newest version, tombstones included."""
    top = F.max_by(F.struct("seq", "kind", "value"), F.struct("seq", "kind")).alias("top")
    return log.groupBy("key").agg(top).select("key", "top.seq", "top.kind", "top.value")


def current(log: DataFrame) -> DataFrame:
    """key, seq, value of live keys."""
    return newest(log).where(F.col("kind") == PUT).drop("kind")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """Live keys at a snapshot; newer versions are not seen at all."""
    return current(log.where(F.col("seq") <= seq))


def as_of_many(probes: DataFrame, log: DataFrame) -> DataFrame:
    """probes (key, snapshot, ...) with the value each sees, null for misses: an as-of join by one sort a key and slice.

    Probes and versions are one stream per key in sequence order, so no pairs are made; a hot key's stream is cut
    into slices of sequence numbers, each begun with what the slices before it leave.
    """
    from tidelog.operators.fold import carried

    columns = [c for c in probes.columns if c not in ("key", "snapshot")]
    kind = log.schema["value"].dataType
    left = probes.select("key", F.col("snapshot").alias("__at"), F.lit(1).alias("__probe"), F.struct(*columns or [F.lit(1).alias("one")]).alias("__rest"), F.lit(None).cast("tinyint").alias("kind"), F.lit(None).cast(kind).alias("value"))
    right = log.select("key", F.col("seq").alias("__at"), F.lit(0).alias("__probe"), F.lit(None).cast(left.schema["__rest"].dataType).alias("__rest"), "kind", "value")
    # A probe comes after the version of its own sequence number.
    both = left.unionByName(right).withColumn("seq", F.col("__at") * 2 + F.col("__probe"))
    version = F.when(F.col("__probe") == 0, F.struct("kind", "value"))
    seen = carried(both, version, "__seen", F.lit(None).cast(both.select(version.alias("v")).schema["v"].dataType)).where("__probe = 1")
    return seen.select("key", F.col("__at").alias("snapshot"), *[F.col(f"__rest.{c}").alias(c) for c in columns], F.when(F.col("__seen.kind") == PUT, F.col("__seen.value")).alias("value"))


def history(log: DataFrame) -> DataFrame:
    """All versions, newest first within a key."""
    return log.orderBy(F.asc("key"), F.desc("seq"), F.desc("kind"))
