"""Compaction: which versions stay, which tombstones go, and what to compact next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.schema import DELETE

L0_TRIGGER, MULTIPLIER, BASE_BYTES = 4, 10, 16 * 1024 * 1024
MAX_LEVEL = 6
#: Size at which compaction output rolls to another file, between two keys.
TARGET_FILE_BYTES = 8 * 1024 * 1024
STALE_RATIO, STALE_BYTES = 0.5, 4 * 1024 * 1024
MAX_PASSES = 64


def oldest_visible(pins: DataFrame, log: DataFrame) -> DataFrame:
    """(seq): the least pinned sequence, or the newest of the log."""
    return pins.agg(F.coalesce(F.min("seq"), log.agg(F.max("seq")).scalar()).alias("seq"))


def marked(log: DataFrame, oldest: int, deeper: DataFrame | None = None) -> DataFrame:
    """Adds `keep`: versions newer than `oldest`, and each key's newest at or below it unless that is a tombstone that may go.

    Where all files of the keys are compacted at once, any such tombstone may; with `deeper`, tables (min_key, max_key)
    that are left out of a job, only one that none of them covers. The newest at or below is an aggregate, not a
    window, so a hot key is combined before the shuffle.
    """
    below = log.where(F.col("seq") <= oldest).groupBy("key").agg(F.max_by("kind", "seq").alias("__kind"), F.max("seq").alias("__top"))
    if deeper is not None:
        covered = below.where(F.col("__kind") == DELETE).join(deeper, (F.col("key") >= F.col("min_key")) & (F.col("key") <= F.col("max_key")), "left_semi")
        below = below.join(covered.select("key", F.lit(True).alias("__covered")), "key", "left")
    else:
        below = below.withColumn("__covered", F.lit(False))
    rows = log.join(below, "key", "left")
    newest = F.coalesce((F.col("seq") == F.col("__top")) & ((F.col("__kind") != DELETE) | F.coalesce("__covered", F.lit(False))), F.lit(False))
    return rows.withColumn("keep", (F.col("seq") > oldest) | newest).drop("__kind", "__top", "__covered")


def retained(log: DataFrame, oldest: int, deeper: DataFrame | None = None) -> DataFrame:
    return marked(log, oldest, deeper).where("keep").drop("keep")


def droppable_tombstones(log: DataFrame, oldest: int, deeper: DataFrame | None = None) -> DataFrame:
    """(key, seq) of newest versions at or below `oldest` that are tombstones no deeper table (min_key, max_key) may need."""
    top = log.where(F.col("seq") <= oldest).groupBy("key").agg(F.max_by(F.struct("seq", "kind"), "seq").alias("t")).where(F.col("t.kind") == DELETE)
    newer = log.where(F.col("seq") > oldest).select("key").distinct()
    rows = top.join(newer, "key", "left_anti").select("key", "t.seq")
    if deeper is None:
        return rows
    # The manifest is small; Spark broadcasts it when its measured size allows.
    return rows.join(deeper, (F.col("key") >= F.col("min_key")) & (F.col("key") <= F.col("max_key")), "left_anti")


def level_sizes(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("level").agg(F.count("*").alias("tables"), F.sum("file_size").alias("bytes"), F.sum("entry_count").alias("entries"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"))


def level_targets(levels: DataFrame, base: int = BASE_BYTES, multiplier: int = MULTIPLIER) -> DataFrame:
    """(level, target): base * multiplier ** (level - 1), at most the largest bigint."""
    target = F.lit(base).cast("double") * F.pow(F.lit(multiplier), F.col("level") - 1)
    top = (1 << 63) - 1
    return levels.select("level", F.when(target >= float(top), F.lit(top)).otherwise(target.cast("decimal(38,0)").try_cast("bigint")).alias("target"))


def level_scores(manifest: DataFrame, trigger: int = L0_TRIGGER, base: int = BASE_BYTES, multiplier: int = MULTIPLIER) -> DataFrame:
    """(level, score): level 0 by its number of tables, others by bytes against the target."""
    sizes = level_sizes(manifest)
    target = F.lit(base).cast("double") * F.pow(F.lit(multiplier), F.col("level") - 1)
    return sizes.select("level", F.when(F.col("level") == 0, F.col("tables") / trigger).otherwise(F.col("bytes") / target).alias("score"))


def pick_level(manifest: DataFrame, max_level: int = MAX_LEVEL, **options) -> DataFrame:
    """(level, score) of the level to compact: the best score of at least 1, the lowest level of equals; no row if none."""
    scores = level_scores(manifest, **options).where((F.col("score") >= 1) & (F.col("level") < max_level))
    return scores.groupBy().agg(F.max_by(F.struct("level", "score"), F.struct("score", -F.col("level"))).alias("top")).where("top IS NOT NULL").select("top.level", "top.score")


def job_inputs(manifest: DataFrame, level: int) -> DataFrame:
    """Files of a job, with `role`: all of level 0 or the level's oldest file, and the next level's files in their key span."""
    source = manifest.where(F.col("level") == level)
    if level > 0:
        first = source.groupBy().agg(F.min("file_number").alias("file_number"))
        source = source.join(first, "file_number", "left_semi")
    span = source.agg(F.min("min_key").alias("low"), F.max("max_key").alias("high"))
    target = manifest.where(F.col("level") == level + 1).join(span, (F.col("min_key") <= F.col("high")) & (F.col("max_key") >= F.col("low")), "left_semi")
    return source.withColumn("role", F.lit("source")).unionByName(target.withColumn("role", F.lit("target")))


def overlapping(tables: DataFrame, start=None, end=None) -> DataFrame:
    """Tables that may hold keys of [start, end)."""
    if start is not None:
        tables = tables.where(F.col("max_key") >= F.lit(start))
    if end is not None:
        tables = tables.where(F.col("min_key") < F.lit(end))
    return tables


def may_contain(tables: DataFrame, key) -> DataFrame:
    return tables.where(F.lit(key).between(F.col("min_key"), F.col("max_key")))


def search_order(manifest: DataFrame) -> DataFrame:
    """Level 0 newest file first, deeper levels by key."""
    return manifest.orderBy("level", F.when(F.col("level") == 0, -F.col("file_number")), F.when(F.col("level") > 0, F.col("min_key")), "file_number")


def orphans(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files on disk that no manifest names."""
    return files.join(manifest.select("file"), "file", "left_anti")


def obsolete(files: DataFrame, versions: DataFrame, log_number: int) -> DataFrame:
    """Tables in no live version, and logs below the log number. files (file, sort: table or log, number)."""
    dead = files.where(F.col("sort") == "table").join(versions.select("file"), "file", "left_anti")
    return dead.unionByName(files.where((F.col("sort") == "log") & (F.col("number") < log_number)))


def newest_backup(files: DataFrame) -> DataFrame:
    """The file with the highest numeric generation, from names ending in a dot and a number."""
    number = F.regexp_extract("file", r"\.([0-9]+)\z", 1).try_cast("bigint")
    return files.groupBy().agg(F.max_by("file", number).alias("file"))


def live_bytes(live: DataFrame) -> DataFrame:
    return live.agg(F.coalesce(F.sum(F.octet_length("key") + F.octet_length("value")), F.lit(0)).cast("bigint").alias("live_bytes"))


def stale_ratio(live, data):
    """1 - live / data, within 0 and 1; 0 without data."""
    live, data = (F.col(x) if isinstance(x, str) else x for x in (live, data))
    return F.when(data > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - live / data))).otherwise(F.lit(0.0))


def should_compact(stats: DataFrame, ratio: float = STALE_RATIO, minimum: int = STALE_BYTES) -> DataFrame:
    """Adds compact: whether stats (live_bytes, data_bytes) call for a rewrite."""
    return stats.withColumn("compact", (F.col("data_bytes") >= minimum) & (stale_ratio("live_bytes", "data_bytes") >= ratio))
