"""Current state and replicated entries kept up to date by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators.views import newest


def source(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 4) -> DataFrame:
    """New Parquet files of a folder; group commit is files_per_trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def newest_versions(log: DataFrame) -> DataFrame:
    """Streaming newest version of each key: sequence numbers decide, so late files need no watermark.

    The state holds a row a key, tombstones included: an op that arrives late must not revive a key.
    """
    return newest(log)


def to_memory(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Runs all that is there into an in-memory table; for tests and small results."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def apply_log(entries: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], already_applied: Callable[[], int]) -> StreamingQuery:
    """The replicated state machine: each micro-batch applied once, in order; a batch that was applied before a crash is skipped.

    `apply` must record the batch id with its effect, `already_applied` returns the last one recorded (-1: none).
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch_id > already_applied():
            apply(batch, batch_id)

    query = entries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def apply_to_store(store, entries: DataFrame, checkpoint: str) -> StreamingQuery:
    """Streams op-log rows (key, seq, kind, value) into a store; the manifest records the batch id with the data."""
    from dataclasses import replace

    def apply(batch: DataFrame, batch_id: int) -> None:
        top = batch.agg(F.max("seq")).first()[0]
        # The stats travel in the manifest that publishes the table: one commit for both.
        store.version = replace(store.version, stats=store.version.stats | {"stream_batch": batch_id})
        store.append(batch, top or 0)

    return apply_log(entries, checkpoint, apply, lambda: int(store.version.stats.get("stream_batch", -1)))


def windowed_rates(metrics: DataFrame, length: str = "10 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(window, node, name, low, high, n) of a streaming or batch metrics table with event times."""
    rows = metrics.withWatermark("ts", late) if metrics.isStreaming else metrics
    return rows.groupBy(F.window("ts", length, slide), "node", "name").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))
