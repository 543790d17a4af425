"""Write path: batches, sequence numbers, complete-batch recovery, flush."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.reads import ranked
from tidelog.operators.views import current
from tidelog.schema import DELETE, MAX_SEQUENCE, StoreError


def sequenced(ops: DataFrame, last_seq: int) -> DataFrame:
    """Contiguous sequence numbers after last_seq, batch by batch, in the order of batch_id and batch_pos."""
    rows = ranked(ops, "batch_id", "batch_pos")
    return rows.withColumn("seq", F.col("rank") + F.lit(last_seq + 1)).drop("rank")


def check_sequence(last_seq: int, added: int) -> int:
    if last_seq + added > MAX_SEQUENCE:
        raise StoreError("sequence numbers are used up")
    return last_seq + added


def complete_batches(ops: DataFrame) -> DataFrame:
    """Ops of batches all of whose ops are there; a torn batch is as if never written."""
    whole = ops.groupBy("batch_id").agg(F.count("*").alias("n"), F.max("batch_size").alias("size")).where("n = size").select("batch_id")
    return ops.join(whole, "batch_id", "left_semi")


def last_of_batch(ops: DataFrame) -> DataFrame:
    """One op a key and batch: the last."""
    top = F.max_by(F.struct("batch_pos", "seq", "kind", "value"), "batch_pos").alias("top")
    return ops.groupBy("batch_id", "key").agg(top).select("batch_id", "key", "top.*")


def flush_tombstones(log: DataFrame, first_seq: int) -> DataFrame:
    """FLUSHDB: a tombstone for every live key, in key order."""
    live = current(log.select("key", "seq", "kind", F.lit(None).cast("string").alias("value"))).select("key")
    rows = ranked(live, "key")
    return rows.select("key", (F.col("rank") + first_seq).alias("seq"), F.lit(DELETE).cast("tinyint").alias("kind"), F.lit(None).cast(log.schema["value"].dataType).alias("value"))


def op_counts(log: DataFrame) -> DataFrame:
    """(writes, deletes): one per op of a batch."""
    return log.agg(F.count_if(F.col("kind") != DELETE).alias("writes"), F.count_if(F.col("kind") == DELETE).alias("deletes"))


def group_commit(ops: DataFrame, max_batches: int = 1024, max_ops: int = 16384) -> DataFrame:
    """Adds commit_id: consecutive batches share a commit while within both caps, judged by their place in the queue."""
    size = ops.groupBy("batch_id").agg(F.count("*").alias("ops"))
    rows = ranked(size, "batch_id")
    within = Window.partitionBy("__slot").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__slot", F.floor(F.col("rank") / max_batches)).withColumn("__before", F.coalesce(F.sum("ops").over(within), F.lit(0)))
    commit = F.struct("__slot", F.floor(F.col("__before") / max_ops).alias("part"))
    return ops.join(rows.select("batch_id", commit.alias("commit_id")), "batch_id")
