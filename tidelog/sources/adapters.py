"""Tables as logs: the events table as op log and command log, ordered tables as key spaces, sample metrics and replicated logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op_log(events: DataFrame) -> DataFrame:
    """key user:<id>, seq event_id + 1, an error event deletes, others put their props. Batches of seven."""
    seq = F.col("event_id") + 1
    kind = F.when(F.col("event_type") == "error", 0).otherwise(1).cast("tinyint")
    return events.select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        seq.alias("seq"),
        kind.alias("kind"),
        F.when(kind == 1, F.col("props")).alias("value"),
        F.floor(F.col("event_id") / 7).cast("bigint").alias("batch_id"),
        (F.col("event_id") % 7).cast("int").alias("batch_pos"),
        F.lit(7).alias("batch_size"),
    )


def command_log(events: DataFrame) -> DataFrame:
    """Events as commands: view SET, signup SETNX, click APPEND, purchase GETSET, error DEL; every fifth view is SET .. XX."""
    kind = F.col("event_type")
    cmd = F.when((kind == "view") & (F.col("event_id") % 5 == 0), "SETXX").when(kind == "view", "SET").when(kind == "signup", "SETNX").when(kind == "click", "APPEND").when(kind == "purchase", "GETSET").otherwise("DEL")
    return events.select((F.col("event_id") + 1).alias("seq"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), cmd.alias("cmd"), F.when(cmd != "DEL", F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("arg"))


def counter_log(events: DataFrame) -> DataFrame:
    """Events as counter commands: purchase INCRBY its cents, signup SET a start, error DEL."""
    kind = F.col("event_type")
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    cmd = F.when(kind == "purchase", "INCRBY").when(kind == "signup", "SET").when(kind == "error", "DEL")
    arg = F.when(kind == "purchase", cents).when(kind == "signup", F.when(F.col("event_id") % 11 == 0, F.lit("none")).otherwise(F.lit("100")))
    return events.select((F.col("event_id") + 1).alias("seq"), F.concat(F.lit("cnt:"), F.col("user_id").cast("string")).alias("key"), cmd.alias("cmd"), arg.alias("arg")).where("cmd IS NOT NULL")


def keyspace(table: DataFrame, prefix: str, number: str, value: str) -> DataFrame:
    """A table as live pairs with zero-padded keys, as an op log of one put a row."""
    return table.select(F.format_string(f"{prefix}:%012d", F.col(number).cast("bigint")).alias("key"), F.col(number).cast("bigint").alias("seq"), F.lit(1).cast("tinyint").alias("kind"), F.col(value).cast("string").alias("value"))


def load_ops(spark: SparkSession, n: int, value_bytes: int = 128, start: int = 0) -> DataFrame:
    """The load generator: key:%012d with a deterministic payload."""
    from tidelog.functions.keys import payload

    key = F.format_string("key:%012d", F.col("id"))
    return spark.range(start, start + n).select(key.alias("key"), (F.col("id") + 1).alias("seq"), F.lit(1).cast("tinyint").alias("kind"), payload(key, value_bytes).alias("value"))


def even_keys(spark: SparkSession, n: int) -> DataFrame:
    return load_ops(spark, 2 * n).where(F.col("seq") % 2 == 1)


def churn_ops(spark: SparkSession, keys: int = 2000, rounds: int = 40, value_bytes: int = 512) -> DataFrame:
    """Every key rewritten `rounds` times."""
    from tidelog.functions.keys import payload

    key = F.format_string("key:%012d", F.col("id") % keys)
    return spark.range(keys * rounds).select(key.alias("key"), (F.col("id") + 1).alias("seq"), F.lit(1).cast("tinyint").alias("kind"), payload(F.concat(key, F.lit(":"), F.floor(F.col("id") / keys).cast("string")), value_bytes).alias("value"))


def batch_sweep(ops: DataFrame, size: int) -> DataFrame:
    """Ops cut into batches of one size by sequence number."""
    return ops.withColumn("batch_id", F.floor((F.col("seq") - 1) / size).cast("bigint")).withColumn("batch_pos", ((F.col("seq") - 1) % size).cast("int")).withColumn("batch_size", F.lit(size))


def read_workload(spark: SparkSession, n: int, keys: int, missing: bool = False, seed: int = 7) -> DataFrame:
    """(pos, key): random reads of `keys` keys, or of keys outside their range."""
    pick = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(keys)) + (keys if missing else 0)
    return spark.range(n).select(F.col("id").alias("pos"), F.format_string("key:%012d", pick).alias("key"))


def lossy(rows: DataFrame, rate: float, seed: int, isolated: tuple[str, ...] = (), groups: tuple[tuple[str, ...], ...] = ()) -> DataFrame:
    """Rows that a network losing `rate` of them lets through; the same ones each time.

    Rows with columns source and target are messages: an isolated node neither sends nor gets any, and with groups a message passes
    only within one of them. A row is lost by a digest of its columns as text, null as nothing.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns], F.lit(str(seed)))
    draw = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    kept = rows.where(draw >= int(rate * (1 << 32)))
    if isolated:
        kept = kept.where(~F.col("source").isin(*isolated) & ~F.col("target").isin(*isolated))
    if groups:
        within = F.lit(False)
        for g in groups:
            within = within | (F.col("source").isin(*g) & F.col("target").isin(*g))
        kept = kept.where(within)
    return kept


def sample_raft_log(events: DataFrame, nodes: int = 3) -> DataFrame:
    """A replicated log from events: terms of 500 entries; node k lags by 10 k entries; one entry in 997 differs on the last node."""
    n = F.col("event_id") + 1
    rows = events.select(n.alias("index"), (F.floor(F.col("event_id") / 500) + 1).cast("bigint").alias("term"), F.when(F.col("event_id") % 500 == 0, 1).when(F.col("event_id") % 333 == 0, 2).otherwise(0).cast("tinyint").alias("entry_kind"), F.col("props").alias("body"), F.col("event_id"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))))
    top = events.agg(F.max("event_id")).scalar()
    odd = (F.col("k") == nodes - 1) & (F.col("event_id") % 997 == 13)
    return rows.where(F.col("event_id") <= top - 10 * F.col("k")).select(F.concat(F.lit("n"), F.col("k").cast("string")).alias("node"), "index", "term", "entry_kind", F.when(odd, F.concat("body", F.lit("!"))).otherwise(F.col("body")).alias("command"))


def sample_progress(events: DataFrame) -> DataFrame:
    """(cluster, node, match_index): clusters are event types, five nodes each, by user."""
    node = F.concat(F.lit("n"), (F.col("user_id") % 5).cast("string"))
    return events.groupBy(F.col("event_type").alias("cluster"), node.alias("node")).agg(F.max(F.col("event_id") - F.col("user_id") * 3).alias("match_index")).withColumn("match_index", F.greatest("match_index", F.lit(0)).cast("bigint"))


def sample_metrics(events: DataFrame, step: int = 60) -> DataFrame:
    """Metrics scraped each minute from events: node by user, gauges and counters by event type."""
    ts = F.to_timestamp(F.from_unixtime(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / step) * step))
    return events.select(ts.alias("ts"), F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("node"), "event_type", "value", "event_id")
