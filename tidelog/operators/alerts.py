"""Alert rules over scraped metrics: metrics(ts, node, name, labels, value).

A counter's increase is the sum of its steps, where a fall counts as a restart from 0; windows are not
extrapolated to their edges. A rule with a hold time fires on a row once its condition has held on
every row of that series for that long (gaps and islands). All windows are per series (node, and labels where they matter), so a
task holds one series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series(metrics: DataFrame, name: str) -> DataFrame:
    return metrics.where(F.col("name") == name)


def increase(metrics: DataFrame, name: str, seconds: int, by: tuple[str, ...] = ("node",)) -> DataFrame:
    """(by.., ts, increase): growth of a counter over the `seconds` up to each sample; samples of one time count in the order of their values."""
    rows = series(metrics, name).withColumn("__t", F.col("ts").cast("long"))
    before = F.lag("value").over(Window.partitionBy(*by).orderBy("__t", "value"))
    step = F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    rows = rows.withColumn("__step", step)
    # The step at a window's first sample lies before the window.
    span = Window.partitionBy(*by).orderBy("__t").rangeBetween(-seconds, 0)
    lost = F.min(F.struct("__t", "value", "__step")).over(span)["__step"]
    return rows.select(*by, "ts", (F.sum("__step").over(span) - lost).alias("increase"))


def held(rows: DataFrame, condition: Column, seconds: int, by: tuple[str, ...] = ("node",)) -> DataFrame:
    """(by.., ts): rows on which the condition has been true without a break for `seconds`."""
    each = Window.partitionBy(*by).orderBy("ts") if by else Window.partitionBy(F.lit(0)).orderBy("ts")
    rows = rows.withColumn("__on", F.coalesce(condition, F.lit(False)))
    broken = F.max(F.when(~F.col("__on"), F.col("ts"))).over(each.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__broken", broken)
    islands = Window.partitionBy(*by, "__broken")
    since = F.min(F.when(F.col("__on"), F.col("ts"))).over(islands)
    rows = rows.withColumn("__since", since)
    return rows.where(F.col("__on") & (F.col("ts").cast("long") - F.col("__since").cast("long") >= seconds)).select(*by, "ts")


def quantile(metrics: DataFrame, name: str, q: float, seconds: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., ts, quantile) from bucket counters with a label le, interpolated within a bucket; the open bucket gives its lower bound.

    Each series (node and labels) grows on its own; the growths are summed by le over all of `by`, then the quantile is taken.
    """
    rows = series(metrics, name).withColumn("le", F.when(F.col("labels")["le"] != "+Inf", F.col("labels")["le"].cast("double")).otherwise(float("inf")))
    rows = rows.withColumn("__series", F.to_json(F.array_sort(F.map_entries("labels"))))
    each = ("node", "__series", "le", *(x for x in by if x != "node"))
    grown = increase(rows, name, seconds, each).groupBy(*by, "ts", "le").agg(F.sum("increase").alias("increase"))
    buckets = grown.groupBy(*by, "ts").agg(F.array_sort(F.collect_list(F.struct("le", F.col("increase").alias("n")))).alias("b"))
    total = F.element_at("b", -1)["n"]
    rank = total * q
    at = F.filter(F.transform("b", lambda x, i: F.struct(i.alias("i"), x["le"].alias("le"), x["n"].alias("n"))), lambda x: x["n"] >= rank)[0]
    low = F.when(at["i"] > 0, F.get(F.col("b"), at["i"] - 1)["le"]).otherwise(F.lit(0.0))
    under = F.when(at["i"] > 0, F.get(F.col("b"), at["i"] - 1)["n"]).otherwise(F.lit(0.0))
    value = F.when(at["le"] == float("inf"), low).otherwise(low + (at["le"] - low) * F.coalesce(F.try_divide(rank - under, at["n"] - under), F.lit(0.0)))
    return buckets.where(total > 0).select(*by, "ts", value.alias("quantile"))


def gauge(metrics: DataFrame, name: str) -> DataFrame:
    return series(metrics, name).select("node", "ts", "value")


def over_nodes(metrics: DataFrame, name: str, how) -> DataFrame:
    """(ts, value) over all nodes; scrapes are aligned on ts."""
    return gauge(metrics, name).groupBy("ts").agg(how("value").alias("value"))


def slope(metrics: DataFrame, name: str, seconds: int, by: tuple[str, ...] = ("node",)) -> DataFrame:
    """(by.., ts, slope): least squares over the window, a second."""
    rows = series(metrics, name).withColumn("__t", F.col("ts").cast("long"))
    span = Window.partitionBy(*by).orderBy("__t").rangeBetween(-seconds, 0)
    return rows.select(*by, "ts", F.regr_slope("value", "__t").over(span).alias("slope"))


def down(metrics: DataFrame) -> DataFrame:
    return held(gauge(metrics, "up"), F.col("value") == 0, 30)


def tail_latency_high(metrics: DataFrame) -> DataFrame:
    return held(quantile(metrics, "command_seconds_bucket", 0.99, 300), F.col("quantile") > 0.05, 120, ())


def level0_backlog(metrics: DataFrame) -> DataFrame:
    return held(gauge(metrics, "level0_tables"), F.col("value") > 12, 300)


def block_cache_thrashing(metrics: DataFrame) -> DataFrame:
    return held(gauge(metrics, "block_cache_hit_rate"), F.col("value") < 0.5, 600)


def bloom_ineffective(metrics: DataFrame) -> DataFrame:
    fp = increase(metrics, "bloom_false_positives", 600).withColumnRenamed("increase", "fp")
    neg = increase(metrics, "bloom_negatives", 600).withColumnRenamed("increase", "neg")
    return held(fp.join(neg, ["node", "ts"]), F.col("fp") / F.greatest(F.col("fp") + F.col("neg"), F.lit(0.001)) > 0.05, 600)


def no_leader(metrics: DataFrame) -> DataFrame:
    on = over_nodes(metrics, "raft_enabled", F.max).withColumnRenamed("value", "enabled")
    lead = over_nodes(metrics, "raft_is_leader", F.max).withColumnRenamed("value", "leaders")
    return held(on.join(lead, "ts"), (F.col("enabled") == 1) & (F.col("leaders") == 0), 60, ())


def two_leaders(metrics: DataFrame) -> DataFrame:
    return held(over_nodes(metrics, "raft_is_leader", F.sum), F.col("value") > 1, 30, ())


def term_churn(metrics: DataFrame) -> DataFrame:
    return held(increase(metrics, "raft_elections", 600), F.col("increase") > 10, 600)


def pre_vote_churn(metrics: DataFrame) -> DataFrame:
    return held(increase(metrics, "raft_pre_votes_lost", 600), F.col("increase") > 20, 600)


def membership_stuck(metrics: DataFrame) -> DataFrame:
    return held(over_nodes(metrics, "raft_joint", F.max), F.col("value") == 1, 300, ())


def log_unbounded(metrics: DataFrame) -> DataFrame:
    """Per node: many log entries, and no snapshot in half an hour."""
    size = gauge(metrics, "raft_log_entries")
    shots = increase(metrics, "raft_snapshots", 1800)
    return held(size.join(shots, ["node", "ts"]), (F.col("value") > 50_000) & (F.col("increase") == 0), 900)


def voter_behind(metrics: DataFrame, role: str = "voter") -> DataFrame:
    commit = over_nodes(metrics, "raft_commit_index", F.max).withColumnRenamed("value", "top")
    match = series(metrics, "raft_match_index").where(F.col("labels")["role"] == role).groupBy("ts").agg(F.min("value").alias("low"))
    return held(commit.join(match, "ts"), F.col("top") - F.col("low") > 10_000, 300, ())


def learner_stalled(metrics: DataFrame) -> DataFrame:
    """A learner far behind whose match index does not rise."""
    learners = series(metrics, "raft_match_index").where(F.col("labels")["role"] == "learner")
    commit = over_nodes(metrics, "raft_commit_index", F.max).withColumnRenamed("value", "top")
    rise = slope(learners, "raft_match_index", 900)
    rows = learners.select("node", "ts", "value").join(commit, "ts").join(rise, ["node", "ts"])
    return held(rows, (F.col("top") - F.col("value") > 10_000) & (F.col("slope") <= 0), 900)


def no_compaction(metrics: DataFrame) -> DataFrame:
    """Per node: writes go on, level 0 grows, and no byte is compacted in a quarter of an hour."""
    writes = increase(metrics, "writes", 900).withColumnRenamed("increase", "writes")
    done = increase(metrics, "compacted_bytes", 900).withColumnRenamed("increase", "bytes")
    level = gauge(metrics, "level0_tables")
    return held(writes.join(done, ["node", "ts"]).join(level, ["node", "ts"]), (F.col("writes") / 900 > 100) & (F.col("bytes") == 0) & (F.col("value") > 4), 900)


RULES = {
    "Down": down, "TailLatencyHigh": tail_latency_high, "Level0Backlog": level0_backlog, "BlockCacheThrashing": block_cache_thrashing,
    "BloomFilterIneffective": bloom_ineffective, "NoRaftLeader": no_leader, "TwoRaftLeaders": two_leaders, "RaftTermChurn": term_churn,
    "PreVoteChurn": pre_vote_churn, "MembershipChangeStuck": membership_stuck, "RaftLogUnbounded": log_unbounded,
    "VoterFallingBehind": voter_behind, "LearnerNotCatchingUp": learner_stalled, "NoCompactionProgress": no_compaction,
}
