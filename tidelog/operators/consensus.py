"""Analytics over replicated logs: quorums, commit index, lag, log matching, membership, snapshots, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.views import current
from tidelog.schema import DELETE

COMMAND, NO_OP, CONFIG = 0, 1, 2


def quorum_size(voters: Column) -> Column:
    return (F.floor(F.size(voters) / 2) + 1).cast("int")


def has_quorum(granted: Column, voters: Column, outgoing: Column) -> Column:
    """A majority of the voters, and of the outgoing voters while a change is joint. No voters: no quorum."""

    def majority(of: Column) -> Column:
        return F.size(F.array_intersect(granted, of)) >= quorum_size(of)

    return (F.size(voters) > 0) & majority(voters) & (F.coalesce(F.size(outgoing) == 0, F.lit(True)) | majority(outgoing))


def _held(matches: Column, of: Column) -> Column:
    """The highest index that a majority of `of` holds; matches is a map from node to match index."""
    held = F.sort_array(F.transform(of, lambda n: F.coalesce(matches[n], F.lit(0).cast("bigint"))), asc=False)
    return F.try_element_at(held, quorum_size(of))


def commit_index(matches: Column, voters: Column, outgoing: Column) -> Column:
    """The highest index held by a quorum, both quorums while a change is joint."""
    own = _held(matches, voters)
    return F.when(F.coalesce(F.size(outgoing), F.lit(0)) > 0, F.least(own, _held(matches, outgoing))).otherwise(own)


def committed(progress: DataFrame, configs: DataFrame, log: DataFrame, terms: DataFrame) -> DataFrame:
    """(cluster, commit_index): progress (cluster, node, match_index), configs (cluster, voters, outgoing), log (cluster, index,
    term), terms (cluster, term, commit_index): only an entry of the current term commits, and commits never go back."""
    at = progress.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("node", "match_index"))).alias("m"))
    high = at.join(configs, "cluster").select("cluster", commit_index(F.col("m"), F.col("voters"), F.col("outgoing")).alias("index"))
    fit = high.join(log, ["cluster", "index"]).join(terms.select("cluster", "term"), ["cluster", "term"], "left_semi").select("cluster", F.col("index").alias("new"))
    return terms.join(fit, "cluster", "left").select("cluster", F.greatest("commit_index", F.coalesce("new", "commit_index")).alias("commit_index"))


def replication_lag(progress: DataFrame, last: DataFrame) -> DataFrame:
    """(cluster, node, lag) from progress and last (cluster, last_index)."""
    return progress.join(last, "cluster").select("cluster", "node", F.greatest(F.lit(0).cast("bigint"), F.col("last_index") - F.col("match_index")).alias("lag"))


def needs_snapshot(progress: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(cluster, node, needs_snapshot): the next index lies within the snapshot."""
    return progress.join(snapshots, "cluster").select("cluster", "node", (F.col("next_index") <= F.col("snapshot_index")).alias("needs_snapshot"))


def log_matching_violations(log: DataFrame) -> DataFrame:
    """(index, term) with different entries on nodes, below the first index where the nodes' terms differ.

    Entries are compared by what each (index, term) holds, not node against node, so rows grow with the log alone.
    """
    entry = F.xxhash64("entry_kind", F.to_json("command") if dict(log.dtypes)["command"].startswith("array") else F.col("command"))
    at = log.groupBy("index").agg(F.min("term").alias("t0"), F.max("term").alias("t1"))
    cut = at.where("t0 <> t1").agg(F.min("index").alias("cut"))
    same = log.withColumn("e", entry).groupBy("index", "term").agg(F.min("e").alias("e0"), F.max("e").alias("e1"))
    return same.where("e0 <> e1").where(_before(cut)).select("index", "term")


def _before(cut: DataFrame) -> Column:
    """index below the one value of `cut`, or no value: a scalar subquery."""
    return F.coalesce(F.col("index") < cut.scalar(), F.lit(True))


def follower_append(local: DataFrame, incoming: DataFrame, snapshot_index: int) -> DataFrame:
    """The log after an append: entries within the snapshot are ignored, the first conflicting term cuts the rest, equal entries stay."""
    fresh = incoming.where(F.col("index") > snapshot_index)
    cut = fresh.alias("i").join(local.alias("l"), "index").where("i.term <> l.term").agg(F.min("index").alias("cut"))
    kept = local.where(_before(cut))
    return kept.unionByName(fresh.join(kept.select("index"), "index", "left_anti").select(kept.columns))


def append_gaps(log: DataFrame) -> DataFrame:
    """(index) whose predecessor is missing though lower entries exist: an append after a gap is refused."""
    low = log.agg(F.min("index").alias("low"))
    after = log.select((F.col("index") + 1).alias("index"))
    return log.select("index").join(after, "index", "left_anti").where(F.col("index") > low.scalar())


def latest_config(log: DataFrame, configs: DataFrame, up_to: int | None = None) -> DataFrame:
    """The configuration in force: that of the last configuration entry, committed or not. configs has index."""
    entries = log.where(F.col("entry_kind") == CONFIG).select("index")
    if up_to is not None:
        entries = entries.where(F.col("index") <= up_to)
    last = entries.agg(F.max("index").alias("index"))
    return configs.join(F.broadcast(last), "index")


def members(config: DataFrame) -> DataFrame:
    """All servers of configurations, each once."""
    return config.select("index", F.explode(F.array_distinct(F.concat("voters", "outgoing", "learners"))).alias("node"))


def invalid_configs(config: DataFrame) -> DataFrame:
    """Configurations with a node that is voter and learner, or without voters."""
    return config.where((F.size(F.array_intersect("voters", "learners")) > 0) | (F.size("voters") == 0))


def departed(old: Column, new: Column) -> Column:
    return F.array_except(old, new)


def joint_complete(configs: DataFrame, commit: int) -> DataFrame:
    """Joint configurations that are committed, so that the change may be finished."""
    return configs.where((F.size("outgoing") > 0) & (F.col("index") <= commit))


def may_campaign(configs: DataFrame, node: str) -> DataFrame:
    return configs.select("index", F.array_contains(F.array_union("voters", "outgoing"), node).alias("may_campaign"))


def up_to_date(last_term: Column, last_index: Column, own_term: Column, own_index: Column) -> Column:
    """A candidate's log is at least as new as the voter's."""
    return (last_term > own_term) | ((last_term == own_term) & (last_index >= own_index))


def log_matches(probes: DataFrame, log: DataFrame, snapshot_index: int = 0, snapshot_term: int = 0) -> DataFrame:
    """probes (index, term) with `matches`; index 0 always does, the snapshot's end by its term, anything below it not."""
    held = log.select("index", F.col("term").alias("__term"))
    found = probes.join(held, "index", "left")
    at = F.when(F.col("index") == 0, True).when(F.col("index") == snapshot_index, F.col("term") == snapshot_term).when(F.col("index") < snapshot_index, False)
    return found.select("index", "term", F.coalesce(at, F.col("__term") == F.col("term"), F.lit(False)).alias("matches"))


def vote_decisions(requests: DataFrame) -> DataFrame:
    """(voter, seq, granted) over requests (voter, seq, candidate, term, fresh): a voter's term is the highest seen; in a term it
    votes for the first candidate whose log is fresh, again for the same one, and for no other; an old term is refused."""
    order = Window.partitionBy("voter").orderBy("seq")
    seen = F.max("term").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = requests.withColumn("current", F.col("term") == seen)
    term = Window.partitionBy("voter", "term").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.when(F.col("current") & F.col("fresh"), F.col("candidate")), ignorenulls=True).over(term)
    return rows.select("voter", "seq", F.coalesce(F.col("current") & F.col("fresh") & (first == F.col("candidate")), F.lit(False)).alias("granted"))


def pre_vote(requests: DataFrame) -> DataFrame:
    """(seq, granted): refused for a stale term, a live leader or an older log; nothing changes."""
    return requests.select("seq", ((F.col("term") >= F.col("own_term")) & ~F.col("leader_alive") & F.col("fresh")).alias("granted"))


def chunk_errors(chunks: DataFrame) -> DataFrame:
    """(transfer, offset) of chunks that don't begin where the last ended; offset 0 restarts."""
    before = F.lag(F.col("offset") + F.col("length")).over(Window.partitionBy("transfer").orderBy("seq"))
    return chunks.withColumn("__end", before).where((F.col("offset") != 0) & (F.coalesce(F.col("__end"), F.lit(0)) != F.col("offset"))).select("transfer", "seq", "offset")


def replace_by_snapshot(log: DataFrame, image: DataFrame, first_seq: int) -> DataFrame:
    """Ops that turn the store into the image (key, value): puts of all pairs, tombstones for keys it lacks. Their sequence number
    is first_seq, or the one after the log's last if that is higher, so that no version of the log hides them."""
    seq = F.greatest(F.lit(first_seq).cast("bigint"), log.agg(F.max("seq") + 1).scalar())
    gone = current(log).select("key").join(image.select("key"), "key", "left_anti")
    puts = image.select("key", F.lit(1).cast("tinyint").alias("kind"), "value")
    ops = puts.unionByName(gone.select("key", F.lit(DELETE).cast("tinyint").alias("kind"), F.lit(None).cast(image.schema["value"].dataType).alias("value")))
    return ops.select("key", seq.alias("seq"), "kind", "value")


def applied_prefix(log: DataFrame, applied: int, commit: int) -> DataFrame:
    """Entries to apply now: after `applied`, up to the commit index."""
    return log.where((F.col("index") > applied) & (F.col("index") <= commit))


def ops_of_entries(log: DataFrame, first_seq_of_index) -> DataFrame:
    """The key-value ops of command entries, numbered within their entry."""
    rows = log.where(F.col("entry_kind") == COMMAND).select("index", F.posexplode("command").alias("pos", "op"))
    return rows.select("index", "pos", "op.key", (first_seq_of_index(F.col("index")) + F.col("pos")).alias("seq"), "op.kind", "op.value")


def discard_prefix(log: DataFrame, snapshot_index: int) -> DataFrame:
    return log.where(F.col("index") > snapshot_index)


def snapshot_due(stats: DataFrame, entries: int = 10_000, size: int = 64 * 1024 * 1024) -> DataFrame:
    """Adds snapshot_due: log entries or bytes beyond their thresholds."""
    return stats.withColumn("snapshot_due", (F.col("log_entries") >= entries) | (F.col("log_bytes") >= size))
