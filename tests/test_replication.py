"""Quorums, logs, votes and alert rules."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import alerts, consensus, metrics


def names(xs):
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


def test_joint_quorums_always_meet(spark):
    sets = [c for n in range(6) for c in itertools.combinations("abcde", n)]
    df = spark.createDataFrame([(i, list(c)) for i, c in enumerate(sets)], "i int, granted array<string>")
    ok = {r["i"] for r in df.where(consensus.has_quorum(F.col("granted"), names("abcde"), names("abc"))).collect()}
    assert ok and all(set(sets[a]) & set(sets[b]) for a in ok for b in ok)
    simple = {r["i"] for r in df.where(consensus.has_quorum(F.col("granted"), names("abc"), names(""))).collect()}
    assert simple == {i for i, c in enumerate(sets) if len(set(c) & set("abc")) >= 2}
    assert df.where(consensus.has_quorum(F.col("granted"), names(""), names(""))).count() == 0


def test_commit_index_against_brute_force(spark):
    rng = random.Random(2)
    cases = [(i, {n: rng.randrange(50) for n in "abcde" if rng.random() < 0.9}, list("abcde")[: rng.randrange(1, 6)], list("cde")[: rng.randrange(4)]) for i in range(60)]
    df = spark.createDataFrame(cases, "i int, m map<string,bigint>, voters array<string>, outgoing array<string>")
    got = {r["i"]: r["c"] for r in df.select("i", consensus.commit_index(F.col("m"), F.col("voters"), F.col("outgoing")).alias("c")).collect()}

    def held(m, of):
        return max(x for x in range(51) if sum(m.get(n, 0) >= x for n in of) * 2 > len(of))

    for i, m, voters, outgoing in cases:
        assert got[i] == min([held(m, voters)] + ([held(m, outgoing)] if outgoing else [])), i


def test_log_matching_stops_at_the_first_term_mismatch(spark):
    rows = [("a", i, 1, 0, "x") for i in range(1, 8)] + [("b", i, 1 if i < 5 else 2, 0, "x") for i in range(1, 8)]
    rows[8] = ("b", 2, 1, 0, "other")
    rows[13] = ("b", 7, 1, 0, "ignored")
    df = spark.createDataFrame(rows, "node string, index bigint, term bigint, entry_kind tinyint, command string")
    assert [tuple(r) for r in consensus.log_matching_violations(df).collect()] == [(2, 1)]


def test_follower_append(spark):
    make = lambda rows: spark.createDataFrame(rows, "index bigint, term bigint")
    local = make([(i, 1) for i in range(1, 6)])
    same = consensus.follower_append(local, make([(3, 1), (4, 1)]), 0)
    assert sorted(map(tuple, same.collect())) == [(i, 1) for i in range(1, 6)]
    cut = consensus.follower_append(local, make([(2, 9), (4, 2), (5, 2)]), 3)
    assert sorted(map(tuple, cut.collect())) == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2)]
    assert [r[0] for r in consensus.append_gaps(make([(1, 1), (2, 1), (5, 2), (6, 2)])).collect()] == [5]


def test_a_snapshot_outranks_the_whole_log(spark, sf, tmp_path):
    from tests.oracle import connect, same
    from tidelog.operators import views
    from tidelog.queries import QUERIES, SQL

    log = spark.createDataFrame([("a", 5, 1, "old"), ("b", 40, 1, "x"), ("c", 50, 0, None), ("d", 45, 1, "y")], "key string, seq bigint, kind tinyint, value string")
    image = spark.createDataFrame([("a", "new"), ("c", "back"), ("d", "y")], "key string, value string")
    for before, first, seq in ((log, 10, 51), (log, 100, 100), (log.limit(0), 10, 10)):
        ops = consensus.replace_by_snapshot(before, image, first)
        assert {r["seq"] for r in ops.collect()} == {seq}
        assert sorted((r["key"], r["value"]) for r in views.current(before.unionByName(ops)).collect()) == [("a", "new"), ("c", "back"), ("d", "y")]
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.withColumn("event_id", F.col("event_id") + 2_000_000).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("snapshot_replaced_state", "snapshot_replace_deletes"):
        same(QUERIES[name](spark, str(tmp_path)), connect(str(tmp_path)), SQL[name])


def test_votes(spark):
    requests = [("v", 1, "a", 1, True), ("v", 2, "b", 1, True), ("v", 3, "a", 1, True), ("v", 4, "b", 2, False), ("v", 5, "c", 2, True), ("v", 6, "a", 1, True)]
    df = spark.createDataFrame(requests, "voter string, seq bigint, candidate string, term bigint, fresh boolean")
    assert [r["granted"] for r in consensus.vote_decisions(df).orderBy("seq").collect()] == [True, False, True, False, True, False]


def scrape(spark, rows):
    """rows: (minute, node, name, value[, labels])"""
    return spark.createDataFrame([(m * 60, n, name, (lab[0] if lab else {}), float(v)) for m, n, name, v, *lab in rows], "t bigint, node string, name string, labels map<string,string>, value double").select(F.timestamp_seconds("t").alias("ts"), "node", "name", "labels", "value")


def minutes(df):
    return sorted(int(r["ts"].timestamp()) // 60 for r in df.select("ts").collect())


GAUGES = [
    ("Level0Backlog", "level0_tables", 13, 12, 5),
    ("BlockCacheThrashing", "block_cache_hit_rate", 0.4, 0.6, 10),
    ("MembershipChangeStuck", "raft_joint", 1, 0, 5),
]


@pytest.mark.parametrize("rule,name,bad,good,hold", GAUGES)
def test_gauge_rules_hold(spark, rule, name, bad, good, hold):
    rows = [(m, "n0", name, good if m in (0, 3, 30) else bad) for m in range(32)]
    assert minutes(alerts.RULES[rule](scrape(spark, rows))) == list(range(4 + hold, 30))


def test_leader_rules(spark):
    rows = [(m, n, "raft_is_leader", v) for m in range(10) for n, v in (("a", m >= 5), ("b", m >= 7))] + [(m, "a", "raft_enabled", 1) for m in range(10)]
    df = scrape(spark, rows)
    assert minutes(alerts.no_leader(df)) == [1, 2, 3, 4] and minutes(alerts.two_leaders(df)) == [8, 9]
    assert minutes(alerts.down(scrape(spark, [(0, "a", "up", 1), (1, "a", "up", 0), (2, "a", "up", 0)]))) == [2]


def test_counter_rules_and_resets(spark):
    rows = [(m, "a", "raft_elections", (m * 3) % 40) for m in range(40)] + [(m, "a", "raft_pre_votes_lost", m // 20) for m in range(40)]
    df = scrape(spark, rows)
    grown = {int(r["ts"].timestamp()) // 60: r["increase"] for r in alerts.increase(df, "raft_elections", 600).collect()}
    values = [r[3] for r in rows[:40]]
    steps = [0] + [b - a if b >= a else b for a, b in zip(values, values[1:])]
    assert grown == {m: float(sum(steps[max(0, m - 10) + 1 : m + 1])) for m in range(40)}
    assert alerts.term_churn(df).count() > 0 and alerts.pre_vote_churn(df).count() == 0


def test_quantile_rule(spark):
    rows = []
    for m in range(12):
        for le, share in (("0.01", 0.5), ("0.1", 0.98), ("1.0", 1.0), ("+Inf", 1.0)):
            rows.append((m, "a", "command_seconds_bucket", 100 * m * share, {"le": le}))
    df = scrape(spark, rows)
    q = {int(r["ts"].timestamp()) // 60: r["quantile"] for r in alerts.quantile(df, "command_seconds_bucket", 0.99, 300).collect()}
    assert q[11] == pytest.approx(0.1 + 0.9 * 0.5) and min(q) == 1
    assert minutes(alerts.tail_latency_high(df)) == list(range(3, 12))


def test_progress_rules(spark):
    rows = []
    for m in range(60):
        rows += [(m, "a", "raft_commit_index", 20_000 + 100 * m), (m, "a", "raft_match_index", 20_000, {"role": "voter"}), (m, "b", "raft_match_index", 50, {"role": "learner"}), (m, "c", "raft_match_index", 50 + 100 * m, {"role": "learner"})]
        rows += [(m, "a", "raft_log_entries", 60_000), (m, "a", "raft_snapshots", m // 50), (m, "a", "writes", 9000 * m), (m, "a", "compacted_bytes", 5), (m, "a", "level0_tables", 6)]
        rows += [(m, "a", "bloom_false_positives", 10 * m), (m, "a", "bloom_negatives", 20 * m)]
    df = scrape(spark, rows)
    assert alerts.voter_behind(df).count() == 0
    assert {r["node"] for r in alerts.learner_stalled(df).collect()} == {"b"}
    assert minutes(alerts.log_unbounded(df))[0] == 15 and 50 not in minutes(alerts.log_unbounded(df))
    assert minutes(alerts.no_compaction(df))[0] >= 15 and alerts.bloom_ineffective(df).count() > 0
    assert len(alerts.RULES) == 14


def test_bloom_rates(spark):
    keys = spark.range(5000).select(F.format_string("present:%08d", "id").alias("key"))
    probes = spark.range(10000).select(F.format_string("absent:%08d", "id").alias("key"), F.lit(False).alias("present"))
    rates = []
    for bits in (6, 10, 16):
        words = metrics.bloom_filter(keys, "key", 5000, bits)
        assert metrics.bloom_probe(keys, "key", words, 5000, bits).where("NOT maybe").count() == 0
        rates.append(metrics.false_positives(metrics.bloom_probe(probes, "key", words, 5000, bits)).first()["rate"])
        assert rates[-1] < max(0.02, 3 * metrics.expected_rate(bits))
    assert rates[0] > 2 * rates[1] > 4 * rates[2]


def test_bloom_hashes_at_the_end_of_64_bits(spark, tmp_path):
    """Twice 377696 as a stored key and one more than twice 1833315 as a probe: their hashes plus five steps exceed 64 bits."""
    from tidelog.queries import QUERIES

    places = metrics._places(F.format_string("key:%012d", "id"), 9_000_000, 6)
    a, b = F.xxhash64(F.format_string("key:%012d", "id")), F.xxhash64(F.format_string("key:%012d", "id"), F.lit(1))
    for r in spark.createDataFrame([(755392,), (3666631,), (1,), (2,)], "id bigint").select(a.alias("a"), b.alias("b"), places.alias("at")).collect():
        assert r["at"] == [(r["a"] + r["b"] % (1 << 40) * i) % 9_000_000 for i in range(6)]
    for name, ids in (("some", [*range(1000), 377696, 1833315]), ("none", [])):
        spark.createDataFrame([(i,) for i in ids], "o_orderkey bigint").write.parquet(f"{tmp_path}/{name}/orders.parquet")
        assert [tuple(r) for r in QUERIES["bloom_measured"](spark, f"{tmp_path}/{name}").collect()] == [(len(ids), True)]


def test_configurations_are_the_entries_of_kind_2(spark, sf, monkeypatch):
    from pyspark.sql import functions as F

    from tidelog import queries

    log = queries.adapters.sample_raft_log
    monkeypatch.setattr(queries.adapters, "sample_raft_log", lambda events: log(events).withColumn("entry_kind", F.lit(2)))
    assert queries._configs(spark, sf).count() == queries._events(spark, sf).count() > 0


def test_samples_of_one_time_do_not_multiply(spark):
    df = scrape(spark, [(0, "a", "raft_elections", 1), (1, "a", "raft_elections", 3), (1, "a", "raft_elections", 4), (2, "a", "raft_elections", 9)])
    got = alerts.increase(df, "raft_elections", 600).collect()
    assert len(got) == 4 and sorted(r["increase"] for r in got)[-1] == 8


def test_figures_of_two_engines(spark):
    rows = spark.createDataFrame([(1.0, 4.0), (0.0, 4.0), (0.0, 0.0), (2.0, 2.0)], "a double, b double")
    low = [r[0] for r in rows.select(metrics.advantage(rows.a, rows.b)).collect()]
    assert low == [4.0, float("inf"), 0.0, 1.0]
    assert [r[0] for r in rows.select(metrics.advantage(rows.a, rows.b, False)).collect()] == [4.0, 0.0, 0.0, 1.0]
    assert metrics.BOUNDS == (0.00005, 0.0001, 0.00025, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
