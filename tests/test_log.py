"""Views, reads, folds, writes and compaction against a dictionary model."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import compaction, fold, reads, views, writes

LOG = "key string, seq bigint, kind tinyint, value string"


def key(n: int) -> str:
    return [f"user:{n}", f"user:{n}:profile", f"ключ:{n}", f"キー:{n}", "k" + "x" * (n % 40), f"a/b/c/{n}", str(n)][n % 7]


def history(seed: int, n: int = 1500, keys: int = 120):
    rng = random.Random(seed)
    return [(key(rng.randrange(keys)), i + 1, 0, None) if rng.random() < 0.3 else (key(rng.randrange(keys)), i + 1, 1, "v" * rng.randrange(5) + str(i)) for i in range(n)]


def state(ops, top=None):
    live = {}
    for k, s, kind, v in ops:
        if top is None or s <= top:
            live.pop(k, None)
            if kind:
                live[k] = v
    return live


@pytest.mark.parametrize("seed", [1, 2, 42])
def test_views_equal_the_model(spark, seed):
    ops = history(seed)
    log = spark.createDataFrame(random.Random(0).sample(ops, len(ops)), LOG)
    assert {r["key"]: r["value"] for r in views.current(log).collect()} == state(ops)
    assert {r["key"]: r["value"] for r in views.as_of(log, 700).collect()} == state(ops, 700)
    assert [r["key"] for r in reads.scan(log).collect()] == sorted(state(ops), key=str.encode)
    low, high = "a", "user:5"
    assert [r["key"] for r in reads.scan(log, low, high, limit=9).collect()] == sorted((k for k in state(ops) if low.encode() <= k.encode() < high.encode()), key=str.encode)[:9]
    assert {r["key"] for r in reads.scan_prefix(log, "user:1").collect()} == {k for k in state(ops) if k.startswith("user:1")}
    assert reads.dbsize(log).first()[0] == len(state(ops)) and reads.dbsize_bound(log).first()[0] == len(ops)


def test_as_of_many(spark):
    ops = history(7, 600, 30)
    log = spark.createDataFrame(ops, LOG)
    rng = random.Random(1)
    probes = [(i, key(rng.randrange(40)), rng.randrange(700)) for i in range(200)]
    got = {r["pos"]: r["value"] for r in views.as_of_many(spark.createDataFrame(probes, "pos int, key string, snapshot bigint"), log).collect()}
    assert got == {i: state(ops, s).get(k) for i, k, s in probes}


def test_pages_visit_each_key_once(spark):
    live = spark.createDataFrame([(f"key:{i:04d}",) for i in random.Random(3).sample(range(500), 500)], "key string")
    rows = sorted((r["page"], r["pos"], r["key"]) for r in reads.pages(live, 37).collect())
    assert [k for _, _, k in rows] == [f"key:{i:04d}" for i in range(500)]
    seen, cursor = [], None
    while True:
        cursor, found = reads.scan_page(live, cursor, "key:00*", 40)
        seen += found
        if cursor is None:
            break
    assert seen == [f"key:00{i:02d}" for i in range(100)]


def test_empty_log(spark):
    log = spark.createDataFrame([], LOG)
    assert views.current(log).count() == 0 and reads.scan(log).count() == 0 and reads.dbsize(log).first()[0] == 0
    assert reads.pages(views.current(log), 5).count() == 0
    assert compaction.retained(log, 5).count() == 0


@pytest.mark.parametrize("oldest", [1, 400, 10_000])
def test_compaction_keeps_every_visible_state(spark, oldest):
    ops = history(11)
    log = spark.createDataFrame(ops, LOG)
    kept = [tuple(r) for r in compaction.retained(log, oldest).select("key", "seq", "kind", "value").orderBy("seq").collect()]
    for top in (oldest, oldest + 1, 900, 1400, 10**6):
        if top >= oldest:
            assert state(kept, top) == state(ops, top)
    assert oldest < 10_000 or len(kept) == len(state(ops))


def run(commands):
    """Final values and replies, one command after another."""
    store, replies = {}, {}
    for seq, k, cmd, arg in commands:
        old = store.get(k)
        if cmd == "SET" or cmd == "GETSET" or cmd == "SETNX" and old is None or cmd == "SETXX" and old is not None:
            store[k] = arg
        elif cmd == "APPEND":
            store[k] = (old or "") + arg
        elif cmd == "DEL":
            store.pop(k, None)
        elif cmd == "INCRBY":
            try:
                n, d = int(old or 0), int(arg)
                if -(2**63) <= n < 2**63 and -(2**63) <= d < 2**63 and -(2**63) <= n + d < 2**63:
                    store[k] = str(n + d)
            except ValueError:
                pass
        replies[seq] = {"SETNX": int(old is None), "SETXX": "OK" if old is not None else None, "GETSET": old, "APPEND": len((store.get(k) or "").encode())}.get(cmd)
    return store, replies


@pytest.fixture
def short_slices(monkeypatch):
    monkeypatch.setattr(fold, "SLICE", 16)


def commands(seed, kinds, args, n=1200, keys=25):
    rng = random.Random(seed)
    return [(i + 1, f"k{rng.randrange(keys)}", c := rng.choice(kinds), None if c == "DEL" else rng.choice(args(c, i))) for i in range(n)]


def test_folds_equal_a_sequential_run(spark, short_slices):
    rows = commands(1, ["SET", "SETNX", "SETXX", "GETSET", "APPEND", "DEL"], lambda c, i: [f"e{i}é", ""])
    df = spark.createDataFrame(rows, "seq bigint, key string, cmd string, arg string")
    want, replies = run(rows)
    assert {r["key"]: r["value"] for r in fold.fold(df).collect()} == want
    assert {r["key"]: r["value"] for r in fold.fold_exact(df).where("value IS NOT NULL").collect()} == want
    for f, cmd in ((fold.setnx_replies, "SETNX"), (fold.set_xx_replies, "SETXX"), (fold.append_replies, "APPEND")):
        assert {r["seq"]: r["reply"] for r in f(df).collect()} == {s: replies[s] for s, _, c, _ in rows if c == cmd}
    plain = [r for r in rows if r[2] != "APPEND"]
    replies = run(plain)[1]
    got = fold.previous_values(spark.createDataFrame(plain, "seq bigint, key string, cmd string, arg string"))
    assert {r["seq"]: r["reply"] for r in got.collect()} == {s: replies[s] for s, _, c, _ in plain if c == "GETSET"}


def test_counter_folds_with_overflow_and_text(spark, short_slices):
    top = str(2**63 - 5)
    args = lambda c, i: ["3", "-2", " 7 "] if c == "INCRBY" else ["10", "", "none", top]
    rows = commands(4, ["INCRBY", "INCRBY", "INCRBY", "SET", "DEL"], args)
    df = spark.createDataFrame(rows, "seq bigint, key string, cmd string, arg string")
    assert {r["key"]: r["value"] for r in fold.fold(df).collect()} == run(rows)[0]


def test_mixed_segments_take_the_exact_path(spark):
    rows = [(1, "a", "SET", "1"), (2, "a", "APPEND", "2"), (3, "a", "INCRBY", "5"), (4, "b", "INCRBY", "x"), (5, "b", "APPEND", "q")]
    df = spark.createDataFrame(rows, "seq bigint, key string, cmd string, arg string")
    assert {r["key"]: r["value"] for r in fold.fold(df).collect()} == {"a": "17", "b": "q"}


def test_batches(spark):
    ops = [(b, p, 3, f"k{p}", 1, f"{b}.{p}") for b in range(5) for p in range(3 if b < 4 else 2)]
    df = spark.createDataFrame(ops, "batch_id bigint, batch_pos int, batch_size int, key string, kind tinyint, value string")
    numbered = writes.sequenced(df, 10)
    assert sorted((r["seq"], r["batch_id"], r["batch_pos"]) for r in numbered.collect()) == [(11 + i, b, p) for i, (b, p, *_) in enumerate(ops)]
    whole = writes.complete_batches(numbered)
    assert {r["batch_id"] for r in whole.collect()} == {0, 1, 2, 3}
    assert writes.last_of_batch(numbered).count() == 14
    commits = writes.group_commit(df, max_batches=2, max_ops=100).select("batch_id", "commit_id").distinct().collect()
    assert len({str(r["commit_id"]) for r in commits}) == 3


def test_planner(spark):
    manifest = spark.createDataFrame([(0, "a", 1, 10, "a", "m"), (0, "b", 2, 10, "b", "n"), (0, "c", 3, 10, "c", "o"), (0, "d", 4, 10, "d", "p"), (1, "e", 5, 10, "n", "z"), (1, "f", 6, 10, "x", "z")], "level int, file string, file_number bigint, file_size bigint, min_key string, max_key string").withColumn("entry_count", F.lit(1).cast("bigint"))
    assert compaction.pick_level(manifest, trigger=3).first()["level"] == 0
    assert compaction.pick_level(manifest.where("file_number < 3")).count() == 0
    job = {(r["role"], r["file"]) for r in compaction.job_inputs(manifest, 0).collect()}
    assert job == {("source", x) for x in "abcd"} | {("target", "e")}
    targets = {r["level"]: r["target"] for r in compaction.level_targets(spark.createDataFrame([(1,), (2,), (3,), (40,)], "level int"), 1000).collect()}
    assert targets == {1: 1000, 2: 10_000, 3: 100_000, 40: 2**63 - 1}
    tombs = compaction.droppable_tombstones(spark.createDataFrame([("y", 5, 0, None), ("a", 6, 0, None), ("c", 9, 0, None)], LOG), 7, manifest.where("level = 1"))
    assert [r["key"] for r in tombs.collect()] == ["a"]
