"""The store on Parquet, the command facade, binary formats, wire text and streams."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import consensus
from tidelog.operators.views import current
from tidelog.plans.cluster import Cluster, Config
from tidelog.plans.facade import COMMANDS, Session, command_specs
from tidelog.plans.store import Store
from tidelog.schema import CorruptRecord, StoreError, TooLarge
from tidelog.sources import adapters, formats, wire
from tidelog.streaming import state


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def pairs(df):
    return [(bytes(r["key"]), bytes(r["value"])) for r in df.collect()]


def test_write_read_reopen(spark, store):
    assert store.get(b"a") is None and store.scan().count() == 0
    store.write([(b"a", b"1"), (b"b", b""), (b"a", b"2")])
    store.delete(b"absent")
    assert store.get(b"a") == b"2" and store.get(b"b") == b""
    again = Store(spark, store.path)
    assert again.version == store.version and again.get(b"a") == b"2"
    assert pairs(again.scan()) == [(b"a", b"2"), (b"b", b"")]
    assert pairs(again.scan(b"b")) == [(b"b", b"")] and pairs(again.scan(None, b"b")) == [(b"a", b"2")]
    assert store.write([]) == store.version.last_seq == 4
    with pytest.raises(TooLarge):
        store.put(b"", b"x")


def test_prefix_scan_with_awkward_prefixes(store):
    store.write([(k, b"v") for k in (b"user:1", b"user:2", b"user:10", b"usera", b"\xff\xff", b"\xff\xffa", b"p\x7f1", b"p\x80")])
    assert [k for k, _ in pairs(store.scan_prefix(b"user:"))] == [b"user:1", b"user:10", b"user:2"]
    assert [k for k, _ in pairs(store.scan_prefix(b"\xff"))] == [b"\xff\xff", b"\xff\xffa"]
    assert [k for k, _ in pairs(store.scan_prefix(b"p\x7f"))] == [b"p\x7f1"]


def test_snapshots_compaction_and_vacuum(store):
    store.write([(b"k%d" % i, b"old") for i in range(20)])
    pin, seq = store.pin()
    store.write([(b"k%d" % i, b"new") for i in range(20)])
    store.write([(b"k5", None), (b"fresh", b"x")])
    before, after = store.compact()
    assert before > 0 and after > 0 and len(store.version.tables) == 1
    assert store.get(b"k5", seq) == b"old" and store.get(b"k5") is None and store.get(b"fresh", seq) is None
    assert store.scan(snapshot=seq).count() == 20 and store.scan().count() == 20
    assert store.version.tables[0].entry_count == 42
    store.unpin(pin)
    store.compact()
    assert store.version.tables[0].entry_count == 20
    assert len(store.vacuum()) == 4 and store.scan().count() == 20
    assert store.vacuum() == []


def test_two_pins_on_one_sequence(store):
    store.put(b"a", b"1")
    one, two = store.pin()[0], store.pin()[0]
    store.unpin(one)
    store.put(b"a", b"2")
    assert store.oldest() == 1
    store.unpin(two)
    assert store.oldest() == 2


def test_a_lost_race_fails(spark, store):
    store.put(b"a", b"1")
    other = Store(spark, store.path)
    store.put(b"a", b"2")
    with pytest.raises(StoreError):
        other.put(b"a", b"3")
    assert Store(spark, store.path).get(b"a") == b"2"


def test_bulk_ingest_prunes_tables(spark, store):
    ops = adapters.batch_sweep(adapters.load_ops(spark, 500, 40), 10).drop("seq").withColumn("key", F.encode("key", "UTF-8")).withColumn("value", F.encode("value", "UTF-8"))
    assert store.ingest(ops) == 500
    store.put(b"zzz", b"1")
    assert store.get(b"key:%012d" % 77).startswith(b"key:%012d|abc" % 77)
    assert len(store.log(b"zz").inputFiles()) == 1
    assert store.maintain(trigger=2) == 1 and store.stats()["level0_tables"] == 0
    assert store.flush_all() == 501 and store.scan().count() == 0
    store.compact()
    assert store.version.tables == ()


def test_commands(store):
    do = Session(store).execute
    assert do(["SET", "k", "first", "XX"]) is None and do(["SET", "k", "first", "NX"]) == ("+", "OK")
    assert do(["SET", "k", "second", "NX"]) is None and do(["set", "k", "second", "XX", "GET"]) == b"first"
    assert do(["SET", "k", "v", "EX", "10"])[1].startswith("ERR expiry is not supported") and do(["GET", "k"]) == b"second"
    assert do(["SET", "k", "v", "NX", "XX"]) == ("-", "ERR syntax error")
    assert do(["MSET", "a", "1", "b", "2", "a", "3"]) == ("+", "OK") and do(["MSET", "a"])[1].startswith("ERR wrong number")
    assert do(["MGET", "a", "nope", "b", "a"]) == [b"3", None, b"2", b"3"]
    assert do(["EXISTS", "a", "a", "nope"]) == 2 and do(["DEL", "a", "a", "nope"]) == 2 and do(["TYPE", "a"]) == ("+", "none")
    assert do(["APPEND", "t", "hello"]) == 5 and do(["APPEND", "t", "é"]) == 7 and do(["STRLEN", "t"]) == 7
    assert do(["INCR", "n"]) == 1 and do(["INCRBY", "n", "41"]) == 42 and do(["DECR", "n"]) == 41 and do(["DECRBY", "n", "40"]) == 1
    assert do(["INCR", "t"]) == ("-", "ERR value is not an integer or out of range")
    do(["SET", "n", str(2**63 - 1)])
    assert do(["INCR", "n"]) == ("-", "ERR increment or decrement would overflow")
    assert do(["GETSET", "g", "1"]) is None and do(["GETSET", "g", "2"]) == b"1" and do(["SETNX", "g", "3"]) == 0
    assert do(["NOPE", "x"]) == ("-", "ERR unknown command 'NOPE', with 1 arg(s)")
    assert do(["GET"]) == ("-", "ERR wrong number of arguments for 'get' command")
    assert do(["SELECT", "1"]) == ("-", "ERR DB index is out of range") and do(["PING"]) == ("+", "PONG") and do(["ECHO", "x"]) == b"x"
    assert do(["CONFIG", "GET", "max*"]) == [b"maxmemory", b"0", b"maxmemory-policy", b"noeviction"] and len(do(["CONFIG", "GET"])) == 16
    assert do(["CONFIG", "SET", "a", "b"]) == ("-", "ERR CONFIG SET is not supported; configuration is fixed at startup")
    assert do(["CONFIG", "nope"]) == ("-", "ERR Unknown CONFIG subcommand 'nope'")
    assert do(["SCAN", "0", "COUNT", "x"]) == do(["SCAN", "0", "COUNT", "0"]) == ("-", "ERR syntax error")
    assert do(["COMMAND", "COUNT"]) == len(COMMANDS) == 35
    assert b"keyspace_hits" in do(["INFO", "stats"]) and b"# Engine" not in do(["INFO", "stats"])
    assert do(["COMPACT"])[0] == "+" and do(["SAVE"]) == ("+", "OK")


def test_keys_scan_and_sizes(store):
    do = Session(store).execute
    store.write([(k.encode(), b"v") for k in ("user:1", "user:2", "user:10", "usera", "order:1", "ka", "kb", "kz", "kaa")] + [(b"key:%02d" % i, b"v") for i in range(30)])
    assert do(["KEYS", "user:*"]) == [b"user:1", b"user:10", b"user:2"] and do(["KEYS", "k[a-b]"]) == [b"ka", b"kb"]
    cursor, seen = b"0", []
    while True:
        cursor, found = do(["SCAN", cursor, "MATCH", "key:*", "COUNT", "7"])
        seen += found
        if cursor == b"0":
            break
    assert seen == [b"key:%02d" % i for i in range(30)]
    do(["DEL", "ka"])
    assert do(["DBSIZE", "EXACT"]) == 38 and do(["DBSIZE"]) >= 38
    assert do(["FLUSHDB"]) == ("+", "OK") and do(["DBSIZE", "EXACT"]) == 0


def test_vacuum_spares_what_a_writer_holds(spark, store):
    """A writer has written its data but not published yet; another vacuums; nothing is lost."""
    store.put(b"a", b"1")
    writer = Store(spark, store.path)
    folder, files = writer._write(spark.createDataFrame([(bytearray(b"b"), 2, 1, bytearray(b"2"), 2, 0, 1)], "key binary, seq bigint, kind tinyint, value binary, batch_id bigint, batch_pos int, batch_size int"), 0, 2)
    assert store.vacuum() == []
    version = writer.version
    writer._publish([folder], type(version)(version.number + 1, 2, 3, version.tables + files))
    assert dict(pairs(Store(spark, store.path).scan())) == {b"a": b"1", b"b": b"2"}
    # A writer left behind loses even after vacuum has dropped the manifest that took its number.
    with pytest.raises(StoreError):
        store.put(b"c", b"3")
    fresh = Store(spark, store.path)
    fresh.put(b"d", b"4")
    fresh.vacuum()
    with pytest.raises(StoreError):
        store.put(b"c", b"3")
    assert len(fresh.vacuum()) == 1 and dict(pairs(Store(spark, store.path).scan())) == {b"a": b"1", b"b": b"2", b"d": b"4"}
    assert fresh._names("leases") == []


def test_vacuum_drops_what_a_dead_writer_left(spark, store, monkeypatch):
    store.put(b"a", b"1")
    store._write(store.log(), 0, 9)
    assert store.vacuum() == []
    monkeypatch.setattr("tidelog.plans.store.LEASE_SECONDS", -1)
    assert len(store.vacuum()) == 1 and store.get(b"a") == b"1"


def test_pins_hold_for_other_processes(spark, store):
    store.put(b"a", b"1")
    pin, seq = store.pin()
    other = Store(spark, store.path)
    other.put(b"a", b"2")
    other.compact()
    assert other.get(b"a", seq) == b"1"
    store.unpin(pin)
    other.compact()
    assert other.get(b"a", seq) is None and other.get(b"a") == b"2"


def test_levels_are_compacted_by_the_planner(spark, store, monkeypatch):
    monkeypatch.setattr("tidelog.operators.compaction.TARGET_FILE_BYTES", 4096)
    rng = random.Random(9)
    model = {}
    for _ in range(6):
        ops = [(b"k%04d" % rng.randrange(400), None if rng.random() < 0.2 else rng.randbytes(60)) for _ in range(150)]
        store.write(ops)
        for k, v in ops:
            model[k] = v
        store.maintain(trigger=2, base=6000, multiplier=3)
    live = {k: v for k, v in model.items() if v is not None}
    assert dict(pairs(store.scan())) == live
    deep = [t for t in store.version.tables if t.level > 0]
    assert len(deep) > 2 and max(t.level for t in deep) >= 2
    for level in {t.level for t in deep}:  # files of a level are disjoint, cut between keys
        spans = sorted((t.min_key, t.max_key) for t in deep if t.level == level)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    before = len(deep)
    store.vacuum()
    assert dict(pairs(Store(spark, store.path).scan())) == live and len(store.log(b"k0000", b"k0001").inputFiles()) < before
    store.compact()
    assert dict(pairs(store.scan())) == live and all(t.level == 1 for t in store.version.tables)


def test_a_tombstone_stays_while_a_deeper_table_covers_it(spark, store):
    store.write([(b"a", b"old"), (b"z", b"1")])
    assert store.compact_level(trigger=1) and store.compact_level(trigger=1, base=1)
    assert {t.level for t in store.version.tables} == {2}
    store.delete(b"a")
    assert store.compact_level(trigger=1)
    assert store.get(b"a") is None and {t.level: t.entry_count for t in store.version.tables} == {1: 1, 2: 2}
    assert not store.compact_level(trigger=4)
    store.compact()
    assert [t.entry_count for t in store.version.tables] == [1] and store.get(b"a") is None


def test_writes_can_compact(spark, store):
    eager = Store(spark, store.path, auto_compact=True)
    for i in range(5):
        eager.put(b"k", b"%d" % i)
    assert sum(t.level == 0 for t in eager.version.tables) < 4 and eager.get(b"k") == b"4"
    assert not eager.compact_if_stale() and eager.compact_if_stale(0.0, 0)


def test_keys_and_scan_read_what_the_pattern_allows(store):
    do = Session(store).execute
    store.write([(b"a:%d" % i, b"v") for i in range(5)])
    store.write([(b"b:%d" % i, b"v") for i in range(5)])
    assert do(["KEYS", "a:*"]) == [b"a:%d" % i for i in range(5)] and do(["KEYS", "b:[2-3]"]) == [b"b:2", b"b:3"]
    rows = Session(store)._live_keys("a:*")
    assert len(rows.inputFiles()) == 1 and "value" not in rows._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert do(["SCAN", "a:3", "MATCH", "a:*", "COUNT", "9"]) == [b"0", [b"a:4"]] and do(["SCAN", "a:3", "MATCH", "b:*", "COUNT", "1"]) == [b"b:0", [b"b:0"]]
    assert do(["SCAN", "b:9", "MATCH", "a:*"]) == [b"0", []]


def test_login(store):
    s = Session(store, "secret")
    assert s.execute(["GET", "a"]) == ("-", "NOAUTH Authentication required.") and s.execute(["PING"]) == ("+", "PONG")
    assert s.execute(["AUTH", "wrong"])[0] == "-" and s.execute(["AUTH", "secret"]) == ("+", "OK") and s.execute(["GET", "a"]) is None


def test_cluster_commands(spark, store):
    cluster = Cluster("a", [(1, Config(("a", "b")))], {"a": 5, "b": 3}, 2, "a")
    do = Session(store, cluster=cluster).execute
    assert do(["CLUSTER", "MYID"]) == b"a" and do(["CLUSTER", "PEERS"]) == [[b"b", 3]] and b"voters:2" in do(["CLUSTER", "INFO"])
    assert do(["CLUSTER", "ADDLEARNER", "c"]) == ("+", "OK") and do(["CLUSTER", "NODES"]) == [b"a voter", b"b voter", b"c learner"]
    assert do(["CLUSTER", "PROMOTE", "c"]) == ("+", "OK") and cluster.config == Config(("a", "b", "c"), ("a", "b"))
    assert do(["CLUSTER", "REMOVENODE", "b"]) == ("-", "ERR a membership change is under way")
    cluster.change(cluster.config.finished())
    assert do(["CLUSTER", "REMOVENODE", "b"]) == ("+", "OK") and cluster.config.voters == ("a", "c")
    assert cluster.configurations(spark).count() == 5 and consensus.invalid_configs(cluster.configurations(spark)).count() == 0
    cluster.leader = "b"
    assert do(["CLUSTER", "ADDNODE", "d"])[1].startswith("NOTLEADER the leader is b")
    assert Session(store, cluster=cluster).health() == (200, "ok") and "tables: 0" in Session(store).stats_text()
    with pytest.raises(StoreError):
        Config(("a",), (), ("a",))


def test_command_specs(spark):
    assert command_specs(spark).count() == 35


def random_batches(seed):
    rng = random.Random(seed)
    return [[(rng.randbytes(rng.randrange(1, 20)), None if rng.random() < 0.3 else rng.randbytes(rng.randrange(300))) for _ in range(rng.randrange(1, 6))] for _ in range(30)]


def test_wal_round_trip_and_every_cut():
    batches, data, seq = random_batches(1), b"", 1
    want = []
    for b in batches:
        data += formats.wal_record(seq, b)
        want += [(seq + i, k, v) for i, (k, v) in enumerate(b)]
        seq += len(b)
    assert [x[:3] for x in formats.wal_ops(data)] == want
    for cut in range(0, len(data), 97):
        got = list(formats.wal_ops(data[:cut]))
        assert [x[:3] for x in got] == want[: len(got)] and all(g[4] == i for g, i in zip(got, [x[4] for x in formats.wal_ops(data)]))


def test_record_log_torn_batches_and_flipped_bits():
    data = formats.record_header() + b"".join(formats.record(b"key:%03d" % i, b"value-%d" % i) for i in range(8))
    want = {b"key:%03d" % i: b"value-%d" % i for i in range(8)}
    assert {k: v for _, k, v, *_ in formats.record_ops(data)} == want
    assert len(list(formats.record_ops(data[:-4]))) == 7
    for i in range(8, len(data)):
        bad = bytearray(data)
        bad[i] ^= 1
        try:
            for _, k, v, *_ in formats.record_ops(bytes(bad)):
                assert want.get(k) == v
        except CorruptRecord:
            pass
    torn = formats.record_header() + formats.record(b"a", b"1") + formats.record(b"b", b"2", True) + formats.record(b"c", None, True)
    assert [k for _, k, *_ in formats.record_ops(torn)] == [b"a"]
    assert [(k, v, i, n) for _, k, v, _, i, n in formats.record_ops(torn + formats.record(b"d", b"4"))][1:] == [(b"b", b"2", 0, 3), (b"c", None, 1, 3), (b"d", b"4", 2, 3)]
    with pytest.raises(CorruptRecord):
        list(formats.record_ops(b"XXXX\x01\0\0\0"))


def test_commands_images_and_configs():
    for b in random_batches(3):
        assert formats.decode_command(formats.encode_command(b)) == b
    with pytest.raises(CorruptRecord):
        formats.decode_command(formats.encode_command([(b"a", b"b")])[:-1])
    image = formats.encode_image([(b"a", b""), (b"b", b"2")])
    assert list(formats.image_pairs(image)) == [(b"a", b""), (b"b", b"2")]
    with pytest.raises(CorruptRecord):
        list(formats.image_pairs(image[:-3]))
    for c in ((["a", "é"], [], ["l"]), (["a"], ["b", "c"], [])):
        assert formats.decode_config(formats.encode_config(*c)) == c
    assert formats.decode_config(formats.encode_config(["a"], [], ["lost"], version=1)) == (["a"], [], [])
    for n in (0, 127, 128, 2**56 - 1):
        assert formats.get_varint(formats.put_varint(n), 0) == (n, len(formats.put_varint(n)))


def test_replicated_logs_and_snapshots(spark, tmp_path):
    log = formats.raft_log_header(4, 2) + b"".join(formats.raft_entry(i, 2 + i // 7, i % 3, b"c%d" % i) for i in range(5, 9))
    want = [(i, 2 + i // 7, i % 3, b"c%d" % i) for i in range(5, 9)]
    assert list(formats.raft_entries(log)) == want and list(formats.raft_entries(log[:-1])) == want[:-1]
    for i in range(24, len(log)):
        bad = bytearray(log)
        bad[i] ^= 1
        got = list(formats.raft_entries(bytes(bad)))
        assert got == want[: len(got)] and len(got) < 4
    assert list(formats.raft_entries(formats.raft_log_header() + formats.raft_entry(2, 1, 0, b""))) == []
    with pytest.raises(CorruptRecord):
        list(formats.raft_entries(b"XXXX" + log[4:]))
    config, image = formats.encode_config(["a"], [], []), formats.encode_image([(b"k", b"v")])
    shot = formats.encode_snapshot(9, 3, config, image)
    assert formats.decode_snapshot(shot) == (9, 3, config, image)
    for i in [*range(40), *range(40 + len(config), len(shot))]:
        bad = bytearray(shot)
        bad[i] ^= 1
        with pytest.raises(CorruptRecord):
            formats.decode_snapshot(bytes(bad))
    (tmp_path / "1.raft").write_bytes(log)
    (tmp_path / "s.bin").write_bytes(shot)
    assert [r["index"] for r in formats.read_raft_log(spark, f"{tmp_path}/*.raft").orderBy("index").collect()] == [5, 6, 7, 8]
    assert [(r["index"], r["term"], bytes(r["key"])) for r in formats.read_snapshot(spark, f"{tmp_path}/s.bin").collect()] == [(9, 3, b"k")]


def test_binary_logs_as_dataframes(spark, tmp_path):
    (tmp_path / "1.wal").write_bytes(formats.wal_record(1, [(b"a", b"1"), (b"b", b"2")]) + formats.wal_record(3, [(b"a", None)]) + b"torn")
    log = formats.read_wal(spark, f"{tmp_path}/*.wal")
    assert [(bytes(r["key"]), bytes(r["value"])) for r in current(log).collect()] == [(b"b", b"2")]
    (tmp_path / "1.data").write_bytes(formats.record_header() + formats.record(b"x", b"y"))
    assert formats.read_records(spark, f"{tmp_path}/*.data").first()["seq"] == 1
    (tmp_path / "s.image").write_bytes(formats.encode_image([(b"k", b"v")]))
    assert formats.read_image(spark, f"{tmp_path}/*.image").count() == 1


def test_a_store_recovers_from_its_logs(spark, store, tmp_path):
    """Logs in number order, the last one torn; what the manifest already holds isn't applied again."""
    (tmp_path / "1.wal").write_bytes(formats.wal_record(1, [(b"a", b"1"), (b"b", b"2")]))
    assert store.replay(formats.read_wal(spark, f"{tmp_path}/*.wal")) == 2
    (tmp_path / "2.wal").write_bytes(formats.wal_record(3, [(b"a", None), (b"c", b"3")]) + formats.wal_record(5, [(b"d", b"4")])[:-2])
    assert store.replay(formats.read_wal(spark, f"{tmp_path}/*.wal")) == 4
    assert store.replay(formats.read_wal(spark, f"{tmp_path}/*.wal")) == 4
    again = Store(spark, store.path)
    assert dict(pairs(again.scan())) == {b"b": b"2", b"c": b"3"} and again.log().count() == 4


def test_wire():
    data = b"*2\r\n$3\r\nGET\r\n$1\r\nk\r\nPING  x\r\n*1\r\n$4\r\nPI"
    args, at = wire.parse_request(data)
    assert args == [b"GET", b"k"]
    args, at = wire.parse_request(data, at)
    assert args == [b"PING", b"x"] and wire.parse_request(data, at) is None
    for bad in (b"*x\r\n", b"*1\r\n:3\r\n", b"*1\r\n$-1\r\n", b"*9999999\r\n"):
        with pytest.raises(wire.ProtocolError):
            wire.parse_request(bad)
    assert wire.write_reply([1, None, b"a", ("+", "OK"), ("-", "ERR x")]) == b"*5\r\n:1\r\n$-1\r\n$1\r\na\r\n+OK\r\n-ERR x\r\n"


def test_stream_into_store_applies_once(spark, sf, tmp_path, store):
    rows = adapters.op_log(adapters.read(spark, sf, "events")).select("key", "seq", "kind", "value")
    for lo, hi in ((0, 300), (300, 1001)):
        rows.where(f"seq > {lo} AND seq <= {hi}").select(F.encode("key", "UTF-8").alias("key"), "seq", "kind", F.encode("value", "UTF-8").alias("value")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        entries = state.source(spark, f"{tmp_path}/in", "key binary, seq bigint, kind tinyint, value binary", 1)
        state.apply_to_store(store, entries, f"{tmp_path}/checkpoint")
    assert store.log().count() == rows.count()
    want = {r["key"].encode(): r["value"].encode() for r in current(rows).collect()}
    assert dict(pairs(store.current())) == want
    store.version.stats["stream_batch"] = 10**6
    state.apply_log(state.source(spark, f"{tmp_path}/in", "key binary, seq bigint, kind tinyint, value binary"), f"{tmp_path}/checkpoint2", lambda *_: pytest.fail("applied twice"), lambda: 10**6)


def test_late_ops_do_not_revive_a_key(spark, tmp_path):
    schema = "key string, seq bigint, kind tinyint, value string"
    for part in ([("a", 5, 0, None), ("b", 1, 1, "x")], [("a", 3, 1, "late"), ("b", 2, 1, "y")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = state.newest_versions(state.source(spark, f"{tmp_path}/in", schema))
        state.to_memory(stream, "newest_late", f"{tmp_path}/checkpoint")
    assert {(r["key"], r["kind"], r["value"]) for r in spark.table("newest_late").collect()} == {("a", 0, None), ("b", 1, "y")}
