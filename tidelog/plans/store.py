"""A store on Parquet: appended tables of ops, a manifest a version, compaction and vacuum.

Data is written first, then a manifest under a version number that must not be taken yet: a number is taken by an
exclusive create of its claim, so a lost race fails on any store. A crash leaves files that no manifest names.
A writer holds a lease on its folder until its version is published or given up; vacuum leaves leased folders
alone. Tables hold rows sorted by key and falling sequence, so row-group statistics prune; the manifest's
key span prunes whole tables. Snapshots are pinned by files, for every process that uses the store.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.keys import check_sizes
from tidelog.operators import compaction, reads
from tidelog.operators.views import as_of, current
from tidelog.operators.writes import check_sequence, sequenced
from tidelog.schema import DELETE, PUT, StoreError

SCHEMA = "key binary, seq bigint, kind tinyint, value binary, batch_id bigint, batch_pos int, batch_size int"
#: Ops from which a write is laid out by key range.
SORT_FROM = 100_000
#: Seconds after which a lease or claim counts as left behind by a writer that died.
LEASE_SECONDS = 24 * 3600


@dataclass(frozen=True)
class Table:
    level: int
    file: str
    file_number: int
    file_size: int
    min_key: str  # hex
    max_key: str
    min_seq: int
    max_seq: int
    entry_count: int


@dataclass(frozen=True)
class Version:
    number: int = 0
    last_seq: int = 0
    next_file: int = 1
    tables: tuple[Table, ...] = ()
    stats: dict = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, path: str, auto_compact: bool = False):
        """auto_compact: after each write, levels that are due are compacted."""
        self.spark, self.path, self.auto_compact = spark, path.rstrip("/"), auto_compact
        self.pins: dict[int, str] = {}  # this object's pins, a file each, so equal sequences are pinned apart
        self._next_pin = 0
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.version = self._load()

    def _hadoop(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        at = self._hadoop(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _load(self) -> Version:
        numbers = [int(n[:-5]) for n in self._names("manifest") if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return Version()
        stream = self._fs.open(self._hadoop(f"manifest/{max(numbers)}.json"))
        try:
            data = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Version(**data | {"tables": tuple(Table(**t) for t in data["tables"])})

    def _create(self, name: str) -> bool:
        """An empty file, by the one caller who finds it missing."""
        at = self._hadoop(name)
        self._fs.mkdirs(at.getParent())
        if self._fs.getScheme() == "file":  # Hadoop looks first and creates then
            try:
                os.close(os.open(at.toUri().getPath(), os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        try:
            self._fs.create(at, False).close()
        except Exception as e:  # noqa: BLE001
            if self._fs.exists(at):
                return False
            raise e
        return True

    def _age(self, name: str) -> float:
        at = self._hadoop(name)
        return time.time() - self._fs.getFileStatus(at).getModificationTime() / 1000 if self._fs.exists(at) else 0.0

    def _install(self, new: Version) -> None:
        """Publishes a version: its number is claimed first; the manifest is written under another name, then renamed."""
        claim = f"claims/{new.number}"
        newest = max((int(n[:-5]) for n in self._names("manifest") if n.endswith(".json") and n[:-5].isdigit()), default=0)
        if newest < new.number and self._fs.exists(self._hadoop(claim)) and self._age(claim) > LEASE_SECONDS:
            self._fs.delete(self._hadoop(claim), False)  # of a writer that died before it published
        if newest >= new.number or not self._create(claim):
            raise StoreError(f"version {new.number} was written by someone else")
        temp, final = self._hadoop(f"manifest/{uuid.uuid4().hex}.tmp"), self._hadoop(f"manifest/{new.number}.json")
        try:
            out = self._fs.create(temp, False)
            out.write(json.dumps(asdict(new)).encode())
            out.close()
            if self._fs.exists(final) or not self._fs.rename(temp, final):
                raise StoreError(f"version {new.number} was written by someone else")
        except Exception:
            self._fs.delete(temp, False)
            if not self._fs.exists(final):
                self._fs.delete(self._hadoop(claim), False)
            raise
        self.version = new

    def _publish(self, folders: list[str], new: Version) -> None:
        """Installs a version and ends the leases on what was written for it."""
        try:
            self._install(new)
        finally:
            for folder in folders:
                self._fs.delete(self._hadoop(f"leases/{folder.removeprefix('data/')}"), False)

    # Reading

    def log(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        """The op log of tables that may hold keys of [start, end)."""
        names = [t.file for t in self.version.tables if (start is None or t.max_key >= start.hex()) and (end is None or t.min_key < end.hex())]
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{n}" for n in names])
        return reads.in_range(rows, start, end)

    def _at(self, snapshot: int | None) -> int:
        return self.version.last_seq if snapshot is None else snapshot

    def get(self, key: bytes, snapshot: int | None = None) -> bytes | None:
        rows = reads.get(self.log(key, key + b"\0"), key, self._at(snapshot)).collect()
        return bytes(rows[0]["value"]) if rows else None

    def scan(self, start: bytes | None = None, end: bytes | None = None, snapshot: int | None = None, limit: int | None = None) -> DataFrame:
        return reads.scan(self.log(start, end), start, end, self._at(snapshot), limit)

    def scan_prefix(self, prefix: bytes, snapshot: int | None = None) -> DataFrame:
        from tidelog.functions.keys import prefix_upper_bound

        return self.scan(prefix, prefix_upper_bound(prefix), snapshot)

    def current(self, snapshot: int | None = None) -> DataFrame:
        return as_of(self.log(), self._at(snapshot))

    # Writing

    def write(self, ops: list[tuple[bytes, bytes | None]]) -> int:
        """One atomic batch; the last op on a key wins; an empty batch does nothing. Returns the last sequence number."""
        if not ops:
            return self.version.last_seq
        for key, value in ops:
            check_sizes(key, value)
        first = self.version.last_seq + 1
        check_sequence(self.version.last_seq, len(ops))
        rows = [(bytearray(k), first + i, DELETE if v is None else PUT, None if v is None else bytearray(v), first, i, len(ops)) for i, (k, v) in enumerate(ops)]
        return self._append(self.spark.createDataFrame(rows, SCHEMA).coalesce(1), first + len(ops) - 1)

    def put(self, key: bytes, value: bytes) -> int:
        return self.write([(key, value)])

    def delete(self, key: bytes) -> int:
        return self.write([(key, None)])

    def ingest(self, ops: DataFrame) -> int:
        """Bulk batches (batch_id, batch_pos, batch_size, key, kind, value), numbered after what is there."""
        rows = sequenced(ops, self.version.last_seq).select("key", "seq", "kind", "value", "batch_id", "batch_pos", "batch_size")
        n = ops.count()
        check_sequence(self.version.last_seq, n)
        return self._append(rows, self.version.last_seq + n, n >= SORT_FROM) if n else self.version.last_seq

    def append(self, rows: DataFrame, last_seq: int) -> int:
        """Rows that bring their sequence numbers."""
        return self._append(rows, max(last_seq, self.version.last_seq))

    def replay(self, log: DataFrame) -> int:
        """Recovery: appends the ops of a write-ahead log (key, seq, kind, value, ..) that the store hasn't got yet. Returns the last sequence number."""
        missing = log.where(F.col("seq") > self.version.last_seq)
        top = missing.agg(F.max("seq")).first()[0]
        return self.version.last_seq if top is None else self.append(missing, top)

    def _lay_out(self, rows: DataFrame, files: int | None = None) -> DataFrame:
        """Range partitions, which never part a key, sorted by key and falling sequence."""
        return (rows.repartitionByRange("key") if files is None else rows.repartitionByRange(files, "key")).sortWithinPartitions("key", F.desc("seq"))

    def _append(self, rows: DataFrame, last_seq: int, lay_out: bool = False) -> int:
        v = self.version
        folder, files = self._write(self._lay_out(rows) if lay_out else rows, 0, v.next_file)
        tables = (_merged(files, folder, v.next_file),) if files else ()
        self._publish([folder], replace(v, number=v.number + 1, last_seq=last_seq, next_file=v.next_file + 1, tables=v.tables + tables))
        if self.auto_compact:
            self.maintain()
        return last_seq

    def _write(self, rows: DataFrame, level: int, number: int) -> tuple[str, tuple[Table, ...]]:
        """The folder, leased, and a table for each of its files, in key order."""
        name = f"data/{number:08d}-{uuid.uuid4().hex}"
        self._create(f"leases/{name.removeprefix('data/')}")
        missing = [c.split() for c in SCHEMA.split(", ") if c.split()[0] not in rows.columns]
        rows = rows.withColumns({n: F.lit(None).cast(t) for n, t in missing}) if missing else rows
        rows.select([F.col(c.split()[0]).cast(c.split()[1]) for c in SCHEMA.split(", ")]).write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        written = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{name}")
        each = written.groupBy("_metadata.file_name").agg(F.max("_metadata.file_size"), F.min("key").alias("low"), F.hex(F.max("key")), F.min("seq"), F.max("seq"), F.count("*"))
        files = sorted(each.withColumn("low", F.hex("low")).collect(), key=lambda r: r[2])
        return name, tuple(Table(level, f"{name}/{f}", number + i, size, low.lower(), high.lower(), first, last, n) for i, (f, size, low, high, first, last, n) in enumerate(files))

    def flush_all(self) -> int:
        """A tombstone for every live key. Returns how many."""
        from tidelog.operators.writes import flush_tombstones

        rows = flush_tombstones(self.log(), self.version.last_seq + 1)
        n = reads.dbsize(self.log()).first()["n"]
        if n:
            self._append(rows, self.version.last_seq + n)
        return n

    # Snapshots

    def pin(self) -> tuple[int, int]:
        """(pin, sequence): versions visible at the sequence stay until `unpin`, whoever compacts."""
        self._next_pin += 1
        name = f"pins/{self.version.last_seq}-{uuid.uuid4().hex}"
        self._create(name)
        self.pins[self._next_pin] = name
        return self._next_pin, self.version.last_seq

    def unpin(self, pin: int) -> None:
        name = self.pins.pop(pin, None)
        if name:
            self._fs.delete(self._hadoop(name), False)

    def oldest(self) -> int:
        """The least sequence pinned by any process, or the newest."""
        return min([self.version.last_seq, *(int(n.split("-")[0]) for n in self._names("pins"))])

    # Maintenance

    def compact(self) -> tuple[int, int]:
        """Rewrites all tables into level 1, without versions that no reader can see. Returns bytes before and after."""
        v = self.version
        before = sum(t.file_size for t in v.tables)
        if not v.tables:
            return 0, 0
        self._rewrite(v.tables, 1, None)
        return before, sum(t.file_size for t in self.version.tables)

    def _rewrite(self, inputs: tuple[Table, ...], level: int, deeper: DataFrame | None) -> None:
        """Replaces tables by files of about TARGET_FILE_BYTES at a level."""
        v = self.version
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{t.file}" for t in inputs])
        files = max(1, -(-sum(t.file_size for t in inputs) // compaction.TARGET_FILE_BYTES))
        folder, tables = self._write(self._lay_out(compaction.retained(rows, self.oldest(), deeper), files), level, v.next_file)
        rest = tuple(t for t in v.tables if t not in inputs)
        self._publish([folder], replace(v, number=v.number + 1, next_file=v.next_file + max(1, len(tables)), tables=rest + tables))

    def compact_level(self, **options) -> bool:
        """One job of the planner: a due level's source tables and those they overlap on the next level. False if no level is due."""
        manifest = self.manifest()
        top = compaction.pick_level(manifest, **options).first()
        if top is None:
            return False
        chosen = {r["file"] for r in compaction.job_inputs(manifest, top["level"]).select("file").collect()}
        deeper = manifest.where(F.col("level") > top["level"] + 1).select("min_key", "max_key")
        self._rewrite(tuple(t for t in self.version.tables if t.file in chosen), top["level"] + 1, deeper)
        return True

    def maintain(self, trigger: int = compaction.L0_TRIGGER, passes: int = compaction.MAX_PASSES, **options) -> int:
        """Runs the planner's jobs until no level is due. Returns the number of jobs."""
        for done in range(passes):
            sizes: dict[int, int] = {}
            for t in self.version.tables:
                sizes[t.level] = sizes.get(t.level, 0) + (1 if t.level == 0 else t.file_size)
            base, multiplier = options.get("base", compaction.BASE_BYTES), options.get("multiplier", compaction.MULTIPLIER)
            if not any(n >= (trigger if k == 0 else base * multiplier ** (k - 1)) for k, n in sizes.items()):
                return done  # told without a job
            if not self.compact_level(trigger=trigger, **options):
                return done
        return passes

    def compact_if_stale(self, ratio: float = compaction.STALE_RATIO, minimum: int = compaction.STALE_BYTES) -> bool:
        """Rewrites everything where the stale share calls for it."""
        s = self.stats()
        due = s["data_bytes"] >= minimum and s["stale_ratio"] >= ratio
        if due:
            self.compact()
        return due

    def manifest(self) -> DataFrame:
        rows = [(t.level, t.file, t.file_number, t.file_size, bytearray.fromhex(t.min_key), bytearray.fromhex(t.max_key), t.min_seq, t.max_seq, t.entry_count) for t in self.version.tables]
        from tidelog.schema import MANIFEST

        return self.spark.createDataFrame(rows, MANIFEST)

    def vacuum(self) -> list[str]:
        """Deletes data that no writer holds and the newest manifest doesn't name, and older manifests. Returns the data deleted.

        Data is listed before leases, leases before the manifest: a folder that has lost its lease in between is named by then.
        """
        folders = self._names("data")
        leased = {n for n in self._names("leases") if self._age(f"leases/{n}") <= LEASE_SECONDS}
        newest = self._load()
        named = {t.file for t in newest.tables}
        holding = {"/".join(f.split("/")[:2]) for f in named}
        gone = []
        for name in folders:
            if name in leased:
                continue
            if f"data/{name}" not in holding:
                gone.append(f"data/{name}")
            elif f"data/{name}" not in named:
                gone += [f"data/{name}/{f}" for f in self._names(f"data/{name}") if f.endswith(".parquet") and f"data/{name}/{f}" not in named]
        for name in gone:
            self._fs.delete(self._hadoop(name), True)
        for name in self._names("manifest"):
            if name.endswith(".json") and int(name[:-5]) < newest.number or name.endswith(".tmp") and self._age(f"manifest/{name}") > LEASE_SECONDS:
                self._fs.delete(self._hadoop(f"manifest/{name}"), False)
        for name in self._names("claims"):  # claims outlast their manifests, so that a writer left behind still loses
            if int(name) < newest.number and self._age(f"claims/{name}") > LEASE_SECONDS:
                self._fs.delete(self._hadoop(f"claims/{name}"), False)
        return gone

    def stats(self) -> dict[str, float]:
        live = compaction.live_bytes(current(self.log())).first()[0]
        data = sum(t.file_size for t in self.version.tables)
        return {
            "tables": len(self.version.tables), "level0_tables": sum(t.level == 0 for t in self.version.tables), "entries": sum(t.entry_count for t in self.version.tables),
            "data_bytes": data, "live_bytes": live, "stale_ratio": max(0.0, min(1.0, 1 - live / data)) if data else 0.0, "last_sequence": self.version.last_seq, "live_snapshots": len(self._names("pins")),
        }


def _merged(files: tuple[Table, ...], folder: str, number: int) -> Table:
    """A folder as one table: level 0 counts writes, not files."""
    return Table(
        files[0].level, folder, number, sum(f.file_size for f in files), min(f.min_key for f in files), max(f.max_key for f in files),
        min(f.min_seq for f in files), max(f.max_seq for f in files), sum(f.entry_count for f in files),
    )
