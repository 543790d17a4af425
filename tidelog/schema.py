"""Declared schemas. Nothing is inferred."""

from __future__ import annotations

DELETE, PUT = 0, 1

OP_LOG = "key binary, seq bigint, kind tinyint, value binary, batch_id bigint, batch_pos int, batch_size int"
COMMAND_LOG = "seq bigint, key binary, cmd string, argv array<binary>"
MANIFEST = "level int, file string, file_number bigint, file_size bigint, min_key binary, max_key binary, min_seq bigint, max_seq bigint, entry_count bigint"
RAFT_LOG = "node string, index bigint, term bigint, entry_kind tinyint, command array<struct<kind:tinyint,key:binary,value:binary>>"
CONFIGURATION = "index bigint, voters array<string>, outgoing array<string>, learners array<string>"
METRICS = "ts timestamp, node string, name string, labels map<string,string>, value double"

#: Limits that are part of behaviour (fixed values).
MAX_KEY_BYTES = 64 * 1024
MAX_VALUE_BYTES = 64 * 1024 * 1024
MAX_SEQUENCE = (1 << 56) - 1
SCAN_COUNT, SCAN_CAP = 10, 10_000
MAX_BATCH_OPS = 1_000_000


class StoreError(Exception):
    """Any failure of the store."""


class CorruptRecord(StoreError):
    def __init__(self, message: str, file: str = "", offset: int = -1):
        super().__init__(f"{message} ({file}:{offset})")
        self.file, self.offset = file, offset


class TooLarge(StoreError):
    """A key or value beyond its limit, or an empty key."""


class NotLeader(StoreError):
    def __init__(self, leader: str | None):
        super().__init__(f"NOTLEADER the leader is {leader or 'unknown'}")
        self.leader = leader
