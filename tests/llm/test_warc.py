from __future__ import annotations

import gzip
import hashlib
import io
import random

from pyspark.sql import functions as F

from tests.oracle import connect, same
from tidelog.llm import warc
from tidelog.llm.common import Scratch

SCHEMA = "page_id bigint, url string, html string, payload string, sha1 string, refers_to string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    scratch = Scratch(spark, "warc-test")
    made = scratch.write(warc.write_archives(warc.chunk_rows(warc.record_plan(df.repartition(3))), scratch.path("archives")), "manifest")
    return made, warc.read_archives(made)


def pages():
    rng = random.Random(1)
    big = "é" * 700_000
    rows = [(i, f"http://h/{i}", "".join(rng.choice("ab\r\n é") for _ in range(rng.choice([0, 5, 999, 1000, 3000])))) for i in range(40)]
    rows += [(50 + i, "http://c\r\nX: y", "copy " * 300) for i in range(6)] + [(60, None, None), (61, "", ""), (62, "u", "short"), (63, "u", "short"), (64, "u", big), (65, "u", big), (66, "u", "WARC/1.1\r\n\r\n" * 100)]
    return rows


def test_round_trip(spark):
    rows = pages()
    made, chunks = run(spark, rows)
    got = {}
    for r in chunks.orderBy("page_id", "chunk").collect():
        got.setdefault(r["page_id"], []).append(r)
        assert len(r["data"]) <= warc.CHUNK
    top = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            top[h] = max(top.get(h, 0), i)
    for i, _, h in rows:
        parts, data = got[i], (h or "").encode()
        whole = b"".join(bytes(p["data"]) for p in parts)
        to = top.get(h)
        assert [p["chunk"] for p in parts] == list(range(len(parts))) and [p["last"] for p in parts] == [False] * (len(parts) - 1) + [True]
        assert parts[-1]["header_digest"] == hashlib.sha1(data).hexdigest()
        if to is None or to == i:
            assert (whole, parts[-1]["digest"], parts[-1]["record_type"], parts[-1]["refers_to"]) == (data, hashlib.sha1(data).hexdigest(), "response", None)
        else:
            assert (whole, parts[-1]["record_type"], parts[-1]["refers_to"], parts[-1]["header_length"]) == (b"", "revisit", to, len(data))
    assert len(got[65]) > 1 and made.agg(F.sum("records")).first()[0] == len(rows)


def test_archives_are_gzip_members_of_warc_records(spark):
    made, _ = run(spark, [(1, "http://a", "x" * 10)])
    data = open(made.first()["path"].removeprefix("file://"), "rb").read()
    text = gzip.decompress(data).decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith("x" * 10 + "\r\n\r\n") and "WARC-Target-URI: http://a\r\n" in text
    records = list(warc.read_records(io.BytesIO(data)))
    assert len(records) == 1 and records[0][2] == b"x" * 10 and records[0][5]


def test_repeated_rows_and_null_ids(spark):
    long = "z" * 1500
    _, chunks = run(spark, [(1, "u", long), (1, "u", long), (2, "u", long), (2, "u", long), (None, "u", long), (None, "u", "only" * 500), (None, "u", "only" * 500)])
    rows = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in chunks.where("last").collect())
    assert rows == [("1", "revisit", "2")] * 2 + [("2", "response", "None")] * 2 + [("None", "response", "None")] * 2 + [("None", "revisit", "2")]


def test_empty(spark):
    made, chunks = run(spark, [])
    assert made.count() == 0 and chunks.count() == 0


def test_query_equals_sql(spark, sf):
    same(warc.op6_warc(spark, sf), connect(sf), warc.OP6_SQL)


def test_archives_roll(spark, tmp_path):
    """Small archives, large records: nothing is lost, and no record is parted."""
    rows = [(i, f"http://a/{i}", f"{i} " * (150_000 if i == 7 else 900), "x") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, record string").coalesce(2)
    made = Scratch(spark, "warc").write(warc.write_archives(warc.chunk_rows(warc.record_plan(df)), f"file://{tmp_path}/archives", roll=500), "manifest")
    assert made.count() > 8 and made.agg({"records": "sum"}).first()[0] == 40
    got = {r["page_id"]: (r["length"], r["digest"]) for r in warc.read_archives(made, with_data=False).where("last").collect()}
    assert got == {i: (len(h.encode()), hashlib.sha1(h.encode()).hexdigest()) for i, _, h, _ in rows}
