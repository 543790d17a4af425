from __future__ import annotations

import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import glob, keys
from tidelog.plans.facade import _python_regex
from tidelog.schema import TooLarge


@given(st.binary(max_size=6), st.binary(max_size=8))
def test_prefix_bound_excludes_just_the_prefixed(prefix, key):
    bound = keys.prefix_upper_bound(prefix)
    if bound is None:
        assert set(prefix) <= {0xFF}
    inside = key >= prefix and (bound is None or key < bound)
    assert inside == key.startswith(prefix)


def test_sizes():
    keys.check_sizes(b"k", b"")
    for bad in (b"", b"x" * 65537):
        with pytest.raises(TooLarge):
            keys.check_sizes(bad, b"")
    with pytest.raises(TooLarge):
        keys.check_sizes(b"k", b"x" * (64 * 1024 * 1024 + 1))


def test_require_sizes_fails_the_job(spark):
    ok = spark.createDataFrame([("k", "v")], "key string, value string")
    assert keys.require_sizes(ok).count() == 1
    with pytest.raises(Exception, match="out of limits"):
        keys.require_sizes(spark.createDataFrame([("", "v")], "key string, value string")).collect()


def test_integers(spark):
    rows = [(" +5 ", 5), ("-7", -7), ("5.7", None), ("1e3", None), ("", None), ("0x1", None), ("1,000", None), ("9223372036854775807", 2**63 - 1), ("9223372036854775808", None), ("5d", None), (None, None)]
    df = spark.createDataFrame([(a,) for a, _ in rows], "t string")
    assert [r[0] for r in df.select(keys.parse_integer(F.col("t"))).collect()] == [b for _, b in rows]
    assert df.limit(0).select(keys.counter_value(F.col("t"))).count() == 0
    assert spark.createDataFrame([("",), (None,)], "t string").select(keys.counter_value(F.col("t"))).collect() == [(0,), (0,)]


def test_text_and_payload(spark):
    row = spark.range(1).select(keys.to_text(F.lit(b"a\xff")).alias("t"), keys.payload(F.lit("key:1"), 12).alias("p"), keys.humanised(F.lit(3 * 1024**3)).alias("h")).first()
    assert row["t"] == "a�" and row["p"] == "key:1|abcdef" and row["h"] == "3.00 GiB"


def model(pattern: str, text: str) -> bool:
    """Matching by definition, with backtracking."""

    def items(p):
        i = 0
        while i < len(p):
            c = p[i]
            i += 1
            if c == "*":
                yield "*", None
            elif c == "?":
                yield "?", None
            elif c == "[":
                negated = p[i : i + 1] == "^"
                i += negated
                body = []
                while i < len(p) and p[i] != "]":
                    escaped = p[i] == "\\" and i + 1 < len(p)
                    i += escaped
                    body.append((p[i], escaped))
                    i += 1
                i += 1
                spans, k = [], 0
                while k < len(body):
                    if k + 2 < len(body) and body[k + 1] == ("-", False) and not body[k + 2][1]:
                        spans.append((body[k][0], body[k + 2][0]))
                        k += 3
                    else:
                        spans.append((body[k][0], body[k][0]))
                        k += 1
                yield "[", (negated, spans)
            elif c == "\\" and i < len(p):
                yield "=", p[i]
                i += 1
            else:
                yield "=", c

    parts = list(items(pattern))

    def fits(i, j):
        if i == len(parts):
            return j == len(text)
        kind, x = parts[i]
        if kind == "*":
            return any(fits(i + 1, k) for k in range(j, len(text) + 1))
        if j == len(text):
            return False
        c = text[j]
        if kind == "=" and c != x:
            return False
        if kind == "[":
            negated, spans = x
            if any(min(a, b) <= c <= max(a, b) for a, b in spans) == negated:
                return False
        return fits(i + 1, j + 1)

    return fits(0, 0)


def test_glob_against_model():
    rng = random.Random(5)
    hits = 0
    for _ in range(4000):
        p = "".join(rng.choice("ab*?[]^-\\x&.") for _ in range(rng.randrange(7)))
        t = "".join(rng.choice("ab-^]\\x&.\n") for _ in range(rng.randrange(5)))
        want = model(p, t)
        hits += want
        assert bool(re.compile(_python_regex(p)).fullmatch(t)) == want, (p, t)
        assert not want or t.startswith(glob.literal_prefix(p))
    assert hits > 100


def test_glob_in_spark(spark):
    texts = ["user:1", "user:2", "user:10", "usera", "order:1", "a\nb", "*", "é", "🙂", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in ["user:*", "u?er:1", "*[0-9]", "a?b", "\\*", "?", "", "*", "[^u]*", "user:[2-1]", "user:1"]:
        got = [r["t"] for r in df.where(glob.matches(F.col("t"), p)).collect()]
        assert got == [t for t in texts if model(p, t)], p


def test_glob_prefix_reaches_the_scan(spark, sf):
    plan = spark.read.parquet(f"{sf}/pages.parquet").where(glob.matches(F.col("url"), "http://[a-c]*"))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(url,http://)" in plan
