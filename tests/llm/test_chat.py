from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from tests.oracle import connect, same
from tidelog.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, slice int, parts string"


def read_back(df):
    made = chat.format_chat(df)
    rows = made.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    return {r["conv_id"]: (r["formatted"], [(t["role"], t["text"]) for t in r["turns"]], r["loss"]) for r in rows}


def expected(rows):
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, chat_role(r[2]), r[3] or "")
    for c in {r[0] for r in rows}:
        out[c] = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
    return out


def chat_role(x):
    return x or ""


def test_round_trip_with_control_strings(spark):
    rng = random.Random(1)
    bits = ["\\", "###", "### ", "#", "</turn>", "<next/>", "</turn>\n", "<", "assistant:\n", ":", "\n", "\\1", "é🙂", "", "text ", "\\0"]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "sys:tem\n", ""]), "".join(rng.choice(bits) for _ in range(rng.randrange(6))), 1, "x") for c in range(60) for t in range(rng.randrange(1, 12))]
    got = read_back(spark.createDataFrame(rows, SCHEMA))
    for c, want in expected(rows).items():
        assert got[c][1] == want
        assert got[c][2] == "".join(t for r, t in want if r == "assistant")


def test_nulls_ties_repeats_and_long_conversations(spark):
    rows = [(None, 1, "user", "of no conversation", 0, ""), (1, None, "user", "first", 0, ""), (1, 2, None, None, 0, ""), (1, 2, "assistant", None, 0, ""), (1, 2, "assistant", None, 0, ""), (2, 0, "assistant", "a" * 200_000, 0, "")]
    rows += [(3, t, "assistant" if t % 3 else "user", f"t{t}", 0, "") for t in range(500)]
    got = read_back(spark.createDataFrame(rows, SCHEMA))
    assert {c: v[1] for c, v in got.items()} == expected(rows)
    assert got[2][2] == "a" * 200_000 and got[3][2] == "".join(f"t{t}" for t in range(500) if t % 3)


def test_adjacent_turns_are_merged_across_slices(spark):
    rows = [(1, t, "user", str(t), 0, "") for t in range(3 * chat.SLICE)]
    formatted = read_back(spark.createDataFrame(rows, SCHEMA))[1][0]
    assert formatted.count(chat.OPEN) == 1 and formatted.count(chat.NEXT) == 3 * chat.SLICE - 1 and formatted.endswith(chat.CLOSE)


def test_empty(spark):
    assert chat.format_chat(spark.createDataFrame([], SCHEMA)).count() == 0


def test_main_path_is_native(spark, sf):
    plan = chat.op2_chat_format(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_query_equals_sql(spark, sf):
    same(chat.op2_chat_format(spark, sf), connect(sf), chat.OP2_SQL)


def test_extra_conversation(spark, sf):
    row = chat.op2_chat_format(spark, sf).where("conv_id = -7").first()
    said = "\\### Assistant: </turn> ok"
    assert row["n_turns"] == 2 and row["loss_chars"] == len(said) and row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_many_rows_of_one_turn_take_linear_time(spark):
    import time

    n = 30_000
    df = spark.range(n).selectExpr("1 AS conv_id", "CAST(NULL AS bigint) AS turn", "CASE WHEN id % 3 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('t', id) AS text")
    began = time.perf_counter()
    row = chat.format_chat(df).selectExpr("length(formatted) AS n", "size(loss_mask) AS m").first()
    assert row["m"] == n - n // 3 and time.perf_counter() - began < 20
