"""Chat formatting by relational means: sorted turn structs, merged neighbours, concatenation. Spark expressions only.

Template: a block of adjacent turns of one role is `### role:\\n` + texts parted by `<next/>` +
`</turn>\\n`. Control strings inside roles and texts are escaped with backslash codes (ESCAPES), so the
output can be read back exactly, merged turns included.

A conversation is first gathered in slices of SLICE turn numbers, so that a very long one is sorted
and merged by many tasks; then its slices, already arrays of merged blocks, are stitched. All steps are linear in a
slice's rows but the sort, so many rows of one turn number, or without any, are no worse.

Defined results: rows are ordered by turn (null first), then role, then text; repeated rows stay, as
turns of their own; null role or text is empty; a null conv_id is a conversation; an
empty table gives no rows; other columns are ignored. Only role `assistant` bears loss.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import let, table

SLICE = 64
OPEN, ROLE_END, NEXT, CLOSE = "### ", ":\n", "<next/>", "</turn>\n"
#: In the order of escaping; unescaping goes backwards.
ESCAPES = [("\\", "\\0"), ("###", "\\1"), ("</turn>", "\\2"), ("<next/>", "\\3")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\4")]


def escape(text: Column, codes=ESCAPES) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), codes, text)


def unescape(text: Column, codes=ESCAPES) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[1]), F.lit(x[0])), codes[::-1], text)


def _blocks(turns: Column) -> Column:
    """Merges adjacent turns of one role: array<struct<role, texts>>. Each block is cut out between two places where the role changes."""

    def cut(t: Column) -> Column:
        opens = F.filter(F.transform(t, lambda x, i: F.when((i == 0) | (F.get(t, i - 1)["role"] != x["role"]), i)), lambda i: i.isNotNull())

        def block(starts: Column) -> Column:
            end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(t))
            return F.transform(starts, lambda at, k: F.struct(F.get(t, at)["role"].alias("role"), F.transform(F.slice(t, at + 1, end(k) - at), lambda x: x["text"]).alias("texts")))

        return let(opens, block)

    return let(turns, cut)


def format_chat(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask): loss_mask lists, for each turn that bears loss, its index among the
    turns and the code points from `start` to `end` of that turn's part of `formatted`. A part runs from
    one block's opening or `<next/>` to the next such place."""
    rows = conversations.select(
        "conv_id",
        F.floor(F.col("turn") / SLICE).alias("slice"),
        F.struct(
            F.col("turn").alias("turn"),
            escape(F.coalesce(F.col("role").cast("string"), F.lit("")), ROLE_ESCAPES).alias("role"),
            escape(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
        ).alias("row"),
    )
    slices = rows.groupBy("conv_id", "slice").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    slices = slices.select("conv_id", F.struct("slice", _blocks(F.col("turns")).alias("blocks")).alias("part"))
    whole = slices.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("part.slice").alias("slice"), F.col("part.blocks").alias("blocks")))).alias("parts"))
    blocks = F.flatten(F.transform("parts", lambda p: p["blocks"]))

    def stitch(all_blocks: Column) -> Column:
        """Each turn as struct<head, text, tail, loss>; blocks of one role on both sides of a slice's end become one."""

        def one(block: Column, i: Column) -> Column:
            first = (i == 0) | (F.get(all_blocks, i - 1)["role"] != block["role"])
            last = (i == F.size(all_blocks) - 1) | (F.get(all_blocks, i + 1)["role"] != block["role"])
            head = F.concat(F.lit(OPEN), block["role"], F.lit(ROLE_END))
            return F.transform(
                block["texts"],
                lambda text, j: F.struct(
                    F.when(first & (j == 0), head).otherwise(F.lit(NEXT)).alias("head"),
                    text.alias("text"),
                    F.when(last & (j == F.size(block["texts"]) - 1), F.lit(CLOSE)).otherwise(F.lit("")).alias("tail"),
                    (block["role"] == "assistant").alias("loss"),
                ),
            )

        return F.flatten(F.transform(all_blocks, one))

    turns = let(blocks, stitch)
    made = whole.select(
        "conv_id",
        let(
            turns,
            lambda t: F.struct(
                F.array_join(F.transform(t, lambda x: F.concat(x["head"], x["text"], x["tail"])), "").alias("formatted"),
                F.filter(
                    F.transform(t, lambda x, i: F.when(x["loss"], F.struct(i.alias("part"), F.length(x["head"]).alias("start"), (F.length(x["head"]) + F.length(x["text"])).alias("end")))),
                    lambda x: x.isNotNull(),
                ).alias("loss_mask"),
            ),
        ).alias("made"),
    )
    return made.select("conv_id", "made.formatted", "made.loss_mask")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, "</turn>\\n"), lambda b: b != "")

    def block_turns(block: Column) -> Column:
        body = F.substring(block, F.lit(len(OPEN) + 1), F.length(block))
        role = F.substring_index(body, ROLE_END, 1)
        texts = F.split(F.substring(body, F.length(role) + len(ROLE_END) + 1, F.length(body)), "<next/>")
        return F.transform(texts, lambda t: F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, block_turns))


def read_loss(formatted: Column, loss_mask: Column) -> Column:
    """The text under the loss mask, unescaped."""

    def under(parts: Column) -> Column:
        return F.array_join(F.transform(loss_mask, lambda m: unescape(F.substring(F.get(parts, m["part"]), m["start"] + 1, m["end"] - m["start"]))), "")

    return let(F.split(formatted, "(?=### |<next/>)"), under)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    made = format_chat(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    read = made.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(plain, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\0'), '###', '\1'), '</turn>', '\2'), '<next/>', '\3') AS safe,
    replace(replace(replace(replace(replace(role, '\', '\0'), '###', '\1'), '</turn>', '\2'), '<next/>', '\3'), ':', '\4') AS safe_role,
    lag(role) OVER o IS DISTINCT FROM role AS opens, lead(role) OVER o IS DISTINCT FROM role AS closes
  FROM rows WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(safe) + CASE WHEN opens THEN 6 + length(safe_role) ELSE 7 END + CASE WHEN closes THEN 8 ELSE 0 END)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
