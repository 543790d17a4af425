"""Per-key evaluation of write commands, as windows instead of a sequential fold.

Existence after a command depends only on the last command that sets it, so `present_before` is a last-value window;
commands that do not apply drop out; each that replaces the value begins a segment; within a segment
the value is the reset followed by appended suffixes, or plus a running sum in DECIMAL(38, 0). Keys for which the
closed form is not exact (a sum that leaves 64 bits, an increment of text that is no integer, appends
and increments in one segment) go through `fold_exact`, an ordered aggregate of the same commands.

A hot key does not hold one task: windows run over (key, slice of sequence numbers), and the
state at the start of each slice comes from a window over one summary row a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.keys import counter_value
from tidelog.shared import stable

SLICE = 4096
LOW, HIGH = -(1 << 63), (1 << 63) - 1
REPLACING = ("SET", "SETNX", "SETXX", "GETSET")
#: Command log columns: seq, key, cmd (SET, SETNX, SETXX, GETSET, APPEND, INCRBY, DEL, GET), arg string.
OVERFLOW = "ERR increment or decrement would overflow"
NOT_INTEGER = "ERR value is not an integer or out of range"


def _sliced(rows: DataFrame) -> DataFrame:
    """With __slice, once: all steps then share one shuffle by (key, slice)."""
    return rows if "__slice" in rows.columns else rows.withColumn("__slice", F.floor(F.col("seq") / SLICE))


def _carried(rows: DataFrame, value: Column, name: str, default: Column) -> DataFrame:
    within = Window.partitionBy("key", "__slice").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("key").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    rows = _sliced(rows).withColumn("__v", value)
    # One row a key and slice.
    ends = rows.groupBy("key", "__slice").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("seq"))).alias("__end"))
    starts = ends.withColumn("__start", F.last("__end", ignorenulls=True).over(earlier)).drop("__end")
    rows = rows.withColumn(name, F.last("__v", ignorenulls=True).over(within))
    return rows.join(starts, ["key", "__slice"]).withColumn(name, F.coalesce(name, "__start", default)).drop("__v", "__start")


def carried(rows: DataFrame, value: Column, name: str, default: Column) -> DataFrame:
    """Adds the last non-null `value` of earlier rows of the key, in sequence order."""
    return _carried(rows, value, name, default).drop("__slice")


def _summed(rows: DataFrame, value: Column, name: str) -> DataFrame:
    within = Window.partitionBy("key", "__slice").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("key").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    rows = _sliced(rows).withColumn("__v", value)
    parts = rows.groupBy("key", "__slice").agg(F.sum("__v").alias("__part"))
    starts = parts.withColumn("__start", F.coalesce(F.sum("__part").over(earlier), F.lit(0))).drop("__part")
    rows = rows.withColumn(name, F.sum("__v").over(within))
    return rows.join(starts, ["key", "__slice"]).withColumn(name, F.coalesce(F.col(name), F.lit(0)) + F.col("__start")).drop("__v", "__start")


def summed(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the running sum of `value` over the key's rows up to and with this one."""
    return _summed(rows, value, name).drop("__slice")


def valid(commands: DataFrame) -> DataFrame:
    """Commands that can change anything: a counter command needs an integer argument."""
    bad = (F.col("cmd") == "INCRBY") & counter_argument().isNull()
    return commands.where(~F.coalesce(bad, F.lit(False)))


def counter_argument() -> Column:
    return F.when(F.col("arg").isNotNull() & (F.col("arg") != ""), counter_value(F.col("arg")))


def _existence(commands: DataFrame) -> DataFrame:
    effect = F.when(F.col("cmd").isin("SET", "SETNX", "GETSET", "APPEND", "INCRBY"), True).when(F.col("cmd") == "DEL", False)
    rows = _carried(commands, effect, "present_before", F.lit(False))
    applies = F.when(F.col("cmd") == "SETNX", ~F.col("present_before")).when(F.col("cmd") == "SETXX", F.col("present_before")).otherwise(F.col("cmd") != "GET")
    return rows.withColumn("applies", applies)


def existence(commands: DataFrame) -> DataFrame:
    """Adds present_before and applies."""
    return _existence(commands).drop("__slice")


def segments(commands: DataFrame) -> DataFrame:
    """Applied commands with `segment`: the number of replacing or deleting commands of the key so far."""
    rows = _existence(commands).where("applies")
    return _summed(rows, F.col("cmd").isin(*REPLACING, "DEL").cast("bigint"), "segment").drop("__slice")


def needs_exact(rows: DataFrame) -> DataFrame:
    """Keys whose closed form might be wrong."""
    each = rows.groupBy("key", "segment").agg(
        F.count_if(F.col("cmd") == "APPEND").alias("appends"),
        F.count_if(F.col("cmd") == "INCRBY").alias("incrs"),
        F.max(F.when(F.col("cmd").isin(*REPLACING), F.col("arg"))).alias("reset"),
        F.sum(F.when(F.col("cmd") == "INCRBY", F.abs(counter_argument().cast("decimal(38,0)")))).alias("moved"),
    )
    start = counter_value(F.col("reset"))
    unsafe = (F.col("incrs") > 0) & ((F.col("appends") > 0) | start.isNull() | (F.abs(start.cast("decimal(38,0)")) + F.col("moved") > HIGH))
    return each.where(unsafe).select("key").distinct()


def fold_closed(rows: DataFrame) -> DataFrame:
    """Final (key, value) of applied commands with segments; value null where the key ends deleted."""
    last = rows.groupBy("key").agg(F.max("segment").alias("segment"))
    end = rows.join(last, ["key", "segment"])
    # Suffixes of a segment are its value, in order; resets are one row.
    got = end.groupBy("key").agg(
        F.max(F.when(F.col("cmd").isin(*REPLACING), F.col("arg"))).alias("reset"),
        F.max((F.col("cmd") == "DEL").cast("int")).alias("deleted"),
        F.count_if(F.col("cmd") == "APPEND").alias("appends"),
        F.count_if(F.col("cmd") == "INCRBY").alias("incrs"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("cmd") == "APPEND", F.struct("seq", "arg")))), lambda x: x["arg"]), "").alias("suffix"),
        F.sum(F.when(F.col("cmd") == "INCRBY", counter_argument().cast("decimal(38,0)"))).alias("moved"),
    )
    base = F.coalesce("reset", F.lit(""))
    value = (
        F.when(F.col("incrs") > 0, (counter_value(F.col("reset")).cast("decimal(38,0)") + F.col("moved")).cast("string"))
        .when(F.col("appends") > 0, F.concat(base, "suffix"))
        .when(F.col("reset").isNotNull(), F.col("reset"))
    )
    return got.select("key", value.alias("value"))


def fold_exact(commands: DataFrame) -> DataFrame:
    """Final (key, value) by an ordered aggregate over each key's commands, whatever they are."""
    row = F.struct("seq", "cmd", "arg", counter_argument().alias("delta"))
    ordered = commands.where("cmd <> 'GET'").groupBy("key").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def step(state: Column, x: Column) -> Column:
        added = counter_value(state) + F.lit(0)
        total = F.try_add(added, x["delta"])
        return (
            F.when(x["cmd"].isin("SET", "GETSET"), x["arg"])
            .when((x["cmd"] == "SETNX") & state.isNull(), x["arg"])
            .when((x["cmd"] == "SETXX") & state.isNotNull(), x["arg"])
            .when(x["cmd"] == "DEL", F.lit(None).cast("string"))
            .when(x["cmd"] == "APPEND", F.concat(F.coalesce(state, F.lit("")), x["arg"]))
            .when((x["cmd"] == "INCRBY") & total.isNotNull(), total.cast("string"))
            .otherwise(state)
        )

    return ordered.select("key", F.aggregate("rows", F.lit(None).cast("string"), step).alias("value"))


def fold(commands: DataFrame) -> DataFrame:
    """(key, value) of the live keys after all commands."""
    rows = valid(commands)
    applied = stable(segments(rows))  # read three times below
    unsafe = needs_exact(applied)
    exact = fold_exact(rows.join(unsafe, "key", "left_semi"))
    closed = fold_closed(applied.join(unsafe, "key", "left_anti"))
    return closed.unionByName(exact).where(F.col("value").isNotNull())


def setnx_replies(commands: DataFrame) -> DataFrame:
    """(seq, key, reply) of SETNX: 1 where it wrote."""
    return existence(commands).where("cmd = 'SETNX'").select("seq", "key", F.col("applies").cast("bigint").alias("reply"))


def set_xx_replies(commands: DataFrame) -> DataFrame:
    """(seq, key, reply) of SET .. XX: OK or null."""
    return existence(commands).where("cmd = 'SETXX'").select("seq", "key", F.when(F.col("applies"), F.lit("OK")).alias("reply"))


def previous_values(commands: DataFrame) -> DataFrame:
    """(seq, key, reply): the value before each GETSET, for logs of SET, SETNX, SETXX, GETSET and DEL."""
    state = F.when(F.col("cmd") == "DEL", F.struct(F.lit(None).cast("string").alias("v"))).when(F.col("cmd").isin(*REPLACING), F.struct(F.col("arg").alias("v")))
    rows = _existence(commands.where(F.col("cmd").isin(*REPLACING, "DEL"))).where("applies")
    got = _carried(rows, state, "before", F.lit(None).cast("struct<v:string>"))
    return got.where("cmd = 'GETSET'").select("seq", "key", F.col("before.v").alias("reply"))


def append_replies(commands: DataFrame) -> DataFrame:
    """(seq, key, reply): byte length after each APPEND, for logs without counters."""
    rows = segments(commands.where("cmd <> 'INCRBY'"))
    size = F.when(F.col("cmd") == "DEL", 0).otherwise(F.octet_length("arg")).cast("bigint")
    # Lengths run per segment: the key of the running sum is (key, segment).
    part = rows.withColumn("__key", F.col("key")).withColumn("key", F.struct("key", "segment"))
    return summed(part, size, "reply").where("cmd = 'APPEND'").select("seq", F.col("__key").alias("key"), F.col("reply").cast("bigint").alias("reply"))


def counter_replies(commands: DataFrame) -> DataFrame:
    """(seq, key, reply, error) of INCRBY for logs of SET, SETNX, INCRBY and DEL whose segments stay within 64 bits or fail visibly."""
    rows = segments(valid(commands.where("cmd <> 'APPEND'")))
    start = F.when(F.col("cmd").isin(*REPLACING), counter_value(F.col("arg"))).when(F.col("cmd") == "DEL", 0)
    delta = F.when(F.col("cmd") == "INCRBY", counter_argument().cast("decimal(38,0)")).otherwise(F.coalesce(start, F.lit(0)).cast("decimal(38,0)"))
    part = rows.withColumn("__key", F.col("key")).withColumn("key", F.struct("key", "segment"))
    part = part.withColumn("bad", (F.col("cmd").isin(*REPLACING) & start.isNull()).cast("bigint"))
    part = _summed(_summed(part, delta, "total"), F.col("bad"), "broken").where("cmd = 'INCRBY'")
    inside = F.col("total").between(F.lit(LOW).cast("decimal(38,0)"), F.lit(HIGH).cast("decimal(38,0)"))
    error = F.when(F.col("broken") > 0, F.lit(NOT_INTEGER)).when(~inside, F.lit(OVERFLOW))
    return part.select("seq", F.col("__key").alias("key"), F.when(error.isNull(), F.col("total").cast("bigint")).alias("reply"), error.alias("error"))
