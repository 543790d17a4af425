"""Statistics: ratios, histograms, nearest-rank percentiles, Bloom figures, exposition text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the latency histogram in seconds (fixed values).
BOUNDS = (0.00005, 0.0001, 0.00025, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def ratio(part: Column, rest: Column) -> Column:
    """part / (part + rest), 0 where both are 0."""
    return F.coalesce(F.try_divide(part.cast("double"), (part + rest).cast("double")), F.lit(0.0))


def histogram(samples: DataFrame, value: str, by: list[str] | None = None, bounds=BOUNDS) -> DataFrame:
    """(by.., le, n): cumulative counts; le is null for the bucket without a bound. One pass; the rows are bounded by the bounds."""
    by = by or []
    counts = samples.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("b_all"), F.sum(value).alias("total"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit(None).cast("double").alias("le"), F.col("b_all").alias("n"))]
    return counts.select(*by, F.explode(F.array(*pairs)).alias("x")).select(*by, "x.le", "x.n")


def percentiles(samples: DataFrame, value: str, by: list[str] | None = None, at=(0.5, 0.95, 0.99, 0.999)) -> DataFrame:
    """Nearest rank, no interpolation: the ceil(p * n)-th smallest."""
    names = [f"p{p * 100:g}".replace(".", "_") for p in at]
    exprs = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(n) for p, n in zip(at, names)]
    return samples.groupBy(*(by or [])).agg(*exprs, F.count(value).alias("n"), F.avg(value).alias("mean"))


def mean_ticks(samples: DataFrame, ticks: str, by: list[str] | None = None) -> DataFrame:
    """(by.., mean_ticks, n): the mean of whole ticks, cut to a whole one."""
    return samples.groupBy(*(by or [])).agg(F.floor(F.sum(ticks) / F.count(ticks)).cast("bigint").alias("mean_ticks"), F.count(ticks).alias("n"))


def throughput(samples: DataFrame, at: str, by: list[str] | None = None) -> DataFrame:
    """(by.., n, seconds, per_second): operations over the time from the first to the last of them, 0 where no time passes."""
    span = (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 1e6
    got = samples.groupBy(*(by or [])).agg(F.count("*").alias("n"), span.alias("seconds"))
    return got.withColumn("per_second", F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("seconds")), F.lit(0.0)))


def pooled(samples: list[DataFrame], value: str, by: list[str] | None = None, at=(0.5, 0.95, 0.99, 0.999)) -> DataFrame:
    """Percentiles of all samples together; percentiles are never averaged."""
    out = samples[0]
    for s in samples[1:]:
        out = out.unionByName(s)
    return percentiles(out, value, by, at)


def winner(left: Column, right: Column, lower_is_better: bool, names=("bitcask", "lsm")) -> Column:
    """The better of two figures; the names are those of a hash-indexed log and of a merge tree."""
    a, b = (left, right) if lower_is_better else (right, left)
    return F.when(a < b, F.lit(names[0])).when(a > b, F.lit(names[1])).otherwise(F.lit("tie"))


def advantage(left: Column, right: Column, lower_is_better: bool = True) -> Column:
    """How many times better the better one is: 0 where the worse figure is 0, infinite where only a better, lower one is."""
    low, high = F.least(left, right).cast("double"), F.greatest(left, right).cast("double")
    worse = high if lower_is_better else low
    return F.when(worse == 0, F.lit(0.0)).when(low == 0, F.lit(float("inf"))).otherwise(high / F.when(low != 0, low))


def bloom_bits(n: int, bits_per_key: int) -> int:
    return -(-max(64, n * bits_per_key) // 8) * 8


def bloom_hashes(bits_per_key: int) -> int:
    return min(30, max(1, int(0.69 * bits_per_key)))


def bloom_expected(bits_per_key: Column, hashes: Column) -> Column:
    """(1 - e ** (-k / bits)) ** k"""
    return F.pow(1 - F.exp(-hashes / bits_per_key), hashes)


def bloom_filter(keys: DataFrame, key: str, n: int, bits_per_key: int) -> DataFrame:
    """(word, bits): the filter of n keys as set 32-bit words, built by an aggregate that combines before the shuffle."""
    bits, k = bloom_bits(n, bits_per_key), bloom_hashes(bits_per_key)
    at = keys.select(F.explode(_places(F.col(key), bits, k)).alias("at"))
    return at.groupBy(F.floor(F.col("at") / 32).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("bits"))


def _places(key: Column, bits: int, hashes: int) -> Column:
    """Double hashing: places of a key's bits. Remainders are added, as a whole hash plus its steps can leave 64 bits."""
    a, b = F.pmod(F.xxhash64(key), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(1 << 40))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(a + b * i, F.lit(bits)))


def bloom_probe(probes: DataFrame, key: str, words: DataFrame, n: int, bits_per_key: int) -> DataFrame:
    """probes with `maybe`: false is certain."""
    bits, k = bloom_bits(n, bits_per_key), bloom_hashes(bits_per_key)
    rows = probes.select(F.col(key).alias("__key")).distinct().select("__key", F.explode(_places(F.col("__key"), bits, k)).alias("at"))
    held = rows.withColumn("word", F.floor(F.col("at") / 32)).join(words, "word", "left")
    bit = F.expr("shiftright(coalesce(bits, 0L), cast(at % 32 as int)) & 1")
    verdict = held.groupBy("__key").agg(F.min(bit).alias("all")).select("__key", (F.col("all") == 1).alias("maybe"))
    return probes.join(verdict, probes[key] == F.col("__key")).drop("__key")


def false_positives(verdicts: DataFrame) -> DataFrame:
    """(false_positives, negatives, rate) from rows (present, maybe) of absent keys."""
    fp, neg = F.count_if(~F.col("present") & F.col("maybe")), F.count_if(~F.col("present") & ~F.col("maybe"))
    return verdicts.agg(fp.alias("false_positives"), neg.alias("negatives"), ratio(fp, neg).alias("rate"))


def expected_rate(bits_per_key: int) -> float:
    k = bloom_hashes(bits_per_key)
    return (1 - math.exp(-k / bits_per_key)) ** k


def exposition(stats: DataFrame, kind: str = "gauge", prefix: str = "tidelog_") -> DataFrame:
    """(line) of the text format, from (name, labels map, value)."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    line = F.concat(F.lit(prefix), "name", labels, F.lit(" "), F.col("value").cast("string"))
    return stats.select("name", F.concat(F.lit(f"# TYPE {prefix}"), "name", F.lit(f" {kind}")).alias("type"), line.alias("line"))


def info_rows(stats: DataFrame, sections: list[str] | None = None) -> DataFrame:
    """(section, field, value) of the sections asked for; none, ALL and EVERYTHING mean all."""
    if not sections or any(s.lower() in ("all", "everything", "default") for s in sections):
        return stats
    return stats.where(F.lower("section").isin([s.lower() for s in sections]))
