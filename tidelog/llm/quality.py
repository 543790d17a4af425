"""Quality rules as a short-circuit cascade. Spark expressions only.

Each rule rejects a document by one signal. The cost of each signal and the share of documents its
rule rejects are measured on a sample of bounded size; rules then run in the order of rejection
per cost, and a document is tested until the first rule that rejects it. The order changes only the
time taken: the verdict is that of all rules together.

Defined results: null and blank texts have no words and are rejected; an empty table gives no rows;
repeated rows and null ids give rows of their own; other columns are passed through by `filter_quality`.
Windows of words are compared by two 64-bit hashes, lines by themselves.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import SPACE, let, table, text_words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rows on which costs and rejections are measured; they decide the order of rules, never a verdict.
SAMPLE_ROWS, SAMPLE_BYTES = 400, 32_768
#: Times that each sampled text is tested, so that a rule's work stands out from a job's own cost.
COPIES = 3


def word_chars(text: Column, words: Column) -> Column:
    return F.length(F.translate(text, SPACE, "")).cast("long")


def n_symbols(text: Column, words: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def n_words(text: Column, words: Column) -> Column:
    return F.size(words).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")


def n_lines(text: Column, words: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def n_dup_lines(text: Column, words: Column) -> Column:
    return let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(text: Column, words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of `window` words that the text has twice or more."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    def covered(w: Column) -> Column:
        """Sorting (hash, place) brings equal windows together; the places of those, sorted, cover a union of runs."""

        def repeated(s: Column) -> Column:
            return F.sort_array(F.transform(F.filter(s, lambda x: x["twin"]), lambda x: x["at"]))

        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        marked = let(
            pairs,
            lambda p: F.transform(
                p,
                lambda x, i: F.struct(x["at"].alias("at"), F.coalesce((F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"]), F.get(p, i - 1)["h"] == x["h"], F.get(p, i + 1)["h"] == x["h"], F.lit(False)).alias("twin")),
            ),
        )
        return let(repeated(marked), lambda at: F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x))

    def count(h: Column) -> Column:
        return F.when(F.size(h) <= window, F.lit(0)).otherwise(let(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))))

    return let(hashes, count).cast("long")


def of_text(text: Column, body) -> Column:
    """body(signal), where signal(name) is a signal's column; the text is read and cut into words once a row."""
    return let(F.coalesce(text, F.lit("")), lambda t: let(text_words(t), lambda w: body(lambda name: SIGNALS[name](t, w))))


#: Functions of the text, not null, and its words.
SIGNALS = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_lines": n_lines, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words}


@dataclass(frozen=True)
class Rule:
    """Rejects where `rejects` holds; it is given a function from signal name to column."""

    name: str
    signals: tuple[str, ...]
    rejects: object


RULES = (
    Rule("few_words", ("n_words",), lambda s: s("n_words") < 10),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda s: 100 * s("n_repeat_words") > 20 * s("n_words")),
    Rule("symbols", ("n_symbols", "word_chars"), lambda s: 100 * s("n_symbols") > 10 * s("word_chars")),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda s: (100 * s("n_dup_lines") > 35 * s("n_lines")) & (s("n_dup_lines") >= 3)),
    Rule("word_length", ("word_chars", "n_words"), lambda s: s("word_chars") > 20 * s("n_words")),
)


def rule_order(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by falling rejection per second, as measured on `sample_rows` texts of SAMPLE_BYTES at most.

    The sample is read from the table's first partitions, as far as needed. A rule's cost is what its job takes on
    COPIES of each text beyond a job that only reads them; each job runs twice, and the faster run counts, without the
    planning and compiling of the first.
    """
    few = docs.select("text").where(F.octet_length("text") <= SAMPLE_BYTES).sample(0.5, seed=7).limit(sample_rows)
    rows = [(r[0],) for r in few.collect()]
    if not rows:
        return list(rules)
    texts = docs.sparkSession.createDataFrame(rows, "text string").coalesce(1).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))

    def timed(rejects: Column) -> tuple[float, int, int]:
        job = texts.agg(F.sum(F.coalesce(rejects, F.lit(False)).cast("long")).alias("n"), F.count("*").alias("of"))
        took = []
        for _ in range(2):
            began = time.perf_counter()
            row = job.collect()[0]
            took.append(time.perf_counter() - began)
        return min(took), row["n"] or 0, row["of"]

    idle, _, of = timed(F.octet_length("text") < 0)
    score = {}
    for rule in rules:
        took, n, _ = timed(of_text(F.col("text"), rule.rejects))
        score[rule.name] = (n / of + 1e-4) / max(took - idle, 1e-3)
    return sorted(rules, key=lambda r: -score[r.name])


def verdict(order: list[Rule], signal) -> Column:
    """True where no rule rejects: a chain of CASE branches, so later signals are computed only for documents still in, and each once."""

    def chain(k: int, known: dict[str, Column]) -> Column:
        if k == len(order):
            return F.lit(True)
        new = [name for name in order[k].signals if name not in known]

        def body(found: Column) -> Column:
            held = known | {name: found[name] for name in new}
            return F.when(order[k].rejects(held.__getitem__), F.lit(False)).otherwise(chain(k + 1, held))

        return let(F.struct(*[signal(name).alias(name) for name in new]), body) if new else body(F.lit(None))

    return chain(0, {})


def quality_signals(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, every signal, base_failed and kept."""
    got = docs.select("doc_id", of_text(F.col("text"), lambda signal: F.struct(*[signal(k).alias(k) for k in SIGNALS])).alias("__s"))
    signal = lambda name: F.col(f"__s.{name}")
    base = (signal("n_words") < 10) | (100 * signal("n_repeat_words") > 20 * signal("n_words"))
    return got.select("doc_id", *[signal(k).alias(k) for k in SIGNALS], base.alias("base_failed"), (~base & verdict(rule_order(docs, rules), signal)).alias("kept"))


def filter_quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    order = rule_order(docs, rules)
    return docs.filter(of_text(F.col("text"), lambda signal: verdict(order, signal)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_signals(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, list_reduce(ws[i:i+4], lambda a, b: a || ' ' || b) AS g FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid),
s AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND NOT (100 * n_symbols > 10 * word_chars) AND NOT (100 * n_dup_lines > 35 * n_lines AND n_dup_lines >= 3) AND NOT (word_chars > 20 * n_words)) AS kept
FROM b
"""
