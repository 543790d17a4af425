from __future__ import annotations

import random
import re
from collections import Counter

from tests.llm.conftest import ODD
from tests.oracle import connect, same
from tidelog.llm import quality


def signals(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def rows_of(df):
    return [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.quality_signals(df).collect()]


def want(pairs):
    out = []
    for i, t in pairs:
        s = signals(t)
        out.append((i, *s, s[0] < 10 or 100 * s[4] > 20 * s[0]))
    return out


def test_random_texts(spark):
    rng = random.Random(2)
    texts = []
    for i in range(300):
        n = rng.choice([0, 1, 4, 5, 6, 9, 10, 11, 30, 200])
        texts.append((i, "".join(rng.choice(["a", "b", "cc", "é🙂", "#%", "d"]) + rng.choice([" ", "  ", "\n", "\t", "\x0b", " ", "\x1c"]) for _ in range(n))))
    assert rows_of(spark.createDataFrame(texts, "doc_id bigint, text string")) == want(texts)


def test_odd_documents(odd, no_docs):
    key = lambda r: str(r)
    assert sorted(rows_of(odd), key=key) == sorted(want(ODD), key=key)
    assert quality.quality_signals(no_docs).count() == 0 and quality.filter_quality(no_docs).count() == 0


def test_filter_keeps_rows_whole_and_agrees_with_the_verdict(spark, odd, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in quality.quality_signals(docs).where("kept").collect()}
    got = quality.filter_quality(docs)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == kept
    assert quality.filter_quality(odd).columns == odd.columns


def test_order_of_rules_never_changes_a_verdict(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = []
    for order in (list(quality.RULES), list(quality.RULES)[::-1]):
        monkeypatch.setattr(quality, "rule_order", lambda d, r=quality.RULES, n=0, order=order: order)
        found.append({r["doc_id"] for r in quality.filter_quality(docs).collect()})
    assert found[0] == found[1]


def test_clean_documents_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("quality = 1")
    got = quality.quality_signals(docs)
    assert got.where("NOT kept AND NOT base_failed").count() == 0


def test_rules_are_ordered_by_rejection_per_cost(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {r.name for r in quality.rule_order(docs)} == {r.name for r in quality.RULES}


def test_main_path_is_native(spark, sf):
    plan = quality.op4_quality_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_query_equals_sql(spark, sf):
    same(quality.op4_quality_rules(spark, sf), connect(sf), quality.OP4_SQL)
