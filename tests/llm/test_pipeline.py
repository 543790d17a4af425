from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_ngram_join import brute
from tests.llm.test_packing import best_fit, check
from tests.llm.test_quality import signals
from tests.llm.test_toxicity import plain_scores
from tidelog.llm import ngram_join, quality, toxicity


def test_stages_take_effect_and_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    stage = dict(corpus_pipeline.STAGES)

    def ids(df):
        return {r["doc_id"] for r in df.collect()}

    good = stage[names[0]](spark, docs, sf)
    assert good.columns == columns and ids(good) == ids(quality.quality_signals(docs).where("kept"))
    mild = stage[names[1]](spark, good, sf)
    model = toxicity.train(good, spark.read.parquet(f"{sf}/labels.parquet"))
    assert mild.columns == columns and ids(mild) == ids(good.where(toxicity.score_column(model, F.col("text")) < 0.5))
    one = stage[names[2]](spark, mild, sf)
    assert one.columns == columns and ids(one) == ids(ngram_join.jaccard_components(mild, 5, 80).where("doc_id = component_id"))
    packed = stage[names[3]](spark, one, sf)
    assert ids(packed) == ids(one)
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_stages_against_brute_force(spark, sf):
    """Each stage on all its predecessor kept, recomputed row by row in Python."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    stage = dict(corpus_pipeline.STAGES)

    def good(text):
        n, chars, symbols, dup, repeat = signals(text)
        lines = len([x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")])
        return not (n < 10 or 100 * repeat > 20 * n or 100 * symbols > 10 * chars or (100 * dup > 35 * lines and dup >= 3) or chars > 20 * n)

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = stage["quality_rules"](spark, docs, sf)
    rows = [r for r in rows if good(r[1] or "")]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in rows)
    mild = stage["toxicity"](spark, kept, sf)
    model = toxicity.train(kept, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [r for r, s in zip(rows, plain_scores(model, [t for _, t in rows])) if s < 0.5]
    assert sorted(r["doc_id"] for r in mild.collect()) == sorted(i for i, _ in rows)
    one = stage["ngram_jaccard"](spark, mild, sf)
    low = {c for _, _, c in brute(rows, 5, 80)}
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(low)
    packed = stage["best_fit_packing"](spark, one, sf).collect()
    assert {r["doc_id"] for r in packed} == low
    assert check([(r["length"], r["sequence_id"], r["offset"]) for r in packed], 4096) == best_fit([r["length"] for r in packed], 4096)


def test_odd_documents_pass_through(spark, odd, no_docs, sf):
    for docs in (odd, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            out.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
