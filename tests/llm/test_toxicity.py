from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidelog.llm import toxicity


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = toxicity.op5_toxicity(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    negatives = [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in negatives) <= 0.05 * len(negatives)
    positives = [r for r in rows if r["toxic"] == 1]
    assert sum(r["predicted"] for r in positives) >= 0.6 * len(positives)  # few labels at this size
    for r in got.collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_labels_of_the_held_out_fold_change_nothing(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    one = toxicity.train(docs, labels)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    two = toxicity.train(docs, flipped)
    assert one.bias == two.bias and one.features.tolist() == two.features.tolist() and one.weights.tolist() == two.weights.tolist()


def test_fit_finds_the_words_of_the_positives():
    rng = np.random.default_rng(0)
    rows, positive = [], []
    for i in range(1500):
        toxic = i % 10 == 0
        r = set(rng.integers(0, 60, 10).tolist()) | ({60 + int(rng.integers(0, 5))} if toxic else set())
        rows.append(np.array(sorted(r)))
        positive.append(toxic and i % 20 == 0)  # half of the toxic ones are unlabelled
    positive = np.array(positive)
    in_p, in_u = (np.bincount(np.concatenate([r for r, y in zip(rows, positive) if y == k]), minlength=65) for k in (True, False))
    used = toxicity.telling(in_p, positive.sum(), in_u, (~positive).sum())
    assert set(np.flatnonzero(used).tolist()) <= set(range(60, 65)) and used.sum() >= 4
    bias, weights = toxicity.fit([r[r >= 60] - 60 for r in rows], positive, 0.1, 5)
    z = np.array([bias + weights[r[r >= 60] - 60].sum() for r in rows])
    toxic = np.arange(1500) % 10 == 0
    assert (z[toxic] > 0).mean() > 0.9 and (z[~toxic] > 0).mean() < 0.02


def test_only_features_far_from_chance_are_used():
    in_p, in_u = np.array([90, 30, 5, 10, 300]), np.array([90, 900, 20, 0, 3000])
    assert toxicity.telling(in_p, 300, in_u, 9000).tolist() == [True, False, False, True, False]


def test_near_copies_count_once():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 18, 300))
    copies = [np.unique(np.r_[base[rng.random(len(base)) > 0.03], rng.integers(0, 1 << 18, 5)]) for _ in range(30)]
    others = [np.unique(rng.integers(0, 1 << 18, 300)) for _ in range(30)]
    kept = toxicity.distinct([toxicity.bands(x) for x in copies + others])
    assert (kept < 30).sum() <= 2 and (kept >= 30).sum() == 30


def test_shared_beginnings_count():
    f = lambda t: set(toxicity.text_features(t, {}).tolist())
    assert len(f("achlicha")) == len(toxicity.PREFIXES) + 1 and f("achlicha achlicha,") == f("achlicha")
    two = f("achlicha achlichb")
    assert sum(x % 4 == 1 for x in two) == 4 and f("") == f(None) == set()


def test_odd_documents(spark, odd, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, None), (None, 1), (6, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(odd, labels)
    got = odd.withColumn("s", toxicity.score_column(model, F.col("text")))
    assert all(0 <= r["s"] <= 1 for r in got.collect()) and got.count() == odd.count()
    none = toxicity.train(no_docs, labels)
    assert no_docs.withColumn("s", toxicity.score_column(none, F.col("text"))).count() == 0
    nothing = toxicity.train(odd, labels.limit(0))
    assert {r["s"] for r in odd.select(toxicity.score_column(nothing, F.col("text")).alias("s")).collect()} == {0.0}


def plain_scores(model, texts):
    """The scores by the definition: features counted word by word, no finder and no cache."""
    from xxhash import xxh3_64_intdigest

    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    out = []
    for text in texts:
        count = {}
        for w in set(re.findall(r"\w+", (text or "").lower())):
            for x in ["=" + w] + [f"{k}{w[:k]}" for k in (4, 5, 6, 7, 8) if len(w) >= k]:
                f = xxh3_64_intdigest(x) % 2**30
                count[f] = count.get(f, 0) + 1
        z = model.bias + sum(weight.get(4 * f + k, 0.0) for f, n in count.items() for k in range(3) if n >= 2**k)
        out.append(1 / (1 + np.exp(-z)) if z > -700 else 0.0)
    return out


def test_scores_against_a_plain_scorer(spark, monkeypatch):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert len(model.features)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = dict(zip(texts, plain_scores(model, texts.values())))
    got = {r["doc_id"]: r["score"] for r in toxicity.op5_toxicity(spark, folder).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-9
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 50)  # a finder that forgets finds the same
    some = list(texts.values())[:200]
    assert np.abs(model.scores(some, model.finder()) - plain_scores(model, some)).max() < 1e-9


def test_the_sample_is_exact_at_any_size(spark):
    """At 2e10 documents, about 9,000 are still drawn: shares don't round to nothing."""
    n = 1_000_000
    drawn = spark.range(n).select(F.col("id").alias("doc_id")).where(toxicity.chosen_share(9000, 2 * 10**10)).count()
    assert drawn <= 10
    many = spark.range(n).select(F.col("id").alias("doc_id")).where(toxicity.chosen_share(9000 * 2 * 10**4, 2 * 10**10)).count()
    assert abs(many - 9000) < 500
    assert spark.range(100).select(F.col("id").alias("doc_id")).where(toxicity.chosen_share(9000, 100)).count() == 100


def test_known_positives_are_not_corrected_for_twice():
    """With every positive known, the rest holds none: the risk is that of plain two-class learning, and its boundary parts them."""
    rng = np.random.default_rng(2)
    positive = np.arange(1200) % 4 == 0
    rows = [np.flatnonzero(rng.random(6) < (0.6 if y else 0.05)) for y in positive]
    bias, weights = toxicity.fit(rows, positive, 0.25, 6, known=0.25)
    z = np.array([bias + weights[r].sum() for r in rows])
    assert (z[positive] > 0).mean() > 0.85 and (z[~positive] > 0).mean() < 0.1


def test_frequent_features_are_counted_whole(spark):
    texts = ["alpha beta gamma"] * 3 + ["alpha beta"] * 2 + ["alpha"]
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)] + [(50, 0, "alpha"), (60, 1, "alpha")], "row long, y int, text string").repartition(4)
    features, counts = toxicity.frequent_features(df, set(range(6)) | {50}, 4)
    of = {w: toxicity.text_features(w, {}).tolist() for w in ("alpha", "beta", "gamma")}
    assert dict(zip(features.tolist(), counts.tolist())) == {f: 6 for f in of["alpha"]} | {f: 5 for f in of["beta"]}
