"""Toxicity by non-negative positive-unlabelled learning, in numpy.

Positives are confirmed toxic documents; every other document is unlabelled text, whatever its label.
A linear model over hashed words and word beginnings is trained on the risk
pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)), with pi the share of toxic among labelled rows. The unlabelled
sample stands for all text, though known positives are left out: they are a share k of it, which falls to nothing as a corpus
outgrows its labels. `fit` can put them back as R_u = k R_p + (1 - k) R_rest. On a table whose labels cover much of it that
calls less toxic (README), so training leans to catching and leaves k at 0. Only rows whose crc32(doc_id as text) mod 5 is not 0 are learnt from. The training sample is
bounded by SAMPLE_POSITIVE and SAMPLE_UNLABELLED documents, chosen by a hash of doc_id; scoring reads every
document whole.

Defined results: null and empty texts get the score of no features; a null doc_id is never
held out nor learnt from; repeated labels count once, toxic if any says so; without positives
every score is 0; an empty table gives no rows; other columns are passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, released, ship, table

#: About how many documents are learnt from, at most.
SAMPLE_POSITIVE, SAMPLE_UNLABELLED = 3000, 9000
BITS, PREFIXES = 30, (4, 5, 6, 7, 8)
#: A beginning that so many distinct words of a text share makes features of its own.
REPEATS = (1, 2, 4)
#: A feature is used if that many sampled positives, and that share of them, hold it, if it is that much more
#: frequent among them than in unlabelled text (1 / prior at most), and if its Poisson deviance from the count that
#: unlabelled text lets expect is so large: of some 100,000 features tested, chance then passes hardly one.
MIN_POSITIVES, MIN_SHARE, MIN_LIFT, MIN_DEVIANCE = 4, 0.02, 3.0, 25.0
ROUNDS, RATE, DECAY = 400, 0.1, 1e-4
#: Distinct words that a task remembers.
CACHE_WORDS = 400_000
#: Tasks that work on the sample, whose size is bounded.
SAMPLE_TASKS = 8

_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    """Hashes of a word and of its first letters."""
    from xxhash import xxh3_64_intdigest

    return [xxh3_64_intdigest(x) & ((1 << BITS) - 1) for x in ("=" + word, *(str(k) + word[:k] for k in PREFIXES if len(word) >= k))]


def text_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _reached(count: dict[int, int]) -> list[int]:
    """Four times a feature's hash plus which of REPEATS its number of distinct words reaches."""
    return [4 * f + k for f, n in count.items() for k, least in enumerate(REPEATS) if n >= least]


def text_features(text: str | None, cache: dict[str, tuple]) -> np.ndarray:
    """Sorted features of a text."""
    count: dict[int, int] = {}
    for w in text_words(text):
        got = cache.get(w)
        if got is None:
            if len(cache) > CACHE_WORDS // 4:
                cache.clear()
            got = cache[w] = tuple(word_features(w))
        for f in got:
            count[f] = count.get(f, 0) + 1
    return np.array(sorted(_reached(count)), np.int64)


class Finder:
    """Places of a text's features among given ones. Words without any of them are known as such and skipped as a set."""

    def __init__(self, features):
        self.used = {f: i for i, f in enumerate(features)}
        self.wanted = {f // 4 for f in self.used}
        self.known: set[str] = set()
        self.owning: set[str] = set()
        self.of: dict[str, tuple[int, ...]] = {}

    def places(self, text: str | None) -> np.ndarray:
        words = text_words(text)
        unseen = words - self.known
        if unseen:
            if len(self.known) > CACHE_WORDS:
                self.known, self.owning, self.of, unseen = set(), set(), {}, words
            wanted = self.wanted
            for w in unseen:
                got = tuple(f for f in word_features(w) if f in wanted)
                if got:
                    self.of[w] = got
                    self.owning.add(w)
            self.known |= unseen
        count: dict[int, int] = {}
        for w in words & self.owning:
            for f in self.of[w]:
                count[f] = count.get(f, 0) + 1
        used = self.used
        return np.array(sorted(used[f] for f in _reached(count) if f in used), np.int64)


@dataclass
class Model:
    bias: float
    features: np.ndarray
    weights: np.ndarray

    def finder(self) -> Finder:
        return Finder(self.features.tolist())

    def scores(self, texts, finder: Finder) -> np.ndarray:
        z = np.array([self.bias + self.weights[finder.places(t)].sum() for t in texts], float)
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-z))


def nothing() -> Model:
    """Scores 0 for every text."""
    return Model(-np.inf, np.empty(0, np.int64), np.empty(0))


_ODD = np.random.default_rng(5).integers(1, 1 << 62, 24, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(features: np.ndarray) -> bytes:
    """8 bands of 3 min-hashes, as 64 bits each."""
    with np.errstate(over="ignore"):
        low = (((features.astype(np.uint64)[:, None] + np.uint64(1)) * _ODD) >> np.uint64(20)).min(axis=0) if len(features) else np.zeros(24, np.uint64)
        low = low.reshape(8, 3)
        return ((low[:, 0] * _ODD[0] + low[:, 1]) * _ODD[1] + low[:, 2] * _ODD[2] + np.arange(8, dtype=np.uint64)).tobytes()


def distinct(signatures: list[bytes]) -> np.ndarray:
    """Indices of rows without near copies of earlier ones, which would pass the words of one text for evidence."""
    seen: set[int] = set()
    keep = []
    for i, s in enumerate(signatures):
        mine = np.frombuffer(s, np.uint64).tolist()
        if not seen.intersection(mine):
            keep.append(i)
        seen.update(mine)
    return np.array(keep, int)


def telling(in_p: np.ndarray, n_p: int, in_u: np.ndarray, n_u: int) -> np.ndarray:
    """Mask of features whose count among positives is far from what unlabelled text lets expect."""
    expected = n_p * (in_u + 1) / (n_u + 1)
    deviance = 2 * (in_p * np.log(np.maximum(in_p, 1) / expected) - (in_p - expected))
    return (in_p >= MIN_LIFT * expected) & (deviance >= MIN_DEVIANCE)


def fit(rows: list[np.ndarray], positive: np.ndarray, prior: float, n_features: int, known: float = 0.0) -> tuple[float, np.ndarray]:
    """(bias, weights) from rows of feature places: non-negative PU risk with the sigmoid loss, by full-batch Adam; a step ascends where
    the corrected part is negative. known: the share of all text that the unlabelled rows leave out as positives."""
    known = min(known, prior)
    n_p, n_u = positive.sum(), (~positive).sum()
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows).astype(int)
    w, b = np.ones(n_features), -2.0  # the features were chosen as telling; from 0, all negative would be a trap
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, ROUNDS + 1):
        z = b + np.bincount(owner, weights=w[flat], minlength=len(rows))
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))  # the sigmoid loss of being called positive; bounded, so long documents can't rule
        slope = p * (1 - p)
        negative_risk = (1 - known) * p[~positive].mean() - (prior - known) * p[positive].mean()
        g = np.zeros(len(rows))
        if negative_risk >= 0:
            g[positive] = -(2 * prior - known) * slope[positive] / n_p
            g[~positive] = (1 - known) * slope[~positive] / n_u
        else:
            g[positive] = (prior - known) * slope[positive] / n_p
            g[~positive] = -(1 - known) * slope[~positive] / n_u
        grad = np.r_[np.bincount(flat, weights=g[owner], minlength=n_features) + DECAY * w, g.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.95 * v + 0.05 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.95**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    z = b + np.bincount(owner, weights=w[flat], minlength=len(rows))
    # Weak evidence leaves z below 0 for some; the boundary is moved down to the gap, never up.
    return float(b) - min(0.0, cut_point(z, positive, prior, known)), w


def cut_point(z: np.ndarray, positive: np.ndarray, prior: float, known: float = 0.0) -> float:
    """Where to part the classes: the least corrected 0-1 risk (2 pi - k) P_p(z < c) + (1 - k) P_rest(z > c), in the middle of the widest gap that has it."""
    values = np.unique(z)
    if len(values) < 2:
        return 0.0
    cuts = (values[1:] + values[:-1]) / 2
    missed = np.searchsorted(np.sort(z[positive]), cuts) / positive.sum()
    called = 1 - np.searchsorted(np.sort(z[~positive]), cuts) / (~positive).sum()
    risk = (2 * prior - known) * missed + (1 - known) * called
    gap = np.where(risk <= risk.min() + 1e-12, np.diff(values), -1)
    return float(cuts[gap.argmax()])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, n_positive: int = SAMPLE_POSITIVE, n_unlabelled: int = SAMPLE_UNLABELLED) -> Model:
    ship(docs.sparkSession)
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = marks.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    total = docs.where(F.col("doc_id").isNotNull() & ~held_out()).count()
    if not toxic or not total:
        return nothing()

    yes = marks.where("toxic = 1").select("doc_id")
    some = docs.select("doc_id").where("doc_id is not null").where(~held_out() & chosen_share(n_unlabelled, total)).distinct()
    chosen = yes.where(chosen_share(n_positive, toxic)).withColumn("y", F.lit(1)).unionByName(some.join(yes, "doc_id", "left_anti").withColumn("y", F.lit(0)))

    # `chosen` holds about n_positive + n_unlabelled ids, whatever the input; so does the sample.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.write(sample.withColumn("row", F.xxhash64("doc_id", "text")).dropDuplicates(["row"]).repartition(SAMPLE_TASKS), "sample")

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, tuple] = {}
        for pdf in batches:
            yield pd.DataFrame({"row": pdf["row"], "y": pdf["y"], "bands": [bands(text_features(t, cache)) for t in pdf["text"]]})

    rows = sample.mapInPandas(sign, "row long, y int, bands binary").toPandas().sort_values(["y", "row"], ascending=[False, True])
    if rows.empty:
        return nothing()
    rows = rows.iloc[distinct(rows["bands"].tolist())]
    kept, positive = set(rows["row"].tolist()), rows["y"].to_numpy() == 1
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    if not n_p or not n_u:
        return nothing()
    features, in_p = frequent_features(sample, kept, max(MIN_POSITIVES, MIN_SHARE * n_p))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder, total = Finder(features.tolist()), np.zeros(len(features), np.int64)
        for pdf in batches:
            for text in pdf["text"][[r in kept and not y for r, y in zip(pdf["row"], pdf["y"])]]:
                total[finder.places(text)] += 1
        yield pd.DataFrame({"counts": [total.tobytes()]})

    in_u = sum((np.frombuffer(r[0], np.int64) for r in sample.mapInPandas(count, "counts binary").collect()), np.zeros(len(features), np.int64))
    features = features[telling(in_p, n_p, in_u, n_u)]

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(features.tolist())
        for pdf in batches:
            pdf = pdf[[r in kept for r in pdf["row"]]]
            yield pd.DataFrame({"row": pdf["row"], "y": pdf["y"], "at": [finder.places(t).astype(np.int32).tobytes() for t in pdf["text"]]})

    held = sample.mapInPandas(hold, "row long, y int, at binary").toPandas().sort_values("row")  # one order, one model
    scratch.drop("sample")
    bias, weights = fit([np.frombuffer(x, np.int32) for x in held["at"]], held["y"].to_numpy() == 1, toxic / n, len(features))
    return Model(bias, features, weights)


def chosen_share(of: int, rest: int) -> Column:
    """True for about `of` of `rest` documents, whatever their number: 63 bits of a hash are compared."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17)), 1) < F.lit(min((1 << 63) - 1, (of << 63) // max(1, rest)))


def frequent_features(sample: DataFrame, kept: set[int], least: float) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of those that `least` kept positives or more hold: at most a text's mean number of features over MIN_SHARE.

    Tasks count on their own and deal the counts by feature, so that no more than that reaches the driver.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, tuple] = {}
        found, times, waiting, held = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merged():
            if not waiting:
                return found, times
            new, counts = np.unique(np.concatenate(waiting), return_counts=True)
            both, at = np.unique(np.concatenate([found, new]), return_inverse=True)
            return both, np.bincount(at, weights=np.concatenate([times, counts]), minlength=len(both)).astype(np.int64)

        for pdf in batches:
            for text in pdf["text"][[r in kept and y == 1 for r, y in zip(pdf["row"], pdf["y"])]]:
                waiting.append(text_features(text, cache))
                held += len(waiting[-1])
                if held > 2_000_000:
                    (found, times), waiting, held = merged(), [], 0
        found, times = merged()
        part = found // 4 % SAMPLE_TASKS
        yield pd.DataFrame([(k, found[part == k].tobytes(), times[part == k].tobytes()) for k in range(SAMPLE_TASKS)], columns=["part", "features", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        found, at = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in pdf["features"]]), return_inverse=True)
        times = np.bincount(at, weights=np.concatenate([np.frombuffer(x, np.int64) for x in pdf["counts"]]), minlength=len(found)).astype(np.int64)
        return pd.DataFrame({"features": [found[times >= least].tobytes()], "counts": [times[times >= least].tobytes()]})

    got = sample.mapInPandas(count, "part int, features binary, counts binary").groupBy("part").applyInPandas(add, "features binary, counts binary").collect()
    features = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(r["features"], np.int64) for r in got]])
    counts = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(r["counts"], np.int64) for r in got]])
    order = np.argsort(features)
    return features[order], counts[order]


def score_column(model: Model, text: Column) -> Column:
    """The score of each text, 0 to 1."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = model.finder()
        return released(lambda each: (pd.Series(model.scores(texts, finder)) for texts in each))(batches)

    return scores(text)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
