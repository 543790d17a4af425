from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import ODD
from tidelog.llm import graph, ngram_join


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n, t):
    """[(doc_id, size, component)] by comparing all pairs; a null id names nothing."""
    sets = [shingles(x, n) for _, x in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= t * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            low[find(a)] = min(low.get(find(a), i), i)
    return sorted(((i, len(sets[a]), low.get(find(a))) for a, (i, _) in enumerate(rows)), key=str)


def ours(df, n, t):
    return sorted((tuple(r) for r in ngram_join.jaccard_components(df, n, t).collect()), key=str)


def near_copies(seed, families=8, each=14, words=80):
    """Families of edited copies with similarities around the threshold, shared lines, exact copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    line = " ".join(word() for _ in range(25))
    rows, i = [], 0
    for _ in range(families):
        base = [word() for _ in range(rng.randrange(words // 3, words))]
        for _ in range(each):
            x = list(base)
            for _ in range(rng.randrange(0, 6)):
                x[rng.randrange(len(x))] = word()
            rows.append((i, " ".join(x) + (" " + line if rng.random() < 0.4 else "")))
            i += 1
    rows += [(i + k, rng.choice(rows)[1].upper()) for k in range(20)] + [(i + 100 + k, line) for k in range(5)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,t", [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, n, t):
    rows = near_copies(n)
    assert ours(spark.createDataFrame(rows, "doc_id bigint, text string"), n, t) == brute(rows, n, t)


def test_blocks_hot_shingles_and_small_buckets(spark, monkeypatch):
    """Every limit small, so that clusters take many blocks and most shared shingles count as hot."""
    rows = near_copies(9, 4, 30)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    monkeypatch.setattr(ngram_join, "HOT_SHARE", 0.05)
    assert ours(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7), 4, 85) == brute(rows, 4, 85)


def test_odd_documents(odd, no_docs):
    for n, t in ((4, 85), (5, 80)):
        assert ours(odd, n, t) == brute(ODD, n, t)
    assert ours(no_docs, 4, 85) == []


def test_all_blank(spark):
    df = spark.createDataFrame([(1, None), (2, " "), (3, "")], "doc_id bigint, text string")
    assert ours(df, 4, 85) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    assert ngram_join.keep_one(df).count() == 3


def test_keep_one_keeps_the_smallest_of_each_component(spark, odd):
    rows = [r for r in near_copies(4)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, lang string")
    got = ngram_join.keep_one(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({c for _, _, c in brute(rows, 5, 80)})
    kept = Counter(r["doc_id"] for r in ngram_join.keep_one(odd).collect())
    # Rows 5, 6 and a null are one component; both texts of 7 and the blank ones stay.
    assert kept[5] == 1 and kept[6] == 0 and kept[7] == 2 and kept[None] == 1 and all(kept[i] == 1 for i in (1, 2, 3, 4, 8, 9))


def test_link_sets_spans_the_components():
    rng = np.random.default_rng(3)
    for m in (2, 7, 40, 90):
        pool = rng.integers(0, 1 << 62, 60).astype(np.uint64)
        sets = [np.unique(np.r_[pool[: rng.integers(20, 60)], rng.integers(0, 1 << 62, rng.integers(0, 6)).astype(np.uint64)]) for _ in range(m)]
        for side in (None, rng.integers(0, 2, m)):
            up = list(range(m))
            find = lambda x, up=up: x if up[x] == x else find(up[x])
            for a in range(m):
                for b in range(a):
                    both = len(np.intersect1d(sets[a], sets[b]))
                    if (side is None or side[a] != side[b]) and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                        up[find(a)] = find(b)
            links = ngram_join.link_sets(sets, 85, side)
            got = list(range(m))
            root = lambda x, got=got: x if got[x] == x else root(got[x])
            for a, b in links:
                got[root(a)] = root(b)
            assert len(links) <= m - 1
            assert [[find(a) == find(b) for b in range(m)] for a in range(m)] == [[root(a) == root(b) for b in range(m)] for a in range(m)]


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 180)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(500, x) for x in range(501, 700)] + [(None, 3), (9, 9)]
    got = dict(tuple(r) for r in graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(up)}
    assert graph.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_query_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in ngram_join.op7_ngram_jaccard(spark, sf).collect()), key=str)
    assert got == brute(rows, 4, 85)
