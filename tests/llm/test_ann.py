from __future__ import annotations

import numpy as np

from tidelog.llm import ann


def exact(ids, vectors, q, k):
    s = vectors.astype(np.float64) @ vectors[q].astype(np.float64)
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
    return ids[order].tolist(), s[order]


def search(spark, rows, k, where="vec_id % 20 = 0"):
    df = ann.usable(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, rank int, v string"))
    got = ann.search_index(ann.build_index(df, k + 1), df.where(where).dropDuplicates(["vec_id"]), k).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_recall_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 700)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 24))
    vectors = (centres[rng.integers(0, 30, 3000)] + 0.6 * rng.normal(size=(3000, 24))).astype(np.float32)
    ids = np.arange(3000)
    got = search(spark, list(zip(ids.tolist(), vectors.tolist())), 10)
    assert set(got) == set(range(0, 3000, 20))
    hits = 0
    for q, found in got.items():
        want, _ = exact(ids, vectors, q, 10)
        hits += len(set(want) & {i for i, _ in found})
        assert len(found) == 10 and q not in {i for i, _ in found}
        assert np.allclose([s for _, s in found], [vectors[i].astype(float) @ vectors[q].astype(float) for i, _ in found])
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    assert hits >= 0.9 * 10 * len(got)


def test_hot_vector_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(600, 8)).astype(np.float32)
    vectors[::2] = vectors[0] * 5
    got = search(spark, list(enumerate(vectors.tolist())), 5)
    for q in range(0, 600, 20):
        assert [i for i, _ in got[q]] == [i for i in range(0, 20, 2) if i != q][:5]


def test_vectors_that_take_no_part(spark):
    ok = [[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]]
    rows = [(0, ok[0]), (1, ok[1]), (2, ok[2]), (2, ok[2]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, ok[0]), (20, [1.0, 1.0, 1.0])]
    got = search(spark, rows, 20)
    assert got == {0: [(1, 0.5), (2, 0.0)]}
    assert search(spark, [], 5) == {} and search(spark, [(0, [1.0])], 5) == {}


def test_query_recall(spark, sf):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    vectors = np.array([rows[i] for i in ids], np.float32)
    got = {}
    for r in ann.op9_nearest_neighbours(spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hits = sum(len(got[q] & set(exact(ids, vectors, int(np.searchsorted(ids, q)), 20)[0])) for q in got)
    assert hits >= 0.95 * 20 * len(got)


def test_double_precision_and_large_components(spark):
    """Vectors that single precision can't part, and components beyond its range."""
    rows = [(0, [1.0, 0.0]), (1, [1.0 + 1e-12, 0.0]), (2, [1.0 + 2e-12, 0.0]), (3, [0.5, 1e200]), (40, [1e200, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.search_index(ann.build_index(ann.usable(df), 6), ann.usable(df).where("vec_id % 20 = 0"), 5).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found[0] == [(40, 1e200), (2, 1.0 + 2e-12), (1, 1.0 + 1e-12), (3, 0.5)]
    assert [i for i, _ in found[40]] == [3, 2, 1, 0] and found[40][0][1] == 1e200 * 0.5 + 1e200


def test_layers_are_grown_by_insertion():
    """Every node is linked, links go both ways where there is room, and upper nodes are the first of the layer below."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(1500, 16))
    graph = ann.build_graph(np.arange(1500), vectors, 21)
    assert len(graph["layers"][0]) == 1500 and [len(x) for x in graph["layers"]] == sorted((len(x) for x in graph["layers"]), reverse=True)
    seen, todo = {0}, [0]
    while todo:
        for x in graph["layers"][0][todo.pop()].tolist():
            if x >= 0 and x not in seen:
                seen.add(x)
                todo.append(x)
    assert len(seen) == 1500
    for links in graph["layers"]:
        assert links.max() < len(links) and (links != np.arange(len(links))[:, None]).all()
    found = ann.search_graph(graph, np.arange(0, 1500, 20), vectors[::20], 10)
    hits = sum(len(set(f[0].tolist()) & set(exact(np.arange(1500), vectors, q, 10)[0])) for q, f in zip(range(0, 1500, 20), found))
    assert hits >= 0.95 * 10 * 75
