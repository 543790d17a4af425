"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, results merged.

Vectors are dealt to shards of about SHARD rows by a hash of vec_id; each shard's graph is one row
of the index table: node vectors, and each layer's neighbours as one flat array. A graph grows by insertion, from the
top layer down: a batch of nodes descends to its layer, searches what is there with a beam, links to diverse near nodes
and is linked back. Every query block is searched in every shard, and the shards' best are merged per block.
Nearness is the inner product, turned into distance for the graph by one more coordinate that gives all nodes the same norm.
Equal vectors of a shard are one node with a list of ids, so a hot vector can't fill a
neighbourhood. Graphs are searched on scaled single-precision vectors; scores are inner products of the original
vectors in double precision.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part;
rows that repeat id and vector count once; an id with several vectors is a candidate with each, and as a query
has the least of them; a null vec_id takes no part; ties go to the smaller
vec_id; vectors of another length are not candidates of a query; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, ship, stream_groups, table

SHARD, BLOCK = 8192, 256
LINKS, CANDIDATES, BEAM, UPPER_BEAM, AT_ONCE = 16, 32, 144, 16, 8
#: Nodes inserted together; of the first ones all pairs are looked at.
TOGETHER, FIRST = 256, 128


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v, dim) of the vectors that take part."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad).where(F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _choose(points: np.ndarray, rows: np.ndarray, near: np.ndarray, links: int) -> np.ndarray:
    """For rows, `links` diverse ones of their candidates (-1: none), which come nearest first."""
    mine = points[rows]
    far = np.where(near >= 0, ((points[near] - mine[:, None]) ** 2).sum(2), np.inf)
    chosen = np.full((len(rows), links), -1, np.int64)
    count, at = np.zeros(len(rows), int), np.arange(len(rows))
    for c in range(near.shape[1]):  # a candidate nearer to a chosen one than to the node is left out
        x = near[:, c]
        gap = ((points[x][:, None] - points[np.maximum(chosen, 0)]) ** 2).sum(2)
        ok = ((gap >= far[:, c, None]) | (chosen < 0)).all(1) & (count < links) & (x >= 0)
        chosen[at[ok], count[ok]] = x[ok]
        count[ok] += 1
    for c in range(near.shape[1]):  # then the nearest fill what is left
        x = near[:, c]
        ok = (count < links) & (x >= 0) & ~(chosen == x[:, None]).any(1)
        chosen[at[ok], count[ok]] = x[ok]
        count[ok] += 1
    return chosen


def _link_back(points: np.ndarray, links: np.ndarray, width: int, rows: np.ndarray, chosen: np.ndarray) -> None:
    """The second half of a node's links are the nearest of those that chose it."""
    r, c = np.nonzero(chosen >= 0)
    to, by = chosen[r, c], rows[r]
    told = np.unique(to)
    k, c = np.nonzero(links[told, width:] >= 0)
    to, by = np.r_[to, told[k]], np.r_[by, links[told[k], width + c]]
    order = np.lexsort((((points[to] - points[by]) ** 2).sum(1), to))
    to, by = to[order], by[order]
    place = np.arange(len(to)) - np.searchsorted(to, to)
    ok = place < width
    links[told, width:] = -1
    links[to[ok], width + place[ok]] = by[ok]


def _layer(points: np.ndarray, upper: list[np.ndarray], links: int) -> np.ndarray:
    """Flat neighbour array (n, 2 * links), -1 where there is none, grown by insertion in the order of points.

    upper: the layers above, lowest first; their nodes are the first of these points.
    """
    n = len(points)
    out = np.full((n, 2 * links), -1, np.int32)
    at = 0
    while at < n:
        rows = np.arange(at, min(n, at + (TOGETHER if at else FIRST)))
        q = points[rows]
        own = q @ q.T  # all pairs of the batch; norms are equal, so the largest product is the least distance
        np.fill_diagonal(own, -np.inf)
        k = min(CANDIDATES, len(rows) - 1)
        near = np.argsort(-own, axis=1, kind="stable")[:, :k]
        score = np.take_along_axis(own, near, 1)
        near = near + at
        if at:
            seeds = np.zeros((len(rows), 1), np.int64)
            for above in reversed(upper):
                found = _beam(points[: len(above)], above, q, np.minimum(seeds, len(above) - 1), 4)
                seeds = np.c_[np.where(found < at, found, -1), np.zeros(len(rows), np.int64)]
                seeds[:, :-1][seeds[:, :-1] == 0] = -1
            found = _beam(points[:at], out[:at], q, seeds, CANDIDATES)
            value = np.where(found >= 0, np.einsum("qkd,qd->qk", points[found], q), -np.inf)
            near, score = np.c_[found, near], np.c_[value, score]
            order = np.argsort(-score, axis=1, kind="stable")[:, :CANDIDATES]
            near = np.where(np.take_along_axis(score, order, 1) > -np.inf, np.take_along_axis(near, order, 1), -1)
        if near.shape[1]:
            chosen = _choose(points, rows, near, links)
            out[rows, :links] = chosen
            _link_back(points, out, links, rows, chosen)
        at = rows[-1] + 1
    return out


def build_graph(ids: np.ndarray, vectors: np.ndarray, keep: int) -> dict:
    """The shard's graph; keep: ids kept of each distinct vector (the smallest)."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    same = np.r_[False, (vectors[1:] == vectors[:-1]).all(1)]
    node = np.cumsum(~same) - 1
    again = same & np.r_[False, ids[1:] == ids[:-1]]
    first = np.flatnonzero(~same)
    # Higher nodes come first, so that a layer's nodes are the first ones of the layer below.
    draw = 1 - np.random.default_rng(len(first)).random(len(first))
    level = np.floor(-np.log(draw) / np.log(LINKS)).astype(int)
    turn = np.lexsort((draw, -level))
    place = np.empty(len(first), np.int64)
    place[turn] = np.arange(len(first))
    ids, node = ids[~again], place[node[~again]]
    order = np.lexsort((ids, node))
    ids, node = ids[order], node[order]
    rank = np.arange(len(node)) - np.searchsorted(node, node)
    ids, node = ids[rank < keep], node[rank < keep]
    exact, level = vectors[first[turn]], level[turn]
    points = _single(exact)
    norm = (points.astype(np.float64) ** 2).sum(1)
    tall = np.c_[points, np.sqrt(np.maximum(norm.max() - norm, 0))].astype(np.float32)
    layers: list[np.ndarray] = []
    for at in range(level.max(), -1, -1):
        layers.insert(0, _layer(tall[: np.searchsorted(-level, -at, side="right")], layers, LINKS))
    if (exact.astype(np.float32) == exact).all():
        exact = exact.astype(np.float32)
    return {"points": points, "exact": exact, "ids": ids, "starts": np.searchsorted(node, np.arange(len(points) + 1)), "layers": layers}


def _single(vectors: np.ndarray) -> np.ndarray:
    """In single precision, scaled to components of at most 1: the order of inner products stays."""
    top = np.abs(vectors).max()
    return (vectors / top).astype(np.float32)


def _beam(points: np.ndarray, links: np.ndarray, queries: np.ndarray, seeds: np.ndarray, width: int) -> np.ndarray:
    """For each query the best `width` nodes of a layer that a beam search from the seeds finds (-1: none), best first."""
    q, n = len(queries), len(points)
    rows = np.arange(q)[:, None]
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    seeds = np.where(seeds < 0, n, seeds)
    seen[rows, seeds] = True
    padded = np.r_[points, np.zeros((1, points.shape[1]), np.float32)]
    score = np.where(seeds < n, np.einsum("qkd,qd->qk", padded[seeds], queries), -np.inf).astype(np.float32)
    links = np.r_[np.where(links < 0, n, links), np.full((1, links.shape[1]), n)]
    beam, done = seeds, seeds == n
    while True:
        waiting = np.where(done, -np.inf, score)
        if not (waiting > -np.inf).any():
            break
        pick = np.argsort(-waiting, axis=1, kind="stable")[:, :AT_ONCE]
        live = np.take_along_axis(waiting, pick, 1) > -np.inf
        done[rows, pick] = True
        fresh = links[np.where(live, beam[rows, pick], n)].reshape(q, -1)
        fresh = np.where(seen[rows, fresh], n, fresh)
        fresh.sort(axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
        seen[rows, fresh] = True
        value = np.full(fresh.shape, -np.inf, np.float32)
        a, b = np.nonzero(fresh < n)
        value[a, b] = np.einsum("nd,nd->n", points[fresh[a, b]], queries[a])
        beam, score, done = np.c_[beam, fresh], np.c_[score, value], np.c_[done, fresh == n]
        best = np.argpartition(-score, min(width, score.shape[1]) - 1, axis=1)[:, :width]
        beam, score, done = beam[rows, best], score[rows, best], done[rows, best]
    best = np.argsort(-score, axis=1, kind="stable")
    beam, score = beam[rows, best], score[rows, best]
    return np.where(score > -np.inf, beam, -1)


def search_graph(graph: dict, own: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of each query's best k in the shard but its own id."""
    layers, points = graph["layers"], graph["points"]
    q32 = (queries / np.abs(queries).max(axis=1, keepdims=True)).astype(np.float32)
    seeds = np.zeros((len(queries), 1), np.int64)
    for links in reversed(layers[1:]):
        seeds = _beam(points[: len(links)], links, q32, seeds, UPPER_BEAM)
    found = _beam(points, layers[0], q32, seeds, max(BEAM, 2 * k))
    top = found[:, : k + 8]
    exact = np.einsum("qkd,qd->qk", graph["exact"][np.maximum(top, 0)].astype(np.float64), queries)
    out = []
    for i in range(len(queries)):
        ids, scores = [], []
        for node, s in zip(top[i].tolist(), exact[i].tolist()):
            if node >= 0:
                mine = graph["ids"][graph["starts"][node] : graph["starts"][node + 1]]
                ids.append(mine)
                scores.append(np.full(len(mine), s))
        ids, scores = np.concatenate(ids), np.concatenate(scores)
        keep = ids != own[i]
        out.append(best(ids[keep], scores[keep], k))
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["v"].tolist(), np.float64)


def build_index(rows: DataFrame, keep: int) -> DataFrame:
    """(dim, shard, shards, graph) from rows of `usable`: one row a shard."""
    ship(rows.sparkSession)
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    dealt = dealt.repartition(parts, "dim", "shard").sortWithinPartitions("dim", "shard")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (dim, shard, shards), pdf in stream_groups(batches, ["dim", "shard", "shards"]):
            graph = build_graph(pdf["vec_id"].to_numpy(np.int64), _matrix(pdf), keep)
            yield pd.DataFrame({"dim": [dim], "shard": [shard], "shards": [shards], "graph": [pickle.dumps(graph)]})

    return dealt.select("dim", "shard", "shards", "vec_id", "v").mapInPandas(run, "dim int, shard int, shards int, graph binary")


def search_index(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries of `usable`."""
    spark = queries.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-queries.count() // BLOCK))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int")).repartition(parts, "dim", "block").sortWithinPartitions("dim", "block", "vec_id")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (dim, block), pdf in stream_groups(batches, ["dim", "block"]):
            yield pd.DataFrame({"dim": [dim], "block": [block], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "data": [_matrix(pdf).tobytes()]})

    packed = dealt.select("dim", "block", "vec_id", "v").mapInPandas(pack, "dim int, block int, ids binary, data binary")
    # Each block goes to each shard once; a shard's graph comes before its blocks.
    shards = index.groupBy("dim").agg(F.max("shards").alias("shards"))
    ask = packed.join(shards, "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "block", "ids", "data")
    graphs = index.select("dim", "shard", F.lit(-1).alias("block"), F.lit(None).cast("binary").alias("ids"), F.col("graph").alias("data"))
    meet = graphs.unionByName(ask).repartition(parts, "dim", "shard").sortWithinPartitions("dim", "shard", "block")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = None
        for pdf in batches:
            for dim, block, ids, data in zip(pdf["dim"], pdf["block"], pdf["ids"], pdf["data"]):
                if block < 0:
                    graph = pickle.loads(data)
                    continue
                ids = np.frombuffer(ids, np.int64)
                found = search_graph(graph, ids, np.frombuffer(data, np.float64).reshape(len(ids), dim), k)
                yield pd.DataFrame({"dim": [dim], "block": [block], "ids": [ids.tobytes()], "counts": [np.array([len(f[0]) for f in found], np.int32).tobytes()], "found": [np.concatenate([f[0] for f in found]).tobytes()], "scores": [np.concatenate([f[1] for f in found]).tobytes()]})

    found = meet.mapInPandas(search, "dim int, block int, ids binary, counts binary, found binary, scores binary")
    found = found.repartition(parts, "dim", "block").sortWithinPartitions("dim", "block")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, tops = None, None, None

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(q, r + 1, v, s) for q, (vs, ss) in zip(ids.tolist(), tops) for r, (v, s) in enumerate(zip(vs.tolist(), ss.tolist()))], columns=["query_id", "rank", "vec_id", "score"])

        for pdf in batches:
            for dim, block, own, counts, f, s in zip(pdf["dim"], pdf["block"], pdf["ids"], pdf["counts"], pdf["found"], pdf["scores"]):
                if (dim, block) != key:
                    if key is not None:
                        yield rows()
                    key, ids = (dim, block), np.frombuffer(own, np.int64)
                    tops = [(np.empty(0, np.int64), np.empty(0))] * len(ids)
                cuts = np.cumsum(np.frombuffer(counts, np.int32))[:-1]
                tops = [best(np.r_[a, x], np.r_[b, y], k) for (a, b), x, y in zip(tops, np.split(np.frombuffer(f, np.int64), cuts), np.split(np.frombuffer(s, np.float64), cuts))]
        if key is not None:
            yield rows()

    return found.mapInPandas(merge, "query_id long, rank int, vec_id long, score double")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    index = Scratch(spark, "ann").write(build_index(rows, keep=21), "index")
    queries = rows.where("vec_id % 20 = 0").groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.v", "q.dim")
    return search_index(index, queries, k=20)
