"""Exact Jaccard self-join of documents on word shingles, by a token-group matrix.

1. Equal shingle sets become one set (id: 64 bits of a digest of the sorted shingles).
2. Shingles get one global order: rarest first, by the number of sets that hold them. With J >= t two
   linked sets share a shingle within the first n - ceil(t n) + 1 of each. Shingles of one set only
   come first, so a set with enough of them links with nothing and is done. Counting runs on
   packed arrays, dealt by shingle; shingles that a sample shows in HOT_SHARE of sets or more
   are not counted but come last in the order (at most mean set size / HOT_SHARE of them).
3. Sets that share such a shingle are partitioned into clusters, a superset of the true groups.
4. A cluster is cut into blocks of bounded size; each pair of blocks is one unit of work. In it,
   sets are sorted by min-hash into small groups of similar ones, each group's token union is a row
   of the matrix, |Q & union| >= ceil(t |Q|) decides which groups a query opens, and only members of
   opened groups that are not yet in the query's component are compared, exactly.
5. Links, at most one a set and unit, are joined into components.

No step emits pairs of a group. Defined results: null, empty or blank texts have no shingles, link with
nothing and are components of their own; repeated rows are copies; a null doc_id takes part but never
names a component (null if nothing else is reachable); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, released, ship, table
from tidelog.llm.graph import connected_components

MULTIPLY, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Sets in the sample that finds hot shingles, and the share of them that makes one hot.
SAMPLE_SETS, HOT_SHARE, SAMPLE_PARTS = 4096, 0.02, 16
#: Shingles a counting task gets about; sets and shingles of a block; sets of a matrix group.
BUCKET_SHINGLES, BLOCK_SETS, BLOCK_SHINGLES, GROUP_SETS = 1_500_000, 512, 1_000_000, 16
CHUNK_SETS, CHUNK_SHINGLES = 2000, 2_000_000
#: Counts of sets stop here; entries of a bucket that are held before those of such shingles go on.
MANY, HELD_SHINGLES = 255, 6_000_000
#: doc_ids from here on stand for null.
NULL_ID = 1 << 62


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; fewer words are one shingle."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(words))
    with np.errstate(over="ignore"):
        s = h[: len(h) - k + 1] + np.uint64(k)
        for i in range(1, k):
            s = s * MULTIPLY + h[i : len(h) - k + 1 + i]
        s ^= s >> np.uint64(32)
        s *= MIX
        s ^= s >> np.uint64(29)
    return np.unique(s)


def set_id(s: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(s.tobytes()) >> 1  # non-negative long


def need(n, t: int):
    """The least overlap of a set of n with one it links with: ceil(t % of n)."""
    return (t * n + 99) // 100


def set_table(docs: DataFrame, n: int, sampled_of: int) -> DataFrame:
    """(doc_id, id, text_hash, n_shingles, sid, sample): sid null for empty sets; sample: the shingles, for one set in sampled_of."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text_hash, text in zip(pdf["id"], pdf["text_hash"], pdf["text"]):
                s = shingle_set(text, n)
                sid = set_id(s) if len(s) else None
                rows.append((i, text_hash, len(s), sid, s.tobytes() if sid is not None and sid % sampled_of == 0 else None))
            got = pd.DataFrame(rows, columns=["id", "text_hash", "n_shingles", "sid", "sample"])
            yield got.assign(sid=pd.array([r[3] for r in rows], "Int64"))

    found = docs.select("id", "text_hash", "text").mapInPandas(released(run), "id long, text_hash long, n_shingles long, sid long, sample binary")
    return found.withColumn("doc_id", F.when(F.col("id") < NULL_ID, F.col("id")))


def hot_shingles(sets: DataFrame) -> np.ndarray:
    """Sorted shingles held by HOT_SHARE of the sampled sets or more, 9 sets at least. Tasks count on their own and deal counts by shingle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [np.frombuffer(x, np.uint64) for pdf in batches for x in pdf["sample"]]
        tokens, times = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
        part = (tokens % np.uint64(SAMPLE_PARTS)).astype(int)
        yield pd.DataFrame([(k, len(parts), tokens[part == k].tobytes(), times[part == k].astype(np.int32).tobytes()) for k in range(SAMPLE_PARTS)], columns=["part", "sets", "tokens", "times"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, at = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["tokens"]]), return_inverse=True)
        times = np.bincount(at, weights=np.concatenate([np.frombuffer(x, np.int32) for x in pdf["times"]]), minlength=len(tokens))
        return pd.DataFrame({"hot": [tokens[times >= max(9, HOT_SHARE * pdf["sets"].sum())].tobytes()]})

    sample = sets.where("sample is not null").dropDuplicates(["sid"]).select("sample")
    got = sample.mapInPandas(count, "part int, sets int, tokens binary, times binary").groupBy("part").applyInPandas(add, "hot binary").collect()
    return np.unique(np.concatenate([np.empty(0, np.uint64), *[np.frombuffer(bytes(r["hot"]), np.uint64) for r in got]]))


class Labels:
    """Union-find over hashable ids; the root is the smallest."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y] if y in up else y
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _low(tokens: np.ndarray) -> np.ndarray:
    """48 bits of each shingle stand for it while counting; a clash can only add candidates."""
    return np.unique(tokens >> np.uint64(16))


BLOB = "bucket long, sids binary, at binary, tokens binary, own_sids binary, own_sizes binary, hot_tokens binary, hot_sids binary"
SHARED = "deal long, sids binary, at binary, tokens binary, counts binary, own_sids binary, own_sizes binary, hot_tokens binary, hot_sids binary"


def _binary(data: np.ndarray, cuts: np.ndarray):
    """An Arrow array of the rows data[cuts[i]:cuts[i + 1]], as bytes."""
    import pyarrow as pa

    size = data.itemsize * (data.shape[1] if data.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _rows(name: str, key, sids, tokens, counts, at_type, own: tuple, hot: tuple):
    """An Arrow batch with a row for each key: the entries (sid, token), own (key, sid, sizes) and hot (key, token, sid) of that key.

    Entries of one key are in the order of sids. No loop over keys: the cost is that of sorting.
    """
    import pyarrow as pa

    rows = np.unique(np.concatenate([key, own[0], hot[0]]))

    def cuts(sorted_keys: np.ndarray) -> np.ndarray:
        return np.r_[np.searchsorted(sorted_keys, rows), len(sorted_keys)]

    ends = cuts(key)
    fresh = np.r_[True, (key[1:] != key[:-1]) | (sids[1:] != sids[:-1])] if len(key) else np.empty(0, bool)
    heads = np.flatnonzero(fresh)
    sets = np.searchsorted(heads, ends)
    local = np.cumsum(fresh) - 1 - np.repeat(sets[:-1], np.diff(ends))
    six = tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    columns = [pa.array(rows, pa.int64()), _binary(sids[heads], sets), _binary(local.astype(at_type), ends), _binary(six, ends)]
    names = [name, "sids", "at", "tokens"]
    if counts is not None:
        columns.append(_binary(counts, ends))
        names.append("counts")
    for kind, parts in (("own", own), ("hot", hot)):
        order = np.argsort(parts[0], kind="stable")
        each = cuts(parts[0][order])
        columns += [_binary(x[order], each) for x in parts[1:]]
        names += ["own_sids", "own_sizes"] if kind == "own" else ["hot_tokens", "hot_sids"]
    return pa.RecordBatch.from_arrays(columns, names)


def pack_tokens(docs: DataFrame, n: int, t: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """Each chunk's (set, shingle) entries, dealt to buckets by shingle as packed arrays.

    own_sizes, sent to one bucket only: light shingles of the set, and how many of the order's first it
    must post. Sets whose prefix reaches the hot shingles post those right here.
    """
    hot_low = np.unique(hot >> np.uint64(16))

    def run(batches):
        seen: set[int] = set()  # copies within the task are sent once
        sids, sizes, light, post_t, post_s, held = [], [], [], [], [], 0
        for batch in batches:
            for text in batch.column(0):
                s = shingle_set(text.as_py(), n)
                if not len(s) or (sid := set_id(s)) in seen:
                    continue
                seen.add(sid)
                low, prefix = _low(s), len(s) - need(len(s), t) + 1
                if len(hot_low):
                    at = np.minimum(np.searchsorted(hot_low, low), len(hot_low) - 1)
                    is_hot = hot_low[at] == low
                    mine, low = low[is_hot], low[~is_hot]
                    if prefix > len(low):
                        mine = mine[: prefix - len(low)]
                        post_t.append(mine)
                        post_s.append(np.full(len(mine), sid, np.int64))
                sids.append(sid)
                sizes.append((len(low), prefix))
                light.append(low)
                held += len(low)
                if len(sids) >= CHUNK_SETS or held >= CHUNK_SHINGLES:
                    yield _deal(np.array(sids, np.int64), np.array(sizes, np.int32).reshape(-1, 2), light, post_t, post_s, buckets)
                    sids, sizes, light, post_t, post_s, held = [], [], [], [], [], 0
        if sids:
            yield _deal(np.array(sids, np.int64), np.array(sizes, np.int32).reshape(-1, 2), light, post_t, post_s, buckets)

    return docs.select("text").mapInArrow(released(run), BLOB)


def _deal(sids, sizes, light, post_t, post_s, buckets: int):
    tokens = np.concatenate(light)
    at = np.repeat(np.arange(len(sids)), [len(x) for x in light])
    bucket = (tokens % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    hot_t, hot_s = (np.concatenate(post_t), np.concatenate(post_s)) if post_t else (np.empty(0, np.uint64), np.empty(0, np.int64))
    hot_bucket = (hot_t % np.uint64(buckets)).astype(np.int64)
    return _rows("bucket", bucket[order], sids[at[order]], tokens[order], None, np.uint16, (sids % buckets, sids, sizes), (hot_bucket, hot_t, hot_s))


def _eight(six: bytes) -> np.ndarray:
    a = np.zeros((len(six) // 6, 8), np.uint8)
    a[:, :6] = np.frombuffer(six, np.uint8).reshape(-1, 6)
    return a.view("<u8").ravel()


class Bucket:
    """The entries of one bucket, as they come; those of a shingle that MANY sets hold don't wait for the others."""

    def __init__(self, deals: int, limit: int):
        self.deals, self.limit = deals, limit
        self.tokens: list[np.ndarray] = []
        self.sids: list[np.ndarray] = []
        self.held, self.full = 0, np.empty(0, np.uint64)
        self.own: list[tuple] = []
        self.hot: list[tuple] = []

    def add(self, sids, at, tokens, own_sids, own_sizes, hot_tokens, hot_sids):
        self.own.append((np.frombuffer(own_sids, np.int64), np.frombuffer(own_sizes, np.int32).reshape(-1, 2)))
        self.hot.append((np.frombuffer(hot_tokens, np.uint64), np.frombuffer(hot_sids, np.int64)))
        self.tokens.append(_eight(tokens))
        self.sids.append(np.frombuffer(sids, np.int64)[np.frombuffer(at, np.uint16)])
        self.held += len(self.tokens[-1])
        if self.held > self.limit:
            yield from self.out(False)
            self.limit = max(self.limit, 2 * self.held)  # what is left are few entries a shingle

    def out(self, last: bool):
        """Entries whose shingle two sets or more have, with min(MANY, that number), dealt by set; before the last, only the full ones."""
        tokens, sids = (np.concatenate(self.tokens), np.concatenate(self.sids)) if self.tokens else (np.empty(0, np.uint64), np.empty(0, np.int64))
        order = np.lexsort((sids, tokens))
        tokens, sids = tokens[order], sids[order]
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (sids[1:] != sids[:-1])  # the same set from several tasks
        tokens, sids = tokens[fresh], sids[fresh]
        starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.empty(0, int)
        each = np.diff(np.r_[starts, len(tokens)])
        each[np.isin(tokens[starts], self.full)] = MANY
        self.full = np.union1d(self.full, tokens[starts[each >= MANY]])
        count = np.minimum(np.repeat(each, np.diff(np.r_[starts, len(tokens)])), MANY).astype(np.uint8)
        keep = count > 1 if last else count == MANY
        self.tokens, self.sids = [tokens[~keep]], [sids[~keep]]
        self.held = len(self.tokens[0])
        tokens, sids, count = tokens[keep], sids[keep], count[keep]
        deal = sids % self.deals
        order = np.lexsort((sids, deal))
        own_s, own_n = (np.concatenate(x) for x in zip(*self.own)) if self.own else (np.empty(0, np.int64), np.empty((0, 2), np.int32))
        hot_t, hot_s = (np.concatenate(x) for x in zip(*self.hot)) if self.hot else (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.own, self.hot = [], []
        if len(tokens) or len(own_s) or len(hot_t):
            yield _rows("deal", deal[order], sids[order], tokens[order], count[order], np.uint32, (own_s % self.deals, own_s, own_n), (hot_s % self.deals, hot_t, hot_s))


def count_tokens(blobs: DataFrame, deals: int, parts: int) -> DataFrame:
    """From each bucket, the entries whose shingle two sets or more have, with min(MANY, that number), dealt by set.

    A bucket's rows are streamed, so that a shingle of very many sets is never held whole.
    """

    def run(batches):
        key, bucket = None, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[0] != key:
                    if bucket is not None:
                        yield from bucket.out(True)
                    key, bucket = row[0], Bucket(deals, HELD_SHINGLES)
                yield from bucket.add(*row[1:])
        if bucket is not None:
            yield from bucket.out(True)

    return blobs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(released(run), SHARED)


def post_prefixes(shared: DataFrame) -> DataFrame:
    """(token, a, b): the prefix shingles of sets, one row for each shingle and deal, with token null for links inside a deal."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known, first = np.unique(np.frombuffer(b"".join(pdf["own_sids"]), np.int64), return_index=True)
        light, prefix = np.frombuffer(b"".join(pdf["own_sizes"]), np.int32).reshape(-1, 2)[first].astype(np.int64).T
        who = [np.searchsorted(known, np.frombuffer(s, np.int64))[np.frombuffer(at, np.uint32)] for s, at in zip(pdf["sids"], pdf["at"]) if s]
        tokens = [_eight(t) for t in pdf["tokens"]]
        counts = [np.frombuffer(c, np.uint8) for c in pdf["counts"]]
        out_t = [np.frombuffer(b"".join(pdf["hot_tokens"]), np.uint64)]
        out_s = [np.frombuffer(b"".join(pdf["hot_sids"]), np.int64)]
        if who:
            who, tokens, counts = np.concatenate(who), np.concatenate(tokens), np.concatenate(counts)
            order = np.lexsort((tokens, counts, who))
            who, tokens = who[order], tokens[order]
            once = np.r_[True, (who[1:] != who[:-1]) | (tokens[1:] != tokens[:-1])]  # copies of a set, met apart
            who, tokens = who[once], tokens[once]
            n_shared = np.bincount(who, minlength=len(known))
            first = np.cumsum(n_shared) - n_shared
            rank = np.arange(len(who)) - first[who]
            keep = rank < (prefix - (light - n_shared))[who]
            out_t.append(tokens[keep])
            out_s.append(known[who[keep]])
        tokens, sids = np.concatenate(out_t), np.concatenate(out_s)
        order = np.lexsort((sids, tokens))
        tokens, sids = tokens[order], sids[order]
        fresh = np.r_[True, tokens[1:] != tokens[:-1]] if len(tokens) else np.empty(0, bool)
        head = sids[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(tokens) else sids
        inner = pd.DataFrame({"token": pd.array([None] * int((~fresh).sum()), "Int64"), "a": sids[~fresh], "b": head[~fresh]}).drop_duplicates()
        posts = pd.DataFrame({"token": pd.array(tokens[fresh].astype(np.int64), "Int64"), "a": sids[fresh], "b": sids[fresh]})
        return pd.concat([inner, posts], ignore_index=True)

    return shared.groupBy("deal").applyInPandas(run, "token long, a long, b long")


def _forest(edges: DataFrame) -> DataFrame:
    """The same components from fewer links: a spanning forest of each partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labels, last, head = Labels(), None, None
        for pdf in batches:
            for token, a, b in zip(pdf["token"].to_numpy(), pdf["a"].to_numpy(), pdf["b"].to_numpy()):
                a, b = int(a), int(b)
                if a != b:
                    labels.join(a, b)
                if token == token and token is not None:
                    if token == last:
                        labels.join(a, head)
                    last, head = token, a
        nodes = list(labels.up)
        roots = [labels.find(x) for x in nodes]
        yield pd.DataFrame([(x, r) for x, r in zip(nodes, roots) if x != r], columns=["a", "b"], dtype="int64")

    return edges.mapInPandas(run, "a long, b long")


def link_sets(sets: list[np.ndarray], t: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets that make their components (a spanning forest); with sides, only links across count."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    labels, links = np.arange(m), []

    def test(q: int, others: np.ndarray, overlap: np.ndarray) -> None:
        linked = others[100 * overlap >= t * (sizes[q] + sizes[others] - overlap)]
        for o in linked.tolist():
            if labels[o] != labels[q]:
                links.append((q, o))
                labels[labels == labels[o]] = labels[q]

    with np.errstate(over="ignore"):
        order = np.argsort([(s * MULTIPLY).min() for s in sets], kind="stable")
    flat, ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    mark = np.zeros(len(flat), np.int32)
    offsets = np.r_[0, np.cumsum(sizes[order])]
    heads = np.arange(0, m, GROUP_SETS)
    unions = [np.unique(ids[offsets[g] : offsets[min(m, g + GROUP_SETS)]]) for g in heads]
    union_flat, union_at = np.concatenate(unions), np.r_[0, np.cumsum([len(u) for u in unions])[:-1]]
    for place, q in enumerate(order.tolist()):
        mine = ids[offsets[place] : offsets[place + 1]]
        mark[mine] = 1
        first = place // GROUP_SETS
        bound = np.add.reduceat(mark[union_flat[union_at[first] :]], union_at[first:] - union_at[first])
        for g in (np.flatnonzero(bound >= need(sizes[q], t)) + first).tolist():
            spots = np.arange(max(place + 1, heads[g]), min(m, heads[g] + GROUP_SETS))
            others = order[spots]
            fit = labels[others] != labels[q]
            if side is not None:
                fit &= side[others] != side[q]
            spots, others = spots[fit], others[fit]
            if len(spots):
                test(q, others, np.array([mark[ids[offsets[p] : offsets[p + 1]]].sum() for p in spots]))
        mark[mine] = 0
    return links


def verify(units: DataFrame, n: int, t: int) -> DataFrame:
    """(a, b) links from rows (cluster, x, y, block, sid, text) sorted by (cluster, x, y)."""

    def unit(rows: list[tuple]) -> list[tuple[int, int]]:
        found = {}
        for x, y, block, sid, text in rows:
            if sid not in found:
                s = shingle_set(text, n)
                if len(s) and set_id(s) == sid:
                    found[sid] = (s, block, x != y)
        if len(found) < 2:
            return []
        sids = list(found)
        side = np.array([found[i][1] for i in sids]) if found[sids[0]][2] else None
        return [(sids[a], sids[b]) for a, b in link_sets([found[i][0] for i in sids], t, side)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows = None, []
        for pdf in batches:
            out = []
            for cluster, x, y, block, sid, text in zip(pdf["cluster"], pdf["x"], pdf["y"], pdf["block"], pdf["sid"], pdf["text"]):
                if (cluster, x, y) != key:
                    out += unit(rows)
                    key, rows = (cluster, x, y), []
                rows.append((x, y, block, sid, text))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        yield pd.DataFrame(unit(rows), columns=["a", "b"], dtype="int64")

    return units.mapInPandas(released(run), "a long, b long")


def _labelled(docs: DataFrame, n: int, t: int) -> DataFrame:
    """A row for each row of docs: doc_id, id, text_hash, n_shingles, sid, group (smallest sid reachable) and low (its smallest id)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    # A null doc_id gets an id by its text, above all others.
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    docs = docs.withColumn("id", F.coalesce("doc_id", F.lit(NULL_ID) + F.shiftrightunsigned("text_hash", 3)))
    total = docs.count()
    found = scratch.write(set_table(docs, n, max(1, total // SAMPLE_SETS)), "sets")
    hot = hot_shingles(found)
    sets = found.where("sid is not null").groupBy("sid").agg(F.min("id").alias("rep"), F.max("n_shingles").alias("size"))
    shingles = found.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(32, shingles // BUCKET_SHINGLES)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A task for each bucket, so that a task's share doesn't grow with the input.
    counted = count_tokens(pack_tokens(docs, n, t, buckets, hot), buckets, max(parts, buckets))
    posted = scratch.write(post_prefixes(counted.repartition(max(parts, buckets), "deal")), "posted")
    dealt = posted.repartition(parts, F.coalesce("token", "a")).sortWithinPartitions("token")
    clusters = connected_components(_forest(dealt), "jaccard-clusters").select(F.col("node").alias("sid"), F.col("component").alias("cluster"))

    members = scratch.write(clusters.join(sets, "sid"), "members")
    scratch.drop("posted")
    blocks = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.count("*").alias("many")).where("many > 1")
    members = members.join(blocks, "cluster").select("cluster", "sid", "rep", "blocks", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("block"))
    # Merged in every case: it splits hot clusters, and the plan is the same at every size.
    texts = docs.join(members.hint("merge"), F.col("id") == F.col("rep")).select("cluster", "sid", "blocks", "block", "text")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = texts.withColumn("other", other).select("cluster", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "sid", "text")
    units = units.repartition(parts, "cluster", "x", "y").sortWithinPartitions("cluster", "x", "y")
    links = scratch.write(verify(units, n, t), "links")
    grouped = connected_components(links, "jaccard-links")
    scratch.drop("links", "members")
    named = grouped.join(sets.withColumnRenamed("sid", "node"), "node").groupBy("component").agg(F.min("rep").alias("low"))
    low = grouped.join(named, "component").select(F.col("node").alias("sid"), F.col("component").alias("group"), "low")
    by_set = sets.join(low, "sid", "left").select("sid", F.coalesce("group", "sid").alias("group"), F.coalesce("low", "rep").alias("low"))
    return found.join(by_set, "sid", "left").select("doc_id", "id", "text_hash", "n_shingles", "sid", "group", "low")


def jaccard_components(docs: DataFrame, n: int = 5, t: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs; linked where 100 |A & B| >= t |A | B|."""
    component = F.coalesce("low", "doc_id")
    return _labelled(docs, n, t).select("doc_id", "n_shingles", F.when(component < NULL_ID, component).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, t: int = 80) -> DataFrame:
    """One document of each component, that with the smallest doc_id, with all its columns; documents without shingles all stay."""
    labelled = _labelled(docs, n, t)
    first = labelled.where("sid is not null").groupBy("group").agg(F.min(F.struct("id", "text_hash")).alias("k")).select("k.id", "k.text_hash")
    keys = first.unionByName(labelled.where("sid is null").select("id", "text_hash").distinct())
    # The user's columns travel in a struct, whatever their names.
    text_hash = F.xxhash64("text")
    marked = docs.select(F.struct(*docs.columns).alias("row"), text_hash.alias("text_hash"), F.coalesce("doc_id", F.lit(NULL_ID) + F.shiftrightunsigned(text_hash, 3)).alias("id"))
    return marked.join(keys, ["id", "text_hash"], "left_semi").dropDuplicates(["id", "text_hash"]).select("row.*")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, t=85)
