from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tests.llm.conftest import ODD
from tidelog.llm import packing

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("word_bpe_49k.json")


def check(rows, capacity):
    """rows: (length, sequence_id, offset): sequences are gapless and within the capacity."""
    bins = {}
    for n, s, o in rows:
        bins.setdefault(s, []).append((o, n))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


def best_fit(lengths, capacity):
    """Sequential best fit, longest first."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_sequential_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 50, 64])
    lengths = [rng.choice([rng.randrange(1, capacity + 1), rng.randrange(1, 8), capacity // 3]) for _ in range(400)]
    plan = packing.sweep_plan({n: lengths.count(n) for n in set(lengths)}, capacity)
    rows, ranks = [], {}
    for n, first, end, each, bin0, offset in plan:
        for r in range(first, end):
            ranks.setdefault(n, []).append(r)
            rows.append((n, bin0 + (r - first) // each, offset + (r - first) % each * n))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(lengths.count(n))) for n in set(lengths)}
    assert check(rows, capacity) == best_fit(lengths, capacity)


def test_plan_size_does_not_grow_with_documents():
    few, many = {n: 10 for n in range(1, 257)}, {n: 10**9 for n in range(1, 257)}
    assert len(packing.sweep_plan(many, 256)) < 20 * 256 > len(packing.sweep_plan(few, 256))


def expected(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def test_odd_documents(odd):
    rows = packing.pack(packing.token_pieces(odd, PATH, capacity=64), capacity=64).collect()
    want = []
    for i, t in ODD:
        ids = expected(t)
        want += [(i, k, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 64))]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    n = check([(r["length"], r["sequence_id"], r["offset"]) for r in rows], 64)
    assert n == best_fit([w[3] for w in want], 64)


def test_no_documents(no_docs):
    assert packing.pack(packing.token_pieces(no_docs, PATH)).count() == 0


def test_hot_length(spark):
    """Most documents of one length: they are dealt out by rank over many partitions."""
    pieces = spark.range(5000).selectExpr("id AS doc_id", "0 AS piece", "CAST(CASE WHEN id % 3 = 0 THEN id % 50 + 1 ELSE 7 END AS bigint) AS length")
    rows = packing.pack(pieces, 64).collect()
    lengths = [r["length"] for r in rows]
    assert check([(r["length"], r["sequence_id"], r["offset"]) for r in rows], 64) == best_fit(lengths, 64)


def test_query_over_the_whole_table(spark, sf):
    rows = packing.op1_best_fit_packing(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == set(texts)
    total = sum(r["length"] for r in rows)
    assert check([(r["length"], r["sequence_id"], r["offset"]) for r in rows], 4096) <= -(-total // 4096) + 1
    for r in rows[:40]:
        ids = expected(texts[r["doc_id"]])[r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]


def test_ids_are_the_tokenizers_own():
    import pyarrow as pa

    rng = random.Random(11)
    letters = "abcdefgxyzßéèÿÑÀ'’.,!<|> \n\t0123日²́İKK_\x1c\x85\xa0Σ"
    texts = ["", None, "<|endoftext|>Foo", "a<|b", "It's we'LL 'tis", "x" * 3000] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 50))) for _ in range(1500)]
    encoder = packing.WordEncoder(PATH, cache_bytes=100_000)
    for _ in range(2):
        ids, ends = encoder.texts(pa.array(texts))
        for t, a, b in zip(texts, ends, ends[1:]):
            assert [*ids[a:b].tolist(), 1] == expected_of(encoder, t)


def expected_of(encoder, text):
    return [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(packing, "TOGETHER", 50)
    encoder = packing.WordEncoder(PATH)
    text = "some words, andé others \n of <|endoftext|> it " * 40
    assert [*encoder.long_text(text).tolist(), 1] == expected_of(encoder, text)


def test_merges_may_be_run_by_any_pair():
    """What `WordEncoder` builds on: each token, spelt alone, is merged into itself, and parts come before their whole."""
    import json

    with open(PATH, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, pairs = model["vocab"], {tuple(p): i for i, p in enumerate(model["merges"])}
    assert all(max(vocab[a], vocab[b]) < vocab[a + b] == 512 + i for (a, b), i in pairs.items())
    for token in vocab:
        parts = list(token.removesuffix("</w>"))
        if token.endswith("</w>"):
            parts[-1] += "</w>"
        while len(parts) > 1:
            rank, k = min((pairs.get(p, 1 << 30), k) for k, p in enumerate(zip(parts, parts[1:])))
            assert rank < 1 << 30, token
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert parts == [token]
