from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tests.llm.conftest import ODD
from tidelog.llm import sentence_piece

tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_equal_the_library(library, spark, sf):
    ours = sentence_piece.Pieces.load(PATH)
    assert ours.bpe
    rng = random.Random(3)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["".join(rng.choice(["a", "the ", "ing", "é", " ", "  ", "\n", "日本", "🙂", "▁", "<0x41>", "1", "xyz", "́"]) for _ in range(rng.randrange(30))) for _ in range(400)]
    texts += ["a" * 500 + " " + "ab" * 300, "", " ", "   ", "ing" * 40]
    for t, ids in zip(texts, ours.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t), t[:60]
        assert ours.decode(ids) == library.decode(library.encode(t)), t[:60]


def toy(bpe=False):
    pieces = ["<unk>", "<s>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "ca"]
    scores = [0, 0, -3.5, -2.1, -2.2, -2.3, -2.5, -2.4, -6.9, -3.0, -2.05]
    return sentence_piece.Pieces(pieces, scores, ["unknown", "control", *["normal"] * 9], bpe, add_prefix=False)


def test_viterbi_against_all_segmentations():
    m = toy()
    score = dict(zip(m.by_text, [m.scores[i] for i in m.by_text.values()]))
    worst = min(score.values()) - 10

    def best(u):
        if not u:
            return 0.0, []
        out = []
        for n in range(1, len(u) + 1):
            s = score.get(u[:n], worst if n == 1 else None)
            if s is not None:
                rest = best(u[n:])
                out.append((s + rest[0], [u[:n], *rest[1]]))
        return max(out, key=lambda x: x[0])

    rng = random.Random(1)
    units = list({"".join(rng.choice("aabbcc▁x") for _ in range(rng.randrange(1, 9))) for _ in range(300)})
    by_size = {}
    for u in units:
        by_size.setdefault(len(u), []).append(u)
    for same in by_size.values():
        for u, ids in zip(same, m.encode_equal(same)):
            got = np.frombuffer(ids, "<u4").tolist()
            total = sum(m.scores[i] if i else worst for i in got)
            assert total == pytest.approx(best(u)[0]), u


def test_odd_documents(odd, no_docs, library):
    rows = sentence_piece.encode_table(odd, PATH).collect()
    want = sorted((str(i), library.encode(t) if t else []) for i, t in ODD)
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in rows) == want
    assert sentence_piece.encode_table(no_docs, PATH).count() == 0


def test_query(spark, sf, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sentence_piece.op10_sentencepiece(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows[:50]:
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_ids"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
