"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Bulk-synchronous best fit. Documents are range-sorted by length and ranked, distributed; gaps are
kept range-sorted as runs of sequences with equal free space. One superstep a length, longest
first: the documents of that length sweep over the gap runs from the smallest gap that fits (the
successor) upwards, a document's rank within its length decides which sequence of a run it gets
when many want the same one, the gaps shrink, and the next superstep begins. As equal lengths and
equal gaps are interchangeable, a sweep moves whole runs: at most `capacity` supersteps, and
a run's gap at least halves each time it is used, so the plan has O(capacity * log capacity) rows
whatever the number of documents. Only that plan and a histogram over lengths reach the driver;
documents are placed by a broadcast join on (length, rank).

Defined results: null text is empty text (one end token); empty table gives no rows; repeated rows and
null ids are packed as rows of their own; other columns are ignored; a document longer than the
capacity is cut into full pieces, the last may be shorter.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, released, ship, table

#: Bytes of words and their ids that a worker remembers, about; the younger half stays when it is full.
CACHE_BYTES = 200_000_000
#: What an entry of the cache takes besides the word and the ids themselves.
ENTRY_BYTES = 170
#: Bytes of text that are encoded together; longer texts are cut at white space.
TOGETHER = 8_000_000

#: A lower-case Latin-1 word with ASCII punctuation after it: the tokenizer splits just there. Else the whole line.
_PLAIN = re.compile("^(?:([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-/:-@\\[-`{-~]*)|.*)$", re.M)
#: Stands for the mark of a word's end; no UTF-8 text holds this byte.
_END = b"\xff"
_loaded: dict = {}


class WordEncoder:
    """Ids of texts, word by word, for BPE models that drop white space and mark the ends of words.

    White space parts words and the pre-tokenizer never crosses it, so each distinct word of a batch is encoded
    once. The letters of plain words go straight to the merges, run by the faster of the two BPE
    libraries: it merges any neighbours that make a token, the tokenizer only the pair a token was made of.
    That is the same where each token, spelt alone, is merged into itself, and merges come after
    those of their parts (tested for the vocabulary in use); all other words take the whole tokenizer.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tiktoken._tiktoken import CoreBPE
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        # The byte alphabet: printable Latin-1 characters stand for themselves, others follow from U+0100 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        ranks = {}
        for token, i in vocab.items():
            text = token.removesuffix("</w>")
            ranks[bytes(byte[c] for c in text) + _END * (text != token)] = i
        self.merge = CoreBPE(ranks, {}, ".+").encode_single_piece
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.limit, self.size = cache_bytes // 2, 0

    def full(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Remembers the ids of words without white space."""
        cache, merge, ends, size = self.words, self.merge, {"": b""}, 0
        for word, (letters, end) in zip(words, _PLAIN.findall("\n".join(words).lower())):
            if letters and "<|" not in end:
                if end not in ends:
                    ends[end] = self.full(end)
                ids = array("I", merge(letters.encode() + _END)).tobytes() + ends[end]
            else:
                ids = self.full(word) if word else b""
            cache[word] = ids
            size += len(word) + len(ids)
        self.size += size + ENTRY_BYTES * len(words)

    def texts(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow array of texts end to end, and where each text's begin and end."""
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        # The tokenizer lower-cases all but its special tokens.
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if self.size > self.limit:
            self.older, self.words, self.size = self.words, {}, 0
        unseen = []
        for w in words:
            if w not in self.words:
                ids = self.older.get(w)
                if ids is None:
                    unseen.append(w)
                else:
                    self.words[w] = ids
                    self.size += ENTRY_BYTES + len(w) + len(ids)
        if unseen:
            self.learn(unseen)
        found = [self.words[w] for w in words]
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = (np.cumsum(sizes) - sizes)[at]
        sizes = sizes[at]
        ends = np.r_[0, np.cumsum(sizes)]
        ids = flat[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])]
        offsets = split.offsets.to_numpy()
        return ids, ends[offsets - offsets[0]]

    def long_text(self, text: str) -> np.ndarray:
        """The ids of one text, which is cut at white space."""
        import pyarrow as pa

        parts, at = [], 0
        while at < len(text):
            found = _SPACE.search(text, at + TOGETHER)
            end = found.start() if found else len(text)
            parts.append(self.texts(pa.array([text[at:end]]))[0])
            at = end
        return np.concatenate(parts)


_SPACE = re.compile(r"[\x20\x09-\x0D]")


def encoder(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def _together(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about TOGETHER bytes; a larger row alone."""
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > TOGETHER:
            yield start, i
            start, held = i, 0
        held += size
    if len(sizes):
        yield start, len(sizes)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and its end id, cut at the capacity."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        words, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for i, j in _together(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)):
                if j - i == 1 and texts[i].is_valid and len(texts[i].as_buffer()) > TOGETHER:
                    ids = words.long_text(texts[i].as_py())
                    cuts = np.array([0, len(ids)])
                else:
                    ids, cuts = words.texts(texts.slice(i, j - i))
                data = memoryview(ids.astype("<u4", copy=False).tobytes())
                rows, piece, start, length, crc = [], [], [], [], []
                for row, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                    n = b - a + 1
                    for k, at in enumerate(range(0, n, capacity)):
                        size = min(capacity, n - at)
                        last = at + size == n
                        value = zlib.crc32(data[4 * (a + at) : 4 * (a + at + size - last)])
                        rows.append(i + row)
                        piece.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(end, value) if last else value)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(released(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end rank, documents a sequence, first sequence, offset) of best fit, longest first."""
    plan, runs, sizes, opened = [], {}, [], 0

    def add(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in runs:
                insort(sizes, gap)
            runs.setdefault(gap, []).append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, end = 0, histogram[length]
        while rank < end:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, count = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], sizes[at]
            else:
                gap, first, count = capacity, opened, -(-(end - rank) // (capacity // length))
                opened += count
            each = gap // length
            full = min(count, (end - rank) // each)
            if full:
                plan.append((length, rank, rank + full * each, each, first, capacity - gap))
                rank += full * each
                add(gap - each * length, first, full)
            if full < count and rank < end:  # fewer documents are left than fit into one sequence
                plan.append((length, rank, end, end - rank, first + full, capacity - gap))
                add(gap - (end - rank) * length, first + full, 1)
                rank, full = end, full + 1
            add(gap, first + full, count - full)
    return plan


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to rows with a length from 1 to the capacity."""
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(pieces, "pieces")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["length", "doc_id", "piece"]
    placed = pieces.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = scratch.write(placed, "sorted")
    scratch.drop("pieces")
    part = F.shiftright("__at", 33)
    # One row for each length and partition; as partitions are ranges, at most partitions + capacity rows.
    seen = placed.groupBy("length", part.alias("part")).agg(F.count("*").alias("n"), F.min("__at").alias("first")).collect()
    total: dict[int, int] = {}
    base = []
    for row in sorted(seen):
        base.append((row["length"], row["part"], row["first"] - total.get(row["length"], 0)))
        total[row["length"]] = total.get(row["length"], 0) + row["n"]
    plan = sweep_plan(total, capacity)
    base_df = spark.createDataFrame(base, "__length long, __part long, __less long")
    plan_df = spark.createDataFrame(plan, "__len long, __from long, __to long, __each long, __sequence long, __offset long")
    ranked = placed.join(F.broadcast(base_df), (F.col("length") == F.col("__length")) & (part == F.col("__part"))).withColumn("__rank", F.col("__at") - F.col("__less"))
    at = F.col("__rank") - F.col("__from")
    found = ranked.join(F.broadcast(plan_df), (F.col("length") == F.col("__len")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
    return found.select(
        *pieces.columns,
        (F.col("__sequence") + F.floor(at / F.col("__each"))).cast("long").alias("sequence_id"),
        (F.col("__offset") + at % F.col("__each") * F.col("length")).cast("long").alias("offset"),
    )


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
