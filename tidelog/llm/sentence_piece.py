"""SentencePiece encoding and decoding in batched numpy.

A text, with white space escaped and the model's dummy prefix, is cut before each run of the space
mark; no piece reaches over such a cut, so each distinct unit is encoded once. Units of equal length
advance together, end by end. Substring hashes, from prefix sums of a polynomial hash, probe the sorted keys of the
pieces. For unigram models the pass takes vectorised maxima of scores over piece lengths and stores
backpointers. For BPE models the ids must be those of merging: there a piece may follow only a piece that
merging leaves beside it, so of the pieces that end at a place just one follows the last piece of its own
beginning; that one is the maximum, and its start the backpointer. Whether two pieces may stand side by side is
told by taking both apart in the reverse order of their merges: at no time may the neighbours at the seam
have been merged first. Verdicts are kept in a table of pairs. Characters without a piece become byte pieces, or the unknown id.

Defined results: null text is empty text and has no ids; an empty table gives no rows; repeated rows and null
ids give rows each; other columns are ignored. Supports identity normalisation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import ship, table

SPACE_MARK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Units a worker remembers; characters above which a unit goes alone, place by place.
CACHE_UNITS, LONG = 400_000, 256
#: Texts whose new units are encoded together.
TEXTS = 1000
#: Slots of the table of pairs of pieces.
PAIR_SLOTS = 1 << 20
#: A rank above all others: no piece, or never merged.
NEVER = 1 << 40

#: A mark in the text itself counts as a space, as in the library.
_UNIT = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")
_loaded: dict = {}


class Pieces:
    """The vocabulary as sorted substring keys."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], bpe: bool, add_prefix: bool = True):
        """kinds: normal, byte, unknown or control, a piece each."""
        self.bpe, self.add_prefix = bpe, add_prefix
        self.scores = np.array(scores, np.float64)
        normal = [i for i, k in enumerate(kinds) if k == "normal"]
        self.longest = max((len(pieces[i]) for i in normal), default=1)
        self.powers = np.ones(self.longest + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(1, self.longest + 1):
                self.powers[i] = self.powers[i - 1] * BASE
        keys = np.array([self.key(self.sums(np.array([[ord(c) for c in pieces[i]]], np.uint64)), np.array([0]), np.array([0]), len(pieces[i]))[0] for i in normal], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal, np.int64)[order]
        self.by_text = {pieces[i]: i for i in normal}
        self.bytes = {int(pieces[i][3:5], 16): i for i, k in enumerate(kinds) if k == "byte"}
        self.unknown = kinds.index("unknown") if "unknown" in kinds else 0
        self.surface = [bytes([int(p[3:5], 16)]) if k == "byte" else b"" if k == "control" else " ⁇ ".encode() if k == "unknown" else p.replace(SPACE_MARK, " ").encode() for p, k in zip(pieces, kinds)]
        self.cache: dict[str, bytes] = {}
        # Low bits of the keys that occur: most substrings are told to be no piece without a search.
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True
        if bpe:
            self._prepare(pieces, normal)

    def _prepare(self, pieces: list[str], normal: list[int]) -> None:
        """Ranks of merges, the last merge of each piece, and hashes; tokens from len(pieces) on are single characters without a piece."""
        n = len(pieces)
        self.many = n
        every = n + 0x110000
        self.rank = np.full(every, -1, np.int64)  # -1: there from the start
        order = sorted((i for i in normal if len(pieces[i]) > 1), key=lambda i: -self.scores[i])
        self.rank[order] = np.arange(len(order))
        rank_of = {pieces[i]: r for r, i in enumerate(order)}
        self.left, self.right = np.zeros(every, np.int32), np.zeros(every, np.int32)
        self.raw, self.size = np.zeros(every, np.uint64), np.ones(every, np.int8)
        self.raw[n:] = np.arange(1, 0x110001)
        self.reached = np.zeros(n, bool)
        for i in normal:
            text = pieces[i]
            h = 0
            for c in text:
                h = (h * int(BASE) + ord(c) + 1) % (1 << 64)
            self.raw[i], self.size[i] = h, len(text)
            parts = list(text)
            while len(parts) > 2:
                best, k = NEVER, 0
                for j in range(len(parts) - 1):
                    found = rank_of.get(parts[j] + parts[j + 1], NEVER)
                    if found < best:
                        best, k = found, j
                if best >= rank_of[text]:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.reached[i] = len(parts) <= 2  # else merging its characters never makes it
            if len(parts) == 2:
                self.left[i], self.right[i] = (self.by_text[p] if p in self.by_text else n + ord(p) for p in parts)
        self.pair_key = np.full(PAIR_SLOTS, -1, np.int64)
        self.pair_ok = np.zeros(PAIR_SLOTS, bool)
        self.verdicts: dict[tuple[int, int], bool] = {}

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the boundary between two tokens."""
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        absorbed_a, absorbed_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(at):
            rank_a, rank_b, size_b = self.rank[a], self.rank[b], self.size[b].astype(np.int64)
            length = self.size[a] + size_b
            fits = length <= self.longest
            with np.errstate(over="ignore"):
                h = self.raw[a] * self.powers[np.where(fits, size_b, 0)] + self.raw[b]
                key = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + length.astype(np.uint64)
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            merged = np.where(fits & (self.keys[place] == key), self.rank[self.ids[place]], NEVER)
            # Of equal merges the leftmost comes first: one that takes a away from the left before, one that takes b away to the right after.
            bad = (merged < absorbed_a) & (merged <= absorbed_b)
            ok[at[bad]] = False
            go = ~bad & ((rank_a >= 0) | (rank_b >= 0))
            at, a, b, rank_a, rank_b, absorbed_a, absorbed_b = (x[go] for x in (at, a, b, rank_a, rank_b, absorbed_a, absorbed_b))
            first = rank_a > rank_b  # the later merge is undone first
            absorbed_a, absorbed_b = np.where(first, rank_a, absorbed_a), np.where(first, absorbed_b, rank_b)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`_apart`, by the table of pairs."""
        pair = a * (self.many + 0x110000) + b
        with np.errstate(over="ignore"):
            slot = (pair.astype(np.uint64) * BASE >> np.uint64(44)).astype(np.int64)
        unknown = self.pair_key[slot] != pair
        out = self.pair_ok[slot]
        if unknown.any():
            new, at = np.unique(pair[unknown], return_inverse=True)
            found = self._apart(new // (self.many + 0x110000), new % (self.many + 0x110000))
            out[unknown] = found[at]
            with np.errstate(over="ignore"):
                slot = (new.astype(np.uint64) * BASE >> np.uint64(44)).astype(np.int64)
            # One of several pairs of a slot stays: key and verdict from the same one.
            slot, first = np.unique(slot, return_index=True)
            self.pair_key[slot], self.pair_ok[slot] = new[first], found[first]
        return out

    @classmethod
    def load(cls, path: str) -> Pieces:
        if path not in _loaded:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            kinds = ["unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) else "byte" if sp.is_byte(i) else "normal" for i in range(sp.vocab_size())]
            pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
            scores = [sp.get_score(i) for i in range(sp.vocab_size())]
            # A BPE model's scores are falling ranks, whole numbers; a unigram model's are log-probabilities.
            bpe = all(float(s).is_integer() for s in scores)
            _loaded[path] = cls(pieces, scores, kinds, bpe)
        return _loaded[path]

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """Prefix hashes of rows of code points."""
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(codes.shape[1]):
                out[:, i + 1] = out[:, i] * BASE + codes[:, i] + np.uint64(1)
        return out

    def key(self, sums: np.ndarray, row: np.ndarray, start: np.ndarray, length) -> np.ndarray:
        length = np.broadcast_to(np.asarray(length), np.shape(start))
        with np.errstate(over="ignore"):
            h = sums[row, start + length] - sums[row, start] * self.powers[length]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + length.astype(np.uint64)
        return h

    def probe(self, sums: np.ndarray, row: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Piece ids of substrings, -1 where there is none."""
        fits = (length <= self.longest) & (start + length < sums.shape[1])
        length, safe = np.where(fits, length, 1), np.where(fits, start, 0)
        key = self.key(sums, row, safe, length)
        out = np.full(len(key), -1, np.int64)
        near = np.flatnonzero(fits & self.maybe[key >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.keys, key[near]), len(self.keys) - 1)
        out[near] = np.where(self.keys[at] == key[near], self.ids[at], -1)
        return out

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "replace")] if self.bytes else [self.unknown]

    def encode_equal(self, units: list[str]) -> list[bytes]:
        """Ids, as little-endian 32-bit bytes, of distinct units of one length, in any order; faster if sorted."""
        size = len(units[0])
        if size > LONG and self.bpe:
            return [self._one(u) for u in units]
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(units), size).astype(np.uint64)
        sums = self.sums(codes)
        row, start = np.nonzero(self._bpe(sums, codes) if self.bpe else self._viterbi(sums, len(units), size))
        after = np.r_[start[1:], 0]
        length = np.where(np.r_[row[1:] != row[:-1], True], size, after) - start
        ids = self.probe(sums, row, start, length)
        cuts = np.searchsorted(row, np.arange(len(units) + 1)) * 4
        data = np.maximum(ids, 0).astype("<u4").tobytes()
        out = [data[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        for r in np.unique(row[ids < 0]).tolist():  # characters without a piece
            i, j = cuts[r] // 4, cuts[r + 1] // 4
            found: list[int] = []
            for k, at, n in zip(ids[i:j].tolist(), start[i:j].tolist(), length[i:j].tolist()):
                found += [k] if k >= 0 else self.fallback(units[r][at : at + n])
            out[r] = np.array(found, "<u4").tobytes()
        return out

    def _viterbi(self, sums: np.ndarray, n: int, size: int) -> np.ndarray:
        """Masks of piece starts, by the best sum of scores; an unknown character costs ten below the least."""
        worst = self.scores[self.ids].min() - 10 if len(self.ids) else -10.0
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, size + 1), np.int64)
        rows = np.arange(n)
        for end in range(1, size + 1):
            first = max(0, end - self.longest)
            start = np.arange(first, end)
            r, s = np.repeat(rows, len(start)), np.tile(start, n)
            piece = self.probe(sums, r, s, end - s).reshape(n, -1)
            value = np.where(piece >= 0, self.scores[np.maximum(piece, 0)], -np.inf)
            value[:, -1] = np.where(piece[:, -1] >= 0, value[:, -1], worst)
            value = value + best[:, first:end]
            pick = value.argmax(1)
            best[:, end], back[:, end] = value[rows, pick], first + pick
        mask = np.zeros((n, size + 1), bool)
        at = np.full(n, size)
        while (at > 0).any():
            at = np.where(at > 0, back[rows, at], 0)
            mask[rows, at] = True
        return mask[:, :size]

    def _bpe(self, sums: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Masks of piece starts: at each end, the one piece that may follow the last piece of what is before it."""
        n, size = codes.shape
        last = np.full((n, size + 1), -1, np.int64)  # the last token of each beginning
        back = np.zeros((n, size + 1), np.int64)
        rows = np.arange(n)
        # The units are sorted: what a unit shares with the one before it is not worked out again.
        shared = np.r_[0, (codes[1:] != codes[:-1]).argmax(1)]
        for end in range(1, size + 1):
            first = max(0, end - self.longest)
            start = np.arange(first, end)
            fresh = shared < end
            new = np.flatnonzero(fresh)
            tiled = np.tile(start, len(new))
            token = self.probe(sums, np.repeat(new, len(start)), tiled, end - tiled).reshape(len(new), -1)
            token = np.where((token >= 0) & self.reached[token], token, -1)
            token[:, -1] = np.where(token[:, -1] >= 0, token[:, -1], self.many + codes[new, end - 1].astype(np.int64))
            fit = token >= 0
            r, s = np.nonzero(fit[:, 1:] if first == 0 else fit)
            s = s + (first == 0)  # a piece from the very beginning follows nothing
            fit[r, s] = self.beside(last[new[r], first + s], token[r, s])
            pick = fit.argmax(1)
            spread = np.cumsum(fresh) - 1
            last[:, end], back[:, end] = token[rows[: len(new)], pick][spread], (first + pick)[spread]
        mask = np.zeros((n, size + 1), bool)
        at = np.full(n, size)
        while (at > 0).any():
            at = np.where(at > 0, back[rows, at], 0)
            mask[rows, at] = True
        return mask[:, :size]

    def _one(self, unit: str) -> bytes:
        """The same pass for one long unit, place by place."""
        n, many, verdicts = len(unit), self.many, self.verdicts
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                token = self.by_text.get(unit[start:end], -1)
                if token < 0 or not self.reached[token]:
                    if start < end - 1:
                        continue
                    token = many + ord(unit[start])
                if start:
                    pair = (last[start], token)
                    ok = verdicts.get(pair)
                    if ok is None:
                        if len(verdicts) > PAIR_SLOTS:
                            verdicts.clear()
                        ok = verdicts[pair] = bool(self.beside(np.array([pair[0]]), np.array([pair[1]]))[0])
                    if not ok:
                        continue
                last[end], back[end] = token, start
                break
        tokens, at = [], n
        while at > 0:
            tokens.append(last[at])
            at = back[at]
        ids: list[int] = []
        for t in reversed(tokens):
            ids += [t] if t < many else self.fallback(chr(t - many))
        return np.array(ids, "<u4").tobytes()

    def learn(self, units: set[str]) -> None:
        sizes: dict[int, list[str]] = {}
        for u in units:
            sizes.setdefault(len(u), []).append(u)
        for same in sizes.values():
            step = max(1, 400_000 // len(same[0]))
            same.sort()
            for i in range(0, len(same), step):
                some = same[i : i + step]
                self.cache.update(zip(some, self.encode_equal(some)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit bytes."""
        out: list[bytes] = []
        for i in range(0, len(texts), TEXTS):
            cut = [_UNIT.findall(((" " if self.add_prefix else "") + t).replace(" ", SPACE_MARK)) if t else [] for t in texts[i : i + TEXTS]]
            if len(self.cache) > CACHE_UNITS:
                self.cache.clear()
            unseen = {u for c in cut for u in c if u not in self.cache}
            if unseen:
                self.learn(unseen)
            out += [b"".join([self.cache[u] for u in c]) for c in cut]
        return out

    def decode(self, ids: bytes) -> str:
        surface = self.surface
        text = b"".join([surface[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if self.add_prefix and text.startswith(" ") else text


def encode_table(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, text): ids as bytes of 32-bit numbers, and the text they decode to."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces.load(model_path)
        for pdf in batches:
            for i in range(0, len(pdf), TEXTS):
                ids = pieces.encode(pdf["text"].iloc[i : i + TEXTS].tolist())
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[i : i + TEXTS].astype("Int64").to_numpy(), "ids": ids, "text": [pieces.decode(x) for x in ids]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids binary, text string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian 32-bit ids), decoded_sha256 of the text read back."""
    import public_tokenizers

    made = encode_table(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return made.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))
