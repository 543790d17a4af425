"""Main text of web pages: host suffix arrays over token streams, with the markup as context.

A page becomes a stream of blocks, each with the context of its markup: main (inside <article>, <main>
or the like), boilerplate (inside menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, comments, by element, whole class, id or role), or neutral. The token streams of a host's pages,
main blocks and the others apart, are concatenated and their suffixes sorted; runs of RUN tokens or more, and
shorter blocks as a whole, are boilerplate of the host if they are on SHARE of its distinct pages and on
LEAST_PAGES of them at least (more for main text): fewer may be copied articles. Main blocks, and neutral
blocks of a page without main text, lose the covered tokens and keep the others; a page with main text keeps
of what lies outside it the blocks of RUN tokens or more that the host's suffix array shows to be unique.

A host's pages are cut into shards of about SHARD_PAGES pages, so that a hot host is many tasks. A run on a
share of the host's pages is on that share of some shard's, so the suffix arrays of the shards propose
runs, all shards count them by hash, and the sums decide: results don't depend on the shards.

Defined results: null or empty html gives an empty text; a null url is a host of its own; repeated
rows give rows each (equal pages are one page when recurrence is counted); an empty table gives no
rows; other columns are ignored. Unclosed elements close with their parent; a tag cut off by the
end of the page is dropped; <br> is white space.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, ship, table

RUN = 8
SHARD_PAGES, SHARD_BYTES = 512, 8_000_000
MAIN, NEUTRAL, BOILER = 0, 1, 2
#: Share of a host's distinct pages that hold a run of boilerplate; the least number of them, by kind of block.
SHARE = 0.5
LEAST_PAGES = {MAIN: 10, NEUTRAL: 3}
KINDS = (MAIN, NEUTRAL)

RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
BOILER_TAGS = frozenset("nav footer aside form button select option input label fieldset dialog menu object embed audio video canvas map head".split())
MAIN_TAGS = frozenset(["article", "main"])
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Closed by the opening of another of the same sort.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Opening any of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: What an opening tag looks through for an element that it closes.
THROUGH = INLINE | {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
#: On these an id is an anchor and says nothing of what they hold.
ANCHORED = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figure figcaption caption section a span b i em strong".split())
#: A class or id names boilerplate if its parts are of these, and of the words that may go with them.
COMMENT_WORDS = frozenset("comment comments commentlist respond reply replies disqus".split())
BOILER_WORDS = COMMENT_WORDS | frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsbygoogle skyscraper sponsor sponsors sponsored banner banners promo promos promotion "
    "breadcrumb breadcrumbs captcha cookie cookies consent gdpr notice notices copyright credits footer masthead menu menus nav navbar navigation topbar toolbar pagination pager "
    "newsletter newsletters subscribe subscription signup login popup modal overlay related recommended search share sharing social sidebar sidebars widget widgets".split()
)
WITH_WORDS = frozenset(
    "site page main global top bottom left right primary secondary sub mobile desktop container wrapper wrap box block blocks list lists links link bar area section panel inner outer holder content "
    "button buttons icon icons form message text title header heading item items unit slot posts post articles article stories news module region zone group row column media js gpt dfp".split()
)
#: A header is boilerplate outside main text; inside it holds the title.
HEADER_WORDS = frozenset("header site page main global top container wrapper inner".split())
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
MAIN_NAMES = frozenset("article article-body article-content post-content entry-content main-content story-body post-body".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
#: Parsed only: boilerplate by the name of a container alone, and main markup within that.
SOFT, CLAIMED = 3, 4


def _parts(name: str) -> list[str]:
    return [w for w in (x.strip("0123456789").lower() for x in _PARTS.split(name)) if w]


def _context(tag: str, attributes: str, outer: int) -> int:
    """The context that an element gives what it holds."""
    if outer == BOILER:
        return BOILER
    in_main = outer in (MAIN, CLAIMED)
    names: list[str] = []
    role = ""
    if attributes:
        for k, v in _ATTRIBUTE.findall(attributes):
            k, v = k.lower(), v.strip("\"'")
            if k == "class" or k == "id" and tag not in ANCHORED:
                names += v.split()
            elif k == "role":
                role = v.strip().lower()
            elif k in ("hidden", "aria-hidden") and v.lower() in ("", "true", "hidden") or k == "style" and _HIDDEN.search(v):
                return BOILER
    if tag in BOILER_TAGS or role in BOILER_ROLES or (tag == "header" and not in_main):
        return BOILER
    named = SOFT
    if names and tag not in ("html", "body", "main"):
        for name in names:
            words = _parts(name)
            if tag == "article" and not COMMENT_WORDS.intersection(words):
                continue
            if BOILER_WORDS.intersection(words) and BOILER_WORDS.union(WITH_WORDS).issuperset(words):
                # What readers wrote is no main text, whatever it is marked up with.
                named = BOILER if in_main or COMMENT_WORDS.intersection(words) else named
                break
            if not in_main and "header" in words and HEADER_WORDS.issuperset(words):
                break
        else:
            named = outer
    else:
        named = outer
    if named == BOILER:
        return BOILER
    if tag in MAIN_TAGS or role in ("main", "article") or any(n.lower() in MAIN_NAMES for n in names):
        return CLAIMED if outer in (SOFT, CLAIMED) else MAIN
    return named


def page_blocks(page: str) -> list[tuple[int, str]]:
    """(context, text) of each block with text, in page order; white space is one space.

    Main markup inside a container that is boilerplate by name alone is main text if the page has no other.
    On a page with main text, short blocks outside it and those that are links mostly are boilerplate.
    """
    out: list[tuple[int, str, bool]] = []
    # Open elements that matter: tag, context around it, and the open inline elements within it that don't matter, by tag.
    stack: list[tuple[str, int, dict[str, int]]] = []
    loose: dict[str, int] = {}
    is_open: dict[str, int] = {}
    context, pieces, linked = NEUTRAL, [], 0
    links = False

    def end_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((context, text, 2 * linked > len(text)))
            pieces.clear()
        linked = 0

    def close(k: int) -> None:
        """Closes open elements down to the k-th."""
        nonlocal context, loose
        tag, outer, _ = stack[k]
        if outer != context or tag not in INLINE:
            end_block()
        for t, _, _ in stack[k:]:
            is_open[t] -= 1
        context, loose = outer, stack[k][2]
        del stack[k:]

    at, size = 0, len(page)
    while at < size:
        low = page.find("<", at)
        if low < 0:
            low = size
        if low > at:
            data = page[at:low]
            if "&" in data:
                data = html_lib.unescape(data)
            pieces.append(data)
            if links:
                linked += len(data)
            at = low
            continue
        found = _TAG.match(page, at)
        if not found:  # a lone "<" is text
            pieces.append("<")
            at += 1
            continue
        at = found.end()
        tag = found[2] or found[6]
        if tag is None or not (found[4] or found[8]):  # comment, declaration, or cut off by the end
            continue
        tag, closing = tag.lower(), found[1] or found[5]
        if tag == "br":
            pieces.append(" ")
            continue
        if tag == "a":
            links = not closing
        if tag in INLINE:
            if tag in VOID:
                continue
            if closing:
                if loose.get(tag):
                    loose[tag] -= 1
                elif stack and stack[-1][0] == tag:
                    close(len(stack) - 1)
                continue
            inner = _context(tag, found[3] or found[7] or "", context)
            if inner == context:
                loose[tag] = loose.get(tag, 0) + 1
                continue
            end_block()
            stack.append((tag, context, loose))
            is_open[tag] = is_open.get(tag, 0) + 1
            context, loose = inner, {}
            continue
        if not closing and tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            end_block()
            at = end.end() if end else size
            continue
        links = False
        if closing:
            if is_open.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
            else:
                end_block()
            continue
        end_block()
        if tag in VOID:
            continue
        shut = SELF_CLOSING.get(tag, frozenset()) | (_P if tag in ENDS_P else frozenset())
        if shut and any(is_open.get(t) for t in shut):
            for k in range(len(stack) - 1, max(-1, len(stack) - 1 - LOOK), -1):
                if stack[k][0] in shut:
                    close(k)
                    break
                if stack[k][0] not in THROUGH:
                    break
        inner = _context(tag, found[3] or found[7] or "", context)
        stack.append((tag, context, loose))
        is_open[tag] = is_open.get(tag, 0) + 1
        context, loose = inner, {}
    end_block()
    claimed = MAIN if not any(c == MAIN for c, _, _ in out) else BOILER
    main = any(c in (MAIN, CLAIMED) for c, _, _ in out)
    final = {MAIN: MAIN, NEUTRAL: NEUTRAL, BOILER: BOILER, SOFT: BOILER, CLAIMED: claimed}
    return [(BOILER if main and c == NEUTRAL and (menu or t.count(" ") < RUN - 1) else final[c], t) for c, t, menu in out]


_P = frozenset(["p"])
#: Open elements that an opening tag looks through at most for one that it closes.
LOOK = 64


def _suffixes(streams: list[tuple[int, list[str]]], run: int):
    """(lengths, offsets, token codes, tokens, tokens left in the block, pages) of blocks laid end to end, each with an end mark."""
    lengths = np.array([len(t) for _, t in streams])
    codes, tokens = pd.factorize(np.array([w for _, t in streams for w in [*t, ""]], dtype=object))
    offsets = np.r_[0, np.cumsum(lengths + 1)]
    left = np.repeat(offsets[1:] - 1, lengths + 1) - np.arange(len(codes))  # tokens from here to the block's end
    return lengths, offsets, codes, tokens, left, np.repeat([p for p, _ in streams], lengths + 1)


def _page_counts(codes: np.ndarray, left: np.ndarray, pages: np.ndarray, run: int) -> np.ndarray:
    """For each suffix the distinct pages that hold its first `run` tokens, by prefix doubling up to that depth.

    Blocks are parted, so that a shorter block's suffixes match only where the block ends too.
    """
    rank, n, depth = codes.astype(np.int64), len(codes), 1
    while depth < run:
        after = np.full(n, -1, np.int64)
        inside = np.arange(n) + depth
        ok = left >= depth  # the mark that ends a block is compared, nothing after it
        after[ok] = rank[inside[ok]]
        order = np.lexsort((after, rank))
        new = np.r_[True, (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        depth *= 2
    # Suffixes of one rank agree on `depth` tokens, or up to both blocks' ends.
    order = np.lexsort((pages, rank))
    starts = np.r_[True, rank[order][1:] != rank[order][:-1]]
    other = starts | np.r_[True, pages[order][1:] != pages[order][:-1]]
    held = np.add.reduceat(other.astype(np.int64), np.flatnonzero(starts))
    counts = np.empty(n, np.int64)
    counts[order] = held[np.cumsum(starts) - 1]
    return counts


def _cover(hit: np.ndarray, lengths, offsets, left, run: int) -> list[np.ndarray]:
    """Masks of the tokens within the runs that start at a hit; a short suffix counts only as a whole block."""
    whole = np.zeros(len(left), bool)
    whole[offsets[:-1]] = True
    at = np.flatnonzero(hit & (left > 0) & ((left >= run) | whole))
    delta = np.zeros(len(left) + 1, np.int64)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + np.minimum(run, left[at]), -1)
    covered = np.cumsum(delta[:-1]) > 0
    return [covered[i : i + k] for i, k in zip(offsets, lengths)]


def recurring(streams: list[tuple[int, list[str]]], run: int = RUN, least: int = 2) -> list[np.ndarray]:
    """For blocks (page, tokens): a mask of the tokens within runs that recur on `least` distinct pages."""
    if not streams:
        return []
    lengths, offsets, codes, _, left, pages = _suffixes(streams, run)
    return _cover(_page_counts(codes, left, pages, run) >= least, lengths, offsets, left, run)


def _keys(codes: np.ndarray, tokens, left: np.ndarray, run: int) -> np.ndarray:
    """64-bit hashes of each suffix's first `run` tokens, the end mark among them: the same in all shards."""
    of = pd.util.hash_array(np.array([w.encode("utf-8", "surrogatepass") for w in tokens], dtype=object), categorize=False)[codes]
    keys, times = np.zeros(len(codes), np.uint64), 1
    for k in range(run):
        ok = np.flatnonzero(left >= k)
        keys[ok] += of[ok + k] * np.uint64(times)
        times = times * 0x9E3779B97F4A7C15 % (1 << 64)
    return keys.view(np.int64)


def _streams(contents: list[list[tuple[int, str]]], kind: int):
    return [(i, text.split(" ")) for i, blocks in enumerate(contents) for context, text in blocks if (context == MAIN) == (kind == MAIN)]


def least_pages(kind: int, pages: int) -> int:
    """Distinct pages, of so many of a host, that hold a run of boilerplate."""
    return max(LEAST_PAGES[kind], math.ceil(SHARE * pages))


def candidates(contents: list, kind: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, distinct pages) of the runs on `least` of these distinct pages or more."""
    if not (streams := _streams(contents, kind)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, _, codes, tokens, left, pages = _suffixes(streams, RUN)
    counts = _page_counts(codes, left, pages, RUN)
    at = np.flatnonzero((counts >= least) & (left > 0))
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, first = np.unique(_keys(codes, tokens, left, RUN)[at], return_index=True)
    return keys, counts[at][first]


def count_keys(contents: list, kind: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, distinct pages) of the wanted runs that these distinct pages hold."""
    if not len(wanted) or not (streams := _streams(contents, kind)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, _, codes, tokens, left, pages = _suffixes(streams, RUN)
    keys = _keys(codes, tokens, left, RUN)
    at = np.flatnonzero(np.isin(keys, wanted) & (left > 0))
    held = np.unique(np.c_[keys[at], pages[at]], axis=0)
    return np.unique(held[:, 0], return_counts=True)


def cut_texts(contents: list, cut: dict[int, np.ndarray], judged: bool) -> list[str]:
    """Main texts of parsed pages, without the runs whose keys are given by kind.

    judged: the host has pages enough to tell its boilerplate; then text outside main markup stays too, if it is unique.
    """
    masks = {MAIN: repeat(None), NEUTRAL: repeat(None)}
    for kind in KINDS:
        streams = _streams(contents, kind)
        if len(cut[kind]) and streams:
            lengths, offsets, codes, tokens, left, _ = _suffixes(streams, RUN)
            masks[kind] = iter(_cover(np.isin(_keys(codes, tokens, left, RUN), cut[kind]), lengths, offsets, left, RUN))
    out = []
    for blocks in contents:
        main = any(c == MAIN for c, _ in blocks)
        kept = []
        for context, text in blocks:
            mask = next(masks[MAIN if context == MAIN else NEUTRAL])
            if context == MAIN or context == NEUTRAL and (not main or judged):
                if mask is None or not mask.any():
                    kept.append(text)
                elif context == NEUTRAL and main:
                    continue
                elif rest := [w for w, c in zip(text.split(" "), mask) if not c]:
                    kept.append(" ".join(rest))
        out.append("\n".join(kept))
    return out


def shard_texts(pages: list[str]) -> list[str]:
    """Main texts of a host's pages."""
    return kept_texts([page_blocks(p) for p in pages])


def kept_texts(parsed: list[list[tuple[int, str]]]) -> list[str]:
    """Main texts of the parsed pages of one host."""
    distinct = [list(p) for p in dict.fromkeys(tuple(map(tuple, p)) for p in parsed)]
    return cut_texts(parsed, {kind: candidates(distinct, kind, least_pages(kind, len(distinct)))[0] for kind in KINDS}, len(distinct) >= LEAST_PAGES[NEUTRAL])


COUNTS = "host string, shards int, kind int, key long, pages long, of long"
ALL = -1  # the kind of the row that holds a host's distinct pages


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for each row of (page_id, url, html)."""
    ship(pages.sparkSession)
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    sizes = pages.groupBy("host").agg(F.greatest(F.ceil(F.count("*") / SHARD_PAGES), F.ceil(F.sum(F.octet_length("html")) / SHARD_BYTES)).cast("int").alias("shards")).where("shards > 1")
    # Written first, so that Spark knows its size: it is broadcast only if that allows, and pages are shuffled once.
    sizes = Scratch(pages.sparkSession, "html").write(sizes, "hosts")
    dealt = pages.join(sizes, "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1))).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.col("shards")).cast("int"))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pages travel without markup, those of a batch for one shard compressed together.

        Equal pages count in one shard, the one of their digest; a task's further copies of a page are dealt by
        their ids and count nowhere, so that a page with many copies is many tasks.
        """
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=5)
        seen = set()
        for pdf in batches:
            dealt: dict[tuple, list] = {}
            for host, shards, salt, page_id, url, page in zip(pdf["host"], pdf["shards"], pdf["salt"], pdf["page_id"].astype(object), pdf["url"].astype(object), pdf["html"]):
                blocks = page_blocks(page)
                digest = hashlib.blake2b(json.dumps(blocks).encode(), digest_size=16).digest()
                first = (host, digest) not in seen
                seen.add((host, digest))
                shard = int.from_bytes(digest[:8], "little") % shards if first else salt
                dealt.setdefault((host, shards, shard), []).append((first, None if pd.isna(page_id) else int(page_id), None if pd.isna(url) else url, blocks))
            keys = [pd.Series(k, dtype=t) for k, t in zip(zip(*dealt), (object, "int32", "int32"))] if dealt else [[], [], []]
            packs = [squeeze.compress(json.dumps(p, ensure_ascii=False).encode("utf-8", "surrogatepass")) for p in dealt.values()]
            yield pd.DataFrame({"host": keys[0], "shards": keys[1], "shard": keys[2], "pages": pd.Series(packs, dtype=object)})

    def unpack(pdf: pd.DataFrame) -> tuple[list, list]:
        """A shard's rows, and its distinct pages that count."""
        import zstandard

        loosen = zstandard.ZstdDecompressor()
        rows = [row for pack in pdf["pages"] for row in json.loads(loosen.decompress(pack).decode("utf-8", "surrogatepass"))]
        return rows, [list(p) for p in dict.fromkeys(tuple(map(tuple, blocks)) for first, _, _, blocks in rows if first)]

    def rows_of(host: str, shards: int, of: int, *parts) -> pd.DataFrame:
        """A row for each (key, count) of parts (kind, keys, counts)."""
        kinds = np.concatenate([np.full(len(keys), kind, np.int32) for kind, keys, _ in parts]) if parts else np.zeros(0, np.int32)
        keys = np.concatenate([np.asarray(keys, np.int64) for _, keys, _ in parts]) if parts else np.zeros(0, np.int64)
        counts = np.concatenate([np.asarray(counts, np.int64) for *_, counts in parts]) if parts else np.zeros(0, np.int64)
        return pd.DataFrame({"host": pd.Series([host] * len(keys), dtype=object), "shards": np.full(len(keys), shards, np.int32), "kind": kinds, "key": keys, "pages": counts, "of": np.full(len(keys), of, np.int64)})

    def propose(pdf: pd.DataFrame) -> pd.DataFrame:
        """A run on a share of a host's pages is on that share of some shard's."""
        host, shards = pdf["host"].iloc[0], int(pdf["shards"].iloc[0])
        if shards == 1:
            return rows_of(host, 1, 0)
        _, mine = unpack(pdf)
        least = max(1, math.ceil(SHARE * len(mine)))
        return rows_of(host, shards, 0, (ALL, [0], [len(mine)]), *((kind, *candidates(mine, kind, least)) for kind in KINDS))

    def count(pdf: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(runs):
            return rows_of("", 1, 0)
        host, shards, (_, mine) = pdf["host"].iloc[0], int(pdf["shards"].iloc[0]), unpack(pdf)
        of = int(runs.loc[runs["kind"] == ALL, "pages"].iloc[0])
        return rows_of(host, shards, of, *((kind, *count_keys(mine, kind, runs.loc[runs["kind"] == kind, "key"].to_numpy())) for kind in KINDS))

    def cut(pdf: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        rows, mine = unpack(pdf)
        cut_up = len(pdf) > 0 and pdf["shards"].iloc[0] > 1
        if cut_up:
            keys = {kind: runs.loc[runs["kind"] == kind, "key"].to_numpy() for kind in KINDS}
        else:
            keys = {kind: candidates(mine, kind, least_pages(kind, len(mine)))[0] for kind in KINDS}
        texts = cut_texts([blocks for *_, blocks in rows], keys, cut_up or len(mine) >= LEAST_PAGES[NEUTRAL])
        return pd.DataFrame({"page_id": pd.array([i for _, i, _, _ in rows], "Int64"), "url": pd.Series([u for _, _, u, _ in rows], dtype=object), "text": pd.Series(texts, dtype=object)})

    def everywhere(runs: DataFrame) -> DataFrame:
        return runs.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))

    packed = dealt.select("host", "shards", "salt", "page_id", "url", "html").mapInPandas(parse, "host string, shards int, shard int, pages binary")
    # Written first: the three passes over the same table then read one exchange.
    packed = Scratch(pages.sparkSession, "html").write(packed, "packed").repartition(parts, "host", "shard")
    mine = packed.groupBy("host", "shard")
    proposed = everywhere(mine.applyInPandas(propose, COUNTS).groupBy("host", "shards", "kind", "key").agg(F.sum("pages").alias("pages")))
    counted = mine.cogroup(proposed.groupBy("host", "shard")).applyInPandas(count, COUNTS).groupBy("host", "shards", "kind", "key", "of").agg(F.sum("pages").alias("pages"))
    least = F.greatest(F.when(F.col("kind") == MAIN, LEAST_PAGES[MAIN]).otherwise(LEAST_PAGES[NEUTRAL]), F.ceil(F.lit(SHARE) * F.col("of")))
    common = everywhere(counted.where(F.col("pages") >= least).select("host", "shards", "kind", "key"))
    return mine.cogroup(common.groupBy("host", "shard")).applyInPandas(cut, "page_id long, url string, text string")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
