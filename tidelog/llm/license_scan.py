"""License notices found by conditional compression.

Each run of words that may be a notice is compressed with zstandard, alone and with each template as a raw dictionary.
The bytes saved rank the templates; from the best down, the first whose exact wording is confirmed is the run's: the run
must differ from it by few words, by the least number that can be missing or put in, and keep every word that names the
license. Of overlapping runs the one whose template saves the most bytes stays, then the one with the fewest differences.
What is left of the text is read again until nothing is confirmed; so a text with several notices has a row for each. Differences are
reported.

For each place where a template's notice may end, the nearest run that ends there may be a notice, if it is near enough; these
are found exactly, around the words that name the license, whatever else stands beside them.

A block is a run of sentences with a licensing word, at most GAP others between two of them; so a notice
inside a long line is a block too. A notice must reach into a block but needn't end with it: full stops and line
ends within it, as in "v. 2.0" or wrapped text, don't matter.

Defined results: null, empty and blank texts have no blocks; an empty table gives no rows; repeated rows
and null ids give rows each; a tie between templates goes to the one listed first; other columns are
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import ship, table

#: Licenses that are also named by a tag alone (fixed values: identifiers of the public list).
TAGGED = (
    "MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "Zlib", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense",
)
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
#: Public notices (fixed values): (license, wording, words that must all be there).
TEMPLATES = (
    ("MIT", "Released under the MIT License.", "mit"),
    ("MIT", "This project is licensed under the MIT License.", "mit"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general 2"),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1.", "gnu lesser 2.1"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "bsd-style"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License.", "bsd 3-clause"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License.", "bsd 2-clause"),
    ("ISC", "Released under the ISC License.", "isc"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "creative commons attribution-sharealike 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by-sa 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by-nc 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", "cc by-nd 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", "cc by-nc-sa 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "waived copyright"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered public domain"),
    *((name, f"SPDX-License-Identifier: {name}", f"spdx-license-identifier {name}") for name in TAGGED),
    ("GPL-2.0-or-later", "This program is free software; " + _GNU.format("General Public License", ";", "2"), "gnu general redistribute 2"),
    ("GPL-3.0-or-later", "This program is free software: " + _GNU.format("General Public License", ",", "3"), "gnu general redistribute 3"),
    ("LGPL-2.1-or-later", "This library is free software; " + _GNU.format("Lesser General Public License", ";", "2.1"), "gnu lesser redistribute 2.1"),
    ("LGPL-3.0-or-later", "This library is free software: " + _GNU.format("Lesser General Public License", ",", "3"), "gnu lesser redistribute 3"),
    ("AGPL-3.0-or-later", "This program is free software: " + _GNU.format("Affero General Public License", ",", "3"), "gnu affero redistribute 3"),
    ("BSD-2-Clause", _BSD, "redistribution source binary permitted retain reproduce"),
    (
        "BSD-3-Clause",
        _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "redistribution source binary permitted retain reproduce endorse",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "purpose fee hereby granted",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "hereby granted sublicense",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "apache 2.0 compliance",
    ),
)
CUE = r"licen[sc]e|free[ \t\r\n]+software|copyright|spdx|public[ \t\r\n]+domain|permission[ \t\r\n]+is[ \t\r\n]+hereby|creative[ \t\r\n]+commons|redistributi"
#: Sentences between two with a cue; least share of bytes saved; share of a template's words that may differ.
GAP, LEAST_SAVED, MAY_DIFFER = 2, 0.25, 0.12
LEVEL = 3
#: Judgements kept for when the same words come again; longest run kept.
JUDGED, JUDGED_CHARS = 4096, 4096

_CUE = re.compile(CUE, re.I)
_SENTENCE = re.compile(r"[^\n.!?]*(?:[.!?](?!\s)[^\n.!?]*)*(?:[.!?]+(?=\s|$)|\n|$)")
_WORD = re.compile(r"[^\s\"'(),;:]+")


def words(text: str) -> list[str]:
    return [w.rstrip(".!?") for w in _WORD.findall(text.lower()) if w.rstrip(".!?")]


def blocks(text: str | None) -> list[tuple[int, str]]:
    """(start, text) of the runs of sentences around licensing words."""
    out: list[list[int]] = []
    k = -GAP - 2
    text = text or ""
    cues = _CUE.finditer(text)  # one may go over a line's end, and so be in two sentences
    cue = next(cues, None)
    for n, found in enumerate(_SENTENCE.finditer(text)):
        while cue and cue.end() <= found.start():
            cue = next(cues, None)
        if found.end() > found.start() and cue and cue.start() < found.end():
            if out and n - k <= GAP + 1:
                out[-1][1] = found.end()
            else:
                out.append([found.start(), found.end()])
            k = n
    return [(a + len(t) - len(t.lstrip()), t.strip()) for a, b in out for t in [text[a:b]]]


def _least(wanted: list[int], seen: np.ndarray, row: np.ndarray, unit: int) -> np.ndarray:
    """For each end within seen, the least cost of turning wanted into the words before it: row is that of no words, unit that of a word missing or put in."""
    along = np.arange(len(row)) * unit
    for w in wanted:
        missing = row + unit
        missing[1:] = np.where(seen == w, np.minimum(missing[1:], row[:-1]), missing[1:])
        row = np.minimum.accumulate(missing - along) + along
    return row


class Scanner:
    """The templates, compressed forms of them ready."""

    def __init__(self, templates=TEMPLATES):
        import zstandard

        self.templates = [(name, words(text), set(words(key))) for name, text, key in templates]
        self.counts = [Counter(w) for _, w, _ in self.templates]
        self.ids = {w: k for k, w in enumerate(dict.fromkeys(w for _, theirs, _ in self.templates for w in theirs))}
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.given = [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, w, _ in self.templates]
        self.frame = len(self.alone.compress(b""))
        self.sizes = [max(1, len(self.alone.compress(" ".join(w).encode())) - self.frame) for _, w, _ in self.templates]
        self.keys = set().union(*(key for _, _, key in self.templates))
        self.judged: dict[str, tuple | None] = {}

    def runs(self, i: int, mine: list[str], low: int, high: int) -> list[tuple[int, int, int]]:
        """(differences, first, last) of the runs within mine[low:high] that may be template i's notices: of overlapping ones the nearest, then the longest, then the first."""
        _, theirs, key = self.templates[i]
        may = int(MAY_DIFFER * len(theirs))
        window = mine[low:high]
        if not key <= set(window) or (self.counts[i] - Counter(window)).total() > may:
            return []
        wanted = [self.ids[w] for w in theirs]
        seen = np.fromiter((self.ids.get(w, -1) for w in window), np.int64, len(window))
        # For each end the nearest run: differences * unit + start, so that of equal ones the longest counts.
        unit = len(window) + 1
        nearest = _least(wanted, seen, np.arange(unit), unit)
        near = []
        for end in np.flatnonzero(nearest < (may + 1) * unit).tolist():
            cost, start = divmod(int(nearest[end]), unit)
            if not key <= set(window[start:end]):
                # Without a word that names the license: the nearest of the longer runs that have them all.
                back = max(0, end - len(theirs) - may)
                if not key <= set(window[back:end]):
                    continue
                costs = _least(wanted[::-1], seen[back:end][::-1], np.arange(end - back + 1), 1)
                named = [(int(costs[end - s]), s) for s in range(back, start) if costs[end - s] <= may and key <= set(window[s:end])]
                if not named:
                    continue
                cost, start = min(named)
            near.append((cost, start - end, start, end))
        out, taken = [], bytearray(len(window))
        for cost, _, first, last in sorted(near):
            if not any(taken[first:last]):
                taken[first:last] = b"\1" * (last - first)
                out.append((cost, low + first, low + last))
        return out

    def differences(self, i: int, run: list[str]) -> tuple[int, int, str]:
        """(words missing, words put in, both in order): the fewest that turn template i into the run."""
        theirs = self.templates[i][1]
        if run == theirs:
            return 0, 0, ""
        rows = [list(range(len(run) + 1))]
        for a, w in enumerate(theirs, 1):
            row, above = [a], rows[-1]
            for b, v in enumerate(run, 1):
                row.append(above[b - 1] if w == v else 1 + min(above[b], row[-1]))
            rows.append(row)
        a, b, missing, extra, notes = len(theirs), len(run), [], [], []
        n_missing = n_extra = 0
        while a or b:
            if a and b and theirs[a - 1] == run[b - 1]:
                a, b = a - 1, b - 1
                notes, missing, extra = notes + extra + missing, [], []
            elif b and (not a or rows[a][b - 1] <= rows[a - 1][b]):
                b, n_extra = b - 1, n_extra + 1
                extra.append("+" + run[b])
            else:
                a, n_missing = a - 1, n_missing + 1
                missing.append("-" + theirs[a])
        return n_missing, n_extra, " ".join(reversed(notes + extra + missing))

    def judge(self, run: str) -> tuple[int, int, int, tuple] | None:
        """(bytes that the template saves, negative; differences, template, notice) of the first template that is confirmed, from the one that saves most."""
        if run in self.judged:
            return self.judged[run]
        mine, data, got = run.split(" "), run.encode("utf-8", "replace"), None
        alone = max(1, len(self.alone.compress(data)) - self.frame)
        saved = [alone - (len(c.compress(data)) - self.frame) for c in self.given]
        for i in sorted(range(len(saved)), key=lambda i: (-saved[i], i)):
            if got and -saved[i] > got[0]:
                break
            name, theirs, key = self.templates[i]
            may = int(MAY_DIFFER * len(theirs))
            if saved[i] < LEAST_SAVED * min(alone, self.sizes[i]) or not key <= set(mine) or (self.counts[i] - Counter(mine)).total() > may:
                continue
            missing, extra, notes = self.differences(i, mine)
            if missing + extra <= may and (got is None or (-saved[i], missing + extra) < got[:2]):
                got = -saved[i], missing + extra, i, (name, round(saved[i] / alone, 6), missing, extra, notes)
        if len(run) <= JUDGED_CHARS:
            if len(self.judged) >= JUDGED:
                self.judged.clear()
            self.judged[run] = got
        return got

    def ranked(self, mine: list[str], low: int, high: int) -> list[tuple[int, int, int, int, int, tuple]]:
        """(bytes that the template saves, negative; differences, template, first, last, notice) of the confirmed runs within mine[low:high], best first."""
        at: dict[str, list[int]] = {}
        for p in range(low, high):
            if mine[p] in self.keys:
                at.setdefault(mine[p], []).append(p)
        found = set()
        for i, (_, theirs, key) in enumerate(self.templates if at else ()):
            # A notice holds each of these words and is at most so long.
            reach = len(theirs) + int(MAY_DIFFER * len(theirs))
            around: list[list[int]] = []
            for p in min((at.get(w, []) for w in key), key=len):
                if around and p - reach + 1 <= around[-1][1]:
                    around[-1][1] = min(high, p + reach)
                else:
                    around.append([max(low, p - reach + 1), min(high, p + reach)])
            found.update(run[1:] for a, b in around for run in self.runs(i, mine, a, b))
        judged = ((self.judge(" ".join(mine[first:last])), first, last) for first, last in found)
        return sorted((*got[:3], first, last, got[3]) for got, first, last in judged if got)

    def readings(self, mine: list[str]) -> list[tuple]:
        """(first, last, (license, share of bytes saved, words missing, words changed or put in, differences)): confirmed notices, best first; none overlaps a better one."""
        out, taken, left = [], bytearray(len(mine)), [(0, len(mine))]
        while left:
            low, high = left.pop()
            new = []
            for *_, first, last, got in self.ranked(mine, low, high):
                if not any(taken[first:last]):
                    taken[first:last] = b"\1" * (last - first)
                    new.append((first, last, got))
            out += new
            # Runs that overlapped a better notice may have others beside it.
            ends = sorted(found[:2] for found in new)
            if new:
                left += [(a, b) for a, b in zip([low, *(last for _, last in ends)], [*(first for first, _ in ends), high]) if a < b]
        return out

    def match(self, block: str) -> tuple | None:
        """(license, share of bytes saved, words missing, words changed or put in, differences), or None."""
        found = self.readings(words(block))
        return found[0][2] if found else None

    def scan(self, text: str | None) -> list[tuple]:
        """(block, start, n_chars, license, saved, missing, extra, differences) of each notice, by start."""
        parts = blocks(text)
        starts = [start for start, _ in parts]
        spans = [m for m in _WORD.finditer(text or "") if m[0].rstrip(".!?")] if parts else []
        out = []
        for first, last, got in self.readings([m[0].lower().rstrip(".!?") for m in spans]):
            low, high = spans[first].start(), spans[last - 1].end()
            # The first block that reaches into the notice, which may go on before and after it.
            n = max(0, bisect_right(starts, low) - 1)
            if starts[n] + len(parts[n][1]) <= low:
                n += 1
            if n < len(parts) and starts[n] < high:
                out.append((n, low, high - low, *got))
        return sorted(out, key=lambda r: r[1])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, block, start, n_chars, license, saved, n_missing, n_extra, differences): a row for each confirmed notice."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"]):
                rows += [(doc_id, *found) for found in scanner.scan(text)]
            got = pd.DataFrame(rows, columns=["doc_id", "block", "start", "n_chars", "license", "saved", "n_missing", "n_extra", "differences"])
            yield got.assign(doc_id=pd.array(got["doc_id"], "Int64"))

    # The scan of all texts for licensing words stays in the JVM; only texts that hold one go on.
    likely = docs.select("doc_id", "text").where(F.col("text").rlike(f"(?i){CUE}"))
    return likely.mapInPandas(run, "doc_id long, block int, start long, n_chars long, license string, saved double, n_missing int, n_extra int, differences string")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
