from __future__ import annotations

import random
import re
import textwrap

from tidelog.llm import license_scan


def test_notices_and_their_wording():
    s = license_scan.Scanner()
    assert s.match("Released under the MIT license.")[0] == "MIT"
    for name, text, _ in license_scan.TEMPLATES:
        got = s.match(text)
        assert got[0] == name and got[2:] == (0, 0, ""), text
    long = license_scan.TEMPLATES[-2][1]
    got = s.match("Some words before. " + long.replace("free of charge", "without charge") + " And some after.")
    assert got[0] == "MIT" and got[2] == 2 and got[3] == 1 and got[4] == "-free -of +without"
    for other in ("Licensed under the Apache License, Version 1.1.", "I lost my driving license yesterday.", "Copyright 2020 by nobody", "license", "GNU is licensed"):
        assert s.match(other) is None, other


def test_blocks():
    text = "Nothing here. Released under the MIT License. More text. And more.\nplain\nplain\nplain\nplain. Version 2.0 licensed so"
    found = license_scan.blocks(text)
    assert [text[a : a + len(t)] for a, t in found] == [t for _, t in found] and len(found) == 2
    assert license_scan.blocks(None) == license_scan.blocks("") == license_scan.blocks(" \n ") == []


def test_odd_documents(spark, odd, no_docs):
    assert license_scan.scan_licenses(odd).count() == 0 and license_scan.scan_licenses(no_docs).count() == 0
    rows = [(1, "x\nReleased under the MIT License.\ny", 3), (1, "x\nReleased under the MIT License.\ny", 3), (None, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.", 3), (3, "word " * 50_000 + "\nReleased under the MIT License.", 3)]
    got = sorted((str(r["doc_id"]), r["license"], r["start"], r["n_chars"]) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string, block int")).collect())
    assert got == [("1", "MIT", 2, 31), ("1", "MIT", 2, 31), ("3", "MIT", 250_001, 31), ("None", "Apache-2.0", 0, 47)]


def test_query_finds_each_notice_of_the_table(spark):
    folder = "/root/testdata/sf0.01"
    want = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        for name, text, _ in license_scan.TEMPLATES[:16]:
            if re.search(re.escape(text), r["text"] or "", re.I):
                want.add((r["doc_id"], name))
    got = {(r["doc_id"], r["license"]) for r in license_scan.op3_license_scan(spark, folder).collect()}
    assert want and want <= got


def licenses(text):
    return [r[3] for r in license_scan.Scanner().scan(text)]


def test_each_notice_of_a_block():
    text = "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."
    assert [(text[a : a + n], name) for _, a, n, name, *_ in license_scan.Scanner().scan(text)] == list(zip(text.split("\n"), ["MIT", "Apache-2.0"]))
    one_line = [t for t in license_scan.TEMPLATES if len(t[1]) < 200]
    assert licenses("\n".join(t[1] for t in one_line)) == [t[0] for t in one_line]
    assert licenses("Released under the MIT License. " * 3) == ["MIT"] * 3


def test_every_template_within_a_text():
    for name, text, _ in license_scan.TEMPLATES:
        for notice in (text, *(textwrap.fill(text, n, break_on_hyphens=False, break_long_words=False) for n in (60, 25)), text.replace(": The above", ":\n\nThe above")):
            for before, after in (("", ""), ("Some words. And\nmore.\n\n", "\n\nOther words follow. THE SOFTWARE IS PROVIDED AS IS.\n")):
                found = license_scan.Scanner().scan(before + notice + after)
                assert {r[3] for r in found} == {name} and all(r[5:] == (0, 0, "") for r in found), notice
                assert min(r[1] for r in found) == len(before), notice
    assert license_scan.Scanner().scan("mit license, no notice") == license_scan.Scanner().scan(None) == []


def test_long_run_of_notices():
    mit, apache = (license_scan.TEMPLATES[i][1] for i in (-2, -1))
    text = "\n".join(f"Copyright 20{i} by somebody\n{mit if i % 3 else apache}" for i in range(10, 60))
    found = license_scan.Scanner().scan(text)
    want = [(text.index("\n", text.index(f"Copyright 20{i} ")) + 1, "MIT" if i % 3 else "Apache-2.0") for i in range(10, 60)]
    assert [(r[1], r[3]) for r in found] == want and {r[0] for r in found} == {0}


def test_tags_headers_and_conditions():
    assert licenses("// SPDX-License-Identifier: Apache-2.0\nint main() {}") == ["Apache-2.0"]
    assert licenses("# SPDX-License-Identifier: GPL-3.0-or-later") == ["GPL-3.0-or-later"] and licenses("SPDX-License-Identifier: Nobody-1.0") == []
    assert licenses("Licensed under CC BY 4.0. Code: Released under the MIT License. Docs: Licensed under CC BY-SA 4.0.") == ["CC-BY-4.0", "MIT", "CC-BY-SA-4.0"]
    named = {}
    for name, text, _ in license_scan.TEMPLATES:
        named.setdefault(name, []).append(text)
    conditions = max(named["BSD-2-Clause"], key=len)
    assert licenses(conditions) == ["BSD-2-Clause"] and licenses(max(named["BSD-3-Clause"], key=len)) == ["BSD-3-Clause"]
    for name in ("GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later"):
        assert licenses("Copyright 2020 x\n\n" + textwrap.fill(max(named[name], key=len), 70) + "\n\nIt comes without any warranty.") == [name]


def plain_search(text):
    """Every place where a template's words stand, whole and in order; of overlapping ones the longest, then the first template."""
    found = re.finditer(r"[^\s\"'(),;:]+", text or "")
    spans = [(m.start(), m[0].lower().rstrip(".!?"), m.start() + len(m[0].rstrip(".!?"))) for m in found if m[0].rstrip(".!?")]
    mine = [w for _, w, _ in spans]
    hits = []
    for i, (name, wording, _) in enumerate(license_scan.TEMPLATES):
        theirs = license_scan.words(wording)
        for k in range(len(mine) - len(theirs) + 1):
            if mine[k] == theirs[0] and mine[k : k + len(theirs)] == theirs:
                hits.append((-len(theirs), i, k, name))
    taken, out = set(), set()
    for size, _, k, name in sorted(hits):
        here = range(k, k - size)
        if taken.isdisjoint(here):
            taken.update(here)
            out.add((spans[k][0], name))
    return out


def test_both_sides_against_a_plain_search(spark):
    """Exact notices of the whole table: none is missed, none is made up; what else is reported differs by some word."""
    folder = "/root/testdata/sf0.01"
    want, got = set(), set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        want |= {(r["doc_id"], *x) for x in plain_search(r["text"])}
    for r in license_scan.op3_license_scan(spark, folder).collect():
        if r["n_missing"] + r["n_extra"] == 0:
            got.add((r["doc_id"], r["start"], r["license"]))
        else:
            assert r["differences"]
    assert want and got == want


def plain_distance(a, b):
    """The fewest words put in and left out, by the longest common subsequence."""
    common = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for x, v in enumerate(a):
        for y, w in enumerate(b):
            common[x + 1][y + 1] = common[x][y] + 1 if v == w else max(common[x][y + 1], common[x + 1][y])
    return len(a) + len(b) - 2 * common[-1][-1]


def test_notice_beside_a_part_of_itself():
    """A longer equal run beside a notice must not draw the alignment away from it."""
    agpl = "this work is licensed under bar the gnu affero general public license version 3 license this work is licensed under the gnu affero general public license,"
    assert [(r[1], r[3], r[5:]) for r in license_scan.Scanner().scan(agpl)] == [(0, "AGPL-3.0", (0, 1, "+bar"))]
    mpl = "this source code form subject to the terms of the mozilla public license v. 2.0 license code form is subject to the terms of the mozilla public license, v."
    assert [(r[1], r[3], r[5:]) for r in license_scan.Scanner().scan(mpl)] == [(0, "MPL-2.0", (1, 0, "-is"))]


def test_savings_rank_overlapping_notices():
    long = next(i for i, t in enumerate(license_scan.TEMPLATES) if t[0] == "Apache-2.0" and "compliance" in t[1])
    text = license_scan.TEMPLATES[long][1].replace("obtain a copy", "get a copy")
    scanner = license_scan.Scanner()
    # The short notice at its beginning is exact, but the long one's dictionary saves more bytes.
    assert [r[1:4] + r[5:] for r in scanner.scan(text)] == [(0, len(text), "Apache-2.0", 1, 1, "-obtain +get")]
    scanner.given[long] = scanner.alone
    scanner.judged.clear()
    assert [r[2:4] + r[5:] for r in scanner.scan(text)] == [(len("Licensed under the Apache License, Version 2.0"), "Apache-2.0", 0, 0, "")]


def test_runs_against_every_span():
    """Runs are those that a look at every span of the text gives, and differences are the fewest."""
    rng = random.Random(3)
    wording = "a b c a d e f b g h a i c k b l m"
    scanner = license_scan.Scanner([("X", wording, "d k")])
    theirs, may, some = wording.split(), 2, 0
    for _ in range(150):
        text = rng.choices("abcdk", k=rng.randrange(6))
        for _ in range(2):
            notice = list(theirs)
            for _ in range(rng.randrange(4)):
                notice.insert(rng.randrange(len(notice)), notice.pop(rng.randrange(len(notice))) if rng.random() < 0.5 else rng.choice("abdkx"))
            text += notice[rng.choice((0, 0, 9)) :] + rng.choices("abcdk", k=rng.randrange(6))
        near = []
        for end in range(1, len(text) + 1):
            spans = [(plain_distance(theirs, text[s:end]), s) for s in range(max(0, end - len(theirs) - may), end) if {"d", "k"} <= set(text[s:end])]
            if spans and min(spans)[0] <= may:
                cost, start = min(spans)
                near.append((cost, start - end, start, end))
        want, taken = [], set()
        for cost, _, first, last in sorted(near):
            if taken.isdisjoint(range(first, last)):
                taken.update(range(first, last))
                want.append((cost, first, last))
        assert scanner.runs(0, text, 0, len(text)) == want, text
        for cost, first, last in want:
            missing, extra, notes = scanner.differences(0, text[first:last])
            assert missing + extra == len(notes.split()) == cost
            some += 1
    assert some > 50
