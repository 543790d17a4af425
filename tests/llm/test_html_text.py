from __future__ import annotations

import html
import random
import re

import numpy as np

from tidelog.llm import html_text


def by_definition(page):
    """The article of the tables' pages, cut by hand."""
    m = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    body = re.sub(r"</?b>", "", m[1]).replace("<br>", " ") if m else ""
    blocks = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(x for x in blocks if x)


def test_query_over_the_whole_table(spark, sf):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = html_text.op8_html_text(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == by_definition(pages[r["page_id"]]["html"]) and r["url"] == pages[r["page_id"]]["url"] and r["n_chars"] == len(r["text"])


def texts(page):
    return [(c, t) for c, t in html_text.page_blocks(page)]


def test_markup():
    page = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><div class="cookie-notice">We use</div>
    <main><article><header><h1>T &amp; x</h1></header><p>One <b>two</b>three<br>four<p>Five &lt;b&gt; &nbsp; a < b
    <div class="related">rel</div><ul><li>i1<li>i2</ul><section id="comments"><article class="comment"><p>bad</p></article></section>
    <form><input name=a>go</form><script>if (a</script><style>p{}</style><!-- no <p> --></article></main><aside>side</aside><footer>f</footer>"""
    main = [t for c, t in texts(page) if c == html_text.MAIN]
    assert main == ["T & x", "One twothree four", "Five <b> a < b", "i1", "i2"]
    assert html_text.shard_texts([page]) == ["\n".join(main)]


def test_broken_pages():
    for page in ("", "<", "<p", "</p></div>", "<p>a", "<div class='x>y'>a</div>", "a<!-- open", "<script>never ends", "<p title=\"a>b\">t</p", "&#x41;&bogus;&amp", "<a href=x>l</a>" * 3, "<p>" * 3000 + "deep", "\x00<p>é😀"):
        html_text.shard_texts([page, page])
    assert html_text.shard_texts(["<article><p>kept <p>cut <i"]) == ["kept\ncut"]


def naive(streams, run):
    """Tokens in runs of `run` that two pages hold, and in whole shorter blocks that two pages hold at a block's end."""
    out = []
    for page, tokens in streams:
        mask = np.zeros(len(tokens), bool)
        for i in range(len(tokens)):
            if i + run <= len(tokens):
                gram = tokens[i : i + run]
                if any(p != page and any(other[k : k + run] == gram for k in range(len(other) - run + 1)) for p, other in streams):
                    mask[i : i + run] = True
        if len(tokens) < run and any(p != page and other[len(other) - len(tokens) :] == tokens for p, other in streams):
            mask[:] = True
        out.append(mask)
    return out


def test_recurring_runs_against_all_pairs():
    rng = random.Random(4)
    for _ in range(30):
        shared = [[rng.choice("abcde") for _ in range(rng.randrange(1, 20))] for _ in range(3)]
        streams = []
        for page in range(6):
            for _ in range(rng.randrange(3)):
                own = [rng.choice("abcdefghij") for _ in range(rng.randrange(0, 6))]
                if block := own + rng.choice(shared) + own[::-1] if rng.random() < 0.7 else rng.choice(shared):
                    streams.append((page, block))
        got = html_text.recurring(streams, 8)
        assert [m.tolist() for m in got] == [m.tolist() for m in naive(streams, 8)]


def test_recurring_text_without_markup_goes():
    menu = "Home About Contact Terms Privacy Jobs Press Blog Help"
    pages = [f"<div>{menu} now</div><div>text number {i} tells of things {i * 7} and of others {i * 13}</div><div>All rights</div>" for i in range(5)]
    assert html_text.shard_texts(pages) == [f"text number {i} tells of things {i * 7} and of others {i * 13}" for i in range(5)]
    assert html_text.shard_texts([pages[0], pages[0]]) == [f"{menu} now\ntext number 0 tells of things 0 and of others 0\nAll rights"] * 2


def test_odd_rows(spark):
    page = "<article><p>x y</article>"
    rows = [(1, "http://a/1", None, 1, "h"), (2, None, "", 1, "h"), (3, None, page, 1, "h"), (3, None, page, 1, "h"), (None, "not a url", page, 1, "h"), (5, "http://A/", "<article><p>" + "long " * 300_000, 1, "h")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, shard int, host string")
    got = sorted(((r["page_id"], r["url"], r["text"]) for r in html_text.extract_text(df).collect()), key=str)
    want = sorted([(1, "http://a/1", ""), (2, None, ""), (3, None, "x y"), (3, None, "x y"), (None, "not a url", "x y"), (5, "http://A/", ("long " * 300_000).strip())], key=str)
    assert got == want
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_hot_host_is_cut_into_shards(spark, monkeypatch):
    monkeypatch.setattr(html_text, "SHARD_PAGES", 10)
    df = spark.range(100).selectExpr("id AS page_id", "concat('http://one.host/', id) AS url", "concat('<nav>menu</nav><article><p>text ', id, '</p></article>') AS html")
    assert {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()} == {i: f"text {i}" for i in range(100)}


def test_copied_text_without_markup_stays():
    copied = "a passage of ten words that two pages of many share"
    pages = [f"<div>text number {i} tells of {i * 7}</div>" + (f"<p>{copied}</p><p>The end</p>" if i < 2 else "") for i in range(8)]
    assert html_text.shard_texts(pages) == [f"text number {i} tells of {i * 7}" + (f"\n{copied}\nThe end" if i < 2 else "") for i in range(8)]


def test_results_do_not_depend_on_shards(spark, monkeypatch):
    def page(i):
        return "<div>Home About Contact Terms Privacy Jobs Press Blog Help</div>" * (i % 5 != 0) + "<p>one sentence of eight words on few pages</p>" * (i % 9 == 0) + "<p>All rights</p>" * (i % 2) + f"<div>text {i % 50} of {i % 50 * 13}</div>"

    pages = [page(i) for i in range(100)]
    want = html_text.shard_texts(pages)
    assert want[0] == "one sentence of eight words on few pages\ntext 0 of 0" and want[7] == "text 7 of 91"
    df = spark.createDataFrame([(i, f"http://one.host/{i}", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    for size in (512, 30, 4):
        monkeypatch.setattr(html_text, "SHARD_PAGES", size)
        cut = html_text.extract_text(df)
        assert {r["page_id"]: r["text"] for r in cut.collect()} == dict(enumerate(want)), size
    assert cut._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 2


def test_boilerplate_within_main_text_goes():
    sign_up = "<p>Get all our stories by mail every single Sunday morning</p><p>Sign up</p>"
    pages = [f"<main><div>Home About Terms</div><h1>Title {i}</h1><p>text {i} of {i * 7}</p>{sign_up}</main>" for i in range(20)]
    assert html_text.shard_texts(pages) == [f"Title {i}\ntext {i} of {i * 7}" for i in range(20)]
    # An article copied on fewer than half of the pages stays, and so does all main text of a small host.
    copied = "<article><p>an article that was copied on many pages of it</p></article>"
    pages = [f"<article><p>text {i}</p></article>" + copied * (i < 9) for i in range(20)]
    assert html_text.shard_texts(pages) == [f"text {i}" + "\nan article that was copied on many pages of it" * (i < 9) for i in range(20)]
    assert html_text.shard_texts([copied + f"<main>{i}</main>" for i in range(9)])[0] == "an article that was copied on many pages of it\n0"


def test_main_text_is_counted_over_all_shards(spark, monkeypatch):
    monkeypatch.setattr(html_text, "SHARD_PAGES", 5)
    pages = [f"<article><p>text {i}</p>" + "<p>Sign up</p>" * (i % 2) + "<p>See also</p>" * (i % 3 == 0) + "</article>" for i in range(60)]
    df = spark.createDataFrame([(i, f"http://one.host/{i}", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    assert got == {i: f"text {i}" + "\nSee also" * (i % 3 == 0) for i in range(60)}


def test_main_markup_outweighs_the_name_of_what_holds_it():
    body = "<article><p>BODY</p></article>"
    for outer in ('class="content has-sidebar"', 'class="layout with-nav"', 'class="page-wrapper no-widgets"', 'class="single-post ads-free"', 'id="page-search"', 'class="sidebar"'):
        assert html_text.shard_texts([f"<body><div {outer}>{body}</div></body>"]) == ["BODY"], outer
    # With an article elsewhere, articles in such containers are teasers; comments never are main text.
    assert html_text.shard_texts([f"<div class='related-posts'><article>teaser</article></div>{body}"]) == ["BODY"]
    assert html_text.shard_texts(["<section id=comments><article class=comment>c</article></section>"]) == [""]


def test_names_are_read_whole():
    page = """<main><h2 id="share">Share prices</h2><p class="search-engines">On search engines</p><p id="credits">Credits were given</p>
    <div class="social-share">s</div><p class="ad">a</p><div class="cookieNotice">c</div><ul class="menu-list-2"><li>m</ul></main>"""
    assert html_text.shard_texts([page]) == ["Share prices\nOn search engines\nCredits were given"]


def test_nested_inline_and_hidden_elements():
    assert html_text.shard_texts(['<article><p>x <i class="ad">A <i>B</i> C</i> y</p><p hidden>h</p><p style="display: none">n</p></article>']) == ["x\ny"]
    assert html_text.shard_texts(["<article><header><h1>Title</h1></header><p>t</p></article>"]) == ["Title\nt"]


def test_unique_text_outside_main_markup_stays():
    """The suffix array decides on it: what recurs goes, what is unique stays, menus and short blocks go."""
    lead = "lead {0} of page {0} with {0} words and {0} more {0}"
    promo = "a promotion of ten words or more stands here on every page"
    pages = [f"<div><a href=/>{lead.format(-i)}</a></div><div>{lead.format(i)}</div><article>text {i}</article><div>{promo}</div><div>short {i}</div>" for i in range(12)]
    assert html_text.shard_texts(pages) == [f"{lead.format(i)}\ntext {i}" for i in range(12)]
    assert html_text.shard_texts(pages[:1]) == ["text 0"]


def test_deep_nesting_takes_linear_time():
    import time

    for part in ("<div>", "<div></p>", "<b class=x>", "<p><foo>", "<li><b><ul>", "<i class=ad>"):
        began = time.process_time()
        html_text.page_blocks(part * 20_000 + "text")
        assert time.process_time() - began < 5, part


def test_host_size_does_not_matter(spark):
    """511 and 513 pages, one shard and two."""
    for n in (511, 513):
        pages = [f"<main><p>text {i} of {i * 7}</p>" + "<p>Sign up now</p>" * (i % 4 != 0) + "</main>" for i in range(n)]
        df = spark.createDataFrame([(i, f"http://one.host/{i}", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
        assert {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()} == {i: f"text {i} of {i * 7}" for i in range(n)}
