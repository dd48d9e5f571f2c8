"""Main text of pages: markup cases one by one, boilerplate of unmarked pages against brute force."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from tidemark.llm import html_text as h

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("host", T.StringType()), T.StructField("text", T.StringType())])


def text_of(html):
    blocks, _ = h.read_blocks(html)
    return "\n\n".join(t for t, main, side in blocks if main and not side)


@pytest.mark.parametrize(("html", "text"), [
    ("<article><h1>A &amp; B</h1><p>one\n  two<br>three</p><p>four</article>", "A & B\n\none two three\n\nfour"),
    ('<nav>x</nav><article><p><b>Bold.<br><p>Next</p></article><footer>f</footer>', "Bold.\n\nNext"),
    ('<script>var t="</p><article>";track(0);</script><article>a</article>', "a"),
    ('<article><p>a <span class="ad">buy</span> b</p><aside>x</aside><div class="share-box">s</div><p>c</p></article>', "a b\n\nc"),
    ("<main><p>a</p><form><p>mail</p></form><ul><li>x<li>y</ul></main>", "a\n\nx\n\ny"),
    ("<article><p>a<!-- <p>no</p> -->b</p><style>p{}</style><template><p>t</p></template></article>", "ab"),
    ('<article><p title="a>b">q</p><p class="lead">l</p></article><section id="comments"><article><p>me too</p></article></section>', "q\n\nl"),
    ('<article><p>a</p><article class="comment"><p>r</p></article></article>', "a"),
    ("<article><table><tr><td>1</td><td>2</td></tr></table><pre>x  y</pre>", "1\n\n2\n\nx y"),
    ("<article><p>1 < 2 &lt;b&gt; &#233;&nbsp;x</p></article>", "1 < 2 <b> é x"),
    ('<head><title>t</title><body><article><p>a</p><img src="x"><p hidden>h</p></article>', "a"),
    ('<article><p>a <em>b</em>c</p><div>d<p>e</p>f</div></article>', "a bc\n\nd\n\ne\n\nf"),
    ("<article></article>", ""), ("", ""), ("plain", ""), ("<article><p>" + "w " * 50_000 + "</p></article>", ("w " * 50_000).strip()),
])
def test_markup(html, text):
    assert text_of(html) == text


def test_article_is_kept_whole(spark):
    shared = "<article><p>the same ten words stand here in every single article</p></article>"
    rows = [(k, "http://a.b/x", f"<p>unmarked {k}</p>" + shared, "h", "t") for k in range(4)]
    rows += [(None, None, None, None, None), (9, "http://a.b/x", "", "h", "t"), rows[0]]
    got = h.main_text(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["page_id", "url", "text"]
    text = "the same ten words stand here in every single article"
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(r[0], r[1], text if r[2] else "") for r in rows], key=repr)
    assert h.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_unmarked_pages_against_brute_force(spark):
    footer = "all rights of this page are reserved by the owner of the site"
    bodies = {k: f"<div>intro {k} some words of page {k} only</div><p>unique {k} text before {footer} and after {k}</p><div>{footer}</div>" for k in range(5)}
    rows = [(k, f"https://Site.org/{k}?q=//x", body, "h", "t") for k, body in bodies.items()]
    rows += [(20, "http://other.org/a", bodies[0], "h", "t"), (30, "http://copy.org/1", bodies[1], "h", "t"), (31, "http://copy.org/2", bodies[1], "h", "t")]
    depth = 6
    tokens = {r[0]: [b.split() for b in re.findall(r">([^<]+)<", r[2])] for r in rows}
    host = {r[0]: re.search("//([^/]*)", r[1])[1].lower() for r in rows}
    pages = defaultdict(set)
    for page, blocks in tokens.items():
        stream = [t for b in blocks for t in b]
        for at in range(len(stream) - depth + 1):
            pages[host[page], tuple(stream[at : at + depth])].add(page)
    want = {}
    for page, blocks in tokens.items():
        stream = [t for b in blocks for t in b]
        gone = {at + k for at in range(len(stream) - depth + 1) if len(pages[host[page], tuple(stream[at : at + depth])]) > 1 for k in range(depth)}
        at, kept = 0, []
        for b in blocks:
            run = " ".join(t for k, t in enumerate(b, at) if k not in gone)
            at += len(b)
            kept += [run] if run else []
        want[page] = "\n\n".join(kept or [" ".join(b) for b in blocks])
    got = h.main_text(spark.createDataFrame(rows, SCHEMA), depth).collect()
    assert {r.page_id: r.text for r in got} == want
    assert footer not in want[2] and want[20].count(footer) == 2 and want[30].count(footer) == 2


def test_near_copies_and_quotations_stay(spark):
    footer = "terms of use and contact of the owner of this site"
    quote = "to be or not to be that is the question they ask"
    story = " ".join(f"story{k}" for k in range(120))
    bodies = {k: f"page {k} " + " ".join(f"own{k}w{j}" for j in range(40)) for k in range(20)}
    bodies |= {20: story, 21: story.replace("story60", "other"), 22: f"{bodies[0]} {quote} end a", 23: f"start b {quote} {bodies[1]}", 24: f"c {quote} d " + " ".join(f"z{j}" for j in range(30))}
    revised = " ".join(f"draft{k}" for k in range(60))
    bodies |= {25 + k: revised + " " + " ".join(f"new{k}w{j}" for j in range(60)) for k in range(3)}
    rows = [(k, f"http://one.org/{k}", f"<p>{body}</p><div>{footer}</div>", "h", "t") for k, body in bodies.items()]
    family = {100 + k: story.replace(f"story{9 * k + 5}", "changed") for k in range(5)}
    rows += [(k, f"http://family.org/{k}", f"<p>{body}</p>", "h", "t") for k, body in family.items()]
    got = {r.page_id: r.text for r in h.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == bodies | family


def test_repeats_are_runs_of_neighbours_in_every_range(spark):
    rows = [(f"h{k % 3}", f"head {j}", k) for k in range(40) for j in range(30) if k % (j + 1) == 0]
    rows += [("h0", "often", k) for k in range(300)] + [("h0", "often", 7), ("h1", "once", 1), ("h1", "once", 1)]
    want = defaultdict(set)
    for host, head, content in rows:
        want[host, head].add(content)
    streams = spark.createDataFrame(rows, "host string, head string, content long")
    got = {(r.host, r.head): r.on for r in h.repeats(streams).collect()}
    assert {k: v for k, v in got.items() if v >= h.PAGES} == {k: len(v) for k, v in want.items() if len(v) >= h.PAGES}
    assert h.repeats(streams.limit(0)).count() == 0


@pytest.mark.parametrize(("part", "piece"), [(2000, 1_000_000), (4, 1_000_000), (2000, 60), (4, 60)])
def test_the_array_decides_on_marked_pages_too(spark, monkeypatch, part, piece):
    """Every page of the given tables marks its main part; the array read none of their texts. Rows may repeat; a host may be in many parts and pieces."""
    monkeypatch.setattr(h, "PART_PAGES", part)
    monkeypatch.setattr(h, "PIECE_TOKENS", piece)
    draw, depth = random.Random(5), 4
    plain = [f"shared{k} " + " ".join(f"s{k}x{j}" for j in range(6)) for k in range(6)]
    rows = []
    for k in range(60):
        blocks = [" ".join(draw.choice("abc") + str(draw.randrange(3)) for _ in range(draw.randrange(1, 25))) for _ in range(draw.randrange(4))]
        blocks += draw.sample(plain, draw.randrange(3))
        draw.shuffle(blocks)
        body, loose = "".join(f"<p>{b}</p>" for b in blocks), draw.choice(plain)
        rows.append((k, f"http://h{min(k % 7, 2)}.org/{k}", f"<article>{body}</article><div>{loose}</div>" if k % 5 else f"{body}<div>{loose}</div>", "h", "t"))
    rows += [rows[3], (None, *rows[4][1:]), (100, None, None, None, None)]
    streams, of_host, on = [], defaultdict(set), defaultdict(set)
    for page, url, html, *_ in rows:
        blocks, marked = h.read_blocks(html or "")
        own, rest = [t.split() for t, main, _ in blocks if main], [t.split() for t, main, _ in blocks if not main]
        host, content = re.sub("^.*//|/.*$", "", url or ""), repr((marked, own, rest))
        streams.append((page, host, own if marked else rest))
        of_host[host].add(content)
        for words in (sum(own, []), sum(rest, [])):
            for at in range(len(words) - depth + 1):
                on[host, tuple(words[at : at + depth])].add(content)
    want, cut = [], 0
    for page, host, blocks in streams:
        words = sum(blocks, [])
        heads = [(at, on[host, tuple(words[at : at + depth])]) for at in range(len(words) - depth + 1)]
        gone = {at + k for at, pages in heads if len(pages) >= max(h.PAGES, h.OF_HOST * len(of_host[host])) for k in range(depth)}
        gone, at, kept = set() if len(gone) > h.MOST * len(words) else gone, 0, []
        for block in blocks:
            kept.append(" ".join(w for k, w in enumerate(block, at) if k not in gone))
            at += len(block)
        want.append((page, "\n\n".join(filter(None, kept))))
        cut += bool(gone) and page is not None and page % 5 > 0
    got = [(r.page_id, r.text) for r in h.main_text(spark.createDataFrame(rows, SCHEMA), depth).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and cut > 10
