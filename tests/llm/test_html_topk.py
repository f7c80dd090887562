import html
import random
import re
import time
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from lociframe.llm import html_text, topk
from lociframe.llm.registry import op2_html_text, op9_topk


def plain(page):
    """The article of the test tables' one template, by a regular expression."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"<(?:/?p|/?h1|br)>", article))
    return "\n".join(x for x in blocks if x)


def test_pages(spark, sf):
    want = {r.page_id: (r.url, plain(r.html)) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op2_html_text(spark, sf).collect()
    assert {r.page_id: (r.url, r.text) for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


ARTICLE = "<p>Hello there, this is the first paragraph of the article.</p><p>And&nbsp;this  is\nthe second &lt;one&gt;, also long enough.</p>"
TEXT = "Hello there, this is the first paragraph of the article.\nAnd this is the second <one>, also long enough."
OTHER = (
    '<div class="site-header">Name of the site</div><ul class="menu-2"><li><a href=x>Home</a><li><a href=y>News</a></ul>{}<div id="comments"><p>A reader wrote this long comment here, really.</p></div>'
    '<div class="sidebar-left"><p>About us, a text which has some length too.</p></div><div class="cookie-notice">We use cookies, accept them all.</div><form><p>Search for something?</p></form>'
    '<script>var x = "<p>not text</p>";</script><style>p > b {{}}</style><!-- <p>nor this</p> --><footer>All rights</footer>'
)


def text_of(page):
    return html_text.main_text(html_text.parse(page))


def test_templates():
    for box in ("<article>{}</article>", '<div class="content-12">{}</div>', "<main><div><div>{}</div></div></main>", '<td><div id="post">{}</div></td>', "<article><header><h1></h1></header>{}<div class=share>Share</div></article>"):
        assert text_of(OTHER.format(box.format(ARTICLE))) == TEXT, box
    assert text_of("<p>open <b>bold<p title='a > b'>next &amp; last<br>line") == "open bold\nnext & last\nline"
    assert text_of("just text\n here") == "just text here"
    assert text_of(None) == text_of("") == text_of("<script>unclosed <p>x") == ""
    assert text_of("<div><p>cut in a tag of the page <a hr") == "cut in a tag of the page"


P = ["The first paragraph of a page says something that is long enough.", "A second one goes on about it for a while, as they do.", "The last one ends it, with no more to be said about it."]
PS = "".join(f"<p>{p}</p>" for p in P)


def test_hostile_pages():
    """Deep and unclosed markup takes time and memory in proportion to the page."""
    n = 30_000
    for page in (
        "<div>" * n + PS, "<div>x" * n, "<b>" * n + "<br>x" * n, "<b>" * n + "</i>x" * n, "<i><div>" + "<b>" * n + "</i>x" * n, '<div class="sidebar">' * n + PS, "<p><b>" * n,
        "<ul><li>" * n + "x", "<span>" * n + "<p>x" * n, "<header>" * n + "x",
    ):
        began = time.process_time()
        tracemalloc.start()
        html_text.main_text(html_text.parse(page))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert time.process_time() - began < 10 and peak < 200e6, page[:20]
    assert text_of("<div>" * 1000 + PS) == "\n".join(P)


def test_names_round_the_only_article():
    for name in ("class='post comments'", "id=ad-column", "class=sponsored", "class=newsletter"):
        assert text_of(f"<body><ul class=menu><li>Home</ul><div {name}>{PS}</div><footer>All rights</footer>") == "\n".join(P), name
        assert text_of(f"<body><div {name}><div>{ARTICLE}</div></div></body>") == TEXT
    assert text_of(f"<body><div class=content><p>{P[0]}</p></div><div class=comments>{PS}{PS}</div>") == P[0]
    assert text_of(f"<body><div class=cookie-notice><p>{P[0]}</p></div>") == ""


def test_page_set():
    """Pages with what browsers forgive, and the exact texts."""
    all_three = "\n".join(P)
    cases = {
        f"<html><head><title>T</title><meta charset=utf-8><body><article>{PS}</article>": all_three,
        f"<head><link rel=x><article>{PS}</article>": all_three,
        f"<article><p>{P[0]}</p><button>Press<p>{P[1]}</p><p>{P[2]}</p></article>": all_three,
        f"<article><p>{P[0]}</p><select><option>one<option>two<p>{P[1]}</p><p>{P[2]}</p></article>": all_three,
        f"<article><p>{P[0]}</p><svg><text>label<p>{P[1]}</p><p>{P[2]}</p></article>": all_three,
        f"<article><p>{P[0]} <button>Press</button></p><p>{P[1]}</p><svg><g><text>x</text></g></svg><p>{P[2]}</p><video>no</video></article>": all_three,
        f"<article><p>{P[0]}</p><button-group><p>{P[1]}</p></button-group><video-player></video-player><title-bar>{P[2]}</title-bar></article>": all_three,
        f"<article><p>{P[0]}</p><figure><img src=x><figcaption>A caption.</figcaption></figure><p>{P[1]}</p></article>": f"{P[0]}\nA caption.\n{P[1]}",
        f"<article><p>{P[0]} <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p><object data=x><p>{P[1]}</p></object></article>": f"{P[0]} x=2\n{P[1]}",
        f'<article><p>{P[0]}</p><p class="advert">Buy this now</p><p hidden>secret</p><p style="display: none">gone</p><p>{P[1]}</p></article>': "\n".join(P[:2]),
        f'<article><ul><li class="menu-item">Home<li class="menu-item">News</ul>{PS}<p>Read <span class="share-count">17 shares</span>more.</p></article>': f"{all_three}\nRead more.",
        f'<article><div class="side-by-side">{PS}</div><div class="legal-analysis"><p>{P[0]}</p></div><p class="share-price">{P[1]}</p><section id="related-work"><p>{P[2]}</p></section></article>': f"{all_three}\n{all_three}",
        f'<body><div class="sidebar-left"><p>{P[0]}</p></div><div class="main-column"><h1>Title</h1>{PS}</div><div class="relatedPosts"><p>{P[1]}</p></div></body>': f"Title\n{all_three}",
        f'<body><form action=x><div id=header><p>Site</p></div><div class=content>{PS}</div><input name=q></form></body>': all_three,
        f"<main><header><h1>Title</h1><p>By somebody</p></header>{PS}<section class=comments><p>{P[0]} I agree with that very much.</p><p>{P[1]} So do I, and for a long time.</p></section></main>": f"Title\n{all_three}",
        f"<table><tr><td class=nav><a href=x>Home</a><a href=y>News</a><td>{PS}<tr><td>Copy<td></table>": all_three,
        f"<article>{PS}<ul><li>one<li>two<ul><li>deep</ul><li>three</ul><dl><dt>a<dd>b<dt>c</dl><pre>x\n  y</pre></article>": f"{all_three}\none\ntwo\ndeep\nthree\na\nb\nc\nx y",
    }
    for page, want in cases.items():
        assert text_of(page) == want, page


def test_many_open_tags():
    assert len(text_of("<button>" * 20_000 + "<a " * 50_000 + "<p>end of it</p>")) < 200_000
    assert text_of("<div>" * 3_000 + "deep" + "</div>" * 3_000) == "deep"


def test_repeated_paths(spark):
    """On each host of five templates, an unnamed box with one text on all pages goes; the same box with texts of its own stays, and so do copies of a page."""
    shells = ["<article>{}</article>", '<div class="content-{n}">{}</div>', "<main><div>{}</div></main>", '<table><tr><td class="x">{}</td></tr></table>', '<section id="post">{}</section>']
    rows, want = [], {}
    for t, shell in enumerate(shells):
        for n in range(12):
            own = [f"Page {n} of host {t} {p}" for p in P]
            note = f"<p class='note'>Note {n} of {t}.</p>"
            page = f"<body>{shell.replace('{n}', str(n)).format(''.join(f'<p>{p}</p>' for p in own) + note + f'<p class=app>Our app is in the store.</p>')}</body>"
            rows.append((100 * t + n, f"http://h{t}.example/{n}", page))
            want[100 * t + n] = "\n".join([*own, f"Note {n} of {t}."])
    copies = "<body><article>" + PS + "<p class=lead>All copies have this lead.</p></article></body>"
    rows += [(900 + n, "http://copies.example/", copies) for n in range(12)]
    want |= {900 + n: "\n".join([*P, "All copies have this lead."]) for n in range(12)}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.key: r.text for r in html_text.extract(pages).collect()} == want


def test_consensus(spark):
    short = '<body><div class="body-1"><p>Too short.</p></div><div class="x"><p>Something that is longer than the text but on no other page.</p></div></body>'
    long = '<body><div class="body-2"><p>' + "A long article text. " * 9 + '</p></div><div class="x"><p>Other.</p></div></body>'
    pages = spark.createDataFrame([(k, "https://Host.example/p", long) for k in range(5)] + [(9, "http://host.example:80/q", short)], "page_id long, url string, html string")
    rows = {r.key: r for r in html_text.extract(pages).collect()}
    assert rows[9].text == "Too short." and rows[9].path == ">body>div.body"


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "no url", "<p>x</p>"), (1, None, ""), (2, "http://h/", "<p>" + "y " * 200_000)], "page_id long, url string, html string")
    pages = pages.selectExpr("*", "'clash' as host", "'clash' as key", "'clash' as text", "'clash' as paths")
    rows = html_text.extract(pages).collect()
    assert sorted((r.key or 0, len(r.text)) for r in rows) == [(0, 1), (1, 0), (1, 0), (2, 399_999)]
    assert html_text.extract(pages.limit(0)).count() == 0


def brute(ids, vectors, k, asks):
    bits = np.array([[x is not None and x > 0 for x in v] for v in vectors])
    out = []
    for q in range(len(ids)):
        if asks(ids[q]):
            far = (bits ^ bits[q]).sum(1)
            order = [o for o in np.lexsort((ids, far)) if ids[o] != ids[q]][:k]
            out += [(ids[q], n + 1, ids[o], int(far[o])) for n, o in enumerate(order)]
    return sorted(out)


def test_topk(spark, sf, monkeypatch):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    want = brute(table.vec_id.tolist(), table.embedding.tolist(), 10, lambda i: i % 50 == 0)
    assert sorted(map(tuple, op9_topk(spark, sf).select("query_id", "rank", "vec_id", "distance").collect())) == want
    monkeypatch.setattr(topk, "PART_CODES", 20)
    monkeypatch.setattr(topk, "SPLIT_QUERIES", 2)
    assert sorted(map(tuple, op9_topk(spark, sf).select("query_id", "rank", "vec_id", "distance").collect())) == want


def test_topk_ties_and_odd(spark):
    rng = random.Random(5)
    rows = [(k, [rng.choice([-1.0, 1.0, 0.0]) for _ in range(6)]) for k in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'clash' as id", "'clash' as code", "'clash' as v")
    got = topk.top_k(topk.sign_codes(frame), F.col("id") % 7 == 0, 20)
    assert sorted(map(tuple, got.collect())) == brute([r[0] for r in rows], [r[1] for r in rows], 20, lambda i: i % 7 == 0)
    odd = spark.createDataFrame([(0, None), (1, []), (2, [1.0, None, float("nan")]), (None, [1.0]), (2, [1.0, None, float("nan")])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(topk.sign_codes(odd), F.lit(True), 5).collect()))
    assert got == [(0, 1, 1, 0), (0, 2, 2, 1), (1, 1, 0, 0), (1, 2, 2, 1), (2, 1, 0, 1), (2, 2, 1, 1)]
    assert topk.top_k(topk.sign_codes(odd.limit(0)), F.lit(True), 5).count() == 0
