import collections
import html as _html
import re

import pytest

import numpy as np
from pyspark.sql import functions as F

from lithos.llm import embeddings, html, registry
from lithos.sources.tables import read_table

from .helpers import groups


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 64)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 24))
    rows = [(i, (base[i % 60] * rng.uniform(0.5, 3) + rng.normal(scale=0.1 * (i % 4), size=24)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24),
                                                          (2003, [1.0, None]), (2004, [1.0]), (2005, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for i, v in rows if i < 2000])
    ids = [i for i, _ in rows if i < 2000]
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    want = groups([(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))], [i for i, _ in rows])
    links = dict(zip(ids, near.sum(1).tolist()))
    got = embeddings.near_duplicates(df, "vec_id", "embedding", 0.95).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_links"], r["component_id"]) == (links.get(r["vec_id"], 0), want[r["vec_id"]])
        assert r["kept"] == (r["vec_id"] == r["component_id"])


def test_vectors_odd_rows(spark):
    rows = [(0, [1.0, 0.0], "a"), (1, [2.0, 0.0], "a"), (6, [1.0, 0.01], "b"), (None, [1.0, 0.0], "b"), (6, [1.0, 0.01], "b"),
            (10, [-1.0, -0.0], "c"), (11, [-1.0, 0.0], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string")
    got = collections.Counter((r[0], r[1], r[2], r[3]) for r in embeddings.near_duplicates(df, "vec_id", "embedding", 0.95).collect())
    assert got == collections.Counter([(0, 4, 0, True), (1, 4, 0, False), (6, 4, 0, False), (6, 4, 0, False), (None, 4, 0, False),
                                       (10, 1, 10, True), (11, 1, 10, False)])
    assert embeddings.near_duplicates(df.limit(0), "vec_id", "embedding", 0.95).count() == 0


def _article(page):
    a = page[page.find("<article>") + 9:page.rfind("</article>")]
    a = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)>", " ", a))
    return " ".join(_html.unescape(a).split())


def test_pages(spark, sf_dir, monkeypatch):
    pages = {r["page_id"]: r for r in read_table(spark, sf_dir, "pages").collect()}
    for limit in (html.BROADCAST_BYTES, 0):  # wrappers as a broadcast, and joined
        monkeypatch.setattr(html, "BROADCAST_BYTES", limit)
        got = registry.q_html(spark, sf_dir).collect()
        assert len(got) == len(pages)
        for r in got:
            assert r["text"] == _article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"])


def test_page_parts():
    page = ('<html><head><title>x</title></head><body class="menu"><header><h1>Site</h1></header><div id="cookie-notice">We use</div>'
            "<main><h2>A &amp; B</h2><p>One<b>two</b> three<p>four<ul><li>i<li>j</ul><form><input>Name</form>"
            '<section class="comments"><p>hi</p></section></main><aside>s</aside></body>')
    assert html.main_text(page, None) == "A & B Onetwo three four i j"
    assert html.main_text("", None) == "" and html.main_text("plain &lt;b&gt; text", None) == "plain <b> text"
    assert html.main_text("<p>a < b</p><!-- x", None) == "a < b"
    assert html.main_text('<script>if (a<b) "</p>"</script><div>ok</div>', None) == "ok"


def test_wrapper_generalises():
    def nodes(page):
        symbols, _ = html.tokens(page)
        return html.fold(symbols, [1] * len(symbols))[0]

    one = nodes("<body><ul><li>a</li></ul><p>t</p></body>")
    many = nodes("<body><ul><li>a</li><li>b</li><li>c</li></ul><div>n</div><p>t</p></body>")
    wrapper = html.align([(n, False) for n in one], many)
    assert (("li", "#", "/li"), False) in wrapper and ("div", True) in wrapper and ("p", False) in wrapper
    assert html.load(html._dump(wrapper)) == wrapper
    rng = np.random.default_rng(0)
    for _ in range(30):  # folding loses nothing
        symbols = [str(x) for x in rng.choice(["a", "b", "/a", "#"], 40)]
        folded, sizes = html.fold(list(symbols), [1] * 40)
        assert sum(sizes) == 40 and len(folded) == len(sizes)


def test_pages_of_a_host_that_differ_in_a_class(spark):
    def page(box, n, shut="</div>"):
        body = "".join(f"<p>body {n} {i}</p>" for i in range(1 + n % 3))
        return (f'<html><body><div class="{box}">box {n}{shut}<article><h1>title {n}</h1>{body}</article>'
                f'<footer>foot</footer></body></html>', " ".join([f"title {n}", *(f"body {n} {i}" for i in range(1 + n % 3))]))

    made = [page("ad" if n % 4 else "byline", n) for n in range(24)] + [page("ad", 24, "")]  # one never closes its box
    rows = [(i, "http://h/x", text) for i, (text, _) in enumerate(made)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.extract(df.where("page_id < 24"), ["page_id"], "url", "html").collect()} == {
        i: text for i, (_, text) in enumerate(made[:24])}
    wrapper = [(n, False) for n in _nodes(made[1][0])]
    assert html.main_text(made[24][0], html.Wrapper(html.align(wrapper, _nodes(made[24][0])))) == made[24][1]
    assert html.main_text(made[24][0], None) == ""


def _nodes(page):
    symbols, _ = html.tokens(page)
    return html.fold(symbols, [1] * len(symbols))[0]


def test_pages_odd_rows(spark):
    rows = [(1, None, None, 0), (2, "http://h/x", "", 0), (3, "http://h/x", "<p>a</p>", 0), (3, "http://h/x", "<p>a</p>", 0),
            (None, "HTTP://user@H:80/y", "<p>b</p>" * 500, 0), (4, "no url", "<b>c", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = collections.Counter((r["page_id"], r["text"][:5]) for r in html.extract(df, ["page_id", "url"], "url", "html").collect())
    assert got == collections.Counter([(1, ""), (2, ""), (3, "a"), (3, "a"), (None, "b b b"), (4, "c")])
    assert html.extract(df.limit(0), ["page_id"], "url", "html").count() == 0
    hosts = {r[0] for r in df.select(html.host_of(F.col("url"))).collect()}
    assert hosts == {"", "h"}


@pytest.mark.parametrize("page,text", [
    ('<div id="page" class="no-sidebar"><nav>menu</nav><article><p>the long text of this article</p></article><div class="ad">buy</div></div>',
     "the long text of this article"),
    ('<div class="content has-sidebar"><p>the long text of this page</p><div class="sidebar">more</div></div><div class="footer">end</div>',
     "the long text of this page"),
    ('<article class="post ad-free"><p>text</p><figure><img><figcaption>a caption</figcaption></figure><div class="comments">no</div></article>',
     "text a caption"),
    ('<div class="main social-sharing-enabled"><div class="entry"><p>a good deal of text here</p></div><div class="share">tweet</div></div>',
     "a good deal of text here"),
    ('<article><p>all that is to be read on this page</p></article><div class="related"><article><p>teaser</p></article></div>',
     "all that is to be read on this page"),
    ("<div>comment <p>only</p></div><div class='comments'>" + "said a lot " * 40 + "</div>", "comment only")])
def test_names_do_not_outweigh_what_an_element_holds(page, text):
    assert html.main_text(page, None) == text


def test_unclosed_tags_take_linear_time():
    import time

    for page in ('<a "' * 250_000, "<p>x</p>" + "<a '" * 250_000, '<a "' * 250_001 + ">", "<b " * 300_000):
        start = time.perf_counter()
        html.tokens(page)
        assert time.perf_counter() - start < 10
    assert html.main_text('<p>a</p>1 < 2 <b "x', None) == 'a 1 < 2 <b "x'
    assert html.main_text("<p>a</p>b<!-- c", None) == "a b" and html.main_text("<p>a</p>b<script c", None) == "a b"


def _host_pages(kind, n, rng):
    """(html, main text) of ``n`` pages of a host whose names say nothing, or the wrong thing."""
    def words(k):
        return " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(k))

    out = []
    for _ in range(n):
        title, paragraphs = words(5), [words(int(rng.integers(5, 40))) for _ in range(int(rng.integers(1, 6)))]
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        menu = "<div class='aa'><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></div>"
        ends = f"<div class='bb'><h3>Most read</h3><p>{words(3)}</p></div><div class='cc'><p>All rights are ours</p></div>"
        text = [title, *paragraphs]
        if kind == "plain":
            page = f"{menu}<div class='dd'><h1>{title}</h1>{body}</div>{ends}"
        elif kind == "misleading":
            page = f"{menu}<div class='page has-sidebar' id='no-ads'><h1>{title}</h1>{body}</div><div class='post-box'>{words(3)}</div>{ends}"
        elif kind == "title before":
            page = f"{menu}<div class='dd'><h1>{title}</h1><div class='ee'>{body}</div></div>{ends}"
        elif kind == "flat":
            page = f"{menu}<h1>{title}</h1>{body}<div class='cc'><p>All rights are ours</p></div>"
        else:  # constant paragraphs of an article stay, a box that is the same on every page goes
            page = f"{menu}<article><h1>{title}</h1><div class='qq'>Tell your friends</div>{body}<h2>Sources</h2><p>none</p></article>{ends}"
            text += ["Sources", "none"]
        out.append((f"<html><body>{page}</body></html>", " ".join(text)))
    return out


HOSTS = ("plain", "misleading", "title before", "flat", "marked")


def test_the_wrapper_decides(spark, monkeypatch):
    rng = np.random.default_rng(11)
    made = {}
    for kind in HOSTS:
        pages = _host_pages(kind, 24, rng)
        for page, text in pages + pages[:1] * 40:  # copies of one page make none of its texts template
            made[len(made)] = (kind, page, text)
    rows = [(i, f"http://{kind.replace(' ', '-')}.example/{i}", page) for i, (kind, page, _) in made.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for limit in (html.BROADCAST_BYTES, 0):
        monkeypatch.setattr(html, "BROADCAST_BYTES", limit)
        got = {r["page_id"]: r["text"] for r in html.extract(df, ["page_id"], "url", "html").collect()}
        assert got == {i: text for i, (_, _, text) in made.items()}
    for kind, page, text in made.values():  # names alone do not find it
        assert html.main_text(page, None) != text


def test_the_wrapper_decides_for_pages_of_any_size(spark):
    rng = np.random.default_rng(12)
    # headings of many names fold into no group, so that every page has thousands of nodes
    long = [(f"<h{1 + int(k) % 6} class='{a}{b}'>{a}{b}{i}</h{1 + int(k) % 6}>", f"{a}{b}{i}") for i, (k, a, b) in enumerate(zip(
        rng.integers(0, 6, 900), rng.choice(list("abcdefgh"), 900), rng.choice(list("ijklmnop"), 900), strict=True))]
    rows = []
    for page, text in _host_pages("title before", 6, rng):
        own = f"own{len(rows)} "
        rows.append((page.replace("<div class='ee'>", "<div class='ee'>" + "".join(h for h, _ in long).replace("</h", own + "</h")),
                     text.split(), " ".join(t + own for _, t in long).split()))
    assert all(len(html.fold(s, [1] * len(s))[0]) > 2_000 for s in (html.tokens(page)[0] for page, *_ in rows))
    df = spark.createDataFrame([(i, "http://long.example/", page) for i, (page, *_) in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df, ["page_id"], "url", "html").collect()}
    assert got == {i: " ".join([*text[:5], *inner, *text[5:]]) for i, (_, text, inner) in enumerate(rows)}


@pytest.mark.parametrize("letters", [2, 5, 40])
def test_the_longest_run_is_that_of_difflib(letters):
    rng = np.random.default_rng(letters)
    for _ in range(60):
        a, b = (rng.integers(0, letters, int(rng.integers(1, 90))).tolist() for _ in range(2))
        lo = int(rng.integers(0, len(a)))
        want = html.SequenceMatcher(None, a, b, autojunk=False).find_longest_match(lo, len(a), 0, len(b))
        assert html._longest(a, b, lo, len(a), 0, len(b)) == tuple(want)


def test_nodes_align_alike_in_any_number(monkeypatch):
    rng = np.random.default_rng(3)
    a, b = (rng.choice(["p", "#", "/p", "h2", ("li", "#")[0], "ul", "/ul"], 400).tolist() for _ in range(2))
    direct = html._matches(a, b)
    monkeypatch.setattr(html, "DIRECT", 0)
    assert html._matches(a, b) == direct


def test_slots_count_different_pages(spark):
    rows = [(i, "http://h/", f"<body><div class='a'>menu</div><div class='b'><p>{'word ' * 9}{i % 7}</p></div></body>") for i in range(70)]
    rows += [(99, "http://h/", None), (100, None, "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["host"]: html.load_slots(r["slots"]) for r in html.inferred(df, "url", "html").collect()}
    assert {(c, pages, top) for _, c, _, pages, top, _ in got["h"]} == {("body>div.a", 7, 7), ("body>div.b>p", 7, 1)}
    assert [(c, pages, top, size) for _, c, _, pages, top, size in got[""]] == [("p", 1, 1, 1)]


def test_close_tags_are_no_repeat():
    nodes = _nodes("<div><div><div>a</div></div></div>")
    assert nodes == [("div",), "#", "/div", "/div", "/div"]
    wrapper = html.Wrapper([(n, False) for n in _nodes("<div class='a'><div class='b'>t</div></div><p>u</p>")])
    assert wrapper.paths[wrapper.nodes.index("p")] == frozenset()
