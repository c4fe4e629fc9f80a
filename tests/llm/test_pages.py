"""Wrappers and the text that they take from pages."""

import random

import pytest

from tabloom.llm import wrappers
from tabloom.llm.queries import QUERIES

ARTICLE = """<html><head><title>T</title></head><body><header>Site</header><nav><ul><li><a href=/>Home</a><li>News</ul></nav>
<div class="ad-box">Buy</div><article class="with-sidebar"><h1>A &amp; B&nbsp;C</h1><p>One <b>two</b>
 three<br>four<p>five<script>var p = "</p>";</script><div class="share-links">Share</div><ul><li>x<li>y</ul>
<section id="comments"><p>Nice!</p></section><form><p>Mail</p></form></article><footer>End</footer>"""


def test_parts_of_a_page():
    want = "A & B C\nOne two three four\nfive\nx\ny"
    assert wrappers.main_text(ARTICLE, ["/html/body/article.with-sidebar"]) == want
    assert wrappers.main_text(ARTICLE, []) == want


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain &lt;text&gt;  here", "plain <text> here"), ("<p>a<p>b</p></div>c", "a\nb\nc"),
    ("<p>a <!-- <p>no --> b<br>c", "a b c"), ("<div><p>cut of<a hre", "cut of"), ("<script>never ends <p>x", ""),
    ("<p>f<i>oo</i>bar</p>", "foobar"), ("a <3 b &am &copy; &#8364;", "a <3 b &am © €"), ("<P CLASS='Cookie-Notice'>x</P><p>y", "y"),
    ("<div style='display: none'>x</div><div aria-hidden=true>z</div>y", "y"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
])
def test_odd_pages(page, text):
    assert wrappers.main_text(page, []) == text


def body(i, extra=""):
    return f"<body><div class=top>Welcome to our site</div><div class=wrap><h2>Title {i}</h2>{'<p>text %d of it</p>' % i * (i % 4 + 1)}{extra}</div></body>"


def test_expression_is_union_free():
    """Repeated neighbours are one group; what some pages lack is optional; texts that differ are slots."""
    pages = [body(i, "<hr><dl><dt>k<dd>v<dt>l<dd>w</dl>" if i % 2 else "") for i in range(10)]
    whole = wrappers.expression(wrappers.parse(pages[0]))
    for p in pages[1:]:
        whole = wrappers.align(whole, wrappers.expression(wrappers.parse(p)))
    top, wrap = whole["k"][0]["k"]
    assert top["k"][0]["t"] == "Welcome to our site" and top["k"][0]["n"] == 10
    head, text, line, extra = wrap["k"]
    assert head["k"][0]["t"] is None and text["r"] == 1 and text["n"] == 10 and line["o"] == extra["o"] == 1
    assert extra["k"][0]["g"] == 1 and [k["s"] for k in extra["k"][0]["k"]] == ["dt", "dd"]
    # Without an article element, the part with the text that differs is the article.
    assert wrappers.containers(whole) == ["/body/div.wrap"]


def test_alignment_order_does_not_matter_for_containers():
    pages = [wrappers.expression(wrappers.parse(body(i))) for i in range(12)]
    left = right = None
    for p in pages:
        left = p if left is None else wrappers.align(left, p)
    for p in pages[::-1]:
        right = p if right is None else wrappers.align(right, p)
    halves = wrappers.align(*(wrappers.align(wrappers.align(a, b), c) for a, b, c in (pages[:3], pages[3:6])))
    assert wrappers.containers(left) == wrappers.containers(right) == ["/body/div.wrap"] and halves["n"] == 6


def test_long_sequences():
    a, b = [str(i % 50) for i in range(300)], [str(i % 70) for i in range(300)]
    found = wrappers.matches(a, b)
    assert all(a[i] == b[j] for i, j in found) and found == sorted(found) and len(found) > 50


def plain_length(a, b):
    row = [0] * (len(b) + 1)
    for s in a:
        new = [0]
        for j, t in enumerate(b):
            new.append(row[j] + 1 if s == t else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment_is_longest(monkeypatch):
    """At every size, in one table and in halves."""
    import random
    rng = random.Random(4)
    lists = [([rng.choice("abcdefgh"[:k]) for _ in range(rng.randrange(60))], [rng.choice("abcdefgh"[:k]) for _ in range(rng.randrange(60))])
             for k in (1, 2, 4, 8) for _ in range(40)]
    jump = [f"x{i}" for i in range(250)]
    lists += [(["end", *jump], [*jump[:200], "y", *jump[200:], "end"]), ([rng.choice("abcd") for _ in range(300)], [rng.choice("abcde") for _ in range(280)])]
    for bits in (wrappers.TABLE_BITS, 50):
        monkeypatch.setattr(wrappers, "TABLE_BITS", bits)
        for a, b in lists:
            found = wrappers.matches(a, b)
            assert all(a[i] == b[j] for i, j in found) and len(found) == plain_length(a, b)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))


def merged_wrapper(pages):
    whole = None
    for p in pages:
        own = wrappers.expression(wrappers.parse(p))
        whole = own if whole is None else wrappers.align(whole, own)
    return whole


def test_counts_of_one_path_and_long_texts():
    # The order of two parts splits the article over two nodes, each with under half of the pages.
    kid = lambda n: {"s": "article", "n": n, "o": 1, "m": 1, "k": [{"s": "#", "n": n, "c": 90, "l": 0, "t": None}]}
    assert wrappers.containers({"s": "#root", "n": 10, "k": [kid(4), {"s": "div", "n": 10, "k": []}, kid(4)]}) == ["/article"]
    whole = merged_wrapper([f"<div class=a><p>{'same ' * 60}{i}</div><div class=b>x {i}</div>" for i in range(9)])
    assert whole["k"][0]["k"][0]["k"][0]["t"] is None and whole["k"][0]["k"][0]["k"][0]["c"] > 2700


def test_no_variable_text_beside_the_container():
    """A lead beside the body and the other layout of a few pages stay."""
    long = lambda i: "".join(f"<p>part {k} of {i} in many words</p>" for k in range(40))
    pages = [f"<body><div class=page><div class=lead>Lead {i}.</div><div class=text><div class=inner>{long(i)}</div></div></div></body>" for i in range(20)]
    pages.append("<body><div class=page><div class=old>Old layout.</div></div></body>")
    paths = wrappers.containers(merged_wrapper(pages))
    assert wrappers.main_text(pages[3], paths).startswith("Lead 3.\npart 0 of 3") and wrappers.main_text(pages[20], paths) == "Old layout."


def taken(pages):
    whole = merged_wrapper(pages)
    paths = wrappers.containers(whole)
    return [wrappers.main_text(p, paths, wrappers.shown(whole), wrappers.template(whole, paths)) for p in pages]


@pytest.mark.parametrize("around", ["div class=content-with-sidebar", "div class=has-sidebar", "div id=share-page", "form", "header"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_hints_hide_no_article(around, tag):
    close = around.split()[0]
    pages = [f"<body><div class=menu>Menu {i}</div><{around}><{tag}><p>Text {i} of the page.<p>And more of {i}.</{tag}></{close}></body>" for i in range(12)]
    assert taken(pages) == [f"Text {i} of the page.\nAnd more of {i}." for i in range(12)]
    assert taken(pages[:1]) == ["Text 0 of the page.\nAnd more of 0."]


def test_template_inside_the_container():
    """Linked blocks that all pages share go; what stands in plain text stays, as a constant alone is no sign."""
    own = lambda i: f"<h1>Title {i}</h1>" + ("<h2>Notes</h2>" if i % 2 else "") + f"<p>Text {i}.</p>"
    pages = [f"<body><article><div class=box><a href=/p>Printed from our site</a></div><ul><li><a href=/1>One</a><li><a href=/2>Two</a></ul>{own(i)}<div class=end>Call <a href=/us>us at home</a></div></article></body>" for i in range(20)]
    assert taken(pages) == [f"Title {i}\n" + ("Notes\n" if i % 2 else "") + f"Text {i}." for i in range(20)]
    # At any number of pages.
    assert taken(pages[:7]) == taken(pages)[:7]


def test_extract(spark):
    rows = [(i, f"https://Host{i % 2}.example/{i}", body(i) if i % 2 else ARTICLE, "x", "y") for i in range(40)]
    rows += [(90, None, None, "", ""), (91, "", "", "", ""), (92, "no address", "<p>" + "long text " * 60_000, "", ""), rows[1]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, containers string").repartition(4)
    got = wrappers.extract_pages(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[0].text == "A & B C\nOne two three four\nfive\nx\ny" and by[0].url == "https://Host0.example/0"
    assert by[3].text == "Title 3" + "\ntext 3 of it" * 4
    assert by[90].text == by[91].text == "" and by[92].n_chars == 600_000 - 1 and all(r.n_chars == len(r.text) for r in got)
    hosts = {r.host: (r.pages, r.containers) for r in wrappers.infer_wrappers(pages).collect()}
    assert hosts["host1.example"] == (21, ["/body/div.wrap"]) and hosts["host0.example"] == (20, ["/html/body/article.with-sidebar"])
    assert wrappers.extract_pages(pages.limit(0)).count() == 0


def test_query_keeps_articles_whole(spark, sf):
    import html
    import re
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op7_pages"](spark, sf).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        assert r.text.split() == html.unescape(re.sub(r"<[^>]+>", " ", inner)).split()


@pytest.mark.parametrize("pages", [1, 2, 5, 8, 50])
def test_constant_headings_stay(spark, pages):
    """What an article says stays at any number of pages, and what only the template links to goes."""
    rows = []
    for i in range(pages):
        body = f"<h1>Recipe</h1><p>Dish number {i} is made of {i + 3} things and tastes well.</p><h2>Ingredients</h2><ul><li>Salt</li><li>{i} eggs</li></ul>" \
               f"<h2>Method</h2><p>Stir.</p><table><tr><th>Time</th><td>{i} min</td></tr></table><div class='x'><a href='/all'>All recipes</a></div>"
        rows.append((i, f"https://r.example/{i}", f"<html><body><div class='top'>Site</div><article>{body}</article></body></html>"))
    got = {r.page_id: r.text for r in wrappers.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(pages):
        want = ["Recipe", f"Dish number {i} is made of {i + 3} things and tastes well.", "Ingredients", "Salt", f"{i} eggs", "Method", "Stir.", "Time", f"{i} min"]
        assert got[i].split("\n") == want + (["All recipes"] if pages == 1 else [])


def test_copies_of_one_page(spark):
    """Pages that differ in a date at the bottom alone keep their article."""
    page = "<html><body><div class='b'><h1>One title</h1><p>{}</p></div><div class='d'>Seen on day {}</div></body></html>"
    rows = [(i, "https://c.example/x", page.format("Long text. " * 30, i)) for i in range(9)]
    got = wrappers.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("One title" in r.text and "Long text." in r.text for r in got)


def test_order_of_rows_does_not_matter(spark):
    rng = random.Random(8)
    rows = [(i, f"https://o.example/{i}", "<html><body>" + "".join(
        f"<div class='k{rng.randrange(6)}'><p>{rng.random()}</p></div>" for _ in range(rng.randrange(1, 9))) + "</body></html>") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    runs = [sorted(map(tuple, wrappers.extract_pages(df).collect())) for _ in range(2)]
    assert runs[0] == runs[1]
