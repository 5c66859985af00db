import re

import pandas as pd

from lexforge.llm import wrappers as W

PAGE = """<!doctype html><html><head><title>T {n}</title><style>p{{}}</style></head><body class="x{n}">
<header><h2>Site</h2></header><nav><ul><li>Home<li>News {n}</ul></nav>
<div class="ad-box">Buy {n}</div><!-- <p>no</p> --><{main} class="body">
<h1>Title &amp; {n}</h1><p>First  <b>bold</b>
 {n} &eacute;&#233;<p>Second<br>line {n}</p>{more}<p class="share">Share</p><div>Read more in our archive</div>
<form><input>Send {n}</form><script>var a = "<p>x</p>";</script></{main}>
<section class="comments"><p>Nice post {n}</p></section><aside>Side</aside><footer>&copy; {n}</footer></body></html>"""


def page(n, main="article", more=""):
    return PAGE.format(n=n, main=main, more=more)


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS wrapper", "3 AS text")
    return {r.page_id: r.text for r in W.main_text(df).collect()}


def want(n, more=""):
    return f"Title & {n}\n\nFirst bold {n} éé\n\nSecond line {n}{more}"


def test_named_article_and_template_text(spark):
    rows = [(n, f"http://a.example/{n}", page(n, more="<ul><li>one</li><li>two</ul>" if n % 2 else "")) for n in range(6)]
    rows += [(10, "http://single.example/", page(10))]
    out = texts(spark, rows)
    told = "\n\nRead more in our archive"  # in the article, so it stays
    assert all(out[n] == want(n, "\n\none\n\ntwo" if n % 2 else "") + told for n in range(6))
    assert out[10] == want(10) + told


def test_article_found_where_text_varies(spark):
    out = texts(spark, [(n, "http://b.example/x", page(n, main="div")) for n in range(5)])
    assert all(out[n] == want(n) for n in range(5))


def test_odd_rows(spark):
    html = "<p>a<p>b <i>c</i>&nbsp;d</p><table><tr><td>1<td>2</table>tail <"
    rows = [(1, None, html), (2, "::bad url", ""), (3, None, None), (4, "http://c/", "plain   text"), (4, "http://c/", "plain   text"), (5, "http://d/", "<article>" + "<p>w</p>" * 20_000), (6, "http://e/", "<div>" * 3)]
    out = texts(spark, rows)
    assert out[1] == "a\n\nb c d\n\n1\n\n2\n\ntail <" and out[2] == out[3] == out[6] == "" and out[4] == "plain text" and out[5].count("w") == 20_000
    assert texts(spark, []) == {}


def test_pages_of_another_layout_have_their_own_place(spark):
    body = lambda kind, n: f"<html><body><nav>Home</nav><{kind}><h1>Head {n}</h1><p>Some text of page {n}, told at length</p></{kind.split()[0]}><footer>f</footer></body></html>"
    told = lambda n: f"Head {n}\n\nSome text of page {n}, told at length"
    kinds = ["article"] * 4 + ["div class='post'"] * 2 + ["section id='story'"] + ["main class='menu-page'", "article class='related-story'"]
    for url in ("http://mixed.example/{}", None, "::bad {}"):
        out = texts(spark, [(n, url and url.format(n), body(k, n)) for n, k in enumerate(kinds)])
        assert out == {n: told(n) for n in range(len(kinds))}
    # No page of the host has an article: most have it in one place, some in another, which may have the first one as well.
    rows = [(n, "http://plain.example/", body("div class='a'", n)) for n in range(20)] + [(n, "http://plain.example/", body("div class='b'", n)) for n in (20, 21)]
    rows += [(22, "http://plain.example/", body("div class='b'", 22).replace("<nav>", "<div class='a'><p>see</p></div><nav>"))]
    assert texts(spark, rows) == {n: told(n) for n in range(23)}


def test_classes_leave_out_neither_body_nor_layout(spark):
    for name in ("has-sidebar", "with-sidebar no-header", "search menu", "widget"):
        page_ = f"<html class='{name}'><body class='{name}'><div class='ad'>Buy</div><div class='page has-sidebar'><article class='{name}'><p>Told</p></article></div></body></html>"
        assert texts(spark, [(1, "http://x.example/", page_), (2, None, page_.replace(f"<article class='{name}'>", "<div>").replace("</article>", "</div>"))]) == {1: "Told", 2: "Told"}, name


def test_copies_and_rare_equal_texts_are_no_template(spark):
    html = lambda n, more="": f"<body><article><h1>T {n}</h1><p>Told {n}</p>{more}</article></body>"
    odd = html(0, "<h2>Part</h2><table><tr><td>cell</td></tr></table><blockquote>said</blockquote>")
    rows = [(n, f"http://c.example/{n}", html(n)) for n in range(1, 9)] + [(100 + n, f"http://c.example/copy{n}", odd) for n in range(20)]
    rows += [(200 + n, "http://c.example/part", html(20 + n, "<h3>Notes</h3>")) for n in range(3)]
    out = texts(spark, rows)
    assert all(out[100 + n] == "T 0\n\nTold 0\n\nPart\n\ncell\n\nsaid" for n in range(20))
    assert all(out[200 + n] == f"T {20 + n}\n\nTold {20 + n}\n\nNotes" for n in range(3)) and out[1] == "T 1\n\nTold 1"
    assert texts(spark, [(n, "http://d.example/", odd) for n in range(3)] + [(9, "http://d.example/", html(9))])[0] == out[100]


def test_alignment_makes_groups_options_and_slots():
    own = [W.single(W.parse(x)) for x in ("<ul><li>x<li>y</ul><p>same", "<ul><li>z</ul><div>d</div><p>same", "<p>same")]
    assert W.expression(W.merged(own)) == "(<ul>(<li>(.*)</li>)+</ul>)?(<div>d</div>)?<p>same</p>"
    assert W.expression(W.Wrapper.unpack(W.merged(own).pack())) == W.expression(W.merged(own))


def test_common_order_of_long_rows():
    a, b = ["p", "ul"] * 10_000, ["h2"] + ["p", "ul"] * 9_000 + ["p"] * 900
    found = W.pairs(a, b)
    assert all(a[i] == b[j] for i, j in found) and len(found) > 18_000
    assert all(x < y and i < j for (x, i), (y, j) in zip(found, found[1:], strict=False))
    assert W.pairs(list("abcd"), list("xbyd")) == [(1, 1), (3, 3)] and W.pairs([], ["a"]) == []


def test_deep_and_long_pages(spark):
    deep = lambda n, depth: "<div>" * depth + f"<p>Text {n}" + "</div>" * depth
    long = lambda n, k: "<article>" + f"<p>a {n}</p><ul><li>b {n}</ul>" * k + "</article>"
    rows = [(n, "http://deep.example/", deep(n, d)) for n, d in enumerate((1_200, 5_000, 50_000, 3))]
    rows += [(10 + n, "http://long.example/", long(n, k) if n != 2 else "<article><h1>T</h1><ul><li>x</ul></article>") for n, k in enumerate((10_000, 9_990, 0, 1))]
    out = texts(spark, rows)
    assert all(out[n] == f"Text {n}" for n in range(4))
    assert out[12] == "T\n\nx" and all(out[10 + n] == "\n\n".join([f"a {n}", f"b {n}"] * k) for n, k in ((0, 10_000), (1, 9_990), (3, 1)))


def test_equal_headings_and_formulas_stay(spark):
    html = lambda n, tag: f"<body><nav>Menu</nav><{tag}><h2>Summary</h2><p>Told {n}: <math><mi>x</mi><mo>=</mo><mn>{n}</mn></math></p><div class='warning'>Mind {n}</div></{tag}></body>"
    for tag in ("article", "div"):
        out = texts(spark, [(n, "http://h.example/", html(n, tag)) for n in range(12)])
        assert all(out[n] == f"Summary\n\nTold {n}: x={n}\n\nMind {n}" for n in range(12))
    reader = "<main><article><p>Told</p></article><article class='comment'><p>Nice</p></article><form>Send</form></main>"
    assert texts(spark, [(1, "http://r.example/", reader)]) == {1: "Told"}


def test_partitioning_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN", 7)
    kinds = ("div class='a'", "section", "td", "div", "p")
    part = lambda n, k: f"<{kinds[(n * k) % 5]}>" + (f"Text {n % (k + 2)} of {k}" if (n + k) % 3 else "<ul><li>x<li>y</ul>") + f"</{kinds[(n * k) % 5].split()[0]}>"
    rows = [(n, f"http://v{n % 2}.example/", "<body>" + "".join(part(n, k) for k in range(1 + n % 7)) + "</body>") for n in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    results = [{r.page_id: r.text for r in W.main_text(df.repartition(n)).collect()} for n in (1, 4, 61)]
    assert results[0] == results[1] == results[2]
    orders = [{r.host: r.wrapper for r in W.infer(df.repartition(n)).collect()} for n in (1, 5)]
    assert orders[0] == orders[1] and len(orders[0]) == 2


def test_given_table(spark):
    path = "/root/testdata/sf0.001"
    pdf = pd.read_parquet(f"{path}/pages.parquet").set_index("page_id")
    for r in W.op9_main_text(spark, path).collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", pdf.html[r.page_id], re.S)[1]
        blocks = [" ".join(W.entities.unescape(re.sub(r"<[^>]+>", " " if "br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", re.sub("<br>", " ", body))]
        assert r.text == "\n\n".join(x for x in blocks if x) and r.n_chars == len(r.text)
