"""Main text: the given pages against a plain reading of their articles, and small hosts of other layouts."""
import html
import re

import pytest

from llm.pages import main_text, parse

SCHEMA = "html string, page_id long, url string, template string, host int"


def article(source):
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    pieces = re.split(r"</?(?:p|h1)>|</article>", inner)
    lines = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in pieces]
    return "\n".join(x for x in lines if x)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    got = main_text(pages).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def plain(k, host):
    return (f"""<html><body class="has-sidebar"><div id="top"><ul class="menu"><li><a href="/a">Home {k}</a></li></ul></div>
<div class="cookie-notice">We use cookies {k}</div><div id="links"><a href="/{k}">more {k}</a> <a href="/x">other {k}</a></div>
<div id="body"><p>Body &amp; text number&nbsp;{k}<p>second   part {k}</p><p>Read by permission of {host}.</p></div>
<div id="legal">All rights reserved by {host}.</div><form><p>Your mail {k}</p></form><section class="comments"><article class="comment"><p>me too {k}</p></article></section>
<script>var x = "<p>no</p>";</script><!-- <p>no</p> --></body></html>""")


def test_template_of_a_host(spark):
    rows = [(plain(k, "h"), k, f"http://h.example/{k}", None, 1) for k in range(20)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: f"Body & text number {k}\nsecond part {k}\nRead by permission of h." for k in range(20)}


def shared(k):
    """A page whose article shares headings, a list, a paragraph and a table head with all others of its host."""
    return (f"""<html><head><title>t</title></head><body><nav><a href="/">Home</a></nav><header><h1>Site</h1></header><article><h1>Dish {k}</h1><h2>Ingredients</h2>
<ul><li>salt</li><li>pepper</li><li>item {k}</li></ul><h2>Method</h2><p>Stir {k} times.</p><p>Serve <a href="/hot">hot</a>.</p><div class="note-box"><p>A note.</p></div>
<table><tr><th>Energy</th><td>{k} kJ</td></tr></table><section class="share-buttons"><p>Share it</p></section></article><aside><p>Also {k}</p></aside><footer>Legal</footer></body></html>""",
            f"Dish {k}\nIngredients\nsalt\npepper\nitem {k}\nMethod\nStir {k} times.\nServe hot.\nA note.\nEnergy\n{k} kJ")


def whole(k):
    """Pages whose articles are the same on all of a host but for a word, or in all."""
    return f"<body><div class=menu>m</div><main><p>{'long ' * 200}</p><p>edit {k}</p><p>end</p></main></body>", ("long " * 200).strip() + f"\nedit {k}\nend"


def same(k):
    return "<body><article><h1>Same</h1><p>copy</p></article><div id=footer>f</div></body>", "Same\ncopy"


def bare(k):
    """No article: headings and standing text inside the part that differs stay, a legal part without a name goes where hosts tell."""
    return (f"<body><div id=x><div class=head><h2>Ingredients</h2></div><div class=t><p>flour {k}</p></div><div class=t><p>Always the same.</p></div></div></body>",
            f"Ingredients\nflour {k}\nAlways the same.")


@pytest.mark.parametrize("n", [1, 2, 3, 20])
def test_region_keeps_what_hosts_repeat(spark, n):
    """Each page against its own text, on hosts of one, two, three and twenty pages: the same whatever its neighbours."""
    rows, want = [], {}
    for h, kind in enumerate((shared, whole, same, bare)):
        for k in range(n):
            source, text = kind(k)
            want[h * 100 + k] = text
            rows.append((source, h * 100 + k, f"http://{kind.__name__}.example/{k}", "x", 7))
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_given_pages_alone(spark):
    """Given pages, each alone on its host, read as they do among the others of their host."""
    from pyspark.sql import functions as F
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    together = {r["page_id"]: r["text"] for r in main_text(pages).collect()}
    alone = main_text(pages.withColumn("url", F.concat(F.lit("http://h"), "page_id", F.lit("/")))).collect()
    assert {r["page_id"]: r["text"] for r in alone} == together


def test_large_templates_are_not_broadcast(spark):
    from llm.pages import with_template
    pages = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("", 4)], "host string, row long")
    known = spark.createDataFrame([("a", [1], [2]), ("c", [3], [])], "_host string, template array<long>, menus array<long>")
    got = [sorted(map(str, with_template(pages, known, most).select("host", "row", "template", "menus").collect())) for most in (0, 10**6)]
    assert got[0] == got[1] and len(got[0]) == 4


def test_odd_rows(spark):
    rows = [(None, 1, "http://a/x", None, None), ("", 2, None, "x", 3), ("just text", 3, "no url", None, None), ("a < b & c", 4, "http://a/y", None, None),
            ("<p>one<p>two", 5, "http://a/z", None, None), ("<p>one<p>two", 5, "http://a/z", None, None), ("<article>" + "<p>long" * 5000, 6, "http://a/", None, None),
            ("<article><header><h1>T</h1></header><p>x</p><footer>f</footer></article><aside>s</aside>", 7, "http://a/", None, None),
            ("<div><script>never closed <p>x", None, "http://a/", None, None)]
    got = sorted(((r["page_id"] or 0), r["text"]) for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, ""), (1, ""), (2, ""), (3, "just text"), (4, "a < b & c"), (5, "one\ntwo"), (5, "one\ntwo"), (6, "\n".join(["long"] * 5000)), (7, "T\nx")]
    assert main_text(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("source,want", [
    ("<div class='has-sidebar'><article><p>a</p></article></div>", "a"), ("<div class='with-comments'><article>a</article></div>", "a"),
    ("<div class='share-layout'><p>a</p></div>", "a"), ("<article class='post comments-open'><p>a</p></article>", "a"),
    ("<div class='page-sidebar'><article>a</article></div><p>x</p>", "a"), ("<form><main>a</main></form>", "a"),
    ("<div class='sidebar-left'>x</div><div class='mainNav'>x</div><p>a</p>", "a"),
    ("<main><p>body</p><article>teaser</article></main>", "body\nteaser"),
    ("<head><title>t</title><style>p{}</style><body><p>a</p>", "a"), ("<head><meta charset=x><title>t</title><p>a", "a"),
    ("<p>a <svg/> b</p><p>c</p>", "a b\nc"), ("<p>a <svg><text>x</text></svg> b", "a b"), ("<p>a</p><select><p>b</p>", "a\nb"), ("<video-list><p>a</p></video-list>", "a")])
def test_markup_loses_no_main_text(source, want):
    from llm.pages import extract
    assert extract(source, set(), set()) == want


@pytest.mark.parametrize("source", ["<" * 5000, "<a " * 5000, '<a href="' * 2000, "<!--" * 3000, "<p>" * 20000])
def test_hostile_markup_ends(source):
    assert isinstance(parse(source), tuple)
