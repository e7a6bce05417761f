import re

from shoebox.llm import template
from shoebox.llm.html import parse


def text_of(page):
    return template.main_text(template.read(page))[0]


def test_article_of_a_page():
    page = """<!DOCTYPE html><html class="has-sidebar"><head><title>T &amp; t</title><script>var a = "<p>no</p>";</script><style>p{}</style></head>
    <body><header><h1>Site</h1></header><nav><ul><li>Menu<li>More</ul></nav><div class="cookie-notice">We use cookies</div>
    <article><header><h1>Head&shy;ing</h1></header><p>One <b>bo</b>ld &lt;tag&gt;&nbsp; and<br>break<p>Two &eacute; &#x41;
    <table><tr><td>a<td>b</table><form><label>Name</label><input value="x"></form><!-- gone > here --><aside>side</aside>
    <div class="ad">Buy</div><pre>x   y</pre><section id="comments"><article class="comment">First!</article></section></article>
    <footer>&copy; me</footer></body></html>"""
    assert text_of(page) == "Head\xading One bold <tag> and break Two é A a b x y"


def test_broken_markup():
    assert text_of("<p>a<p>b</div><b>c</p>d") == "a bc d"
    assert text_of('<article><p title="a > b">x<a href=y>z</a></article') == "xz"
    assert text_of("just text & more") == "just text & more"
    assert text_of("<article>kept<script>never closed <p>x") == "kept"
    assert text_of("<div>" * 5000 + "deep") == "deep"
    assert text_of("<") == "<" and text_of("") == ""
    assert [e.tag for e in parse("<ul><li>a<ul><li>b</ul><li>c</ul>")] == ["", "ul", "li", "ul", "li", "li"]


def test_templates_of_a_site_are_removed(spark):
    menu = "<div><p>Home of the brave</p><ul><li>About</li></ul></div>"
    rows = [(k, f"http://A.example/{k}", f"<body>{menu}<div><p>Story {k} told.</p></div><div>Call us</div></body>") for k in range(8)]
    rows += [(100 + k, f"http://b.example/{k}", f"<body>{menu}<div>Story {k}</div></body>") for k in range(3)]
    # In an article the same running text stays on every page; a block of links goes.
    rows += [(200 + k, f"http://c.example/{k}", f"<article><p>Same words</p><p>{k}</p><div><a>Next</a> <a>Last</a></div></article>") for k in range(9)]
    rows += [(300, None, None), (300, None, None), (301, "nohost", ""), (None, "http://c.example/x?", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS text", "3 AS id")
    for spec in (template.Template(), template.Template(marks=False)):
        found = {r["page_id"]: r for r in template.extract(pages, spec).collect()}
        assert found[3]["text"] == "Story 3 told." and found[3]["n_chars"] == 13
        assert found[101]["text"] == "Home of the brave About Story 1"
        assert found[204]["text"] == "Same words 4"
        assert found[300]["text"] == "" and found[None]["text"] == "x"
        assert template.extract(pages, spec).count() == len(rows)


def test_given_pages_against_plain_reading(spark, sf_dir):
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in template.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        blocks = [html.unescape(re.sub(r"</?(?:b|i|a|em|span)\b[^>]*>", "", x)) for x in re.split(r"</?(?:h1|p|br|article)\b[^>]*>", article)]
        assert found[r["page_id"]] == " ".join(" ".join(blocks).split())


def test_templates_stay_off_the_driver(spark, monkeypatch):
    rows = [(k, "http://a.example/", f"<div>Same</div><p>Story {k % 7}</p>") for k in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")

    def refused(*args):
        raise AssertionError("rows brought to the driver")

    with monkeypatch.context() as m:
        for name in ("collect", "first", "head", "take", "toLocalIterator", "toPandas", "toArrow"):
            m.setattr(type(pages), name, refused)
        found = template.extract(pages, template.Template(least_pages=4))
    assert {r["page_id"]: r["text"] for r in found.collect()} == {k: f"Story {k % 7}" for k in range(20)}


def test_least_pages_do_not_grow_with_the_host(spark):
    rows = [(k, "http://a.example/", f"<div>{'Six of six hundred' if k < 6 else f'Words {k}'}</div><div>Story {k}</div>") for k in range(600)]
    found = template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in found} == {k: f"Story {k}" if k < 6 else f"Words {k} Story {k}" for k in range(600)}


def test_empty_table(spark):
    assert template.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def plain_templates(rows, least):
    """Subtrees of each host that stand on enough of its pages, by counting in one dictionary."""
    import collections

    counts = collections.Counter()
    for host, page in rows:
        counts.update({(host, h) for h in template.candidates(template.read(page)).values()})
    return {key for key, n in counts.items() if n >= least}


def test_counting_equals_plain_counting(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/pages.parquet")
    rows = [(re.search("://([^/?#]*)", r["url"])[1].lower(), r["html"], r["page_id"]) for r in pages.collect()]
    # A host with a third of the pages, half of them equal.
    rows = [("hot.example" if k % 3 == 0 else host, rows[0][1] if k % 6 == 0 else page, i) for k, (host, page, i) in enumerate(rows)]
    table = spark.createDataFrame([(i, f"http://{host}/x", page) for host, page, i in rows], "page_id long, url string, html string")
    for least, marks in ((2, True), (2, False), (5, False)):
        known = plain_templates([(h, p) for h, p, _ in rows], least)
        want = {i: template.main_text(template.read(p), frozenset(t for at, t in known if at == h), marks) for h, p, i in rows}
        got = {r["page_id"]: (r["text"], r["n_templates"]) for r in template.extract(table, template.Template(least, marks)).collect()}
        assert got == want
        assert sum(n > 0 for _, n in got.values()) >= len(range(0, len(rows), 6))


def test_counts_alone_leave_the_articles(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/pages.parquet").filter("url LIKE '%://blog.tionsh.example.com/%'")
    both = template.extract(pages).join(template.extract(pages, template.Template(marks=False)).selectExpr("page_id", "text AS bare", "n_templates AS n"), "page_id").collect()
    # Three templates a page: menu, advert and footer.
    whole = [r for r in both if r["n"] >= 3]
    assert len(whole) > 50 and all(r["text"] == r["bare"] for r in whole)


def test_unmarked_parts_of_a_site_go(spark):
    rows = [(k, "http://a.example/", f"<div class='x1'><p>Call us today</p></div><article><p>Story {k}</p></article><div class='x2'>Office {k % 3} of ours</div>") for k in range(30)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_templates"]) for r in template.extract(table, template.Template(marks=False)).collect()}
    assert got == {k: (f"Story {k}", 3) for k in range(30)}


def test_long_page_and_equal_pages(spark):
    long = "<article>" + "".join(f"<p>Part {k} &amp; more</p>" for k in range(20_000)) + "</article><div>Imprint</div>"
    rows = [(k, "http://a.example/", long if k < 2 else f"<p>Same</p><div>Imprint</div><p>{k % 2}</p>") for k in range(400)]
    got = {r["page_id"]: r["text"] for r in template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == got[1] == " ".join(f"Part {k} & more" for k in range(20_000))
    # Whole equal pages recur, but so do their parts: nothing of them is the page's own.
    assert set(got[k] for k in range(2, 400)) == {""}
