from pyspark.sql import functions as F

from tenderweave.functions.normalize import resolve_url
from tenderweave.operators import corpus as X

BASE = "http://a.org/b/c/d.html?q=1#f"
LINKS = [
    ("x.html", "http://a.org/b/c/x.html"), ("../x", "http://a.org/b/x"), ("../../../x/./y", "http://a.org/../x/y"), ("/r", "http://a.org/r"), ("//h.net/z", "http://h.net/z"), ("?p=2", "http://a.org/b/c/d.html?p=2"),
    ("#g", "http://a.org/b/c/d.html?q=1#g"), ("", "http://a.org/b/c/d.html?q=1"), ("HTTPS://k.de/", "HTTPS://k.de/"), ("mailto:x@y", "mailto:x@y"), ("../../x", "http://a.org/x"), ("./x/../y", "http://a.org/b/c/y"),
]


def test_links_resolve(spark):
    df = spark.createDataFrame(LINKS, "href string, wanted string")
    assert [r.got for r in df.select(resolve_url(F.lit(BASE), F.col("href")).alias("got")).collect()] == [w for _, w in LINKS]
    assert spark.range(1).select(resolve_url(F.lit("http://a.org"), F.lit("x")).alias("u")).first().u == "http://a.org/x"


def test_page_links_of_all_quotings(spark):
    html = """<a href="/one?page=2">1</a><a class='k' href='two.pdf'>2</a><A HREF=three/ >3</A><a href="mailto:x@y">m</a><abbr href="no">n</abbr>"""
    df = spark.createDataFrame([(1, "http://a.org/b/", html), (2, "http://a.org/", None)], "page_id long, url string, html string")
    assert [(r.pos, r.url, r.kind) for r in X.page_links(df).orderBy("pos").collect()] == [(0, "http://a.org/one?page=2", "pagination"), (1, "http://a.org/b/two.pdf", "document"), (2, "http://a.org/b/three/", "navigation")]


def test_tables(spark):
    html = "<table><tr><th>A<th>B</tr><tr><td> 1 <i>x</i></td><td></td></tr></table><p>no</p><table border=1><TR><TD>z</table>"
    got = [(r.table, r.row, r.col, r.value, r.header) for r in X.html_tables(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("table", "row", "col").collect()]
    assert got == [(0, 0, 0, "A", True), (0, 0, 1, "B", True), (0, 1, 0, "1 x", False), (0, 1, 1, "", False), (1, 0, 0, "z", False)]
