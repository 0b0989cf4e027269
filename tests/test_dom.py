import random
from html.parser import HTMLParser

from tenderweave.operators import dom as D

PAGE = """<table id=a><thead><tr><th>Tender No.</th><th>Due &amp; time<th>File</tr></thead>
<tr><td>T/1</td><td>1 Jan</td><td><a title="Notice" href="n/1.PDF?x=1">Get <b>it</b></a> or <a href=2.docx>this</a></td></tr>
<tr><td>T/2<table><tr><td>in<td><a href="#top">up</a> <a href="inner.csv">c</a></tr></table></td><td></td><td>none</td></tr></table>
<script>var x = "<a href='no.pdf'>";</script><![foo]><p><a href='/view?id=3'>View  document</a><a href="page.html">page</a><a href="javascript:x.pdf">j</a>
<a href="n/1.PDF?x=1#again">again</a><iframe src="emb.pdf"></iframe><embed src="/e.html"><object data=n/1.pdf></object>"""


def test_cells_of_nested_tables(spark):
    df = spark.createDataFrame([(1, "http://a.org/d/", PAGE), (2, "http://a.org/", None), (3, "x", "<td>no table</td>")], "page_id long, url string, html string")
    got = {(r.table, r.row, r.col): (r.parent, r.header, r.value, r.link) for r in D.table_cells(df).collect()}
    assert got[0, 0, 1] == (None, True, "Due & time", None)
    assert got[0, 1, 2] == (None, False, "Get it or this", "n/1.PDF?x=1")
    assert got[0, 2, 0] == (None, False, "T/2 in up c", "#top")
    assert got[1, 0, 1] == (0, False, "up c", "#top") and got[1, 0, 0] == (0, False, "in", None) and len(got) == 11
    records = {(r.table, r.row): r.record for r in D.table_records(df).collect()}
    assert records == {(0, 1): {"tender_no": "T/1", "due__time": "1 Jan", "file": "Get it or this", "file_link": "n/1.PDF?x=1"}, (0, 2): {"tender_no": "T/2 in up c", "tender_no_link": "#top", "due__time": "", "file": "none"}}


def test_attachments_with_their_row(spark):
    df = spark.createDataFrame([(1, "http://a.org/d/", PAGE), (2, "http://a.org/", None)], "page_id long, url string, html string")
    got = {r.href: (r.url, r.text, r.kind, r.mime.rsplit("/", 1)[1], r.context) for r in D.attachments(df).collect()}
    row = {"col_Tender No.": "T/1", "col_Due & time": "1 Jan", "col_File": "Get it or this"}
    assert set(got) == {"n/1.PDF?x=1", "2.docx", "inner.csv", "/view?id=3", "emb.pdf", "n/1.pdf"}
    assert got["n/1.PDF?x=1"][1:4] == ("Get it", "document", "pdf") and got["n/1.PDF?x=1"][4] == {**row, "title": "Notice"}
    assert got["2.docx"][4] == row and got["2.docx"][0] == "http://a.org/d/2.docx"
    assert got["inner.csv"][1:] == ("c", "document", "csv", {"row_text": "in | up c"})
    assert got["/view?id=3"][1:] == ("View document", "document", "pdf", {})
    assert got["emb.pdf"][1:] == ("Embedded Document", "attachment", "pdf", {"embedded_tag": "iframe"})


def test_pages_stay_with_their_readers(spark):
    """A page's text is not sent back with what was found in it, and its links' URLs are made once, not where they are used."""
    df = spark.createDataFrame([(1, "http://a.org/d/", PAGE)], "page_id long, url string, html string")
    assert D._listed(df, "html", D.FOUND, D._links).columns == ["page_id", "url", "found"]
    plan = D.attachments(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^?#]*)(?:") == 4  # scheme, host, path and query, each once


def test_plain_tags_are_read_as_by_the_standard_reader():
    pieces = ["<table>", "<TR>", "<td >", "<td>", "</td>", "</table>", '<a href="x.pdf" title="T">', '<a href="a&amp;b">', "<a href='q'>", '<a href="1" href="2">', '<a href="k"/>', "</a>", "</A >", "<script>", "</script>", "<title>", "</title>"]
    pieces += ["<textarea>", "</textarea>", "<p/>", "<", "&lt", "&", "text ", "<!-- c -->", "<!--", "-->", "<td", "</", '</td x="1">', '<a href="u"title="v">', '<a href="x>y">', '<iframe src="e.pdf">']

    class Standard(D._Walk):
        parse_starttag, parse_endtag = HTMLParser.parse_starttag, HTMLParser.parse_endtag

    told = lambda w: ([(x["href"], x["title"], x["said"]) for x in w.links], [[[(c.header, c.said, c.link) for c in r] for r in t.rows] for t in w.tables])
    chance = random.Random(1)
    for _ in range(3000):
        page = "".join(chance.choices(pieces, k=chance.randint(1, 20)))
        walks = D._Walk(), Standard()
        for w in walks:
            w.feed(page)
            w.close()
        assert told(walks[0])[1] == told(walks[1])[1], page
        assert ["".join(x[2]) for x in told(walks[0])[0]] == ["".join(x[2]) for x in told(walks[1])[0]], page
