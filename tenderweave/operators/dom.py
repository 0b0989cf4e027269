"""Tables and attachments of HTML pages, out of a walk over the elements.

A small reader of one page (`walked`) tells what stands where; Spark resolves, classifies, filters and dedupes.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N

CELLS = "table int, parent int, row int, col int, header boolean, value string, link string"
RECORDS = "table int, row int, heads array<string>, values array<string>, links array<string>"
FOUND = "pos int, tag string, href string, text string, title string, headers array<string>, cells array<string>"

# Endings of documents with their types, and words that make a link a document.
TYPES = {
    "pdf": "application/pdf", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "csv": "text/csv", "json": "application/json", "xml": "application/xml",
}
ASKS = ("download", "view document", "view pdf", "gazette pdf", "tender document")

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_MUTE = {"script", "style"}
# Elements whose tags have no say in how the text after them is read, and the plainest spelling of tags: there the standard
# reader's tolerant patterns find the same name, attributes and end.
_PLAIN = {*"a b i p u br dd dl dt em hr li ol td th tr ul div h1 h2 h3 h4 h5 h6 img nav pre body font form head html link main meta span tbody table tfoot thead strong article caption section".split()}
_PIECE = re.compile(r"""([^<]*+)<(/?)([A-Za-z][A-Za-z0-9]*+)((?:[ \n]++[A-Za-z][A-Za-z-]*+="[^"<>&]*+")*+)>""")
_ATTRIBUTE = re.compile(r"""([A-Za-z][A-Za-z-]*)="([^"]*)\"""")


class _Cell:
    def __init__(self, header: bool):
        self.header, self.said, self.link = header, [], None


class _Table:
    def __init__(self, number: int, parent: int | None):
        self.number, self.parent, self.rows, self.cell = number, parent, [], None


class _Walk(HTMLParser):
    """Text goes to every open cell, so a cell holds what its inner tables say, and to the open link."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.open, self.links, self.link, self.mute = [], [], [], None, None

    def updatepos(self, i, j):  # nobody asks for lines
        return j

    def _plain(self, i):
        """Reads plain tags and the texts between them, as many as follow each other from i on, and tells where they end."""
        m = _PIECE.match(self.rawdata, i)
        while m:
            text, closing, tag, attrs = m.groups()
            tag = tag.lower()
            if tag not in _PLAIN or (closing and attrs):
                break
            if text:
                self.handle_data(unescape(text))
            if closing:
                self.handle_endtag(tag)
            else:
                self.handle_starttag(tag, [(k.lower(), v) for k, v in _ATTRIBUTE.findall(attrs)] if tag == "a" else ())
            i = m.end()
            m = _PIECE.match(self.rawdata, i)
        return i

    def parse_starttag(self, i):
        end = self._plain(i)
        return end if end > i else super().parse_starttag(i)

    def parse_endtag(self, i):
        end = self._plain(i) if self.cdata_elem is None else i
        return end if end > i else super().parse_endtag(i)

    def handle_starttag(self, tag, attrs):
        if self.mute:
            return
        top = self.open[-1] if self.open else None
        if tag in _MUTE:
            self.mute = tag
        elif tag == "table":
            self.open.append(_Table(len(self.tables), top.number if top else None))
            self.tables.append(self.open[-1])
        elif tag == "tr" and top:
            top.rows.append([])
            top.cell = None
        elif tag in ("td", "th") and top:
            if not top.rows:
                top.rows.append([])
            top.cell = _Cell(tag == "th")
            top.rows[-1].append(top.cell)
        elif tag == "a":
            self.link = None
            got = _first_of(attrs)
            if "href" in got:
                self._found(tag, got["href"], got.get("title", ""))
                self.link = self.links[-1]
                for t in self.open:
                    if t.cell and t.cell.link is None:
                        t.cell.link = got["href"]
        elif tag in ("iframe", "embed", "object"):
            got = _first_of(attrs)
            if got.get("src") or got.get("data"):
                self._found(tag, got.get("src") or got.get("data"), got.get("title", ""))

    def _found(self, tag, href, title):
        top = self.open[-1] if self.open else None
        row = top.rows[-1] if top and top.cell else None
        self.links.append({"tag": tag, "href": href.strip(), "title": title, "said": [], "table": top if row is not None else None, "row": row})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag not in _MUTE:
            self.handle_endtag(tag)
        elif tag in _MUTE:
            self.mute = None

    def handle_endtag(self, tag):
        if self.mute:
            self.mute = None if tag == self.mute else self.mute
        elif tag == "table" and self.open:
            self.open.pop()
        elif tag in ("td", "th", "tr") and self.open:
            self.open[-1].cell = None
        elif tag == "a":
            self.link = None

    def handle_data(self, data):
        if self.mute:
            return
        for t in self.open:
            if t.cell:
                t.cell.said.append(data)
        if self.link:
            self.link["said"].append(data)

    def unknown_decl(self, data):  # a marked section of an unknown kind says nothing
        pass

    def parse_marked_section(self, i, report=1):
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1


def _first_of(attrs) -> dict[str, str]:
    """Of an attribute that repeats, the first counts."""
    return {k: v or "" for k, v in reversed(attrs)}


def _flat(said: list[str]) -> str:
    return " ".join(" ".join(said).split())


def walked(html: str | None) -> _Walk:
    walk = _Walk()
    walk.feed(html or "")
    walk.close()
    return walk


def _cells(html: str | None) -> list[dict]:
    out = []
    for t in walked(html).tables:
        for r, row in enumerate(r for r in t.rows if r):
            for c, cell in enumerate(row):
                out.append({"table": t.number, "parent": t.parent, "row": r, "col": c, "header": cell.header, "value": _flat(cell.said), "link": cell.link})
    return out


def _records(html: str | None) -> list[dict]:
    out = []
    for t in walked(html).tables:
        rows = [[(_flat(c.said), c.link) for c in row] for row in t.rows if row]
        heads = [v for v, _ in rows[0]] if rows else []
        out += [{"table": t.number, "row": r, "heads": heads, "values": [v for v, _ in row], "links": [x for _, x in row]} for r, row in enumerate(rows) if r]
    return out


def _links(html: str | None) -> list[dict]:
    out, heads = [], {}
    for pos, x in enumerate(walked(html).links):
        t = x["table"]
        if t and t.number not in heads:
            heads[t.number] = [_flat(c.said) for row in t.rows for c in row if c.header]
        cells = [_flat(c.said) for c in x["row"]] if x["row"] else []
        out.append({"pos": pos, "tag": x["tag"], "href": x["href"], "text": _flat(x["said"]), "title": x["title"], "headers": heads[t.number] if t else [], "cells": cells})
    return out


def _listed(df: DataFrame, column: str, kind: str, read) -> DataFrame:
    """The other columns of df with `found`, the list of what `read` finds in the column."""
    kept = [c for c in df.columns if c != column]
    schema = df.select(*kept, F.lit(None).cast(f"array<struct<{kind}>>").alias("found")).schema
    fields = [_field(f) for f in kind.split(", ")]

    def run(batches):
        for b in batches:
            ends, rows = [0], []
            for text in b.column(b.schema.get_field_index(column)).to_pylist():
                rows += read(text)
                ends.append(len(rows))
            said = [pa.array([r[name] for r in rows], of) for name, of in fields]
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(said, fields=[pa.field(name, of) for name, of in fields]))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), found], [*kept, "found"])

    return df.mapInArrow(run, schema)


def _field(text: str) -> tuple[str, pa.DataType]:
    name, kind = text.split(" ")
    return name, {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string())}[kind]


def table_cells(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, table, parent, row, col, header, value, link) of every cell of every table, inner tables after the outer one.

    parent is the table around it; a cell's value has the text of tables inside it too, its link is its first one. Rows
    without cells don't count. Cells and rows may be left open. Null and empty pages have no cells.
    """
    found = _listed(pages.select(key, "html"), "html", CELLS, _cells)
    return found.select(key, F.explode("found").alias("c")).select(key, "c.*")


def table_records(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, table, row, record): each row below the headers as a map from column to value, and `<column>_link` to its link.

    A table's first row is its header row. A column is named by its header in lower case, signs left out and blanks as _;
    beyond the headers, or where nothing is left of one, it is col_<number>.
    """
    rows = _listed(pages.select(key, "html"), "html", RECORDS, _records).select(key, F.explode("found").alias("f")).select(key, "f.*")
    name = lambda x: F.replace(F.lower(F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}_\s]", ""))), F.lit(" "), F.lit("_"))
    named = rows.withColumn("names", F.transform("heads", lambda h: F.nullif(name(h), F.lit(""))))
    column = lambda i: F.coalesce(F.get("names", i), F.concat(F.lit("col_"), i.cast("string")))
    cells = F.transform("values", lambda v, i: F.array(F.struct(column(i).alias("k"), v.alias("v")), F.struct(F.concat(column(i), F.lit("_link")).alias("k"), F.get("links", i).alias("v"))))
    told = named.select(key, "table", "row", F.filter(F.flatten(cells), lambda p: p["v"].isNotNull()).alias("said")).withColumn("keys", F.transform("said", lambda p: p["k"]))
    last = F.filter("said", lambda p, i: F.array_position(F.slice("keys", i + 2, F.size("keys")), p["k"]) == 0)  # of columns with one name the last counts
    return told.select(key, "table", "row", F.map_from_entries(last).alias("record"))


def _ending(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"\.(" + "|".join(TYPES) + r")(?:[?#].*)?$", 1)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with the column; exploding a list of one keeps a long expression from being evaluated wherever its result is used."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def attachments(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, url, href, text, kind, mime, context) of the documents that pages (key, url, html) link or embed.

    A link is a document by its ending, by an ending anywhere in its href, or by what its text asks for; frames, embeds and
    objects only by an ending. Each canonical URL of a page counts once, links before embedded ones. context is what
    stands in the link's own table row: by header where there are as many headers as cells, else the cells as row_text;
    and the link's title. Fragments and scripts are no documents. Null pages have none.
    """
    found = _listed(pages.select(key, F.col("url").alias("base"), "html"), "html", FOUND, _links).select(key, "base", F.explode("found").alias("f")).select(key, "base", "f.*")
    found = found.where("href <> '' AND NOT startswith(href, '#') AND NOT startswith(lower(href), 'javascript:')")
    found = _once(found, "_whole", N.joined_url(F.col("base"), F.col("href")))
    found = _once(found, "_whole", N.without_dots(F.col("_whole")))
    found = _once(found, "_parts", N.url_parts(F.col("_whole")))
    found = _once(found, "url", N.canonical_url(F.col("_parts"))).drop("_whole", "_parts", "base")
    found = _once(found, "_ending", _ending(F.col("url")))
    embedded = F.col("tag") != "a"
    ending = F.nullif(F.col("_ending"), F.lit(""))
    inside = F.lower("href").rlike(r"\.(?:" + "|".join(TYPES) + ")")
    asked = F.lower("text").rlike("|".join(ASKS))
    found = found.where(F.when(embedded, F.lower("url").rlike(r"\.(?:" + "|".join(TYPES) + ")")).otherwise(ending.isNotNull() | inside | asked))
    first = Window.partitionBy(key, "url").orderBy(embedded, "pos")
    found = found.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    types = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    mime = F.when(embedded, "application/pdf").when(ending.isNotNull(), types[ending]).when(asked & ~inside, "application/pdf").otherwise("application/octet-stream")
    entry = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    by_header = F.filter(F.zip_with("headers", "cells", lambda h, v: entry(F.concat(F.lit("col_"), h), v)), lambda p: (p["k"] != "col_") & (p["v"] != ""))
    in_row = F.when((F.size("headers") > 0) & (F.size("headers") == F.size("cells")), by_header).when(F.size("cells") > 0, F.array(entry(F.lit("row_text"), F.array_join("cells", " | ")))).otherwise(F.array().cast("array<struct<k: string, v: string>>"))
    titled = F.when(F.col("title") != "", F.array(entry(F.lit("title"), F.col("title")))).otherwise(F.array().cast("array<struct<k: string, v: string>>"))
    found = _once(found, "_said", F.when(embedded, F.array(entry(F.lit("embedded_tag"), F.col("tag")))).otherwise(F.concat(in_row, titled)))
    found = _once(found, "_keys", F.transform("_said", lambda q: q["k"]))
    distinct = F.map_from_entries(F.filter("_said", lambda p, i: F.array_position("_keys", p["k"]) == i + 1))
    text = F.when(embedded, "Embedded Document").when(F.col("text") != "", F.col("text")).otherwise(F.col("title"))
    return found.select(key, "pos", "url", "href", text.alias("text"), F.when(embedded, "attachment").otherwise("document").alias("kind"), mime.alias("mime"), distinct.alias("context"))
