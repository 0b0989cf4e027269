"""Jobs over text and page tables: one row in, many rows out. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import classify_link, normalize_url, resolve_url

CITATION = r"(?i)\bIS\s*\d+(?:\s*\(Part\s*\d+\))?(?::\d{4})?"
BLOCKED = "captcha|access denied|are you a robot|unusual traffic"
#: In lower-case text: a run of letters without a vowel, with five consonants in a row, or of one or two different letters.
ODD_WORD = r"(?<![a-z])(?:[bcdfghjklmnpqrstvwxz]+|[a-z]*[bcdfghjklmnpqrstvwxz]{5}[a-z]*|([a-z])\1*(?:([a-z])(?:\1|\2)*)?)(?![a-z])"


LINK = r"""(?i)<a\s(?:[^>]*\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def html_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href): the link targets of each page, in its order, however they are quoted."""
    tags = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(LINK), 0)).alias("pos", "tag"))
    group = lambda k: F.regexp_extract("tag", LINK, k)
    return tags.select("page_id", "pos", F.concat(group(1), group(2), group(3)).alias("href"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, url, kind, mime): the links of pages (page_id, url, html) as canonical absolute URLs; kind
    is document, pagination or navigation. Links that lead to no web page are left out."""
    links = html_links(pages).join(pages.select("page_id", F.col("url").alias("base")), "page_id")
    found = links.withColumn("url", normalize_url(resolve_url(F.col("base"), F.col("href")))).where("url <> ''")
    kind, mime = classify_link(F.col("url"))
    return found.select("page_id", "pos", "url", kind.alias("kind"), mime.alias("mime"))


def _meta(name: str) -> Column:
    return F.trim(F.regexp_extract("html", rf'(?i)<meta\s[^>]*name="{name}"[^>]*content="([^"]*)"', 1))


def html_metadata(pages: DataFrame) -> DataFrame:
    """(page_id, title, lang, n_headings, description, keywords, json_ld)."""
    return pages.select(
        "page_id", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.regexp_extract("html", r'(?i)<html[^>]*lang="([^"]*)"', 1).alias("lang"), F.regexp_count("html", F.lit(r"(?i)<h[1-3][ >]")).alias("n_headings"),
        _meta("description").alias("description"), _meta("keywords").alias("keywords"), F.trim(F.regexp_extract("html", r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', 1)).alias("json_ld"),
    )


def html_tables(pages: DataFrame) -> DataFrame:
    """(page_id, table, row, col, value, header): the cells of the tables of each page; markup inside a cell goes,
    white space is collapsed. A table inside a cell of another one ends that one."""
    tables = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<table(?:\s[^>]*)?>(.*?)(?=<table[\s>]|</table>|$)"), 1)).alias("table", "body"))
    rows = tables.select("page_id", "table", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<tr(?:\s[^>]*)?>(.*?)(?=<tr[\s>]|</tr>|$)"), 1)).alias("row", "cells"))
    cells = rows.select("page_id", "table", "row", F.posexplode(F.regexp_extract_all("cells", F.lit(r"(?is)(<t[dh](?:\s[^>]*)?>.*?)(?=<t[dh][\s>]|</t[dh]>|$)"), 1)).alias("col", "cell"))
    value = F.trim(F.regexp_replace(F.regexp_replace("cell", "<[^>]*>", " "), r"\s+", " "))
    return cells.select("page_id", "table", "row", "col", value.alias("value"), F.col("cell").rlike("(?i)^<th").alias("header"))


def blocked_page(body: Column, status: Column) -> Column:
    """A page that says so, whatever its status, or one that was refused."""
    return F.lower(body).rlike(BLOCKED) | status.isin(401, 403, 429)


def low_text(rows: DataFrame, least: int) -> DataFrame:
    """rows (text, pages) with low: under `least` characters a page."""
    return rows.withColumn("low", F.length("text") / F.col("pages") < least)


def quality_gate(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_odd, outcome): too_short, no_words if over half the tokens have no word's shape, else accepted."""
    text = F.lower("text")
    counted = docs.select("doc_id", F.regexp_count(text, F.lit("[a-z]+")).alias("n_words"), F.regexp_count(text, F.lit(ODD_WORD)).alias("n_odd"))
    return counted.withColumn("outcome", F.when(F.col("n_words") < 3, "too_short").when(2 * F.col("n_odd") > F.col("n_words"), "no_words").otherwise("accepted"))


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, clause): the lines of a text that are not blank."""
    return docs.select("doc_id", F.posexplode(F.split("text", r"\n+")).alias("pos", "clause")).withColumn("clause", F.trim("clause")).where("clause <> ''")


def classify(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that occurs in the lower-cased text."""
    out = F
    for label, pattern in rules:
        out = out.when(F.lower(text).rlike(pattern), label)
    return out.otherwise(default)


def loose_citations(docs: DataFrame) -> DataFrame:
    """(doc_id, citation, number, part, year) of every citation in a text."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(CITATION), 0)).alias("citation"))
    part = F.nullif(F.regexp_extract("citation", r"(?i)Part\s*(\d+)", 1), F.lit(""))
    return found.select("doc_id", "citation", F.regexp_extract("citation", r"(?i)IS\s*(\d+)", 1).alias("number"), part.alias("part"), F.regexp_extract("citation", r":(\d{4})$", 1).try_cast("int").alias("year"))


def tender_text_clean(text: Column) -> Column:
    """Plain dashes and quotes, no licence lines, white space flattened."""
    plain = F.translate(text, "–—“”‘’", "--\"\"''")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?im)^licensed under.*$", ""), r"\s+", " "))


def json_fields(rows: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """rows with the fields of a JSON text, ok (whether it parses) and its sha256 as digest, instead of the text."""
    keep = [c for c in rows.columns if c != column]
    parsed = F.from_json(F.col(column), "map<string,string>")
    return rows.select(*keep, *[parsed[k].try_cast(kind).alias(k) for k, kind in fields.items()], parsed.isNotNull().alias("ok"), F.sha2(F.col(column), 256).alias("digest"))


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, text, status): text outside tags, scripts and styles; EMPTY without any, else SUCCESS."""
    x = F.coalesce("html", F.lit(""))
    for pattern in (r"(?is)<(?:script[^>]*>.*?</script|style[^>]*>.*?</style|title[^>]*>.*?</title)>", r"(?s)<!--.*?-->", "<[^>]*>"):
        x = F.regexp_replace(x, pattern, " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(sign))
    text = F.trim(F.regexp_replace(x, r"\s+", " "))
    return pages.select("page_id", text.alias("text")).withColumn("status", F.when(F.col("text") == "", "EMPTY").otherwise("SUCCESS"))


def tfidf_cosine(pairs: DataFrame, key: list[str]) -> DataFrame:
    """(key, cosine) of texts a and b: tf = 1 + ln n, idf over the two texts alone, unit length; 0 without common terms."""
    side = lambda c, n: F.transform(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]{2,}"), 0), lambda t: F.struct(t.alias("token"), F.lit(n).alias("side")))
    tokens = pairs.select(*key, F.explode(F.concat(side("a", 1), side("b", 2))).alias("x")).select(*key, "x.token", "x.side")
    counted = tokens.groupBy(*key, "token").agg(F.count_if(F.col("side") == 1).alias("m"), F.count_if(F.col("side") == 2).alias("n"))
    idf = F.log(3.0 / (1 + (F.col("m") > 0).cast("int") + (F.col("n") > 0).cast("int"))) + 1
    weight = lambda c: F.when(F.col(c) > 0, (1 + F.log(c)) * idf).otherwise(0.0)
    both = counted.select(*key, weight("m").alias("a"), weight("n").alias("b")).groupBy(*key).agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    return both.select(*key, F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).otherwise(0.0).alias("cosine"))


def next_page_url(url: Column, most: int = 50) -> Column:
    """The URL with its page parameter one higher (2, where it has none); null past page `most`."""
    plain = F.regexp_replace(url, "#.*$", "")
    page = F.regexp_extract(plain, r"[?&]page=(\d+)", 1).try_cast("int")
    added = F.concat(plain, F.when(F.contains(plain, F.lit("?")), "&").otherwise("?"), F.lit("page=2"))
    raised = F.concat(F.regexp_extract(plain, r"^(.*?[?&]page=)\d+", 1), (page + 1).cast("string"), F.regexp_extract(plain, r"[?&]page=\d+(.*)$", 1))
    return F.when(page.isNull(), added).when(page < most, raised)


def policy_decision(url: Column, sources: list[tuple[str, str]], default: str) -> Column:
    """The decision of the first registered domain that the host is, or is under."""
    host, out = F.lower(F.regexp_extract(url, "://([^/?#:]*)", 1)), F
    for domain, decision in sources:
        out = out.when((host == domain) | host.endswith("." + domain), decision)
    return out.otherwise(default)


# Fixed value: what after a number makes it a measured quantity, not a citation.
UNITS = ("years?", "yrs?", "months?", "days?", "hours?", "hrs?", "nos", "mm", "cm", "km", "m", "kg", "kv", "kva", "kw", "ma", "v", "a", "w", "hz")


def is_quantity(tail: Column) -> Column:
    """Whether what follows a number says that it is measured."""
    return tail.rlike(rf"(?i)^\s*(?:[%°]|(?:{'|'.join(UNITS)})\b)")


def _taken(tail: Column, pattern: str) -> tuple[Column, Column]:
    """(the first group of the pattern at the start of tail, or null; the rest of tail behind the match)."""
    whole = F.regexp_extract(tail, f"^(?:{pattern})", 0)
    return F.nullif(F.regexp_extract(tail, f"^(?:{pattern})", 1), F.lit("")), F.substr(tail, F.length(whole) + 1)


#: Where a citation begins; the first that is none by its quantity, and all behind it.
_BEGINS = r"\bIS\s*[:\-–]?\s*\d"
_FIRST = rf"(?s){_BEGINS}++(?!\s*(?:[%°]|(?i:{'|'.join(UNITS)})\b)).*"


def _read_citation(found: DataFrame) -> DataFrame:
    """found (piece, ...) with what its piece, cut before an IS with a number, gives up: (citation, number, part_section,
    designation, year, amendment); all null for a null."""
    digits, tail = _taken(F.col("piece"), r"IS\s*[:\-–]?\s*(\d+)")
    found = found.withColumn("_digits", digits).withColumn("_t0", tail)
    bracket, after = _taken(F.col("_t0"), r"\s*\(([^)]+)\)")
    found = found.withColumn("_bracket", bracket).withColumn("_t1", after)
    no_range = r"(?!\d|\s*(?:to|and|&)\s*\d)"
    part, after = _taken(F.col("_t1"), rf"(?i)\s*:\s*(Part\s*\d+{no_range}(?:\s*:\s*Sec(?:tion)?\s*\d+{no_range})?)")
    found = found.withColumn("part_section", F.coalesce("_bracket", part)).withColumn("_t2", F.when(F.col("_bracket").isNull(), after).otherwise(F.col("_t1")))
    colon, after_colon = _taken(F.col("_t2"), r"\s*:\s*(\d{4})")
    dash, after_dash = _taken(F.col("_t2"), r"\s*[\-–]\s*((?:19|20)\d{2})(?!\d)")
    found = found.withColumn("year", F.coalesce(colon, dash).try_cast("int")).withColumn("_t3", F.when(colon.isNotNull(), after_colon).otherwise(after_dash))
    amendment, rest = _taken(F.col("_t3"), r"(?i)\s+Amd\.?\s*(\d+)")
    found = found.withColumn("amendment", amendment.try_cast("int")).withColumn("_rest", rest)
    base = F.concat(F.lit("IS "), F.col("_digits"))
    inside = r"(?i)^\s*Part\s*(\d+)\s*(?:[/:,]\s*Sec(?:tion)?\s*(\d+))?\s*$"
    p, s = F.regexp_extract("part_section", inside, 1), F.regexp_extract("part_section", inside, 2)
    spelt = F.concat(base, F.when(p != "", F.concat(F.lit(" : Part "), p)).otherwise(""), F.when(s != "", F.concat(F.lit(" : Sec "), s)).otherwise(""))
    text = F.substr("piece", F.lit(1), F.length("piece") - F.length("_rest"))
    found = found.withColumn("citation", F.trim(F.regexp_replace(text, r"\s+", " "))).withColumn("number", base).withColumn("designation", F.coalesce(spelt, base))
    return found.drop("_digits", "_t0", "_bracket", "_t1", "_t2", "_t3", "_rest")


def scan_citations(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, citation, number, part_section, designation, year, amendment) of the citations in a
    text, in their order; prose such as "the voltage IS 230 V" is none.

    A text is cut before every upper-case IS with a number; a piece then gives up, from its start, the
    number, a part in brackets or behind a colon, the year and the amendment, one after the other. Ranges
    of parts are no part. What stands in brackets up to the next IS with a number is that one's own.
    """
    pieces = docs.select("doc_id", F.posexplode(F.split("text", f"(?={_BEGINS})")).alias("nth", "piece"))
    digits, tail = _taken(F.col("piece"), r"IS\s*[:\-–]?\s*(\d+)")
    found = _read_citation(pieces.where(digits.isNotNull() & ~is_quantity(tail)))
    return found.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("nth")) - 1).alias("pos"), "citation", "number", "part_section", "designation", "year", "amendment")


def with_citation(rows: DataFrame, text: str) -> DataFrame:
    """rows with the first citation of their text by scan_citations(): (citation, number, part_section, designation, year,
    amendment), null without any. Read where the row lies; a text without IS is not searched."""
    behind = F.when(F.contains(text, F.lit("IS")), F.nullif(F.regexp_extract(text, _FIRST, 0), F.lit("")))
    return _read_citation(rows.withColumn("piece", F.get(F.split(behind, f"(?={_BEGINS})", 2), F.lit(0)))).drop("piece")


def cross_references(rows: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """(key, refs): distinct base numbers cited in the texts of a row, in the order they first appear."""
    found = scan_citations(rows.select(F.col(key).alias("doc_id"), F.concat_ws("\n", *texts).alias("text")))
    first = found.groupBy("doc_id", "number").agg(F.min("pos").alias("pos"))
    return first.groupBy(F.col("doc_id").alias(key)).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "number"))), lambda x: x["number"]).alias("refs"))
