"""Notices of catalogues, tenders and orders: texts or fields of a page in, rows of the catalogue's shape out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .corpus import scan_citations

# Words of authorities and ministries, divisions by committee, schemes, what stands for a missing value.
AUTHORITIES = (("CPWD", "Central Public Works Department (CPWD)"), ("NHAI", "National Highways Authority of India (NHAI)"), ("Railways", "Ministry of Railways"), ("MES", "Military Engineer Services (MES)"))
MINISTRIES = (
    ("Ministry of Steel", "Ministry of Steel"), ("Ministry of Heavy Industries", "Ministry of Heavy Industries"), ("Ministry of Electronics|MeitY", "Ministry of Electronics and Information Technology"),
    ("Ministry of Chemicals", "Ministry of Chemicals and Fertilizers"),
)
DIVISIONS = {
    "CED": "Civil Engineering Division", "ETD": "Electrotechnical Division", "MED": "Mechanical Engineering Division", "CHD": "Chemical Division", "TXD": "Textile Division", "FAD": "Food and Agriculture Division",
    "LITD": "Electronics and Information Technology Division", "MHD": "Medical Equipment and Hospital Planning Division",
}
SCHEMES = ("isi_mark", "crs", "hallmarking", "other")
NO_TENDER, NO_AUTHORITY = "TENDER_NOTICE", "Central Public Procurement Portal (CPPP)"
NO_ORDER, NO_STANDARD, NO_MINISTRY = "S.O. Notification", "Mandatory Standard", "Ministry of Commerce and Industry / DPIIT"
NO_GAZETTE, NO_GAZETTE_STANDARD, NO_GAZETTE_MINISTRY = "Gazette Notification", "Mandatory Notification", "Directorate of Printing / Ministry of Housing & Urban Affairs"
NO_DRAFT, NO_NUMBER = "DRAFT Standard", "IS Unknown"
LEAST_CLAUSE, MOST_CLAUSES, LEAST_TITLE, MOST_TITLE = 20, 10, 25, 120
# End of the fixed values.

#: A code of letters, digits, _, / and -, and a date: 2024-03-05, 5-Mar-2024, 5 March 2024 or 5th March 2024.
CODE = r"[\w/\-]*\w"
DATE = r"\d{4}-\d\d-\d\d|\d{1,2}(?:st|nd|rd|th)?[\s\-]+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[\s\-]+[12]\d{3}"


def labelled(leads: tuple[str, ...], names: tuple[str, ...], value: str) -> str:
    """A pattern for a field of running text, as in "Tender Ref. no: X/1": one of the leading words, one or more of the
    names behind it (none needed if there are no names), up to three signs and blanks between, and the value as group 1."""
    words = lambda ws: rf"(?:{'|'.join(sorted(ws))})\b"
    middle = rf"(?:\W{{0,3}}{words(names)})+" if names else ""
    return rf"(?i)\b{words(leads)}{middle}\W{{0,3}}\b({value})"


TENDER_ID = labelled(("tender",), ("id", "no", "notice", "number", "ref", "reference"), CODE)
CLOSING_DATE = labelled(("closing", "due", "submission"), ("date",), DATE)
DRAFT_NUMBER = labelled(("doc", "draft", "wc"), (), r"\w+[/\-]\w+")
ANY_DATE = rf"(?i)\b({DATE})"
GAZETTE_DATE = ANY_DATE
GAZETTE_ID = r"\b(CG-[A-Z]{2}-[EW]-\d{8}-\d+)\b"  # a format
#: An order: its number, and its series if there is one.
ORDER = r"(?i)\bS\W{0,2}O\W{0,2}(\d+)(?:\s*\((\w+)\))?"
NUMBER = r"(?i)\bIS\s*(\d{2,6})\b"
NUMBER_AND_YEAR = r"(?i)\bIS\s*(\d{2,6}(?:\W{1,3}Part\s*\d+)?(?:\W{0,3}[12]\d{3})?)\b"
COMMITTEE = r"\b((?:[A-HJ-Z][A-Z]|I[A-RT-Z])[A-Z]{0,2}\s*\d{1,3})\b"
YEAR = r"\b(19[5-9]\d|20[0-3]\d)\b"


def _first(text: Column, pattern: str) -> Column:
    """The first group of the pattern's first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _said(text: Column, rules, default: Column) -> Column:
    """The value of the first rule whose words the text holds."""
    out = F
    for pattern, value in rules:
        out = out.when(text.rlike(pattern), value)
    return out.otherwise(default)


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def tender_notices(pages: DataFrame) -> DataFrame:
    """(doc_id, tender_id, title, authority, closing_date, referenced, clauses) of pages (doc_id, title, text, author).

    referenced are the distinct numbers cited, in order; clauses the first ten lines over 20 characters that
    name one of them, null if there are none. A null title, text or author counts as absent.
    """
    text, title = _filled("text"), F.coalesce("title", F.lit("Public Procurement Tender Notice"))
    referenced = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), 1), lambda n: F.concat(F.lit("IS "), n)))
    lines = F.transform(F.split(text, r"\R"), lambda x: F.trim(x))
    naming = F.filter(lines, lambda x: (F.length(x) > LEAST_CLAUSE) & F.exists("referenced", lambda r: F.contains(x, r)))
    rows = pages.withColumn("referenced", referenced)
    return rows.select(
        "doc_id", F.coalesce(_first(F.concat_ws(" ", title, F.left(text, F.lit(1000))), TENDER_ID), F.lit(NO_TENDER)).alias("tender_id"), title.alias("title"), _said(text, AUTHORITIES, F.coalesce("author", F.lit(NO_AUTHORITY))).alias("authority"),
        _first(text, CLOSING_DATE).alias("closing_date"), "referenced", F.when(F.size(naming) > 0, F.slice(naming, 1, MOST_CLAUSES)).alias("clauses"),
    )


def order_notices(pages: DataFrame) -> DataFrame:
    """(doc_id, so_number, is_number, title, ministry, effective_date, excerpt) of order pages (doc_id, title, text):
    the first order number with its series, the first number cited, the first ministry of the table, the first date."""
    text, title = _filled("text"), F.coalesce("title", F.lit("Quality Control Order"))
    series = F.nullif(F.regexp_extract(text, ORDER, 2), F.lit(""))
    number = F.concat(F.lit("S.O. "), _first(text, ORDER), F.coalesce(F.concat(F.lit("("), F.upper(series), F.lit(")")), F.lit("")))
    return pages.select(
        "doc_id", F.coalesce(number, F.lit(NO_ORDER)).alias("so_number"), F.coalesce(F.concat(F.lit("IS "), F.trim(_first(text, NUMBER_AND_YEAR))), F.lit(NO_STANDARD)).alias("is_number"), title.alias("title"),
        _said(text, MINISTRIES, F.lit(NO_MINISTRY)).alias("ministry"), _first(text, ANY_DATE).alias("effective_date"), F.when(text != "", F.left(text, F.lit(2000))).otherwise(title).alias("excerpt"),
    )


def gazette_notices(pages: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(doc_id, gazette_id, is_number, title, ministry, effective_date) of gazette pages (doc_id, title, text).

    cells (doc_id, table, row, col, name, value) are those of the pages' tables: the first row with a gazette's id
    counts, and the text of a page only where it has none. A cell is ministry, subject or date by its name or
    value, in this order; of several the last one counts.
    """
    text, title = _filled("text"), F.coalesce("title", F.lit("Gazette of India Notification"))
    plain = pages.select("doc_id", text.alias("text"), F.coalesce(_first(F.concat_ws(" ", title, F.left(text, F.lit(1000))), GAZETTE_ID), F.lit(NO_GAZETTE)).alias("gazette_id"), title.alias("title"), F.lit(NO_GAZETTE_MINISTRY).alias("ministry"), F.lit(None).cast("string").alias("effective_date"))
    number = lambda c, default: F.coalesce(F.concat(F.lit("IS "), _first(c, NUMBER)), F.lit(default))
    plain = plain.withColumn("is_number", number(F.col("text"), NO_GAZETTE_STANDARD))
    wanted = ["doc_id", "gazette_id", "is_number", "title", "ministry", "effective_date"]
    if cells is None:
        return plain.select(wanted)
    name, value = F.lower("name"), F.trim("value")
    kind = F.when(value.rlike(GAZETTE_ID), "id").when(name.contains("ministry") | F.lower(value).contains("ministry"), "ministry").when(name.contains("subject") | F.lower(value).contains("for publication"), "subject").when(name.contains("date") | value.rlike(GAZETTE_DATE), "date")
    last = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("v")), F.when(F.col("kind") == k, F.col("col")))
    rows = cells.select("doc_id", "table", "row", "col", value.alias("v"), kind.alias("kind")).groupBy("doc_id", "table", "row").agg(last("id").alias("id"), last("ministry").alias("m"), last("subject").alias("s"), last("date").alias("d"))
    rows = rows.where("id is not null").groupBy("doc_id").agg(F.min(F.struct("table", "row", "id", "m", "s", "d")).alias("r"))
    both = plain.join(rows, "doc_id", "left")
    has, gid = F.col("r").isNotNull(), _first(F.col("r.id"), GAZETTE_ID)
    return both.select(
        "doc_id", F.coalesce(gid, "gazette_id").alias("gazette_id"), F.when(has, number(F.concat_ws(" ", "r.s", "text"), "Statutory Gazette")).otherwise(F.col("is_number")).alias("is_number"), F.when(has, F.coalesce("r.s", F.concat(F.lit("Gazette Notification "), gid))).otherwise(F.col("title")).alias("title"),
        F.when(has, F.coalesce("r.m", F.lit("Government of India"))).otherwise(F.col("ministry")).alias("ministry"), F.when(has, F.col("r.d")).otherwise(F.col("effective_date")).alias("effective_date"),
    )


def catalogue_standards(pages: DataFrame) -> DataFrame:
    """(doc_id, is_number, nth, part, section, year, title, committee, division): a row for each standard that a page
    (doc_id, text) names, numbered by its first place.

    Part and section are those of the first mention, the year the first one given with a mention or on its line,
    the committee the first on such a line, else the page's first (in its first 2,000 characters). The title is the
    longest line naming the standard, cut to 120 characters (of longer ones the last); a line under 25 characters
    takes the next one with it. Citations are upper-case, as in scan_citations; IS itself is no committee.
    """
    lines = pages.select("doc_id", F.transform(F.split("text", r"\R"), lambda x: F.trim(x)).alias("all"))
    said = F.transform("all", lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), F.get("all", i + 1).alias("next")))
    lines = lines.select("doc_id", F.explode(said).alias("l")).select("doc_id", "l.*")
    full = F.when((F.length("line") < LEAST_TITLE) & F.col("next").isNotNull(), F.concat_ws(" - ", "line", "next")).otherwise(F.col("line"))
    lines = lines.select("doc_id", "line_no", "line", full.alias("full")).where(F.col("line").rlike(r"\bIS\s*[:\-–]?\s*\d"))
    lines = lines.withColumn("key", F.struct("doc_id", "line_no"))
    found = scan_citations(lines.select(F.col("key").alias("doc_id"), F.col("line").alias("text"))).select(F.col("doc_id").alias("key"), F.col("pos").alias("at"), F.col("number").alias("is_number"), "part_section", F.col("year").alias("own_year")).join(lines, "key")
    place = F.struct("line_no", "at")
    inside = lambda word: F.regexp_extract("part_section", rf"(?i){word}\s*(\d+)", 1).try_cast("int")
    over = F.length("full") > MOST_TITLE
    best = F.struct(F.least(F.length("full"), F.lit(MOST_TITLE)), over, F.when(over, F.col("line_no")).otherwise(-F.col("line_no")))
    year, committee = F.coalesce("own_year", _first(F.col("line"), YEAR).try_cast("int")), _first(F.col("line"), COMMITTEE)
    rows = found.groupBy("doc_id", "is_number").agg(
        F.min(place).alias("place"), F.min_by(inside("Part"), place).alias("part"), F.min_by(inside(r"Sec(?:tion)?"), place).alias("section"), F.min_by(year, F.when(year.isNotNull(), place)).alias("year"),
        F.max_by(F.left("full", F.lit(MOST_TITLE)), best).alias("title"), F.min_by(committee, F.when(committee.isNotNull(), place)).alias("own"),
    )
    whole = pages.select("doc_id", _first(F.left("text", F.lit(2000)), COMMITTEE).alias("page_committee"))
    table = F.create_map(*[F.lit(x) for pair in DIVISIONS.items() for x in pair])
    chosen = rows.join(whole, "doc_id").withColumn("committee", F.coalesce("own", "page_committee"))
    nth = (F.row_number().over(Window.partitionBy("doc_id").orderBy("place")) - 1).cast("long")
    return chosen.select("doc_id", "is_number", nth.alias("nth"), "part", "section", "year", "title", "committee", table[F.regexp_extract("committee", "^[A-Z]+", 0)].alias("division"))


def payloads(pages: DataFrame) -> DataFrame:
    """(doc_id, kind, identifier, title, authority, excerpt): what a page (doc_id, kind, title, text, author) without
    fields of its own says: kind is bis, draft, tender or order, others give no identifier."""
    text, kind = _filled("text"), F.col("kind")
    number = F.concat(F.lit("IS "), _first(text, NUMBER))
    title = F.coalesce("title", F.when(kind == "bis", "Indian Standard Document").when(kind == "draft", "Wide Circulation Draft Standard"))
    own = F.when(kind == "bis", F.coalesce(number, F.when(F.contains(title, F.lit("IS")), title), F.lit(NO_NUMBER)))
    own = own.when(kind == "draft", F.coalesce(F.concat(F.lit("DRAFT "), _first(text, DRAFT_NUMBER)), F.lit(NO_DRAFT))).when(kind == "tender", F.coalesce(_first(text, TENDER_ID), F.lit(NO_TENDER)))
    own = own.when(kind == "order", F.when(F.length(F.regexp_extract(text, ORDER, 2)) == 1, F.concat(F.lit("S.O. "), _first(text, ORDER), F.lit("(E)"))).otherwise(NO_ORDER))
    authority = F.when(kind == "tender", F.coalesce("author", F.lit("Central Public Procurement Portal"))).when(kind == "order", "Ministry / DPIIT")
    return pages.select("doc_id", "kind", own.alias("identifier"), title.alias("title"), authority.alias("authority"), F.when(kind == "tender", text).when(kind == "order", F.left(text, F.lit(2000))).otherwise(F.left(text, F.lit(1500))).alias("excerpt"))


def order_records(rows: DataFrame, key: str) -> DataFrame:
    """(key, ok, is_number, so_number, ministry, scheme, effective_date, source_name, excerpt, publication_date) of order
    fields under any of their names; a missing column is null. ok is false, and the rest null, where neither a
    number nor a gazette number is given. An unknown scheme is null."""
    known = set(rows.columns)

    def any_of(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in known], F.lit(None).cast("string"))

    so = F.nullif(F.trim(any_of("gazette_so_number", "so_number", "notification_number")), F.lit(""))
    number = F.nullif(F.trim(any_of("is_number", "notified_standard")), F.lit(""))
    ministry = F.trim(F.coalesce(any_of("issuing_ministry", "ministry"), F.lit("Government of India")))
    scheme = F.lower(F.trim(any_of("certification_scheme", "scheme")))
    made = F.concat(F.lit("QCO Notification "), F.coalesce(so, F.lit("")), F.lit(" requiring mandatory BIS certification for "), F.coalesce(number, F.lit("")), F.lit("."))
    effective, published = any_of("effective_date").try_cast("date"), any_of("publication_date").try_cast("date")
    fields = {
        "is_number": number, "so_number": so, "ministry": ministry, "scheme": F.when(scheme.isin(*SCHEMES), scheme), "effective_date": effective, "source_name": F.concat(F.lit("QCO Gazette Notification "), F.coalesce(so, number)),
        "excerpt": F.trim(F.coalesce(any_of("excerpt", "mandate_text", "title"), made)), "publication_date": F.coalesce(published, effective),
    }
    ok = so.isNotNull() | number.isNotNull()
    return rows.select(key, ok.alias("ok"), *[F.when(ok, c).alias(n) for n, c in fields.items()])


def crawl_decisions(urls: DataFrame, policies: DataFrame) -> DataFrame:
    """urls (url, ...) with source and decision by policies (pos, source, domain, blocked, denied, allowed), a row for
    each domain of a source; denied and allowed are path prefixes, an empty allowed list allows all.

    access_restricted: no URL, a denied path or one not allowed; permission_required: no policy;
    source_blocked: the source refuses crawlers; else allowed. The first policy by pos of the host or a
    domain above it counts. Hosts meet policies on their domains by equality, so nothing is compared pairwise.
    """
    host = F.lower(F.regexp_extract("url", r"://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1)
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hosts = urls.select(host.alias("host"), above.alias("above")).where("host <> ''").distinct()
    rows = policies.withColumn("domain", F.lower(F.trim("domain")))
    first = hosts.select("host", F.explode("above").alias("domain")).join(rows, "domain").groupBy("host").agg(F.min_by(F.struct("source", "blocked", "denied", "allowed"), "pos").alias("p"))
    both = urls.withColumn("host", host).withColumn("path", path).join(first, "host", "left")
    begins = lambda c: F.exists(F.coalesce(c, F.expr("cast(array() as array<string>)")), lambda x: F.startswith("path", x))
    shut = begins(F.col("p.denied")) | ((F.size(F.coalesce("p.allowed", F.expr("cast(array() as array<string>)"))) > 0) & ~begins(F.col("p.allowed")))
    decision = F.when(F.trim(_filled("url")) == "", "access_restricted").when(F.col("p").isNull(), "permission_required").when(F.col("p.blocked"), "source_blocked").when(shut, "access_restricted").otherwise("allowed")
    return both.select(*urls.columns, F.col("p.source").alias("source"), decision.alias("decision"))


def content_type_allowed(content_type: Column, permitted: list[str]) -> Column:
    """Whether the type without its parameters begins with a permitted one, or begins one; none given is allowed."""
    clean = F.trim(F.substring_index(F.lower(F.coalesce(content_type, F.lit(""))), ";", 1))
    out = F.coalesce(content_type, F.lit("")) == ""
    for p in permitted:
        out = out | clean.startswith(p) | F.startswith(F.lit(p), clean)
    return out
