"""Clauses, requirement spans and requirements of tender texts: one text in, many rows out. Built-in expressions only.

Rows of a text keep its key (doc_id) and their place (pos); what depends on the rows before, such as the
page or the heading that a span stands under, comes from windows over one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import category_of_lower
from .corpus import tender_text_clean, with_citation

# Abbreviations whose full stop ends no sentence, words that open an item, words of obligation, headers of columns and pages.
ABBREVIATIONS = ("amd", "amdt", "no", "nos", "sl", "sec", "cl", "cls", "pt", "para", "fig", "ref", "vol", "sr", "rs", "ltd", "pvt", "co", "govt", "dept", "approx", "max", "min", "qty", "wt", "viz", "vs", r"i\.e", r"e\.g")
OPENERS = ("Clause", "Section", "Item", "Annex", "Note", "Schedule", r"Sl\.")
OBLIGATIONS = ("shall", "must", "should", "required", "mandatory", "comply", "conform", "meet", "provide", "supply", "furnish", "ensure", "guarantee", "certify", "approved")
HEADERS = ("s no", "serial no", "sl no", "tender ref", "tender reference", "tender no", "bid document", "national competitive", "cppp", "gem bid")
EXCERPT = 400
LEAST = 20
MOST = 500
# End of the fixed values.

_CUT, _HOLD = "\u0001", "\u0002"
#: What opens an item at the start of a line: a number with dots or a bracket, a letter in a bracket, a lone sign, a word.
ITEM = rf"(?:\d[\d.]*[.)][\d.)]*\s|\(?[A-Za-z]\)|[^\w\s(]\s|(?:{'|'.join(OPENERS)})\b)"
PAGE = r"(?i)^---\s*page\s+(\d+)\s*---$"
#: A heading's number, and what none of its other characters may be; letters make up most of it.
HEAD_NUMBER, NO_HEAD, HEAD_LENGTH, LETTER_SHARE = r"^\d[\d.]*\s+", r"[a-z0-9\n]", (5, 80), 0.6
#: Lines that say nothing: page counts, and signs alone. Column headers are compared by their letters.
COUNTS, SIGNS = r"(?i)^(?:(?:page|of|\d+)\s*)*\d$", r"^[^\p{L}\p{N}\s]{5,}$"
#: What stands behind an item's number, its letter, or its sign.
NUMBERED, LETTERED, BULLETED = r"^\d+[.)][\d.)]*\s*(\S.*)$", r"^([A-Za-z]) ?[.)]\s+(\S.*)$", r"^[^\w\s(]\s+(\S.*)$"


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def split_code(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), the text read out of an array. An expression that makes a text may give whole-stage code of over 8,000
    bytes in a method, which the JVM never compiles; a function over arrays keeps it apart, in code that is split."""
    return docs.select("doc_id", F.transform(F.array("text"), lambda t: t)[0].alias("text"))


def clause_pieces(docs: DataFrame, *keep: Column) -> DataFrame:
    """(doc_id, nth, piece) and what to keep of docs: the texts cut where clauses end, in their order, blank ones among them.

    Each pattern begins with the one sign that it needs, so that other places are passed at once; the abbreviation is
    looked for from its full stop backwards.
    """
    held = F.regexp_replace("text", rf"(?i)\.(?<=[A-Z]\.)(?<=(?:^|[^\p{{L}}\p{{N}}.])(?:{'|'.join(ABBREVIATIONS)})\.)", f".{_HOLD}")
    ends = F.regexp_replace(held, r"[.;!?](?=\s)", f"$0{_CUT}")
    blank = F.regexp_replace(ends, r"\n(?=[ \t]*\n)", f"{_CUT}\n")
    items = F.regexp_replace(blank, rf"\n(?=[ \t]*{ITEM})", f"{_CUT}\n")
    return split_code(docs).select("doc_id", *keep, F.posexplode(F.split(F.replace(items, F.lit(_HOLD)), _CUT)).alias("nth", "piece"))


def placed_clauses(docs: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, nth, offset, line, clause): the clauses of `least` characters or more, with the place and the line of their
    first character; nth rises with the place.

    explode() stands in for where(), which would be pushed down and so make each clause twice.
    """
    signs = lambda text, sign: F.length(text) - F.length(F.replace(text, F.lit(sign)))
    # the text itself goes along only where it holds the signs that cut and hold, as its pieces have lost them
    odd = F.when(F.col("text").rlike(f"[{_CUT}{_HOLD}]"), F.col("text")).alias("odd")
    rows = clause_pieces(docs, odd).withColumn("blanks", F.regexp_extract("piece", r"^(\s*)", 1))
    before = Window.partitionBy("doc_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    rows = rows.withColumn("offset", (so_far(F.length("piece")) + F.length("blanks")).cast("long")).withColumn("line", so_far(signs("piece", "\n")) + signs("blanks", "\n") + 1)
    rows = rows.where(F.col("piece").rlike(r"\S")).withColumn("line", F.when(F.col("odd").isNull(), F.col("line")).otherwise(signs(F.left("odd", F.col("offset").cast("int")), "\n") + 1))
    rows = rows.select("doc_id", "nth", "offset", "line", flat(F.col("piece")).alias("clause"))
    return rows.select("doc_id", "nth", "offset", "line", F.explode(F.when(F.length("clause") >= least, F.array("clause"))).alias("clause"))


def split_clauses(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, offset, clause): a clause ends at a blank line, before a line that opens an item, and at
    a sentence end that closes no abbreviation. offset is that of its first character; white space is
    collapsed, empty clauses are left out."""
    return placed_clauses(docs).select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("nth")) - 1).alias("pos"), "offset", "clause")


def clause_at(docs: DataFrame, places: DataFrame, most: int = EXCERPT) -> DataFrame:
    """places (doc_id, offset) with the clause that holds each; a clause of over `most` characters is cut at
    both ends around the place, with an ellipsis at each cut."""
    clauses = split_clauses(docs).select("doc_id", F.col("offset").alias("start"), "clause")
    upto = places.join(clauses, "doc_id").where("start <= offset")
    found = upto.groupBy("doc_id", places["offset"]).agg(F.max_by(F.struct("start", "clause"), "start").alias("c"))
    inside = F.col("offset") - F.col("c.start")
    low = F.greatest(F.lit(0).cast("long"), F.least(inside - most // 2, (F.length("c.clause") - most).cast("long")))
    piece = F.trim(F.substr("c.clause", (low + 1).cast("int"), F.lit(most)))
    cut = F.concat(F.when(low > 0, "…").otherwise(""), piece, F.when(low + most < F.length("c.clause"), "…").otherwise(""))
    return found.select("doc_id", "offset", F.when(F.length("c.clause") <= most, F.col("c.clause")).otherwise(cut).alias("clause"))


def is_noise(text: Column) -> Column:
    """Page marks and numbers, lines of dots, headers of columns and pages."""
    t = F.trim(text)
    letters = F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]", "")
    return (t == "") | t.rlike(PAGE) | t.rlike(COUNTS) | t.rlike(SIGNS) | letters.isin(*[h.replace(" ", "") for h in HEADERS])


def is_heading(text: Column) -> Column:
    """A line that shouts: 5 to 80 characters that begin with a capital, hold no small letter and no digit but those of the
    line's own number, and are letters for the most part; no obligation and no citation."""
    line = F.regexp_replace(F.trim(text), HEAD_NUMBER, "")
    capitals = F.length(F.regexp_replace(line, "[^A-Z]", ""))
    shouts = F.length(line).between(*HEAD_LENGTH) & line.rlike("^[A-Z]") & ~line.rlike(NO_HEAD) & (capitals >= F.length(line) * LETTER_SHARE)
    return shouts & ~line.rlike(rf"(?i)\b(?:{'|'.join(OBLIGATIONS)})\b") & ~line.rlike(r"\bIS\s*[:\-]?\s*\d")


def _with_items(blocks: DataFrame) -> DataFrame:
    """blocks (body, ...) with the items of each that is a list, else null, found in the row itself.

    Each step is a column of its own, read more than once by the next, so that none is worked out again for an item. A block
    of one line has no steps.
    """
    lines = F.transform(F.filter(F.split("body", r"\n"), lambda x: F.trim(x) != ""), lambda x: F.trim(x))
    # a lettered item counts if all before it, from the block's first letter on, have given its place in the alphabet
    follows = lambda s, x: (x > 0) & ((s["at"] == -1) | (x == s["at"] + 1))
    none_yet = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("line"), F.array().cast("array<int>").alias("found"))
    chain = lambda s, x: F.struct(F.when(follows(s, x), x).otherwise(s["at"]).alias("at"), (s["line"] + 1).alias("line"), F.when(follows(s, x), F.concat(s["found"], F.array(s["line"]))).otherwise(s["found"]).alias("found"))
    many = lambda c: F.size(F.filter(c, lambda x: x != "")) >= 2
    behind_letter = F.transform("_lines", lambda x, k: F.when(F.array_contains("_lettered", k), F.regexp_extract(x, LETTERED, 2)).otherwise(""))
    upto = lambda k: F.coalesce(F.get("_starts", k + 1), F.size("_lines"))
    item = lambda start, k: F.array_join(F.concat(F.array(F.get("_own", start)), F.slice("_lines", start + 2, upto(k) - start - 1)), " ")
    steps = {
        "_lines": F.when(F.contains("body", F.lit("\n")), lines),
        "_numbered": F.transform("_lines", lambda x: F.regexp_extract(x, NUMBERED, 1)),
        "_lettered": F.aggregate(F.transform("_lines", lambda x: F.ascii(F.lower(F.regexp_extract(x, LETTERED, 1)))), none_yet, chain, lambda s: s["found"]),
        "_bullets": F.transform("_lines", lambda x: F.regexp_extract(x, BULLETED, 1)),
        "_own": F.when(many("_numbered"), F.col("_numbered")).when(F.size("_lettered") >= 2, behind_letter).when(many("_bullets"), F.col("_bullets")),
        "_starts": F.filter(F.transform("_own", lambda x, k: F.when(x != "", k)), lambda k: k.isNotNull()),
        "items": F.when(F.col("_own").isNotNull(), F.transform("_starts", item)),
    }
    out = blocks
    for name, step in steps.items():
        out = out.withColumn(name, step)
    return out.drop(*[name for name in steps if name != "items"])


def _spans(docs: DataFrame) -> DataFrame:
    """requirement_spans() with block and nth, by which a text's spans are sorted already."""
    text = F.regexp_replace("text", r"(?im)^[ \t]*(---\s*page\s+\d+\s*---)[ \t]*$", "\n\n$1\n\n")
    blocks = split_code(docs).select("doc_id", F.posexplode(F.split(text, r"\n{2,}")).alias("block", "body")).where(F.col("body").rlike(r"\S"))
    blocks = blocks.withColumn("body", F.trim(F.regexp_replace("body", r"^\s+|\s+$", "")))
    number = F.nullif(F.regexp_extract("body", PAGE, 1), F.lit("")).cast("int")
    rows = _with_items(blocks).select("doc_id", "block", number.alias("mark"), F.col("items").isNotNull().alias("structural"), F.posexplode(F.coalesce("items", F.array("body"))).alias("nth", "text"))
    in_order = Window.partitionBy("doc_id").orderBy("block", "nth")
    paged = rows.withColumn("page", F.last("mark", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, 0))).where("mark is null")
    return paged.select("doc_id", "block", "nth", (F.row_number().over(in_order) - 1).alias("pos"), "page", "text", "structural")


def requirement_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, page, text, structural): paragraphs, of which those that are lists are their items.

    A block of two or more numbered lines is a list; else of two or more lettered ones that follow each
    other in the alphabet; else of two or more bullets. Lines without a mark continue the item before;
    those before the first one are left out. The page is that of the last page mark before.
    """
    return _spans(docs).select("doc_id", "pos", "page", "text", "structural")


def requirements(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(doc_id, pos, page, location, text, normalized, reference, cited_year, category, confidence): the spans that
    are no noise and no heading and have at least `least` characters, the first `most` of a text. location is the last
    heading before. Confidence: 0.90 for a citation in a list, 0.80 for one elsewhere, 0.65 in a list, else 0.45."""
    in_order = Window.partitionBy("doc_id").orderBy("block", "nth")
    spans = _spans(docs).where((F.length(F.trim("text")) >= least) & ~is_noise(F.col("text"))).withColumn("heading", is_heading(F.col("text")))
    placed = spans.withColumn("location", F.last(F.when(F.col("heading"), F.trim("text")), ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("heading"))
    first = placed.withColumn("place", F.row_number().over(in_order)).where(F.col("place") <= most).withColumn("normalized", tender_text_clean(F.col("text")))
    both = with_citation(first.withColumn("low", F.lower("normalized")), "text")
    has = F.col("number").isNotNull()
    confidence = F.when(has & F.col("structural"), 0.90).when(has, 0.80).when(F.col("structural"), 0.65).otherwise(0.45)
    return both.select("doc_id", "pos", "page", "location", F.trim("text").alias("text"), "normalized", F.col("number").alias("reference"), F.col("year").alias("cited_year"), category_of_lower(F.col("low"), F.col("number")).alias("category"), confidence.alias("confidence"))
