"""Queries over texts, URLs, pages and vectors: token functions, link handling, quality gate, requirements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import text as T
from ..operators import corpus as X
from ..sources.storage import table
from .base import view

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_PUNCT = r"""[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def _tokens(x: str) -> str:
    return f"list_filter(list_distinct(regexp_split_to_array(regexp_replace(lower(coalesce({x}, '')), '{_PUNCT}', '', 'g'), '\\s+')), lambda t: length(t) >= 2)"


@query("f1_tokenize_set", f"SELECT doc_id, len(t)::INT AS n_tokens, array_to_string(list_sort(t)[1:5], ' ') AS first_tokens FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)")
def f1(spark, sf):
    t = T.tokenize_set(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.array_join(F.slice(F.array_sort("t"), 1, 5), " ").alias("first_tokens"))


def _turns(spark, sf):
    """Each turn beside the one before it in its conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", "text", F.lag("text").over(w).alias("before"))


_TURNS = "(SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)"
_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '\\s+'), lambda t: t <> '')"


@query(
    "f2_token_jaccard",
    f"""SELECT conv_id, turn, round(CASE WHEN len(u) > 0 THEN len(list_intersect(a, b)) / len(u) ELSE 0 END, 6) AS jaccard
        FROM (SELECT *, list_distinct(list_concat(a, b)) AS u FROM (SELECT conv_id, turn, list_distinct({_WORDS.replace('{x}', 'text')}) AS a, list_distinct({_WORDS.replace('{x}', 'before')}) AS b FROM {_TURNS}))""",
)
def f2(spark, sf):
    a, b = (F.array_distinct(T.words(F.col(c))) for c in ("text", "before"))
    return _turns(spark, sf).select("conv_id", "turn", F.round(T.jaccard(a, b), 6).alias("jaccard"))


@query(
    "f7_length_ratio",
    f"SELECT conv_id, turn, round(CASE WHEN a > 0 AND b > 0 THEN least(a, b) / greatest(a, b) ELSE 0 END, 6) AS ratio FROM (SELECT conv_id, turn, len({_WORDS.replace('{x}', 'text')}) AS a, len({_WORDS.replace('{x}', 'before')}) AS b FROM {_TURNS})",
)
def f7(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.round(T.length_ratio(F.col("text"), F.col("before")), 6).alias("ratio"))


_NAME_WORDS = "(SELECT DISTINCT unnest(regexp_split_to_array(lower(concat(p_name, ' ', p_type, 's ', p_brand, ' copies glass ties')), '[^a-z]+')) AS w FROM part)"


@query("f8_singularize", f"SELECT w AS word, CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN substr(w, 1, length(w) - 3) || 'y' WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN substr(w, 1, length(w) - 1) ELSE w END AS singular FROM {_NAME_WORDS} WHERE w <> ''")
def f8(spark, sf):
    text = F.lower(F.concat_ws(" ", "p_name", F.concat("p_type", F.lit("s")), "p_brand", F.lit("copies glass ties")))
    w = table(spark, sf, "part").select(F.explode(F.split(text, "[^a-z]+")).alias("word")).where("word <> ''").distinct()
    return w.select("word", T.singularize(F.col("word")).alias("singular"))


@query(
    "f9_token_shape",
    """SELECT shape, count(*) AS n FROM (SELECT CASE WHEN NOT regexp_matches(w, '[aeiouy]') THEN 'no_vowel' WHEN regexp_matches(w, '[bcdfghjklmnpqrstvwxz]{5}') THEN 'consonant_run' WHEN len(list_distinct(string_split(w, ''))) < 3 THEN 'few_letters' ELSE 'ok' END AS shape
       FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents) WHERE w <> '') GROUP BY shape""",
)
def f9(spark, sf):
    w = table(spark, sf, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("w <> ''").distinct()
    return w.groupBy(T.token_shape(F.col("w")).alias("shape")).agg(F.count("*").alias("n"))


@query("f12_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def f12(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query(
    "f14_l2_normalize",
    "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / n)), 5) AS total, round(n, 5) AS norm FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)",
)
def f14(spark, sf):
    unit = T.l2_normalize(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(T.norm(F.col("embedding")), 5).alias("norm"))


@query("f17_clip", "SELECT doc_id, CASE WHEN length(f) <= 60 THEN f ELSE rtrim(substr(f, 1, 59)) || '…' END AS clipped FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)")
def f17(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clip(F.col("text"), 60).alias("clipped"))


@query("f16_gap_years", "SELECT l_orderkey, l_linenumber, CAST(date_diff('day', CAST(l_shipdate AS DATE), DATE '1998-12-01') AS INT) AS days_left, CAST(1998 - year(l_shipdate) AS INT) AS gap_years FROM lineitem")
def f16(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.datediff(F.lit("1998-12-01").cast("date"), F.col("l_shipdate").cast("date")).alias("days_left"), (1998 - F.year("l_shipdate")).alias("gap_years"))


@query("f18_rescale_confidence", "SELECT l_orderkey, l_linenumber, round(0.70 + 0.29 * l_discount, 6) AS confidence FROM lineitem")
def f18(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(T.rescale_confidence(F.col("l_discount")), 6).alias("confidence"))


@query(
    "f6_unit_overlap",
    r"""WITH r AS (SELECT l_orderkey, l_linenumber, concat(CAST(l_quantity AS INT), CASE l_linenumber % 3 WHEN 0 THEN ' KG and ' WHEN 1 THEN 'mm x ' ELSE ' V, ' END, l_linenumber, 'kg') AS a, concat('rated ', l_suppkey, ' kg at ', l_partkey, CASE WHEN l_suppkey % 2 = 0 THEN ' v' ELSE ' hz' END) AS b FROM lineitem),
        u AS (SELECT l_orderkey, l_linenumber, list_distinct(list_transform(regexp_extract_all(a, '(?i)\b\d+(?:\.\d+)?\s*(mm|cm|km|kg|kw|kv|kva|hz|mpa|lm|ip|m|v|w|a|g)\b', 1), lambda x: upper(x))) AS a, list_distinct(list_transform(regexp_extract_all(b, '(?i)\b\d+(?:\.\d+)?\s*(mm|cm|km|kg|kw|kv|kva|hz|mpa|lm|ip|m|v|w|a|g)\b', 1), lambda x: upper(x))) AS b FROM r)
        SELECT l_orderkey, l_linenumber, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS overlap FROM u""",
)
def f6(spark, sf):
    a = F.concat(F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, " KG and ").when(F.col("l_linenumber") % 3 == 1, "mm x ").otherwise(" V, "), F.col("l_linenumber").cast("string"), F.lit("kg"))
    b = F.concat(F.lit("rated "), F.col("l_suppkey").cast("string"), F.lit(" kg at "), F.col("l_partkey").cast("string"), F.when(F.col("l_suppkey") % 2 == 0, " v").otherwise(" hz"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(T.unit_overlap(a, b), 6).alias("overlap"))


_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


@query(
    "p23_normalize_url",
    rf"""WITH u AS (SELECT page_id, lower(regexp_extract(trim(url), '{_URL}', 1)) AS s, lower(regexp_extract(trim(url), '{_URL}', 2)) AS h, regexp_extract(trim(url), '{_URL}', 3) AS p, regexp_extract(trim(url), '{_URL}', 4) AS q FROM pages),
         f AS (SELECT *, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: regexp_matches(x, '^[^=]*=.+') AND NOT regexp_matches(lower(x), '^(utm_[^=]*|gclid|fbclid|ref|source)='))), '&') AS j FROM u)
         SELECT page_id, CASE WHEN s IN ('http', 'https') THEN s || '://' || CASE WHEN s = 'http' THEN regexp_replace(h, ':80$', '') ELSE regexp_replace(h, ':443$', '') END || CASE WHEN p = '' THEN '/' ELSE regexp_replace(p, '/+', '/', 'g') END || CASE WHEN j <> '' THEN '?' || j ELSE '' END ELSE '' END AS url FROM f""",
)
def p23(spark, sf):
    return table(spark, sf, "pages").select("page_id", N.normalize_url(F.col("url")).alias("url"))


@query(
    "p24_classify_link",
    rf"""SELECT page_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) AS domain,
         CASE WHEN regexp_matches(p, '\.(pdf|docx?|xlsx?|csv|json|xml)$') THEN 'document' WHEN regexp_matches(q, '(page|pageno|p|offset|start)=') OR contains(p, 'page/') THEN 'pagination' ELSE 'navigation' END AS kind
         FROM (SELECT page_id, url, lower(regexp_extract(trim(url), '{_URL}', 3)) AS p, lower(regexp_extract(trim(url), '{_URL}', 4)) AS q FROM pages)""",
)
def p24(spark, sf):
    return table(spark, sf, "pages").select("page_id", N.extract_domain(F.col("url")).alias("domain"), N.classify_link(F.col("url"))[0].alias("kind"))


@query(
    "x17_html_links",
    rf"""SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_distinct, count(*) FILTER (WHERE href LIKE '/%') AS n_relative, min(href) AS first_href
        FROM (SELECT page_id, regexp_extract(t, '{X.LINK.replace("'", "''")}', 1) || regexp_extract(t, '{X.LINK.replace("'", "''")}', 2) || regexp_extract(t, '{X.LINK.replace("'", "''")}', 3) AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, '{X.LINK.replace("'", "''")}')) AS t FROM pages)) GROUP BY page_id""",
)
def x17(spark, sf):
    links = X.html_links(table(spark, sf, "pages"))
    return links.groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_distinct("href").alias("n_distinct"), F.count_if(F.col("href").startswith("/")).alias("n_relative"), F.min("href").alias("first_href"))


@query(
    "x16_html_metadata",
    r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_extract(html, '(?i)<html[^>]*lang="([^"]*)"', 1) AS lang, len(regexp_extract_all(html, '(?i)<h[1-3][ >]'))::INT AS n_headings, trim(regexp_extract(html, '(?i)<meta\s[^>]*name="description"[^>]*content="([^"]*)"', 1)) AS description,
        trim(regexp_extract(html, '(?i)<meta\s[^>]*name="keywords"[^>]*content="([^"]*)"', 1)) AS keywords, trim(regexp_extract(html, '(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', 1)) AS json_ld FROM pages""",
)
def x16(spark, sf):
    return X.html_metadata(table(spark, sf, "pages"))


_PRICES = "SELECT o_orderkey AS page_id, concat('<p>x</p><TABLE class=\"a\"><tr><th>Key</th><th scope=\"col\">Priority</th></tr><tr><td>', o_custkey, '</td><td> <b>', o_orderpriority, '</b>', chr(10), '</td></tr></TABLE><table><tr><td>', o_orderstatus, '<td>end</table>') AS html FROM {orders}"


@query(
    "x16_html_tables",
    """SELECT o_orderkey AS page_id, c.t::INT AS "table", c.r::INT AS row, c.c::INT AS col, c.v AS value, c.h AS header FROM (SELECT *, unnest([{'t': 0, 'r': 0, 'c': 0, 'v': 'Key', 'h': true}, {'t': 0, 'r': 0, 'c': 1, 'v': 'Priority', 'h': true}, {'t': 0, 'r': 1, 'c': 0, 'v': o_custkey::VARCHAR, 'h': false},
        {'t': 0, 'r': 1, 'c': 1, 'v': o_orderpriority, 'h': false}, {'t': 1, 'r': 0, 'c': 0, 'v': o_orderstatus, 'h': false}, {'t': 1, 'r': 0, 'c': 1, 'v': 'end', 'h': false}]) AS c FROM orders)""",
)
def x16_tables(spark, sf):
    return X.html_tables(view(spark, sf, _PRICES))


@query("x17_page_links")
def x17_page_links(spark, sf):
    return X.page_links(table(spark, sf, "pages"))


@query("x19_blocked_page", "SELECT page_id, regexp_matches(lower(html), 'captcha|access denied|are you a robot|unusual traffic') OR page_id % 50 IN (1, 3, 29) AS blocked FROM pages")
def x19(spark, sf):
    status = F.when(F.col("page_id") % 50 == 1, 401).when(F.col("page_id") % 50 == 3, 403).when(F.col("page_id") % 50 == 29, 429).otherwise(200)
    return table(spark, sf, "pages").select("page_id", X.blocked_page(F.col("html"), status).alias("blocked"))


@query("x21_low_text_documents", "SELECT source, count(*) AS n_docs, count(*) FILTER (WHERE length(text) < 200) AS n_low FROM documents GROUP BY source")
def x21(spark, sf):
    low = X.low_text(table(spark, sf, "documents").select("doc_id", "source", "text", F.lit(5).alias("pages")), 40)
    return low.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("low").alias("n_low"))


@query(
    "x12_quality_gate",
    r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '') AS w FROM documents),
        s AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: NOT regexp_matches(x, '[aeiouy]') OR regexp_matches(x, '[bcdfghjklmnpqrstvwxz]{5}') OR len(list_distinct(string_split(x, ''))) < 3)) AS odd FROM t)
        SELECT doc_id, n::INT AS n_words, odd::INT AS n_odd, CASE WHEN n < 3 THEN 'too_short' WHEN 2 * odd > n THEN 'no_words' ELSE 'accepted' END AS outcome FROM s""",
)
def x12(spark, sf):
    return X.quality_gate(table(spark, sf, "documents"))


@query(
    "x2_citations",
    r"""WITH t AS (SELECT l_orderkey AS doc_id, string_agg(concat('Item ', l_linenumber, ' shall conform to IS ', l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN concat(' (Part ', l_linenumber, ')') ELSE '' END, CASE WHEN l_linenumber % 3 = 0 THEN concat(':', 1980 + CAST(l_quantity AS INT)) ELSE '' END, ' at ', l_suppkey, ' V.'), ' ' ORDER BY l_linenumber, l_partkey) AS text FROM lineitem GROUP BY l_orderkey),
        m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\bIS\s*\d+(?:\s*\(Part\s*\d+\))?(?::\d{4})?')) AS citation FROM t)
        SELECT doc_id, regexp_extract(citation, '(?i)IS\s*(\d+)', 1) AS number, nullif(regexp_extract(citation, '(?i)Part\s*(\d+)', 1), '') AS part, TRY_CAST(nullif(regexp_extract(citation, ':(\d{4})$', 1), '') AS INT) AS year, count(*) AS n FROM m GROUP BY ALL""",
)
def x2(spark, sf):
    line = F.concat(
        F.lit("Item "), F.col("l_linenumber").cast("string"), F.lit(" shall conform to IS "), F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" (Part "), F.col("l_linenumber").cast("string"), F.lit(")"))).otherwise(""),
        F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit(":"), (1980 + F.col("l_quantity").cast("int")).cast("string"))).otherwise(""), F.lit(" at "), F.col("l_suppkey").cast("string"), F.lit(" V."),
    )
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("line")))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), " ")
    return X.loose_citations(rows.select("doc_id", text.alias("text"))).groupBy("doc_id", "number", "part", "year").agg(F.count("*").alias("n"))


@query(
    "p33_tender_text_clean",
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(translate(text, '–—“”‘’', '--""'''''), '(?im)^licensed under.*$', '', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents""",
)
def p33(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.tender_text_clean(F.col("text"))).alias("digest"))


@query("s8_json_documents", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, json_valid(props) AS ok, sha256(props) AS digest FROM events")
def s8(spark, sf):
    return X.json_fields(table(spark, sf, "events").select("event_id", "props"), "props", {"k": "int"})
