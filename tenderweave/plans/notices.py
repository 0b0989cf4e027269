"""Queries of notices, order fields and crawl decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import notices as N
from ..operators.records import excerpt_choice
from .base import NOTICES, ORDERS, plain, view

_D, _O = plain(NOTICES), plain(ORDERS)
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _first(text: str, pattern: str) -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', 1), '')"


def _said(text: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{v}'" for p, v in rules) + f" ELSE {default} END"


_HEAD = "coalesce(title, '{0}') || ' ' || left(t, 1000)"


@query("x14_tender_notices", f"""WITH d AS (SELECT *, coalesce(text, '') AS t, list_transform(regexp_extract_all(coalesce(text, ''), '{N.NUMBER}', 1), lambda x: 'IS ' || x) AS all_refs FROM ({_D})),
       r AS (SELECT *, list_filter(all_refs, lambda x, i: list_position(all_refs, x) = i) AS refs FROM d), c AS (SELECT *, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: length(x) > {N.LEAST_CLAUSE} AND len(list_filter(refs, lambda y: contains(x, y))) > 0) AS lines FROM r)
       SELECT doc_id, coalesce({_first(_HEAD.format('Public Procurement Tender Notice'), N.TENDER_ID)}, '{N.NO_TENDER}') AS tender_id, {_said('t', N.AUTHORITIES, f"coalesce(author, '{N.NO_AUTHORITY}')")} AS authority, {_first('t', N.CLOSING_DATE)} AS closing_date,
              array_to_string(refs, ', ') AS referenced, len(lines[1:{N.MOST_CLAUSES}]) AS n_clauses, coalesce(array_to_string(lines[1:{N.MOST_CLAUSES}], chr(10)), '') AS clauses FROM c""")
def x14(spark, sf):
    rows = N.tender_notices(view(spark, sf, NOTICES))
    clauses = F.coalesce("clauses", F.expr("cast(array() as array<string>)"))
    return rows.select("doc_id", "tender_id", "authority", "closing_date", F.array_join("referenced", ", ").alias("referenced"), F.size(clauses).cast("long").alias("n_clauses"), F.array_join(clauses, "\n").alias("clauses"))


@query("x15_order_notices", rf"""WITH d AS (SELECT *, coalesce(text, '') AS t, coalesce(title, 'Quality Control Order') AS named FROM ({_D}))
       SELECT doc_id, coalesce('S.O. ' || {_first('t', N.ORDER)} || coalesce('(' || upper(nullif(regexp_extract(t, '{N.ORDER}', 2), '')) || ')', ''), '{N.NO_ORDER}') AS so_number, coalesce('IS ' || trim({_first('t', N.NUMBER_AND_YEAR)}), '{N.NO_STANDARD}') AS is_number, named AS title,
              {_said('t', N.MINISTRIES, f"'{N.NO_MINISTRY}'")} AS ministry, {_first('t', N.ANY_DATE)} AS effective_date, CASE WHEN t <> '' THEN left(t, 2000) ELSE named END AS excerpt FROM d""")
def x15_orders(spark, sf):
    return N.order_notices(view(spark, sf, NOTICES))


# cells of a gazette's table for half of the notices, made of their own fields
_NAME = "CASE n WHEN 0 THEN 'id' WHEN 1 THEN 'issuing ministry' WHEN 2 THEN 'subject' ELSE 'date' END AS name"
_VALUE = "CASE n WHEN 0 THEN CASE WHEN (doc_id + row) % 3 = 0 THEN concat('CG-DL-E-03032023-', doc_id) ELSE '-' END WHEN 1 THEN concat('Ministry ', doc_id % 7) WHEN 2 THEN concat('Order on IS ', doc_id % 50 + 10, ' row ', row) ELSE '2023-03-03' END AS value"


@query("x15_gazette_notices", f"""WITH d AS (SELECT *, coalesce(text, '') AS t, coalesce(title, 'Gazette of India Notification') AS named FROM ({_D})),
       r AS (SELECT doc_id, min(k) AS k FROM (SELECT doc_id, unnest([0, 1]) AS k FROM d WHERE doc_id % 2 = 0) WHERE (doc_id + k) % 3 = 0 GROUP BY doc_id)
       SELECT d.doc_id, CASE WHEN k IS NOT NULL THEN 'CG-DL-E-03032023-' || d.doc_id ELSE coalesce({_first("named || ' ' || left(t, 1000)", N.GAZETTE_ID)}, '{N.NO_GAZETTE}') END AS gazette_id,
              CASE WHEN k IS NOT NULL THEN 'IS ' || (d.doc_id % 50 + 10) ELSE coalesce('IS ' || {_first('t', N.NUMBER)}, '{N.NO_GAZETTE_STANDARD}') END AS is_number, CASE WHEN k IS NOT NULL THEN 'Order on IS ' || (d.doc_id % 50 + 10) || ' row ' || k ELSE named END AS title,
              CASE WHEN k IS NOT NULL THEN 'Ministry ' || d.doc_id % 7 ELSE '{N.NO_GAZETTE_MINISTRY}' END AS ministry, CASE WHEN k IS NOT NULL THEN '2023-03-03' END AS effective_date FROM d LEFT JOIN r ON r.doc_id = d.doc_id""")
def x15_gazettes(spark, sf):
    pages = view(spark, sf, NOTICES)
    places = pages.where("doc_id % 2 = 0").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("row")).select("doc_id", "row", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("n"))
    cells = places.selectExpr("doc_id", "row", "n", _NAME, _VALUE)
    return N.gazette_notices(pages, cells.select("doc_id", F.lit(0).alias("table"), "row", F.col("n").alias("col"), "name", "value"))


@query("x13_catalogue_standards")
def x13(spark, sf):
    return N.catalogue_standards(view(spark, sf, NOTICES, {"orders": "o_orderkey"}))


@query("x18_payloads", rf"""WITH d AS (SELECT *, coalesce(text, '') AS t, coalesce(title, CASE kind WHEN 'bis' THEN 'Indian Standard Document' WHEN 'draft' THEN 'Wide Circulation Draft Standard' END) AS named FROM ({_D}))
       SELECT doc_id, kind, CASE kind WHEN 'bis' THEN coalesce('IS ' || {_first('t', N.NUMBER)}, CASE WHEN contains(named, 'IS') THEN named END, '{N.NO_NUMBER}') WHEN 'draft' THEN coalesce('DRAFT ' || {_first('t', N.DRAFT_NUMBER)}, '{N.NO_DRAFT}') WHEN 'tender' THEN coalesce({_first('t', N.TENDER_ID)}, '{N.NO_TENDER}')
              WHEN 'order' THEN CASE WHEN length(regexp_extract(t, '{N.ORDER}', 2)) = 1 THEN 'S.O. ' || {_first('t', N.ORDER)} || '(E)' ELSE '{N.NO_ORDER}' END END AS identifier, named AS title,
              CASE kind WHEN 'tender' THEN coalesce(author, 'Central Public Procurement Portal') WHEN 'order' THEN 'Ministry / DPIIT' END AS authority, CASE kind WHEN 'tender' THEN t WHEN 'order' THEN left(t, 2000) ELSE left(t, 1500) END AS excerpt FROM d""")
def x18(spark, sf):
    return N.payloads(view(spark, sf, NOTICES))


_NUMBER = "CASE WHEN order_pos % 5 = 0 THEN ' ' ELSE is_number END"


@query("s19_order_records", f"""WITH o AS (SELECT order_pos, nullif(trim({_NUMBER}), '') AS num, nullif(trim(gazette_so_number), '') AS so, issuing_ministry, certification_scheme, effective_date FROM ({_O}))
       SELECT order_pos, num IS NOT NULL OR so IS NOT NULL AS ok, num AS is_number, so AS so_number, CASE WHEN ok THEN issuing_ministry END AS ministry, CASE WHEN ok THEN certification_scheme END AS scheme, CASE WHEN ok THEN CAST(effective_date AS DATE) END AS effective_date,
              'QCO Gazette Notification ' || coalesce(so, num) AS source_name, CASE WHEN ok THEN 'QCO Notification ' || coalesce(so, '') || ' requiring mandatory BIS certification for ' || coalesce(num, '') || '.' END AS excerpt, CASE WHEN ok THEN CAST(effective_date AS DATE) END AS publication_date FROM o""")
def s19(spark, sf):
    orders = view(spark, sf, ORDERS)
    return N.order_records(orders.select("order_pos", F.expr(_NUMBER).alias("notified_standard"), F.col("gazette_so_number").alias("so_number"), F.col("issuing_ministry").alias("ministry"), F.upper("certification_scheme").alias("scheme"), "effective_date"), "order_pos")


# URLs over pages whose hosts fall under the policies below
_URLS = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN concat('https://www.a.example/', page_id % 3, '/x') WHEN 2 THEN concat('http://in.b.example:80/docs/', page_id) WHEN 3 THEN 'https://c.example?q=1' ELSE concat('https://ba.example/', page_id) END AS url FROM {pages}"""
_POLICIES = [(1, "A", "a.example", False, ["/1"], []), (2, "B", "b.example", False, [], ["/docs/1", "/docs/2"]), (3, "C", "c.example", True, [], [])]


@query("p26_crawl_decisions", f"""SELECT page_id, url, CASE WHEN page_id % 5 = 1 THEN 'A' WHEN page_id % 5 = 2 THEN 'B' WHEN page_id % 5 = 3 THEN 'C' END AS source,
       CASE page_id % 5 WHEN 1 THEN CASE WHEN page_id % 3 = 1 THEN 'access_restricted' ELSE 'allowed' END WHEN 2 THEN CASE WHEN starts_with(page_id::VARCHAR, '1') OR starts_with(page_id::VARCHAR, '2') THEN 'allowed' ELSE 'access_restricted' END
              WHEN 3 THEN 'source_blocked' ELSE CASE WHEN trim(coalesce(url, '')) = '' THEN 'access_restricted' ELSE 'permission_required' END END AS decision FROM ({plain(_URLS)})""")
def p26(spark, sf):
    policies = spark.createDataFrame(_POLICIES, "pos int, source string, domain string, blocked boolean, denied array<string>, allowed array<string>")
    return N.crawl_decisions(view(spark, sf, _URLS), policies)


# the lines of an order propose their parts, with a part's own text or a line's as evidence
_PROPOSED = "SELECT l_orderkey AS analysis_id, l_linenumber * 1000000 + l_partkey AS pos, l_partkey AS std_id, CAST(NULL AS DOUBLE) AS own_score, CAST(l_partkey % 10 AS DOUBLE) AS score, CASE WHEN l_partkey % 3 = 0 THEN concat(' ', p_name, ' ') ELSE ' ' END AS own_excerpt, CASE WHEN p_size % 5 > 0 THEN p_type END AS scope FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"
_EVIDENCE = "SELECT DISTINCT l_orderkey AS analysis_id, l_partkey AS std_id, l_linenumber AS pos, concat('line ', l_linenumber) AS excerpt FROM {lineitem} WHERE l_returnflag = 'R'"


@query("p37_excerpt_choice", f"""WITH c AS (SELECT * FROM ({plain(_PROPOSED)}) QUALIFY row_number() OVER (PARTITION BY analysis_id, std_id ORDER BY pos) = 1),
       e AS (SELECT analysis_id, std_id, string_agg(excerpt, chr(10) || '---' || chr(10) ORDER BY pos) AS said FROM ({plain(_EVIDENCE)}) GROUP BY analysis_id, std_id)
       SELECT c.analysis_id, c.std_id, c.pos, score, coalesce(nullif(trim(own_excerpt), ''), said, scope) AS excerpt FROM c LEFT JOIN e ON e.analysis_id = c.analysis_id AND e.std_id = c.std_id""")
def p37(spark, sf):
    return excerpt_choice(view(spark, sf, _PROPOSED), view(spark, sf, _EVIDENCE), "analysis_id")
