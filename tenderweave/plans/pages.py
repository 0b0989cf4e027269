"""Queries over whole pages and over many phrases at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import phrases, thesaurus
from ..functions import vocabulary as V
from ..operators import dom as D
from ..sources.storage import table
from .base import TITLES, plain, view
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()


def _rules_sql(text: str, rules: list[tuple[list[str], str]]) -> str:
    """A list of what the rules say, null where none of a rule's phrases occurs."""
    any_of = lambda ps: " OR ".join(f"contains(lower({text}), '{p.lower()}')" for p in ps)
    cases = ",\n           ".join(f"CASE WHEN {any_of(ps)} THEN '{says}' END" for ps, says in rules)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


_TERMS = _rules_sql("text", thesaurus.THESAURUS)
_CATS = _rules_sql("text", thesaurus.CATEGORY_RULES)


@query("p16_thesaurus_terms", f"SELECT std_id, array_to_string({_TERMS}, ' ') AS terms FROM (SELECT std_id, title AS text FROM ({plain(TITLES)}))")
def p16_titles(spark, sf):
    return view(spark, sf, TITLES).select("std_id", V.thesaurus_terms(F.col("title")).alias("terms"))


@query("p16_document_terms", f"SELECT doc_id, array_to_string({_TERMS}, ' ') AS terms FROM documents")
def p16_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", V.thesaurus_terms(F.col("text")).alias("terms"))


@query(
    "p12_categories_of_rules",
    f"""WITH t AS (SELECT std_id, concat_ws(' ', title, is_number) AS text FROM ({plain(TITLES)})), c AS (SELECT std_id, {_CATS} AS c FROM t),
        n AS (SELECT std_id, c, list_transform(range(1, len(c) + 1), lambda i: list_position(c, c[i]) = i) AS new FROM c),
        d AS (SELECT std_id, list_where(c, new) AS c FROM n)
        SELECT std_id, CASE WHEN len(c) = 0 THEN 'General Standards' ELSE array_to_string(c[1:3], '|') END AS categories FROM d""",
)
def p12_rules(spark, sf):
    return view(spark, sf, TITLES, {"part": "p_partkey"}).select("std_id", F.array_join(V.categories_of_rules(F.col("title"), F.col("is_number")), "|").alias("categories"))


_WORDS = ["the", "in", "an", "and", "ing", "thing", "some", "someone", "on", "one", "der", "die", "und", "les", "est", "el", "la", "que", "th", "t"]


@query("p16_phrases_in_documents", "SELECT doc_id, array_to_string(list_sort(list_filter([" + ", ".join(f"'{w}'" for w in _WORDS) + "], lambda w: contains(lower(text), w))), ' ') AS found FROM documents")
def p16_phrases(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(phrases.phrases_in(F.col("text"), _WORDS)), " ").alias("found"))


#: Pages of tenders over orders: a table of documents with headers, an inner table without, links in text.
TENDER_PAGES = """
    SELECT o_orderkey AS page_id, concat('http://tenders.example.org/', o_custkey, '/list.html') AS url,
           concat('<h1>Tenders</h1><table><tr><th>Number</th><th>Due</th><th>File</th></tr><tr><td>T/', o_orderkey, '</td><td>', o_orderpriority, '</td><td><a href="docs/', o_orderkey, '.pdf" title="Notice">Notice of ', o_orderkey, '</a>',
                  CASE WHEN o_orderkey % 3 = 0 THEN concat('<table><tr><td>Annex<td><a href="/annex/', o_custkey, '.xlsx">Sheet</a></table>') ELSE '' END, '</td></tr></table><p><a href="view?id=', o_orderkey, '">Download</a> <a href="#top">Top</a>',
                  '<a href="docs/', o_orderkey, '.pdf">again</a>') AS html
    FROM {orders}"""

_DEALT = {"orders": "o_orderkey"}
_FILE = "concat('Notice of ', o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ' Annex Sheet' ELSE '' END)"


@query(
    "x16_table_cells",
    f"""WITH c AS (SELECT o_orderkey, o_custkey, unnest([
            {{'t': 0, 'p': NULL, 'r': 0, 'c': 0, 'h': true, 'v': 'Number', 'l': NULL}}, {{'t': 0, 'p': NULL, 'r': 0, 'c': 1, 'h': true, 'v': 'Due', 'l': NULL}}, {{'t': 0, 'p': NULL, 'r': 0, 'c': 2, 'h': true, 'v': 'File', 'l': NULL}},
            {{'t': 0, 'p': NULL, 'r': 1, 'c': 0, 'h': false, 'v': concat('T/', o_orderkey), 'l': NULL}}, {{'t': 0, 'p': NULL, 'r': 1, 'c': 1, 'h': false, 'v': o_orderpriority, 'l': NULL}},
            {{'t': 0, 'p': NULL, 'r': 1, 'c': 2, 'h': false, 'v': {_FILE}, 'l': concat('docs/', o_orderkey, '.pdf')}},
            {{'t': 1, 'p': 0, 'r': 0, 'c': 0, 'h': false, 'v': 'Annex', 'l': NULL}}, {{'t': 1, 'p': 0, 'r': 0, 'c': 1, 'h': false, 'v': 'Sheet', 'l': concat('/annex/', o_custkey, '.xlsx')}}]) AS x FROM orders)
        SELECT o_orderkey AS page_id, x.t::INT AS "table", x.p::INT AS parent, x.r::INT AS row, x.c::INT AS col, x.h AS header, x.v AS value, x.l AS link FROM c WHERE x.t = 0 OR o_orderkey % 3 = 0""",
)
def x16_cells(spark, sf):
    return D.table_cells(view(spark, sf, TENDER_PAGES, _DEALT))


@query(
    "x16_table_records",
    f"""SELECT o_orderkey AS page_id, 0 AS "table", 1 AS row, concat_ws(';', 'due=' || o_orderpriority, 'file=' || {_FILE}, 'file_link=docs/' || o_orderkey || '.pdf', 'number=T/' || o_orderkey) AS record FROM orders""",
)
def x16_records(spark, sf):
    entries = F.array_sort(F.transform(F.map_entries("record"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return D.table_records(view(spark, sf, TENDER_PAGES, _DEALT)).withColumn("record", F.array_join(entries, ";"))


@query(
    "x17_attachments",
    f"""WITH c AS (SELECT o_orderkey, o_custkey, concat('http://tenders.example.org/', o_custkey, '/') AS base, unnest([
            {{'k': 0, 'h': concat('docs/', o_orderkey, '.pdf'), 't': concat('Notice of ', o_orderkey), 'm': 'pdf', 'c': concat_ws(';', 'col_Due=' || o_orderpriority, 'col_File=' || {_FILE}, 'col_Number=T/' || o_orderkey, 'title=Notice')}},
            {{'k': 1, 'h': concat('/annex/', o_custkey, '.xlsx'), 't': 'Sheet', 'm': 'sheet', 'c': 'row_text=Annex | Sheet'}}, {{'k': 2, 'h': concat('view?id=', o_orderkey), 't': 'Download', 'm': 'pdf', 'c': ''}}]) AS x FROM orders)
        SELECT o_orderkey AS page_id, CASE WHEN x.k = 1 THEN concat('http://tenders.example.org', x.h) ELSE base || x.h END AS url, x.h AS href, x.t AS text, 'document' AS kind, x.m AS mime, x.c AS context FROM c WHERE x.k <> 1 OR o_orderkey % 3 = 0""",
)
def x17_attachments(spark, sf):
    entries = F.array_sort(F.transform(F.map_entries("context"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return D.attachments(view(spark, sf, TENDER_PAGES, _DEALT)).drop("pos").withColumns({"context": F.array_join(entries, ";"), "mime": F.regexp_extract("mime", r"([a-z]+)$", 1)})
