"""Queries that split tender texts into clauses and requirements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clauses as C
from ..sources.storage import table
from .base import TENDERS, plain, view

_D = plain(TENDERS)
QUERIES: dict = {}
_DEALT = {"orders": "o_orderkey"}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _split(source: str) -> str:
    """SQL of split_clauses(): cuts are chr(1), held full stops chr(2); what an item's mark consumes is put back."""
    held = rf"regexp_replace(text, '(?i)((?:^|[^\p{{L}}\p{{N}}.])(?:{'|'.join(C.ABBREVIATIONS)})\.)', '\1' || chr(2), 'g')"
    ends = rf"regexp_replace({held}, '([.;!?])(\s)', '\1' || chr(1) || '\2', 'g')"
    blank = rf"regexp_replace({ends}, '(\n[ \t]*\n)', chr(1) || '\1', 'g')"
    items = rf"regexp_replace({blank}, '(\n[ \t]*{C.ITEM})', chr(1) || '\1', 'g')"
    return rf"""(WITH s AS (SELECT doc_id, string_split(replace({items}, chr(2), ''), chr(1)) AS p FROM {source}),
        n AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS nth FROM s),
        o AS (SELECT doc_id, nth, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(regexp_extract(piece, '^(\s*)', 1)) AS place, trim(regexp_replace(piece, '\s+', ' ', 'g')) AS clause FROM n)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1 AS pos, place::BIGINT AS "offset", clause FROM o WHERE clause <> '')"""


@query("x4_split_clauses", f'SELECT doc_id, pos, "offset", clause FROM {_split(f"({_D})")}')
def x4(spark, sf):
    return C.split_clauses(view(spark, sf, TENDERS)).withColumn("pos", F.col("pos").cast("long"))


@query("x4_document_clauses", f"SELECT doc_id, count(*) AS n_clauses, max(length(clause))::INT AS longest, min(clause) AS least FROM {_split('documents')} GROUP BY doc_id")
def x4_documents(spark, sf):
    return C.split_clauses(table(spark, sf, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_clauses"), F.max(F.length("clause")).alias("longest"), F.min("clause").alias("least"))


@query("x5_clause_at", f"""WITH c AS {_split(f"({_D})")}, p AS (SELECT doc_id, strpos(text, 'IS ') - 1 AS place FROM ({_D}) WHERE contains(text, 'IS '))
       SELECT p.doc_id, p.place AS "offset", arg_max(clause, "offset") AS clause FROM p JOIN c ON c.doc_id = p.doc_id AND c."offset" <= p.place GROUP BY p.doc_id, p.place""")
def x5(spark, sf):
    docs = view(spark, sf, TENDERS)
    places = docs.where(F.contains("text", F.lit("IS "))).select("doc_id", (F.instr("text", "IS ") - 1).cast("long").alias("offset"))
    return C.clause_at(docs, places)


_OBLIGED = "|".join(C.OBLIGATIONS)
_HEADERS = ", ".join(f"'{h.replace(' ', '')}'" for h in C.HEADERS)


@query("x7_noise_and_headings", rf"""SELECT doc_id, nth, t = '' OR regexp_matches(t, '{C.PAGE}') OR regexp_matches(t, '{C.COUNTS}') OR regexp_matches(t, '{C.SIGNS}')
        OR regexp_replace(lower(t), '[^\p{{L}}\p{{N}}]', '', 'g') IN ({_HEADERS}) AS noise,
        length(h) BETWEEN {C.HEAD_LENGTH[0]} AND {C.HEAD_LENGTH[1]} AND regexp_matches(h, '^[A-Z]') AND NOT regexp_matches(h, '{C.NO_HEAD}')
        AND length(regexp_replace(h, '[^A-Z]', '', 'g')) >= length(h) * {C.LETTER_SHARE}
        AND NOT regexp_matches(h, '(?i)\b(?:{_OBLIGED})\b') AND NOT regexp_matches(h, '\bIS\s*[:\-]?\s*\d') AS heading
        FROM (SELECT doc_id, unnest(b) AS raw, generate_subscripts(b, 1) - 1 AS nth, trim(raw) AS t, regexp_replace(t, '{C.HEAD_NUMBER}', '') AS h FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS b FROM ({_D})))""")
def x7(spark, sf):
    rows = view(spark, sf, TENDERS).select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("nth", "raw"))
    return rows.select("doc_id", F.col("nth").cast("long").alias("nth"), C.is_noise(F.col("raw")).alias("noise"), C.is_heading(F.col("raw")).alias("heading"))


@query("x6_requirement_spans")
def x6(spark, sf):
    return C.requirement_spans(view(spark, sf, TENDERS, _DEALT))


@query("x11_requirements")
def x11(spark, sf):
    return C.requirements(view(spark, sf, TENDERS, _DEALT))
