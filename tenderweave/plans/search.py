"""Queries of catalogue search and of changed texts under the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from ..operators.rules import SEVERITY
from .base import _LINES, STANDARDS, TITLES, _pick, plain, view
from .matching import _TOK, TODAY
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()

#: A catalogue with all searched fields over part, and lines of tenders over supplier, two of three with a number.
FIELDS = f"""
    SELECT std_id, is_number AS number, concat(is_number, CASE WHEN part IS NOT NULL THEN concat(' (', part, ')') ELSE '' END) AS designation, title, coalesce(summary, '') AS scope, concat(source, ' ', coalesce(status, '')) AS keywords,
           concat('ETD ', std_id % 40) AS committee, CASE std_id % 3 WHEN 0 THEN 'Electrotechnical Division' WHEN 1 THEN 'Civil Division' ELSE '' END AS council FROM ({TITLES})"""
ASKED = f"""
    SELECT s_suppkey AS query_id, concat({_pick('s_suppkey', _LINES)}, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat(' under ', CASE WHEN s_suppkey % 2 = 0 THEN 'is ' ELSE 'IS ' END, s_suppkey * 7 % 700) END) AS query_text FROM {{supplier}}"""
_COLUMNS = {"number": "number", "title": "title", "scope": "scope", "keyword": "keywords", "committee": "committee", "council": "council"}


def _search(asked: str, catalogue: str, columns: dict[str, str], exact: list[str]) -> str:
    fields = " UNION ALL ".join(f"SELECT std_id, {S.WEIGHTS[f]} AS w, unnest({_TOK.replace('{x}', c)}) AS token FROM cat" for f, c in columns.items())
    whole = " UNION ALL ".join(f"SELECT a.query_id, std_id, {S.EXACT} AS w, {c} AS token FROM asked a JOIN cat ON trim({c}) <> '' AND contains(lower(trim(query_text)), lower(trim({c}))) AND len({_TOK.replace('{x}', 'query_text')}) > 0" for c in exact)
    return f"""asked AS ({asked}), cat AS ({catalogue}), q AS (SELECT query_id, unnest({_TOK.replace('{x}', 'query_text')}) AS token FROM asked), p AS ({fields}),
        m AS (SELECT query_id, std_id, w, p.token FROM q JOIN p ON p.token = q.token UNION ALL {whole}),
        found AS (SELECT query_id, std_id, sum(w)::DOUBLE AS score, list_sort(list_distinct(list(token))) AS matched FROM m GROUP BY query_id, std_id),
        top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, std_id) AS rank FROM found)"""


@query("w17_catalogue_search", f"WITH {_search(plain(ASKED), plain(FIELDS), _COLUMNS, ['number', 'designation'])} SELECT query_id, std_id, score, rank::INT AS rank, array_to_string(matched, '|') AS matched FROM top WHERE rank <= 5")
def w17(spark, sf):
    found = S.search_best(view(spark, sf, ASKED), view(spark, sf, FIELDS), _COLUMNS, ["number", "designation"], 5)
    return found.withColumn("matched", F.array_join("matched", "|"))


#: One changed text for each supplier: the name of a part under a number, some with a year.
CHANGED = """
    SELECT s_suppkey AS req_id, concat(p_name, CASE s_suppkey % 4 WHEN 0 THEN '' ELSE concat(' to IS ', p_partkey) END, CASE s_suppkey % 4 WHEN 1 THEN concat(' : ', 1975 + p_size) WHEN 2 THEN ' : 1988' ELSE '' END) AS text
    FROM {supplier} JOIN {part} ON p_partkey = s_suppkey * 3"""
_CITED = r"regexp_extract(text, 'IS (\d+)', 1)"
_RANK = "list_position([" + ", ".join(f"'{v}'" for v in SEVERITY) + "], {0})"
_RULES = [
    ("status = 'withdrawn'", "incorrect_standard", 0.95), (f"status = 'superseded' AND deadline < DATE '{TODAY}'", "outdated_reference", 0.95), (f"status = 'superseded' AND deadline >= DATE '{TODAY}'", "outdated_reference", 0.75),
    ("status = 'superseded'", "outdated_reference", 0.85), ("year - cited > 5", "outdated_reference", 0.8), ("year - cited > 0", "outdated_reference", 0.7), ("year - cited < 0", "requires_human_verification", 0.55),
    ("cited IS NOT NULL AND year IS NULL", "unable_to_determine", 0.45), ("status = 'under_revision'", "requires_human_verification", 0.65), ("cited IS NULL", "ambiguous", 0.6), ("status = 'unknown'", "unable_to_determine", 0.5),
]


def _case(n: int, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {r[n]!r}" for r in _RULES) + f" ELSE {otherwise} END"


@query(
    "r17_rules_rerun",
    f"""WITH c AS ({plain(CHANGED)}), {_search('SELECT req_id AS query_id, text AS query_text FROM c', f"SELECT std_id, number, title, year, status, deadline FROM ({plain(STANDARDS)})", {'number': 'number', 'title': 'title'}, ['number'])},
       j AS (SELECT top.query_id, top.std_id, rank, status, deadline, year, CASE WHEN 'IS ' || {_CITED} = number THEN TRY_CAST(nullif(regexp_extract(text, ': (\\d{{4}})', 1), '') AS INT) END AS cited FROM top JOIN cat ON cat.std_id = top.std_id JOIN c ON c.req_id = top.query_id WHERE rank <= 3),
       v AS (SELECT *, {_case(1, "'justified'")} AS v, {_case(2, '0.85')}::DOUBLE AS sure FROM j),
       g AS (SELECT query_id, string_agg(std_id, ',' ORDER BY rank) AS std_ids, string_agg(v, ',' ORDER BY rank) AS verdicts, arg_min(v, {_RANK.format('v')} * 10 + rank) AS verdict, arg_min(sure, {_RANK.format('v')} * 10 + rank) AS confidence FROM v GROUP BY query_id)
       SELECT c.req_id, coalesce(std_ids, '') AS std_ids, coalesce(verdicts, '') AS verdicts, verdict, confidence,
              CASE WHEN verdict = 'justified' THEN 'acceptable' WHEN verdict IN ('outdated_reference', 'incorrect_standard') THEN 'risky' WHEN verdict IS NULL THEN 'no_finding' ELSE 'unclear' END AS impact FROM c LEFT JOIN g ON g.query_id = c.req_id""",
)
def r17(spark, sf):
    found = S.rerun_rules(view(spark, sf, CHANGED), view(spark, sf, STANDARDS), F.lit(TODAY).cast("date"))
    return found.withColumns({"std_ids": F.array_join(F.transform("std_ids", lambda x: x.cast("string")), ","), "verdicts": F.array_join("verdicts", ",")})
