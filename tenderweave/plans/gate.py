"""Queries of the gate in front of analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as X
from ..operators import gate as G
from ..sources.storage import table
from .base import TENDERS, _pick, plain, view
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()

_SHORT = [
    "IS 10322", "qwertyuiop asdfghjkl", "N95 mask", "kjh gfd saq", "12345", "", "borewell", "fhbjfbdjvfdjhbdf dhdjfhfjfjfjfjsjs PVC", "LED street light 90 W, IP66", "aaaaaaa bbbbbbb ccccccc ddddddd paper", "पानी का पंप", "... --- ...", "bcd THD MCB",
]
#: Texts as users type them, beside the documents.
ASKED = f"SELECT event_id AS doc_id, concat({_pick('event_id', _SHORT)}, CASE WHEN user_id % 4 = 0 THEN concat(' ', event_type, ' zxcvbnm') ELSE '' END) AS text FROM {{events}}"

_WORDS = ", ".join(f"'{w}'" for w in G.known_words())
_STEPS = ", ".join(f"'{s}'" for s in G.STEPS)


def _gate(source: str) -> str:
    pattern = lambda p: p.replace("'", "''")
    return rf"""WITH d AS (SELECT doc_id, trim(coalesce(text, '')) AS t FROM {source}),
        e AS (SELECT *, regexp_extract_all(t, '{pattern(G.TOKEN)}') AS ws FROM d),
        x AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM e),
        l AS (SELECT *, lower(regexp_replace(w, '[^A-Za-z]', '', 'g')) AS l FROM x),
        s AS (SELECT *, array_to_string(list_transform(range(1, greatest(length(l), 2)), lambda i: CASE WHEN substr(l, i, 2) IN ({_STEPS}) THEN '1' ELSE '0' END), '') AS steps FROM l),
        k AS (SELECT doc_id, pos, w, CASE WHEN l IN ({_WORDS}) THEN 'vocabulary' WHEN length(l) < {G.LEAST_LETTERS} THEN 'neutral'
                     WHEN length(l) < {G.SHAPED_LETTERS} THEN CASE WHEN regexp_matches(l, '[aeiouy]') OR (regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]')) THEN 'short' ELSE 'malformed' END
                     WHEN NOT regexp_matches(l, '[aeiouy]') OR regexp_matches(l, '{G.CONSONANTS}') OR len(list_distinct(string_split(l, ''))) < {G.LEAST_DISTINCT} OR contains(steps, '{'1' * (G.MOST_STEPS + 1)}') THEN 'gibberish' ELSE 'shaped' END AS k FROM s),
        n AS (SELECT doc_id, count(*) FILTER (WHERE k = 'vocabulary') AS n_vocabulary, count(*) FILTER (WHERE k = 'shaped') AS n_shaped, count(*) FILTER (WHERE k = 'short') AS n_short, count(*) FILTER (WHERE k = 'gibberish') AS n_gibberish,
                     count(*) FILTER (WHERE k = 'malformed') AS n_malformed, count(*) AS n_tokens, list(w ORDER BY pos) FILTER (WHERE k = 'gibberish') AS g, list(w ORDER BY pos) FILTER (WHERE k = 'malformed') AS m FROM k GROUP BY doc_id),
        c AS (SELECT d.doc_id, t, regexp_matches(t, '{G.DESIGNATION}') AS designation, regexp_matches(t, '{G.SPECIFICATION}') AS specification, regexp_matches(t, '{G.CODE}') AS code, coalesce(n_vocabulary, 0) AS n_vocabulary, coalesce(n_shaped, 0) AS n_shaped,
                     coalesce(n_short, 0) AS n_short, coalesce(n_gibberish, 0) AS n_gibberish, coalesce(n_malformed, 0) AS n_malformed, len(regexp_extract_all(t, '\p{{L}}')) - len(regexp_extract_all(t, '[A-Za-z]')) AS n_foreign, coalesce(n_tokens, 0) AS n_tokens,
                     coalesce(g, []) AS g, coalesce(m, []) AS m FROM d LEFT JOIN n ON n.doc_id = d.doc_id),
        p AS (SELECT *, designation OR specification OR code OR n_vocabulary + n_shaped > 0 OR n_foreign >= {G.LEAST_FOREIGN} OR n_short > n_malformed AS positive,
                     NOT designation AND n_shaped + n_gibberish >= {G.LEAST_TESTED} AND n_gibberish >= {G.DOMINANCE}::DOUBLE * (n_shaped + n_gibberish) AS drowned FROM c),
        r AS (SELECT *, CASE WHEN t = '' THEN 'empty' WHEN NOT positive AND n_gibberish + n_malformed > 0 THEN 'no_meaningful_content' WHEN NOT positive THEN 'no_analysable_content' WHEN drowned THEN 'dominated_by_gibberish' END AS reason FROM p)
        SELECT doc_id, reason IS NULL AS meaningful, reason, designation, specification, code, n_vocabulary::INT AS n_vocabulary, n_shaped::INT AS n_shaped, n_short::INT AS n_short, n_gibberish::INT AS n_gibberish, n_malformed::INT AS n_malformed,
               n_foreign::INT AS n_foreign, n_tokens::INT AS n_tokens,
               array_to_string((CASE reason WHEN 'no_meaningful_content' THEN list_concat(g, m) WHEN 'dominated_by_gibberish' THEN g ELSE [] END)[1:{G.MOST_SHOWN}], ' ') AS rejected FROM r"""


@query("x12_document_gate", _gate("documents"))
def x12_documents(spark, sf):
    return G.quality_gate(table(spark, sf, "documents")).withColumn("rejected", F.array_join("rejected", " "))


@query("x12_asked_gate", _gate(f"({plain(ASKED)})"))
def x12_asked(spark, sf):
    return G.quality_gate(view(spark, sf, ASKED)).withColumn("rejected", F.array_join("rejected", " "))


@query(
    "x21_low_text_pages",
    rf"""SELECT doc_id, pages, length(text) / pages < 300 AS low FROM (SELECT doc_id, text, greatest(len(regexp_extract_all(text, '(?im)^[ \t]*---\s*page\s+[0-9]+\s*---[ \t]*$')), 1)::INT AS pages
        FROM (SELECT doc_id, concat(text, CASE WHEN doc_id % 3 = 0 THEN concat(chr(10), '--- page 12 ---', chr(10), 'last') ELSE '' END) AS text FROM ({plain(TENDERS)})))""",
)
def x21_pages(spark, sf):
    docs = view(spark, sf, TENDERS).withColumn("text", F.concat("text", F.when(F.col("doc_id") % 3 == 0, "\n--- page 12 ---\nlast").otherwise("")))
    return X.low_text(docs.withColumn("pages", G.page_count(F.col("text"))), 300).select("doc_id", "pages", "low")
