"""Queries of tender profiles and their buckets."""

from __future__ import annotations

from ..operators import profile as P
from .base import TENDERS, _pick, plain, view
from .clauses import _split
from .registry import registry

_SUBJECTS = [
    "Procurement of LED luminaires for the municipal street lighting project in town; outdoor and coastal use, IP 66, -10 C to 50 C", "Name of Work: Overhaul of submersible pumps at the plant", "Purchase of contract papers", "Supply, installation and testing of steel furniture to be placed at site",
    "Subject - supply of medical devices for use in hospital building of the colony, relative humidity 95 %", "Tender of the month", "Design, manufacture and delivery of a very long kind of underground distribution switchgear and control gear assembly with all of its parts and tools",
]
PROFILES = f"SELECT doc_id, concat({_pick('doc_id', _SUBJECTS)}, chr(10), chr(10), text) AS text FROM ({TENDERS})"
_D = plain(PROFILES)
_DEALT = {"orders": "o_orderkey"}
QUERIES, ORACLE_SQL, query = registry()


def _ends(text: str, signs: str) -> str:
    return f"regexp_replace({text}, '^[{signs}]+|[{signs}]+$', '', 'g')"


def _without(text: str, words) -> str:
    return f"NOT regexp_matches(lower({text}), '{'|'.join(words)}')"


_SITES = "array_to_string(list_filter([" + ", ".join(rf"CASE WHEN regexp_matches(lower(text), '\b{s}s?\b') THEN '{s}' END" for s in P.SITINGS) + "], lambda x: x IS NOT NULL), ', ')"
_SAID = ", ".join(rf"'{label}' || nullif(regexp_replace(regexp_extract(text, '{p}', 1), '\s+', ' ', 'g'), '')" for label, p in P.CONDITIONS)
_CATEGORY = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{t}')" for t in terms) + f" THEN '{label}'" for label, terms in P.CATEGORIES) + f" ELSE '{P.NO_CATEGORY}' END"


def _plain(words: str) -> str:
    return rf"list_transform({words}, lambda w: regexp_replace(lower(w), '^[^\p{{L}}\p{{N}}%°]+|[^\p{{L}}\p{{N}}%°]+$', '', 'g'))"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _first(words: str, test: str, start: str = "1") -> str:
    """The first place k of a list from start on, for which the test holds."""
    return f"list_filter(range({start}, len({words}) + 1), lambda k: {test})[1]"


_LEADS = " OR ".join(f"low[k] = '{word}' AND list_has_any(low[greatest(k - {P.REACH}, 1):k - 1], {list(acts)})" for word, acts in P.ACTS.items())
_LEAD = _first("low", f"({_LEADS}) AND len(list_filter(words[greatest(k - {P.REACH}, 1):k - 1], lambda w: w LIKE '%.')) = 0")
_SKIP = _first("behind", rf"NOT (pl[k] IN {_in(P.COUNTED)} OR regexp_matches(behind[k], '{P.FIGURE}'))")
_STOP = _first("lows", f"(lows[k] IN {_in(P.STOPS)} OR lows[k] || ' ' || coalesce(lows[k + 1], '') IN {_in(P.STOP_PAIRS)}) AND length(array_to_string(rest[1:k - 1], ' ')) >= {P.LEAST_NAME}")
_PLACE = "(low[{0}] IN " + _in(P.PLACES) + " OR regexp_replace(low[{0}], 's$', '') IN " + _in(P.PLACES) + ")"
_NEAR = f"list_filter(range({{0}} + 1, least({{0}} + 1 + {P.REACH}, len(low)) + 1), lambda p: {_PLACE.format('p')})[1]"


@query(
    "x10_tender_profile",
    rf"""WITH c AS (SELECT doc_id, pos, clause, regexp_matches(lower(clause), '^(?:name of work|subject)') AS titled FROM {_split(f"({_D})")}),
       s AS (SELECT *, CASE WHEN titled THEN trim(regexp_replace(regexp_replace(clause, '^[^:]*:', ''), '^[^-]*-', '')) ELSE clause END AS subject FROM c),
       w AS (SELECT *, string_split(subject, ' ') AS words, {_plain("string_split(subject, ' ')")} AS low FROM s),
       l AS (SELECT *, {_LEAD} AS lead FROM w),
       b AS (SELECT *, CASE WHEN lead IS NOT NULL THEN words[lead + 1:] WHEN titled AND length(subject) > 4 THEN words END AS behind FROM l),
       q AS (SELECT *, {_plain("behind")} AS pl FROM b),
       r AS (SELECT *, CASE WHEN lead IS NULL THEN behind ELSE behind[coalesce({_SKIP}, 1):] END AS rest FROM q),
       t AS (SELECT *, {_plain("rest")} AS lows FROM r),
       n AS (SELECT *, {_STOP} AS stop FROM t),
       m AS (SELECT doc_id, pos, {_ends("array_to_string(CASE WHEN stop IS NOT NULL THEN rest[1:stop - 1] ELSE rest END, ' ')", ' ,.;:—-')} AS name FROM n),
       o AS (SELECT *, left(name, {P.MOST_CHARS}) AS short, regexp_extract(left(name, {P.MOST_CHARS}), '^(.*)\s\S*$', 1) AS cut FROM m),
       f AS (SELECT doc_id, pos, CASE WHEN length(name) >= 4 AND {_without('name', P.NO_PRODUCT)} THEN
                    CASE WHEN length(name) > {P.MOST_CHARS} THEN {_ends("CASE WHEN length(cut) > 20 THEN cut ELSE short END", ' ,.;:')} ELSE name END END AS product FROM o),
       u AS (SELECT doc_id, pos, string_split(clause, ' ') AS words, {_plain("string_split(clause, ' ')")} AS low FROM c),
       x AS (SELECT *, {_first("low", f"low[k] = 'for' AND {_NEAR.format('k')} IS NOT NULL")} AS f FROM u),
       y AS (SELECT *, {_NEAR.format('f')} AS place FROM x),
       z AS (SELECT *, list_filter(range(f + 1, place + 1), lambda k: low[k] NOT IN {_in(P.BEFORE_PLACE)})[1] AS start FROM y),
       h AS (SELECT doc_id, pos, {_ends("array_to_string(words[start:place], ' ')", ' ,.;:')} AS phrase FROM z WHERE f IS NOT NULL),
       i AS (SELECT doc_id, pos, {_ends(f"left(phrase, {P.MOST_CHARS})", ' ,.;:')} AS application FROM h WHERE length(phrase) >= 5 AND {_without('phrase', P.NO_APPLICATION)}),
       g AS (SELECT doc_id, arg_min(product, pos) AS product FROM f WHERE product IS NOT NULL GROUP BY doc_id),
       j AS (SELECT doc_id, arg_min(application, pos) AS application FROM i GROUP BY doc_id)
       SELECT d.doc_id, coalesce(product, '{P.NOT_STATED}') AS product, {_CATEGORY} AS category, coalesce(application, '{P.NOT_STATED}') AS application,
              coalesce(nullif(concat_ws('; ', nullif({_SITES}, ''), {_SAID}), ''), '{P.NOT_STATED}') AS environment
       FROM ({_D}) d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN j ON j.doc_id = d.doc_id""",
)
def x10(spark, sf):
    return P.tender_profile(view(spark, sf, PROFILES, _DEALT))


def _named(terms, words=False) -> str:
    holds = (lambda t: rf"regexp_matches(low, '\b{t}\b')") if words else (lambda t: f"contains(low, '{t}')")
    return "CASE " + " ".join(f"WHEN {holds(t)} THEN '{t.upper() if len(t) <= 5 else t.title()}'" for t in terms) + " END"


# SQL of the strict citation scan for the citations that these texts hold
_CITED = r"nullif(regexp_extract(clause, '\bIS\s*[:\-–]?\s*\d+(?:\s*:\s*Part\s*\d+)?(?:\s*:\s*\d{4})?', 0), '')"


_BARE = r"regexp_replace(coalesce({0}, ''), '[.,;:)]+$', '')"
_WORD, _NEXT = _BARE.format("w[k]"), _BARE.format("w[k + 1]")
_FIGURE = rf"""list_filter(list_transform(range(1, len(w) + 1), lambda k:
    CASE WHEN regexp_matches({_WORD}, '{P.GLUED}') AND lower(regexp_extract({_WORD}, '{P.GLUED}', 2)) IN {_in(P.UNITS)} THEN ltrim({_WORD}, '(')
         WHEN regexp_matches({_WORD}, '{P.FIGURE}') AND lower({_NEXT}) IN {_in(P.UNITS)} THEN ltrim({_WORD}, '(') || ' ' || {_NEXT} END), lambda x: x IS NOT NULL)[1]"""


@query(
    "x9_profile_buckets",
    rf"""WITH c AS (SELECT doc_id, pos, "offset", clause, lower(clause) AS low, string_split(clause, ' ') AS w FROM {_split(f"({_D})")} WHERE length(clause) >= {P.LEAST_CLAUSE}),
       t AS (SELECT *, coalesce({_FIGURE}, nullif(regexp_extract(clause, '{P.CLASS}', 1), '')) AS technical FROM c),
       b AS (SELECT *, coalesce({_CITED}, {_named(P.CERTIFICATION)}) AS regulatory, {_named(P.TESTING, True)} AS testing, CASE WHEN technical IS NOT NULL THEN {_named(P.PERFORMANCE)} END AS performance FROM t),
       k AS (SELECT *, CASE WHEN regulatory IS NOT NULL THEN 'regulatory' WHEN testing IS NOT NULL THEN 'testing' WHEN performance IS NOT NULL THEN 'performance' ELSE 'technical' END AS bucket,
                    coalesce(regulatory, testing, performance, technical) AS label FROM b WHERE coalesce(regulatory, testing, performance, technical) IS NOT NULL),
       u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, low ORDER BY pos) = 1),
       v AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, bucket ORDER BY pos) <= {P.MOST_IN_BUCKET})
       SELECT v.doc_id, row_number() OVER (PARTITION BY v.doc_id ORDER BY pos) AS nth, bucket, label, clause,
              coalesce('Clause ' || nullif(regexp_extract(clause, '^(?:(?:Clause|Section|Item|Annex)\s+)?(\d{{1,3}}(?:\.\d{{1,3}})+)', 1), ''), 'Item ' || nullif(regexp_extract(clause, '^(\d{{1,3}})[.)]\s', 1), ''),
              'Line ' || (length(left(text, "offset"::INT)) - length(replace(left(text, "offset"::INT), chr(10), '')) + 1)) AS location FROM v JOIN ({_D}) d ON d.doc_id = v.doc_id""",
)
def x9(spark, sf):
    return P.profile_buckets(view(spark, sf, PROFILES, _DEALT))
