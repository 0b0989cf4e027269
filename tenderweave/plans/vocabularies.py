"""Queries that label titles, fill what records lack, and keep track of where statements come from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocabulary as V
from .base import TITLES, plain, view

_T = plain(TITLES)
QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: Rules for the ordered categories: labels may repeat, the first three different ones count.
TOP_RULES = [("Lighting", ["led street", "road lighting"]), ("Lighting", ["luminaire", "lamp"]), ("Cables", ["cable", "694"]), ("Renewable", ["solar pv"]), ("Motors", ["motor", "4722"]), ("Construction", ["cement", "concrete", "steel"]), ("Water", ["pump", "drinking water"])]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _any(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{t}')" for t in terms) + ")"


def _all_labels(text: str, rules) -> str:
    merged: dict[str, list[str]] = {}
    for label, terms in rules:
        merged.setdefault(label, []).extend(terms)
    return "list_filter([" + ", ".join(f"CASE WHEN {_any(text, terms)} THEN '{label}' END" for label, terms in merged.items()) + "], lambda x: x IS NOT NULL)"


def _first_label(text: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(text, terms)} THEN '{label}'" for label, terms in rules) + f" ELSE {default} END"


@query("p9_designations", f"""SELECT std_id, CASE WHEN part IS NOT NULL AND NOT contains(lower(is_number), lower(part)) THEN is_number || ' (' || concat_ws('/', part, section) || ')' ELSE is_number END AS base,
        is_number || CASE WHEN part IS NOT NULL THEN ' (' || concat_ws('/', part, section) || ')' ELSE '' END || coalesce(':' || year, '') || CASE WHEN n_amendments > 0 THEN ' Amd.' || n_amendments ELSE '' END AS designation FROM ({_T})""")
def p9(spark, sf):
    c = F.col
    amendments = F.filter(F.sequence(F.lit(0), c("n_amendments")), lambda x: x > 0)
    return view(spark, sf, TITLES).select("std_id", V.base_designation(c("is_number"), c("part"), c("section")).alias("base"), V.designation(c("is_number"), c("part"), c("section"), c("year"), amendments).alias("designation"))


@query("p11_infer_categories", f"SELECT std_id, array_to_string({_all_labels('title', V.CATEGORIES6)}, '|') AS categories FROM ({_T})")
def p11(spark, sf):
    return view(spark, sf, TITLES).select("std_id", F.array_join(V.categories(F.col("title")), "|").alias("categories"))


@query("p12_categories_top3", f"""SELECT std_id, CASE WHEN len(c) > 0 THEN array_to_string(c[1:3], '|') ELSE 'General Standards' END AS categories FROM (SELECT std_id, {_all_labels("concat_ws(' ', title, is_number)", TOP_RULES)} AS c FROM ({_T}))""")
def p12(spark, sf):
    return view(spark, sf, TITLES).select("std_id", F.array_join(V.top_categories(F.col("title"), F.col("is_number"), TOP_RULES), "|").alias("categories"))


@query("p13_infer_type", f"SELECT std_id, {_first_label('title', V.TYPES, 'NULL')} AS kind, {_first_label('title', V.TYPES_DETAILED, repr('Specification'))} AS detailed FROM ({_T})")
def p13(spark, sf):
    t = F.col("title")
    return view(spark, sf, TITLES).select("std_id", V.standard_type(t).alias("kind"), V.standard_type(t, V.TYPES_DETAILED, "Specification").alias("detailed"))


@query("p14_infer_scope", f"SELECT std_id, 'This standard specifies requirements for ' || {_first_label('title', V.DOMAINS, 'rtrim(lower(title), chr(46))')} || '.' AS scope, true AS generated FROM ({_T})")
def p14(spark, sf):
    return view(spark, sf, TITLES).select("std_id", V.inferred_scope(F.col("title")).alias("s")).select("std_id", "s.scope", "s.generated")


@query("p15_synthesise_scope", rf"""SELECT std_id, CASE WHEN lower(base) = lower(title) THEN title || '. Applicable to ' || cats || ' applications.' ELSE base || ' — covers requirements for ' || cats || ' applications.' END AS scope
        FROM (SELECT std_id, title, trim(regexp_replace(trim(regexp_replace(title, '(?i)\s*[:-]\s*Part \d+[\w\s]*$', '')), '(?i)\s*[:-]\s*Section \d+[\w\s]*$', '')) AS base, coalesce(nullif(array_to_string({_all_labels('title', V.CATEGORIES6)}, ', '), ''), 'General') AS cats FROM ({_T}))""")
def p15(spark, sf):
    return view(spark, sf, TITLES).select("std_id", V.synthesised_scope(F.col("title"), V.categories(F.col("title"))).alias("scope"))


@query("p16_context", f"SELECT std_id, array_to_string({_all_labels('title', V.CONTEXTS)}, ' ') AS context FROM ({_T})")
def p16(spark, sf):
    return view(spark, sf, TITLES).select("std_id", V.application_context(F.col("title")).alias("context"))


_REFS = "CASE is_number " + " ".join(f"WHEN '{k}' THEN '{'|'.join(v)}'" for k, v in V.REFERENCES.items()) + " ELSE '' END"


@query("p18_infer_references", f"SELECT std_id, CASE WHEN reference <> '' THEN reference ELSE {_REFS} END AS refs FROM ({_T})")
def p18(spark, sf):
    own = F.filter(F.array("reference"), lambda x: x != "")
    return view(spark, sf, TITLES).select("std_id", F.array_join(V.inferred_references(F.col("is_number"), own), "|").alias("refs"))


@query("p19_completeness", f"SELECT std_id, 1 + (is_number <> '')::INT + (title <> '')::INT + (year IS NOT NULL)::INT + (coalesce(scope, '') <> '')::INT + (reference <> '')::INT + (status IS NOT NULL)::INT AS score FROM ({_T})")
def p19(spark, sf):
    c = F.col
    return view(spark, sf, TITLES).select("std_id", V.completeness(c("is_number"), c("title"), c("year"), c("scope"), F.filter(F.array("reference"), lambda x: x != ""), c("status")).alias("score"))


_SCOPE = f"""SELECT *, CASE WHEN json IS NOT NULL THEN json_extract_string(json, '$.value') WHEN coalesce(scope, '') <> '' THEN scope ELSE coalesce(summary, '') END AS value,
             CASE WHEN json IS NOT NULL THEN json_extract_string(json, '$.source_type') WHEN coalesce(scope, '') <> '' THEN CASE WHEN contains(source, 'Curated') THEN 'curated' ELSE 'official' END ELSE 'synthetic' END AS source_type
             FROM (SELECT *, CASE WHEN scope LIKE '{{%' THEN scope END AS json FROM ({_T}))"""


@query("p20_provenance_scope", f"SELECT std_id, value, source_type, CASE WHEN json IS NOT NULL THEN json_extract_string(json, '$.verified') = 'true' ELSE coalesce(scope, '') <> '' END AS verified FROM ({_SCOPE})")
def p20(spark, sf):
    c = F.col
    return view(spark, sf, TITLES).select("std_id", V.provenance_scope(c("scope"), c("summary"), c("source")).alias("s")).select("std_id", "s.*")


@query("p21_provenance_filters", f"""SELECT std_id, CASE WHEN ok THEN trim(value) END AS text, CASE WHEN ok THEN 'verified' ELSE 'not_available' END AS scope_availability,
        CASE WHEN said THEN mandatory END AS mandatory, CASE WHEN said THEN nullif(trim(scheme), '') END AS scheme_label, CASE WHEN said THEN 'verified' ELSE 'not_available' END AS certification_availability
        FROM (SELECT *, trim(value) <> '' AND source_type IN ('official', 'curated') AS ok, coalesce(verified, false) AND mandatory IS NOT NULL AS said FROM ({_SCOPE}))""")
def p21(spark, sf):
    c = F.col
    scope = V.accepted_scope(V.provenance_scope(c("scope"), c("summary"), c("source")))
    rows = view(spark, sf, TITLES).select("std_id", scope.alias("s"), V.accepted_certification(c("verified"), c("mandatory"), c("scheme")).alias("c"))
    return rows.select("std_id", "s.text", c("s.availability").alias("scope_availability"), "c.mandatory", "c.scheme_label", c("c.availability").alias("certification_availability"))


@query("p21_clean_lists", r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: x <> ''))), '|') AS parts FROM documents")
def p21_lists(spark, sf):
    from ..sources.storage import table

    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(V.clean_list(F.split("text", r"\."))), "|").alias("parts"))


@query("p34_candidate_text", f"SELECT std_id, trim(concat_ws(' ', nullif(title, ''), nullif(CASE WHEN scope LIKE '{{%' THEN json_extract_string(scope, '$.value') ELSE scope END, ''), nullif(summary, ''))) AS text FROM ({_T})")
def p34(spark, sf):
    return view(spark, sf, TITLES).select("std_id", V.candidate_text(F.col("title"), F.col("scope"), F.col("summary")).alias("text"))


@query("p38_keywords", f"""SELECT std_id, array_to_string(c, '|') AS categories, array_to_string(list_sort(list_distinct(list_concat(list_concat(list_filter([reference], lambda x: x <> ''), c), {_all_labels('title', V.KEYWORDS)}))), '|') AS keywords
        FROM (SELECT *, CASE WHEN len(f) > 0 THEN f ELSE ['General Electrical'] END AS c FROM (SELECT *, {_all_labels('title', V.CATEGORIES9)} AS f FROM ({_T})))""")
def p38(spark, sf):
    t = F.col("title")
    found = V.categories(t, V.CATEGORIES9, "General Electrical")
    known = F.filter(F.array("reference"), lambda x: x != "")
    return view(spark, sf, TITLES).select("std_id", F.array_join(found, "|").alias("categories"), F.array_join(V.keywords(t, known, found), "|").alias("keywords"))


@query("p29_export_metadata", f"SELECT std_id, coalesce(status, 'unknown') AS status, year, coalesce(source, 'BIS') AS source, coalesce(mandatory, false) AS is_mandatory, scheme AS certification_scheme, 'unified_v1' AS schema_version FROM ({_T})")
def p29(spark, sf):
    rows = view(spark, sf, TITLES)
    meta = F.struct(F.coalesce("status", F.lit("unknown")).alias("status"), "year", F.coalesce("source", F.lit("BIS")).alias("source"), F.coalesce("mandatory", F.lit(False)).alias("is_mandatory"), F.col("scheme").alias("certification_scheme"), F.lit("unified_v1").alias("schema_version"))
    return rows.select("std_id", meta.alias("metadata")).select("std_id", "metadata.*")


@query("f13_point_ids", f"SELECT std_id, CAST('0x' || substr(md5(is_number), 1, 15) AS BIGINT) AS point_id FROM ({_T})")
def f13(spark, sf):
    return view(spark, sf, TITLES).select("std_id", V.point_id(F.col("is_number")).alias("point_id"))


@query("u4_ordered_union", f"SELECT std_id, array_to_string(list_filter([reference, CASE WHEN other <> reference THEN other END, CASE WHEN is_number <> reference AND is_number <> other THEN is_number END], lambda x: x <> ''), '|') AS refs FROM (SELECT *, concat('IS ', std_id % 50) AS other FROM ({_T}))")
def u4(spark, sf):
    other = F.concat(F.lit("IS "), (F.col("std_id") % 50).cast("string"))
    return view(spark, sf, TITLES).select("std_id", F.array_join(V.clean_list(F.concat(F.array("reference"), F.array(other, "is_number"))), "|").alias("refs"))


@query("x8_classify_category", None)
def x8(spark, sf):
    from .base import TENDER_LINES

    rows = view(spark, sf, TENDER_LINES)
    return rows.select("line_id", V.requirement_category(F.col("text"), F.col("reference")).alias("category"))


def _category_sql() -> str:
    from .base import TENDER_LINES

    cases = " ".join(f"WHEN {' OR '.join(f'regexp_matches(lower(text), {chr(39)}{t}{chr(39)})' for t in terms)} THEN '{label}'" for label, terms in V.REQUIREMENT_CATEGORIES)
    return f"SELECT line_id, CASE {cases} WHEN coalesce(reference, '') <> '' THEN 'technical_specification' ELSE 'other' END AS category FROM ({plain(TENDER_LINES)})"


ORACLE_SQL["x8_classify_category"] = _category_sql()
