"""Queries over the catalogue: cleaning, keys, merging, reconciliation, upserts, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import text as T
from ..operators import catalogue as C
from .base import CATALOGUE, ORDERS, STANDARDS, plain, view

_CAT, _ORD, _STD = plain(CATALOGUE), plain(ORDERS), plain(STANDARDS)
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_SQL_COLLAPSE = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _collapse(x: str) -> str:
    return _SQL_COLLAPSE.replace("{x}", x)


_CLEAN = _collapse("replace(replace(title, '&nbsp;', ' '), '&amp;', '&')")


@query("p1_clean_title", f"SELECT std_id, {_CLEAN} AS title FROM ({_CAT})")
def p1(spark, sf):
    return view(spark, sf, CATALOGUE).select("std_id", N.clean_title(F.col("title")).alias("title"))


def _tails(x: str) -> str:
    for tail in N.TITLE_TAILS:
        x = f"trim(regexp_replace({x}, '(?is){tail}', ''))"
    return _collapse(x)


@query("p2_strip_portal_noise", f"SELECT std_id, {_tails('trim(title)')} AS title FROM ({_CAT})")
def p2(spark, sf):
    return view(spark, sf, CATALOGUE).select("std_id", N.strip_portal_noise(F.col("title")).alias("title"))


@query(
    "p3_extract_validity",
    rf"""SELECT std_id, CASE WHEN v <> '' THEN trim(regexp_replace(title, '(?i)\s*\(Vai?ld\s+upto\s+[^)]+\)', '', 'g')) ELSE title END AS title, nullif(trim(v), '') AS valid_upto
         FROM (SELECT *, regexp_extract(title, '(?i)\(Vai?ld\s+upto\s+([^)]+)\)', 1) AS v FROM ({_CAT}))""",
)
def p3(spark, sf):
    title, upto = N.extract_validity(F.col("title"))
    return view(spark, sf, CATALOGUE).select("std_id", title.alias("title"), upto.alias("valid_upto"))


_STATUS = "CASE WHEN lower(trim(raw_status)) IN ('active','superseded','withdrawn','under_revision','reaffirmed') THEN lower(trim(raw_status)) WHEN lower(trim(raw_status)) = 'under revision' THEN 'under_revision' ELSE 'unknown' END"


@query("p4_normalize_status", f"SELECT status, count(*) AS n FROM (SELECT {_STATUS} AS status FROM ({_CAT})) GROUP BY status")
def p4(spark, sf):
    return view(spark, sf, CATALOGUE).groupBy(N.normalize_status(F.col("raw_status")).alias("status")).agg(F.count("*").alias("n"))


@query(
    "p5_year_from_version",
    rf"""SELECT std_id, coalesce(year, TRY_CAST(nullif(regexp_extract(latest_version, ':(\d{{4}})', 1), '') AS INT)) AS year,
         CASE WHEN y > 1900 AND y <= 2030 THEN y END AS year_at_end FROM (SELECT *, TRY_CAST(nullif(regexp_extract(trim(latest_version), ':(\d{{4}})\s*$', 1), '') AS INT) AS y FROM ({_CAT}))""",
)
def p5(spark, sf):
    return view(spark, sf, CATALOGUE).select("std_id", N.year_from_version(F.col("latest_version"), F.col("year")).alias("year"), N.year_at_end(F.col("latest_version")).alias("year_at_end"))


_TIGHT = _collapse("regexp_replace(lower(trim(is_number)), '\\s*([:()])\\s*', '\\1', 'g')")
_FAMILY = _collapse("pre || regexp_replace(substr(low, length(pre) + 1), '(?s)(?:[:(/\\[]|\\bpart\\b|\\bsec\\b).*$', '')")


@query(
    "p6_number_keys",
    f"""SELECT std_id, {_collapse("regexp_replace(is_number, '\\s*:\\s*', ': ', 'g')")} AS spaced, regexp_replace(upper(trim(is_number)), '\\s+', ' ', 'g') AS upper_key, {_TIGHT} AS tight,
        upper(regexp_replace(is_number, '\\s+', '', 'g')) AS solid, {_collapse("regexp_replace(lower(is_number), '[^a-z0-9\\s]', ' ', 'g')")} AS word_key,
        regexp_replace(upper(regexp_extract(is_number, '^([^:(]*)', 1)), '\\s+', '', 'g') AS base, low AS exact, {_FAMILY} AS family,
        trim(regexp_replace(lower(is_number), '[\\s:]+', ' ', 'g')) AS colon_space, regexp_replace(lower(is_number), '[\\s:]+', '', 'g') AS no_colon
        FROM (SELECT *, regexp_extract(low, '^(is(?:/[a-z]+)+)\\s', 1) AS pre FROM (SELECT *, lower(trim(is_number)) AS low FROM ({_CAT})))""",
)
def p6(spark, sf):
    x = F.col("is_number")
    return view(spark, sf, CATALOGUE).select(
        "std_id", N.key_spaced(x).alias("spaced"), N.key_upper(x).alias("upper_key"), N.key_tight(x).alias("tight"), N.key_solid(x).alias("solid"), N.key_words(x).alias("word_key"), N.key_base(x).alias("base"), N.key_exact(x).alias("exact"),
        N.key_family(x).alias("family"), N.key_colon_space(x).alias("colon_space"), N.key_no_colon(x).alias("no_colon"),
    )


@query(
    "p7_parse_designation",
    f"""SELECT std_id, CASE WHEN m.digits <> '' THEN m.publisher || ' ' || m.digits || CASE WHEN inside <> '' THEN ' (' || inside || ')' ELSE '' END ELSE x END AS normalized, CASE WHEN m.digits <> '' THEN m.publisher || ' ' || m.digits END AS number, nullif(m.part, '') AS part, nullif(m.section, '') AS section
        FROM (SELECT std_id, x, m, concat_ws('/', CASE WHEN m.part <> '' THEN 'PART ' || m.part END, CASE WHEN m.section <> '' THEN 'SEC ' || m.section END) AS inside
              FROM (SELECT std_id, x, regexp_extract(x, '{N.DESIGNATION}', ['publisher', 'digits', 'part', 'section']) AS m FROM (SELECT std_id, {_collapse('upper(is_number)')} AS x FROM ({_CAT}))))""",
)
def p7(spark, sf):
    x = F.col("is_number")
    return view(spark, sf, CATALOGUE).select("std_id", N.normalize_designation(x).alias("normalized"), N.parse_designation(x).alias("p")).select("std_id", "normalized", "p.number", "p.part", "p.section")


@query("p8_base_number", f"""SELECT base, count(*) AS n FROM (SELECT {_collapse("regexp_extract(upper(is_number), '(IS(?:/[A-Z]+)?\\s*\\d+)', 1)")} AS base FROM ({_CAT})) GROUP BY base""")
def p8(spark, sf):
    return view(spark, sf, CATALOGUE).groupBy(N.base_number(F.col("is_number")).alias("base")).agg(F.count("*").alias("n"))


@query(
    "p10_number_variants",
    rf"""WITH a AS (SELECT std_id, trim(is_number) AS r, regexp_replace(rtrim(regexp_extract(trim(is_number), '(\d[\d\s:.]+)', 1)), ':+$', '') AS m FROM ({_CAT})),
         b AS (SELECT *, regexp_extract(replace(m, ' ', ''), '^(\d+)', 1) AS g FROM a),
         v AS (SELECT std_id, unnest([r, m, regexp_replace(m, '[\s:]+', '', 'g'), CASE WHEN g <> '' THEN 'IS ' || g ELSE '' END, CASE WHEN g <> '' THEN 'IS' || g ELSE '' END, g, trim(regexp_replace(r, '\s*:\s*', ' ', 'g')), regexp_replace(r, '[\s:]+', '', 'g')]) AS x FROM b)
         SELECT std_id, string_agg(DISTINCT x, '|' ORDER BY x) AS variants FROM v WHERE length(x) >= 2 GROUP BY std_id""",
)
def p10(spark, sf):
    return view(spark, sf, CATALOGUE).select("std_id", F.array_join(N.number_variants(F.col("is_number")), "|").alias("variants"))


_KINDS = [("Testing Method", ["test", "method"]), ("Steel", ["steel"]), ("Brass", ["brass"]), ("Copper", ["copper"])]


@query(
    "p30_parse_dates",
    """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber % 3 = 2 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS DATE) AS parsed, CAST(year(l_shipdate) AS INT) AS year
       FROM lineitem""",
)
def p30(spark, sf):
    from ..sources.storage import table

    day = F.col("l_shipdate")
    spelled = F.when(F.col("l_linenumber") % 3 == 0, F.date_format(day, "dd/MM/yyyy")).when(F.col("l_linenumber") % 3 == 1, F.date_format(day, "yyyy-MM-dd'T'HH")).otherwise(F.lit("not a date"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", N.parse_date(spelled).alias("parsed"), N.parse_year(F.date_format(day, "'on' dd MMM yyyy")).alias("year"))


@query("p31_explicit_status", f"SELECT std_id, CASE WHEN size % 5 = 0 THEN 'withdrawn' WHEN contains(s, 'withdraw') THEN 'withdrawn' WHEN contains(s, 'supersed') THEN 'superseded' WHEN contains(s, 'active') THEN 'active' WHEN size % 5 = 1 THEN 'superseded' ELSE 'unknown' END AS status FROM (SELECT *, lower(coalesce(raw_status, '')) AS s FROM ({_CAT}))")
def p31(spark, sf):
    flag, by = F.when(F.col("size") % 5 == 0, 1), F.when(F.col("size") % 5 == 1, "IS 1")
    return view(spark, sf, CATALOGUE).select("std_id", N.explicit_status(flag, F.col("raw_status"), by).alias("status"))


@query("s3_stable_ids", f"""SELECT std_id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12)) AS uid FROM (SELECT std_id, md5(is_number || ':' || coalesce(CAST(year AS VARCHAR), 'None')) AS h FROM ({_CAT}))""")
def s3(spark, sf):
    return view(spark, sf, CATALOGUE).select("std_id", T.stable_id(F.col("is_number"), F.col("year")).alias("uid"))


_MERGE = f"""WITH s AS (SELECT std_id, is_number, title FROM ({_CAT})), o AS (SELECT * FROM ({_ORD})),
    sk AS (SELECT *, {_TIGHT} AS k FROM s), ok AS (SELECT *, {_TIGHT} AS k FROM o),
    l AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY k ORDER BY order_pos DESC) = 1)"""


@query(
    "j1_merge_orders",
    _MERGE
    + """ SELECT sk.std_id, sk.is_number, sk.title, l.k IS NOT NULL AS qco_notified, l.gazette_so_number AS qco_gazette_so_number, l.issuing_ministry AS qco_issuing_ministry, l.effective_date AS qco_effective_date, l.certification_scheme,
          l.k IS NOT NULL AS is_mandatory, CASE WHEN l.k IS NOT NULL THEN 'Mandatory under QCO Gazette Notification ' || coalesce(l.gazette_so_number, 'N/A') || ' issued by ' || coalesce(l.issuing_ministry, 'Government of India') || '. Effective from ' || coalesce(l.effective_date, 'N/A') || '.' END AS certification_details,
          CASE WHEN l.k IS NOT NULL THEN 'BIS,QCO' ELSE 'BIS' END AS unified_sources, 'unified_v1' AS schema_version FROM sk LEFT JOIN l ON l.k = sk.k""",
)
def j1(spark, sf):
    return C.merge_orders(view(spark, sf, CATALOGUE).select("std_id", "is_number", "title"), view(spark, sf, ORDERS), N.key_tight(F.col("is_number")))


@query("j2_orphan_orders", _MERGE + " SELECT order_pos, is_number FROM ok WHERE k NOT IN (SELECT k FROM sk)")
def j2(spark, sf):
    return C.unmatched(view(spark, sf, ORDERS), view(spark, sf, CATALOGUE), N.key_tight(F.col("is_number"))).select("order_pos", "is_number")


@query("j4_coverage_check", _MERGE + " SELECT std_id, is_number FROM sk WHERE k NOT IN (SELECT k FROM ok)")
def j4(spark, sf):
    return C.unmatched(view(spark, sf, CATALOGUE), view(spark, sf, ORDERS), N.key_tight(F.col("is_number"))).select("std_id", "is_number")


@query(
    "a5_merge_report",
    _MERGE
    + """ SELECT (SELECT count(*) FROM sk) AS total_standards, (SELECT count(*) FROM ok) AS total_orders, m AS matched, (SELECT count(*) FROM sk) - m AS standards_only,
          (SELECT count(DISTINCT k) FROM ok WHERE k NOT IN (SELECT k FROM sk)) AS orphaned_orders, round(100 * m / (SELECT count(*) FROM sk), 1) AS match_rate_pct FROM (SELECT count(*) AS m FROM sk WHERE k IN (SELECT k FROM ok))""",
)
def a5(spark, sf):
    return C.merge_report(view(spark, sf, CATALOGUE), view(spark, sf, ORDERS), N.key_tight(F.col("is_number")))


_SOURCES = ("CASE size % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'generated' WHEN 2 THEN 'curated' ELSE NULL END", "CASE WHEN size % 3 = 0 THEN NULL ELSE concat('covers ', type) END")


@query(
    "j3_reconcile",
    f"""WITH b AS (SELECT *, {_SOURCES[0]} AS scope_source, {_SOURCES[1]} AS scope, {_TIGHT} AS k FROM ({_CAT})),
        f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY k ORDER BY pos) = 1),
        c AS (SELECT k, concat('curated ', brand) AS scope, 'reaffirmed' AS status FROM b WHERE pos % 13 = 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY pos) = 1),
        p AS (SELECT k, price, concat('until ', year) AS valid_upto FROM b WHERE pos % 2 = 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY pos) = 1)
        SELECT f.is_number, f.title, coalesce(c.scope, CASE WHEN f.scope_source IN ('official', 'curated') THEN f.scope END) AS scope, coalesce(c.status, f.raw_status) AS status, p.price, p.valid_upto,
               CASE WHEN c.scope IS NOT NULL OR (f.scope_source IN ('official', 'curated') AND f.scope IS NOT NULL) THEN 'verified' ELSE 'not_available' END AS scope_availability
        FROM f LEFT JOIN c ON c.k = f.k LEFT JOIN p ON p.k = f.k""",
)
def j3(spark, sf):
    base = view(spark, sf, CATALOGUE).withColumns({"scope_source": F.expr(_SOURCES[0]), "scope": F.expr(_SOURCES[1])}).withColumnRenamed("raw_status", "status")
    curated = base.where("pos % 13 = 0").withColumns({"scope": F.concat(F.lit("curated "), "brand"), "status": F.lit("reaffirmed")})
    priced = base.where("pos % 2 = 0").withColumn("valid_upto", F.concat(F.lit("until "), F.coalesce(F.col("year").cast("string"), F.lit(""))))
    return C.reconcile(base, curated, priced, N.key_tight(F.col("is_number")))


@query(
    "j5_curated_merge",
    f"""WITH a AS (SELECT std_id, concat('IS ', std_id) AS n, title, year FROM ({_CAT}) WHERE pos % 5 <> 0), b AS (SELECT std_id, concat('IS ', std_id) AS n, CASE WHEN size % 2 = 0 THEN '' ELSE 'New ' || brand END AS title, CASE WHEN size % 3 = 0 THEN NULL ELSE 2024 END AS year FROM ({_CAT}) WHERE pos % 10 < 3)
        SELECT coalesce(a.n, b.n) AS is_number, coalesce(nullif(b.title, ''), a.title) AS title, coalesce(b.year, a.year) AS year, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'kept' ELSE 'updated' END AS change FROM a FULL OUTER JOIN b ON a.n = b.n""",
)
def j5(spark, sf):
    cat = view(spark, sf, CATALOGUE).withColumn("is_number", F.concat(F.lit("IS "), F.col("std_id").cast("string")))
    curated = cat.where("pos % 10 < 3").withColumns({"title": F.when(F.col("size") % 2 == 0, "").otherwise(F.concat(F.lit("New "), "brand")), "year": F.when(F.col("size") % 3 == 0, F.lit(None).cast("int")).otherwise(2024)})
    return C.curated_merge(cat.where("pos % 5 <> 0"), curated, N.key_tight(F.col("is_number")))


@query(
    "j7_resolve_citation",
    f"""WITH c AS (SELECT std_id, low, {_FAMILY} AS fam FROM (SELECT *, regexp_extract(low, '^(is(?:/[a-z]+)+)\\s', 1) AS pre FROM (SELECT *, lower(trim(is_number)) AS low FROM ({_CAT}) WHERE size % 5 <> 0))),
        q AS (SELECT order_pos AS cite_id, low, {_FAMILY} AS fam FROM (SELECT *, regexp_extract(low, '^(is(?:/[a-z]+)+)\\s', 1) AS pre FROM (SELECT *, lower(trim(is_number)) AS low FROM ({_ORD}) AS o))),
        e AS (SELECT q.cite_id, c.std_id, 'exact' AS how FROM q JOIN c ON c.low = q.low)
        SELECT * FROM e UNION ALL SELECT q.cite_id, c.std_id, 'family' FROM q JOIN c ON c.fam = q.fam WHERE q.cite_id NOT IN (SELECT cite_id FROM e)""",
)
def j7(spark, sf):
    x = F.col("is_number")
    return C.resolve_citations(view(spark, sf, ORDERS).withColumnRenamed("order_pos", "cite_id"), view(spark, sf, CATALOGUE).where("size % 5 <> 0"), N.key_exact(x), N.key_family(x))


@query(
    "a1_link_versions",
    f"""WITH d AS (SELECT std_id, concat('IS ', pos % 700) AS number, year, latest_version FROM ({_CAT})),
        m AS (SELECT *, count(*) OVER (PARTITION BY number) AS n, first_value(year) OVER w AS ly, first_value(latest_version) OVER w AS ld FROM d WINDOW w AS (PARTITION BY number ORDER BY coalesce(year, 0) DESC, latest_version DESC))
        SELECT std_id, number, year, CASE WHEN n > 1 THEN ly END AS latest_year, CASE WHEN n > 1 THEN ld END AS latest_designation FROM m""",
)
def a1(spark, sf):
    rows = view(spark, sf, CATALOGUE).select("std_id", F.concat(F.lit("IS "), (F.col("pos") % 700).cast("string")).alias("number"), "year", "latest_version")
    return C.link_versions(rows, "number", "year", "latest_version").drop("latest_version")


@query(
    "a2_cleaning_report",
    rf"""WITH c AS (SELECT {_TIGHT} AS is_number, title, year, {_STATUS} AS status, nullif(trim(regexp_extract(title, '(?i)\(Vai?ld\s+upto\s+([^)]+)\)', 1)), '') AS v FROM ({_CAT}))
         SELECT count(*) AS total, count(*) FILTER (WHERE title <> '') AS with_title, count(v) AS with_validity, count(year) AS with_year, count(*) FILTER (WHERE status = 'unknown') AS status_unknown,
                (SELECT count(*) FROM (SELECT 1 FROM c GROUP BY is_number HAVING count(*) > 1)) AS duplicate_families FROM c""",
)
def a2(spark, sf):
    rows = view(spark, sf, CATALOGUE).select(N.key_tight(F.col("is_number")).alias("is_number"), "title", "year", N.normalize_status(F.col("raw_status")).alias("status"), N.extract_validity(F.col("title"))[1].alias("valid_upto"))
    return C.cleaning_report(rows)


@query("a6_availability", f"SELECT 'year' AS field, CASE WHEN year IS NULL THEN 'not_available' ELSE 'available' END AS state, count(*) AS n FROM ({_CAT}) GROUP BY ALL UNION ALL SELECT 'raw_status', CASE WHEN raw_status IS NULL THEN 'not_available' ELSE 'available' END, count(*) FROM ({_CAT}) GROUP BY ALL")
def a6(spark, sf):
    return C.availability_counts(view(spark, sf, CATALOGUE), ["year", "raw_status"])


@query("w11_first_seen", f"SELECT std_id, is_number FROM ({_CAT}) QUALIFY row_number() OVER (PARTITION BY {_TIGHT} ORDER BY pos) = 1")
def w11(spark, sf):
    rows = view(spark, sf, CATALOGUE).withColumn("k", N.key_tight(F.col("is_number")))
    return C.first_seen(rows, "k", "pos").select("std_id", "is_number")


@query("s9_upsert", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderkey % 7 AS version FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, 'U', o_totalprice + 1, 9 FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey + 100000000, 'N', o_totalprice, 1 FROM orders WHERE o_orderkey % 9 = 0")
def s9(spark, sf):
    from ..sources.storage import table

    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", (F.col("o_orderkey") % 7).alias("version"))
    fives = rows.where("o_orderkey % 5 = 0")
    changed = fives.withColumns({"o_orderstatus": F.lit("U"), "o_totalprice": F.col("o_totalprice") + 1, "version": F.lit(9).cast("long")}).unionByName(fives.withColumns({"o_orderstatus": F.lit("old"), "version": F.lit(8).cast("long")}))
    added = rows.where("o_orderkey % 9 = 0").withColumns({"o_orderkey": F.col("o_orderkey") + 100000000, "o_orderstatus": F.lit("N"), "version": F.lit(1).cast("long")})
    return C.upsert_rows(rows, changed.unionByName(added), "o_orderkey")


@query("s11_delete", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def s11(spark, sf):
    from ..sources.storage import table

    gone = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return C.delete_by_key(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), gone, "o_orderkey")


@query("s13_missing_from_index", "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def s13(spark, sf):
    from ..sources.storage import table

    index = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return C.missing_from(table(spark, sf, "part").select("p_partkey", "p_name"), index, "p_partkey")


@query("s15_list_page", f"SELECT number, year, std_id FROM (SELECT *, lpad(CAST(std_id AS VARCHAR), 9, '0') AS nr FROM ({_STD})) ORDER BY nr, coalesce(year, 0) LIMIT 40 OFFSET 60")
def s15(spark, sf):
    rows = view(spark, sf, STANDARDS).withColumn("nr", F.lpad(F.col("std_id").cast("string"), 9, "0"))
    return C.list_page(rows, "nr", "year", 60, 40).select("number", "year", "std_id")


@query(
    "p32_amendments",
    """WITH a AS (SELECT l_partkey AS std_id, l_linenumber AS number, 2000 + CAST(l_quantity AS INT) AS year, l_returnflag AS description FROM lineitem WHERE l_linenumber < 4),
       d AS (SELECT DISTINCT std_id, number, year, description FROM a)
       SELECT std_id, count(*) AS n_amendments, string_agg(concat_ws('/', number, year), ',' ORDER BY number, year, description) AS amendments FROM d GROUP BY std_id""",
)
def p32(spark, sf):
    from ..sources.storage import table

    rows = table(spark, sf, "lineitem").where("l_linenumber < 4").select(F.col("l_partkey").alias("std_id"), F.col("l_linenumber").alias("number"), (2000 + F.col("l_quantity").cast("int")).alias("year"), F.col("l_returnflag").alias("description"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return C.normalize_amendments(rows, "std_id")


@query(
    "w12_latest_edition",
    """WITH c AS (SELECT p_partkey % 300 AS family, concat('IS ', p_partkey % 300, ':', 1975 + p_size) AS designation, CASE WHEN p_size % 8 = 0 THEN NULL ELSE p_size END AS published FROM part),
       w AS (SELECT DISTINCT l_partkey % 300 AS family, concat('IS ', l_partkey % 300, ':', 1975 + l_linenumber) AS wanted FROM lineitem)
       SELECT wanted, designation, published FROM w JOIN c ON c.family = w.family QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY CASE WHEN designation = wanted THEN 0 ELSE 1 END, published DESC NULLS LAST, designation) = 1""",
)
def w12(spark, sf):
    from ..sources.storage import table

    family = F.col("p_partkey") % 300
    cat = table(spark, sf, "part").select(family.alias("family"), F.concat(F.lit("IS "), family.cast("string"), F.lit(":"), (1975 + F.col("p_size")).cast("string")).alias("designation"), F.when(F.col("p_size") % 8 != 0, F.col("p_size")).alias("published"))
    fam = F.col("l_partkey") % 300
    wanted = table(spark, sf, "lineitem").select(fam.alias("family"), F.concat(F.lit("IS "), fam.cast("string"), F.lit(":"), (1975 + F.col("l_linenumber")).cast("string")).alias("wanted")).distinct()
    return C.latest_edition(wanted, cat)
