"""Views that the queries share, derived from the given tables.

Their SQL runs in Spark and in an ANSI engine alike, so both sides of a comparison start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.storage import table

#: A raw standards catalogue over part: spellings of numbers vary, some numbers repeat.
CATALOGUE = """
    SELECT p_partkey AS pos, p_partkey AS std_id,
           CASE p_partkey % 4 WHEN 0 THEN concat('IS ', p_partkey % 700) WHEN 1 THEN concat('is  ', p_partkey % 700, ' : Part ', p_size % 5 + 1)
                WHEN 2 THEN concat(' IS ', p_partkey % 700, ' :Part ', p_size % 5 + 1, ' : Sec ', p_size % 3 + 1) ELSE concat('IS/IEC ', p_partkey % 700, ' (Part ', p_size % 5 + 1, ')') END AS is_number,
           concat(p_name, ' &amp;  ', p_type, CASE WHEN p_size % 7 = 0 THEN ' (Valid upto 31 Dec 2024)' WHEN p_size % 7 = 1 THEN ' (Vaild  upto 1 Jan 2020) ' WHEN p_size % 7 = 2 THEN ' ( Second Revision )'
                WHEN p_size % 7 = 3 THEN ' Print price : 1,230.00 INR and more' WHEN p_size % 7 = 4 THEN ' (Reaffirmed 2016)' ELSE '' END) AS title,
           CASE WHEN p_size % 6 = 0 THEN NULL ELSE 1975 + p_size END AS year,
           concat('IS ', p_partkey % 700, ':', 1975 + p_size) AS latest_version,
           CASE p_partkey % 7 WHEN 0 THEN 'Active' WHEN 1 THEN ' superseded' WHEN 2 THEN 'Withdrawn' WHEN 3 THEN 'under revision' WHEN 4 THEN 'Reaffirmed' WHEN 5 THEN 'draft' ELSE NULL END AS raw_status,
           p_brand AS brand, p_type AS type, p_size AS size, p_retailprice AS price
    FROM {part}"""

#: Orders over supplier and nation: each names a number of the catalogue or one beyond it.
ORDERS = """
    SELECT s_suppkey AS order_pos, concat('IS ', CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE '' END, s_suppkey * 7 % 900) AS is_number,
           CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE concat('SO ', s_suppkey) END AS gazette_so_number, n_name AS issuing_ministry,
           concat('2020-01-', 10 + s_suppkey % 18) AS effective_date, CASE s_suppkey % 3 WHEN 0 THEN 'isi_mark' WHEN 1 THEN 'crs' ELSE NULL END AS certification_scheme
    FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"""

#: Requirements over lineitem: each cites a standard, most with a year.
REQUIREMENTS = """
    SELECT l_orderkey AS analysis_id, l_orderkey * 10 + l_linenumber AS req_id, l_partkey AS std_id, l_linenumber AS pos,
           CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE 1975 + CAST(l_quantity AS INT) END AS cited_year, l_discount AS discount, l_returnflag AS flag
    FROM {lineitem}"""

#: Standards with a normal status, deadline and order flags, over part.
STANDARDS = """
    SELECT p_partkey AS std_id, CASE p_partkey % 7 WHEN 0 THEN 'active' WHEN 1 THEN 'superseded' WHEN 2 THEN 'withdrawn' WHEN 3 THEN 'under_revision' WHEN 4 THEN 'reaffirmed' WHEN 5 THEN 'unknown' ELSE 'active' END AS status,
           CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN DATE '2024-06-30' ELSE DATE '2022-01-31' END AS deadline,
           CASE WHEN p_size % 9 = 0 THEN NULL ELSE 1975 + p_size END AS year, p_size % 4 = 0 AS mandatory, CASE p_size % 3 WHEN 0 THEN 'isi_mark' WHEN 1 THEN 'crs' ELSE NULL END AS scheme,
           p_size % 10 = 0 AS mismatch, CASE WHEN p_partkey % 7 = 1 THEN concat('IS ', p_partkey + 1) ELSE NULL END AS superseded_by, p_size % 4 AS n_amendments, p_size % 2 = 0 AS verified,
           concat('IS ', p_partkey) AS number, p_name AS title
    FROM {part}"""

#: Fetches of pages over events: URLs come back, contents change now and then.
FETCHES = """
    SELECT concat('https://host', user_id % 50, '.example.org/', user_id) AS url, CASE WHEN event_id % 17 = 0 THEN '' ELSE concat('h', (user_id * 31 + CAST(floor(value / 40) AS BIGINT)) % 2000) END AS hash,
           ts, event_id AS seq, event_type <> 'error' AS ok, CASE WHEN event_id % 3 = 0 THEN concat('e', event_id) ELSE NULL END AS etag, event_type AS status
    FROM {events}"""


def _pick(key: str, texts: list[str]) -> str:
    """SQL: one of the texts by key."""
    return f"CASE {key} % {len(texts)} " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(texts[:-1])) + f" ELSE '{texts[-1]}' END"


_TITLES = [
    "LED street light luminaire for road lighting", "PVC insulated cable for fixed wiring : Part 2", "Power transformer, oil immersed - Section 4 Losses", "Squirrel cage motor efficiency, method of measurement", "Switchgear and controlgear assemblies - Part 1 General",
    "Household refrigerator safety requirements", "Code of practice for electrical wiring", "Solar PV module design and performance", "Medical electrical equipment for hospital use, safety standard", "Submersible pump installation guide", "Cement and concrete for industrial plant.",
    "Steel fasteners, vocabulary", "Graphical symbols for railway traction", "Lithium-ion battery energy storage : Part 3 Testing of cells", "Watt-hour meter accuracy test", "Coal mine fans", "Paint for ship hulls", "Cotton fabric, determination of strength", "Fire extinguisher maintenance",
    "Drinking water", "Office furniture specification", "Wooden toys", "Cross Linked Polyethylene (XLPE) insulated, PVC sheathed cable for highways", "Glossary of terms and definitions", "Zinc coated wire", "Rubber lined pipe",
]

#: Standards over part with spoken titles, parts, sections and scopes of several shapes.
TITLES = f"""
    SELECT p_partkey AS std_id, concat({_pick('p_partkey', _TITLES)}, CASE WHEN p_size % 5 = 0 THEN concat(' (', p_name, ')') ELSE '' END) AS title,
           CASE p_partkey % 6 WHEN 0 THEN 'IS 732' WHEN 1 THEN 'IS 15885' WHEN 2 THEN concat('IS ', p_partkey % 700, ' : Part ', p_size % 3 + 1) ELSE concat('IS ', p_partkey % 700) END AS is_number,
           CASE WHEN p_size % 3 = 0 THEN NULL ELSE concat('Part ', p_size % 3 + 1) END AS part, CASE WHEN p_size % 6 = 1 THEN concat('Sec ', p_size % 4 + 1) ELSE NULL END AS section,
           CASE WHEN p_size % 7 = 0 THEN NULL ELSE 1975 + p_size END AS year, p_size % 4 AS n_amendments, CASE WHEN p_partkey % 5 = 0 THEN concat('IS ', p_partkey % 90) ELSE '' END AS reference,
           CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat(chr(123), '"value": "Covers ', p_type, '", "source_type": "official", "verified": true', chr(125)) WHEN 3 THEN concat(chr(123), '"value": "Made up", "source_type": "synthetic", "verified": false', chr(125)) ELSE concat('Covers ', p_type) END AS scope,
           CASE WHEN p_size % 8 = 0 THEN NULL ELSE concat('On ', p_type) END AS summary, CASE p_size % 3 WHEN 0 THEN 'BIS Curated' WHEN 1 THEN 'BIS' ELSE 'Portal' END AS source, CASE WHEN p_size % 9 = 0 THEN NULL WHEN p_size % 9 < 5 THEN 'active' ELSE 'withdrawn' END AS status,
           CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 5 < 3 END AS mandatory, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN true ELSE p_size % 2 = 0 END AS verified, CASE WHEN p_size % 3 = 0 THEN ' ISI Mark ' ELSE '' END AS scheme
    FROM {{part}}"""

_LINES = [
    "The luminaire shall conform to IS 10322 : Part 5 : 2012 with IP66 protection", "Bidder must hold a valid BIS certification and ISI mark", "Type test reports shall be furnished", "Luminous efficacy of at least 110 lm/W", "Body of die cast aluminium", "Delivery within thirty days",
    "Installation, fixing and testing at site", "The OEM shall have three years of experience", "XLPE insulated cable as per IS 7098 : Part 1", "PVC insulated and galvanised armoured cable to IS 694", "Earthing as per good practice", "Payment terms apply", "see IS 732", "A CRI over 80 and 3.5 core cable",
]

#: Lines of tenders over lineitem.
TENDER_LINES = f"""
    SELECT l_orderkey AS tender_id, l_orderkey * 10 + l_linenumber AS line_id, l_linenumber AS pos, l_partkey AS std_id, {_pick('(l_orderkey + l_partkey)', _LINES)} AS text, CASE WHEN l_partkey % 9 = 0 THEN concat('IS ', l_partkey) ELSE NULL END AS reference
    FROM {{lineitem}}"""

#: Whole tender texts over orders: page marks, headings, numbered, lettered and bulleted lists, plain paragraphs.
TENDERS = f"""
    SELECT o_orderkey AS doc_id, concat('--- PAGE ', o_orderkey % 9 + 1, ' ---', chr(10), chr(10), {_pick('o_orderkey', ['TECHNICAL REQUIREMENTS', '2. SCOPE OF WORK', 'ELIGIBILITY (GENERAL)', 'Introduction'])}, chr(10), chr(10),
           {_pick('o_orderkey', ['1. ', 'a) ', '- ', '4.1 '])}, {_pick('o_custkey', _LINES)}, ';', chr(10), 'as amended by Amd. 2 of the Govt. rules.', chr(10), {_pick('o_orderkey', ['2. ', 'b) ', '- ', '4.2 '])}, {_pick('(o_custkey + 3)', _LINES)}, '.', chr(10), {_pick('o_orderkey', ['3. ', 'd) ', '* ', 'Note that '])}, {_pick('(o_custkey + 5)', _LINES)},
           chr(10), chr(10), 'Sl. No.', chr(10), chr(10), {_pick('(o_custkey + 7)', _LINES)}, '. It weighs 1.1 kg! ', {_pick('(o_custkey + 9)', _LINES)}, chr(10), chr(10), '.......', chr(10), chr(10), 'page 3 of 9', CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat(chr(10), chr(10), {_pick('(o_custkey + 11)', _LINES)}) END) AS text
    FROM {{orders}}"""


#: Pages of notices over orders and customer: catalogue pages, drafts, tenders, orders, and others.
NOTICES = f"""
    SELECT o_orderkey AS doc_id, {_pick('o_orderkey', ['bis', 'draft', 'tender', 'order', 'other'])} AS kind,
           CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat({_pick('o_custkey', ['Standards list', 'Tender Ref: NH/', 'Order on cables ', 'CG-DL-E-01012024-'])}, o_custkey) END AS title, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE c_name END AS author,
           CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE concat({_pick('o_custkey', ['ETD 20 ', 'CPWD notice. ', 'The Railways and MES. ', 'Ministry of Steel order. ', 'Plain. '])}, {_pick('o_orderkey', ['Tender ID: ', 'Tender Notice No - ', 'DOC: MED/', 'S.O. '])}, o_custkey, {_pick('o_custkey', [' (E)', ' ', '/24 ', '. '])}, chr(10),
               {_pick('(o_orderkey + o_custkey)', _LINES)}, chr(10), 'See is ', o_custkey % 400 + 10, ' : Part ', o_orderkey % 4 + 1, ' : ', 1990 + o_orderkey % 30, ' and IS ', o_orderkey % 90 + 10, ' of ', o_orderdate, chr(10), 'IS ', o_custkey % 400 + 10, chr(10), {_pick('(o_orderkey + 3)', _LINES)}, '.', chr(10),
               {_pick('o_custkey', ['Closing Date: 2024-03-05', 'Submission date - 12th March 2024', 'Due Date 3 May 2025', 'From 1st Apr 2023'])}, chr(10), {_pick('o_orderkey', ['CG-DL-E-02022023-5', 'nothing more', 'IS 732 of 2019, code of practice for the electrical wiring of installations in homes and offices, with the parts that follow it below'])}) END AS text
    FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey"""


def view(spark: SparkSession, sf_dir: str, text: str, deal: dict[str, str] | None = None, into: int | None = None) -> DataFrame:
    """The view's rows. deal names a table and its key: its rows are dealt by that key before any text is made of them, into as
    many partitions as shuffles have or as said, so a small file that gives long texts is not one task's work, and what groups by
    the key later moves no text."""
    names = [t for t in ("part", "supplier", "nation", "lineitem", "events", "orders", "customer", "documents", "pages", "benchmark", "embeddings", "labels", "conversations") if "{" + t + "}" in text]
    tables = {t: table(spark, sf_dir, t) for t in names}
    for t, key in (deal or {}).items():
        tables[t] = tables[t].repartition(into or int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    return spark.sql(text, **tables)


def plain(text: str) -> str:
    """The same SQL over tables by name."""
    return text.replace("{", "").replace("}", "")
