"""Queries of whole merged records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import merging as M
from .base import CATALOGUE, ORDERS, plain, view
from .catalogue import _TIGHT
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()

#: Orders with all that they may say, and standards with what they say of certification themselves.
FULL = f"""
    SELECT order_pos, is_number, gazette_so_number, issuing_ministry, effective_date, certification_scheme, CASE WHEN order_pos % 4 = 0 THEN NULL ELSE concat('2019-12-', 10 + order_pos % 20) END AS publication_date,
           concat('Order ', order_pos) AS notification_title, CASE WHEN order_pos % 3 = 1 THEN concat('No sale without mark, clause ', order_pos % 7) END AS mandate_text, concat('goods ', order_pos % 5, ',parts') AS products,
           CASE WHEN order_pos % 6 = 0 THEN 'exports' END AS exemptions, concat('https://orders.example.org/', order_pos) AS source_url FROM ({ORDERS})"""
STATED = f"SELECT std_id, is_number, title, CASE WHEN size % 3 = 0 THEN NULL ELSE size % 3 = 1 END AS applicable, CASE WHEN size % 4 = 0 THEN concat('own note ', size) END AS details FROM ({CATALOGUE})"

_MERGE = f"""WITH sk AS (SELECT *, {_TIGHT} AS k FROM ({plain(STATED)})), ok AS (SELECT *, {_TIGHT} AS k FROM ({plain(FULL)})),
    l AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY k ORDER BY order_pos DESC) = 1)"""
_DETAILS = "'Mandatory under QCO Gazette Notification ' || coalesce(l.gazette_so_number, 'N/A') || ' issued by ' || coalesce(l.issuing_ministry, 'Government of India') || '. Effective from ' || coalesce(l.effective_date, 'N/A') || '.'"


@query(
    "j1_merged_records",
    _MERGE
    + f""" SELECT sk.std_id, sk.is_number, l.k IS NOT NULL AS qco_notified, l.gazette_so_number AS qco_gazette_so_number, l.issuing_ministry AS qco_issuing_ministry, l.effective_date AS qco_effective_date, l.publication_date AS qco_publication_date,
       l.notification_title AS qco_notification_title, l.mandate_text AS qco_mandate_text, l.products AS qco_products_covered, l.exemptions AS qco_exemptions, l.source_url AS qco_source_url, l.certification_scheme, l.k IS NOT NULL AS is_mandatory,
       l.k IS NOT NULL AS qco_enriched, CASE WHEN l.k IS NOT NULL THEN true ELSE applicable END AS applicable, CASE WHEN l.k IS NOT NULL THEN true WHEN applicable IS NULL THEN false END AS mandatory,
       CASE WHEN l.k IS NOT NULL THEN {_DETAILS} ELSE details END AS details, CASE WHEN l.k IS NOT NULL THEN 'BIS+QCO' ELSE 'BIS' END AS unified_sources FROM sk LEFT JOIN l ON l.k = sk.k""",
)
def j1(spark, sf):
    standards = view(spark, sf, STATED).select("std_id", "is_number", F.struct("applicable", "details").alias("certification_requirements"))
    orders = view(spark, sf, FULL).withColumn("products_covered", F.split("products", ","))
    out = M.merged_records(standards, orders, N.key_tight(F.col("is_number")))
    block = F.col("certification_requirements")
    return out.select(
        "*", block["applicable"].alias("applicable"), block["mandatory"].alias("mandatory"), block["details"].alias("details")
    ).drop("certification_requirements", "schema_version").withColumns({"qco_products_covered": F.array_join("qco_products_covered", ","), "unified_sources": F.array_join("unified_sources", "+")})


@query(
    "a5_merge_lists",
    _MERGE
    + """ SELECT CASE WHEN l.k IS NULL THEN 'bis_only' ELSE 'matched' END AS kind, sk.is_number FROM sk LEFT JOIN l ON l.k = sk.k UNION ALL SELECT 'orphaned', is_number FROM l WHERE k NOT IN (SELECT k FROM sk)""",
)
def a5(spark, sf):
    return M.merge_lists(view(spark, sf, STATED), view(spark, sf, FULL), N.key_tight(F.col("is_number")))
