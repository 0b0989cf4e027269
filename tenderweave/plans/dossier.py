"""Queries of findings in full."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dossier as D
from ..operators.rules import SEVERITY
from .base import _pick, plain, view
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()

_VERDICTS = ["justified", "outdated_reference", "wrong_scope", "ambiguous", "nonsense", "incorrect_standard", "missing_requirement"]
#: Orders propose the parts of their lines, in falling number of line, with evidence that may not exist.
SAID = f"""
    SELECT o_orderkey AS req_id, {_pick('(o_custkey + o_orderkey)', _VERDICTS)} AS verdict, CAST(o_custkey % 10 AS DOUBLE) / 10 AS confidence, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 10 AS DOUBLE) / 10 END AS raw_confidence,
           CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('Seen in ', o_orderpriority, '.') END AS reason, o_custkey AS first_proof FROM {{orders}}"""
NAMED = "SELECT l_orderkey AS req_id, l_partkey AS std_id, min(8 - l_linenumber) AS place FROM {lineitem} GROUP BY l_orderkey, l_partkey"
CHECKS = f"""
    SELECT n.req_id, n.std_id, concat('IS ', n.std_id) AS designation, {_pick('(n.std_id + n.req_id)', ['justified', 'outdated_reference', 'wrong_scope', 'ambiguous', 'incorrect_standard', 'justified', 'justified'])} AS verdict,
           0.5 + CAST(n.std_id % 5 AS DOUBLE) / 10 AS confidence, CASE p_size % 6 WHEN 0 THEN 'withdrawn' WHEN 1 THEN 'superseded' ELSE 'active' END AS status, CASE WHEN p_size % 12 = 1 THEN concat('IS ', p_partkey + 1) END AS superseded_by,
           CASE WHEN n.req_id % 5 = 0 THEN NULL ELSE CAST(1990 + n.req_id % 7 AS INT) END AS cited_year, CASE WHEN p_size % 9 = 0 THEN NULL ELSE CAST(1990 + p_size % 7 AS INT) END AS current_year,
           CASE WHEN n.std_id % 4 = 0 THEN NULL ELSE n.std_id % 5 = 0 END AS mismatch, n.std_id % 11 = 0 AS notified, CASE WHEN n.std_id % 11 = 0 THEN 'crs' END AS scheme, CASE WHEN n.std_id % 11 = 0 THEN concat('Ministry ', n.std_id % 3) END AS ministry,
           CASE WHEN n.std_id % 22 = 0 THEN concat('S.O. ', n.std_id) END AS so_number, CASE WHEN n.std_id % 7 = 0 THEN concat('IS ', n.std_id % 3, ',IS ', n.std_id % 4) ELSE '' END AS needs
    FROM ({NAMED}) n JOIN {{part}} ON p_partkey = n.std_id WHERE n.std_id % 13 > 0"""
PROOFS = "SELECT p_partkey AS evidence_id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_partkey - p_size % 2 END AS std_id FROM {part}"

_RANK = "list_position([" + ", ".join(f"'{v}'" for v in SEVERITY) + "], {0})"
_CUR = ", ".join(f"'{v}'" for v in D.CURRENTNESS)
_AXIS = "CASE WHEN {0} IN (" + _CUR + ") THEN 'currentness' ELSE 'applicability' END"
_LABEL = """CASE WHEN {0}verdict IS NULL AND {0}status IS NULL THEN 'unknown' WHEN {0}status IN ('withdrawn', 'superseded') THEN {0}status WHEN {0}cited_year IS NULL THEN 'year_omitted' WHEN {0}current_year IS NULL THEN 'unverifiable'
    WHEN {0}current_year < {0}cited_year THEN 'ahead_of_catalogue' WHEN {0}current_year = {0}cited_year THEN 'current' ELSE 'outdated' END"""
_ACTIONS = "CASE verdict " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.ACTIONS.items()) + f" ELSE '{D.LOOK}' END"


@query(
    "r11_finding_details",
    f"""WITH p AS (SELECT *, coalesce(coalesce(raw_confidence, confidence) < 0.2, false) AS weak FROM ({plain(SAID)})),
       s AS (SELECT req_id, weak, confidence AS sure, first_proof, CASE WHEN weak THEN 'No standard of the catalogue fits this requirement.' ELSE coalesce(reason, '') END AS why,
                    CASE WHEN weak THEN 'unsupported' WHEN {_RANK.format('verdict')} > 0 THEN verdict ELSE 'unable_to_determine' END AS said FROM p),
       k AS (SELECT n.req_id, n.std_id, n.place, c.* EXCLUDE (req_id, std_id), {_RANK.format('c.verdict')} AS rank, coalesce(c.mismatch, false) AS off
             FROM ({plain(NAMED)}) n JOIN s ON s.req_id = n.req_id AND NOT weak LEFT JOIN ({plain(CHECKS)}) c ON c.req_id = n.req_id AND c.std_id = n.std_id WHERE n.std_id % 6 > 0),
       w AS (SELECT * FROM k WHERE verdict IS NOT NULL QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY rank, place, std_id) = 1),
       m AS (SELECT s.*, w.rank AS theirs, w.verdict AS wv, w.confidence AS wc, w.status, w.cited_year, w.current_year, w.verdict AS verdict_w, CASE WHEN w.off AND w.verdict <> 'wrong_scope' THEN w.std_id END AS moved,
                    CASE WHEN w.rank IS NULL THEN 'proposal_only' WHEN w.rank < {_RANK.format('said')} THEN 'check_override' WHEN w.rank > {_RANK.format('said')} THEN 'proposal_primary' ELSE 'agree' END AS resolution FROM s LEFT JOIN w ON w.req_id = s.req_id),
       v AS (SELECT *, CASE WHEN resolution = 'check_override' THEN wv ELSE said END AS verdict, CASE resolution WHEN 'check_override' THEN wc WHEN 'agree' THEN (sure + wc) / 2 ELSE sure END AS confidence FROM m),
       x AS (SELECT k.*, NOT k.off OR coalesce(k.std_id = v.moved, false) AS fits, coalesce(k.std_id = v.moved, false) AS late FROM k JOIN v ON v.req_id = k.req_id),
       pr AS (SELECT std_id, list(evidence_id ORDER BY evidence_id) AS proofs FROM ({plain(PROOFS)}) WHERE std_id IS NOT NULL GROUP BY std_id),
       xe AS (SELECT x.req_id, flatten(list(proofs ORDER BY place, x.std_id) FILTER (WHERE x.verdict IS NOT NULL AND proofs IS NOT NULL)) AS proofs FROM x LEFT JOIN pr ON pr.std_id = x.std_id GROUP BY x.req_id),
       un AS (SELECT req_id, string_agg(DISTINCT u, ', ' ORDER BY u) AS unmet FROM (SELECT req_id, unnest(string_split(needs, ',')) AS u FROM x WHERE needs <> '') GROUP BY req_id),
       g AS (SELECT req_id, string_agg(std_id, ',' ORDER BY late, place, std_id) FILTER (WHERE fits) AS applicable, string_agg(std_id, ',' ORDER BY place, std_id) FILTER (WHERE NOT fits) AS cited, bool_or(coalesce(notified, false)) AS any_order,
                    arg_min(superseded_by, place * 10000000 + std_id) FILTER (WHERE superseded_by IS NOT NULL) AS newer,
                    string_agg(std_id || ':' || {_LABEL.format('')} || ':' || coalesce(CASE WHEN status IN ('withdrawn', 'superseded') AND superseded_by IS NOT NULL THEN 'Cite ' || superseded_by || ' instead.'
                        WHEN status IN ('withdrawn', 'superseded') THEN 'It can''t be used: find its replacement.' WHEN cited_year IS NULL THEN 'Give the year of the edition.' WHEN current_year IS NULL OR current_year <> cited_year THEN 'Give the current year.'
                        WHEN mismatch THEN 'Check whether it covers this product.' ELSE 'No issue found.' END, ''), ';' ORDER BY late, place, std_id) FILTER (WHERE fits AND verdict IS NOT NULL) AS notes FROM x GROUP BY req_id),
       o AS (SELECT req_id, notified, ministry, so_number FROM x WHERE fits AND verdict IS NOT NULL QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY NOT coalesce(notified, false), late, place, std_id) = 1),
       sc AS (SELECT req_id, mismatch, designation FROM x WHERE mismatch IS NOT NULL QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY NOT mismatch, place, std_id) = 1),
       e AS (SELECT v.req_id, list_concat(CASE WHEN v.first_proof IN (SELECT evidence_id FROM ({plain(PROOFS)})) THEN [v.first_proof] ELSE [] END, coalesce(xe.proofs, [])) AS l FROM v LEFT JOIN xe ON xe.req_id = v.req_id)
       SELECT v.req_id, verdict, round(confidence, 6) AS confidence, resolution, coalesce(applicable, '') AS applicable, coalesce(cited, '') AS cited,
              array_to_string(list_filter(e.l, lambda y, i: list_position(e.l, y) = i), ',') AS evidence, coalesce(unmet, '') AS unmet, {_LABEL.format('v.').replace('v.verdict IS NULL', 'v.wv IS NULL')} AS label,
              CASE WHEN wv IN ({_CUR}) THEN wv END AS current_verdict, sc.mismatch AS scope_mismatch, sc.designation AS scope_of, coalesce(o.notified, false) AS notified, o.ministry, o.so_number, {_AXIS.format('verdict')} AS axis,
              CASE WHEN resolution = 'check_override' AND {_AXIS.format('said')} <> {_AXIS.format('verdict')} THEN 'The proposal''s ' || said || ' holds beside it.' END AS note,
              trim(why || coalesce(' It depends on ' || unmet || ', which the tender does not name.', '')) AS reason,
              CASE WHEN verdict = 'outdated_reference' AND newer IS NOT NULL THEN 'Cite ' || newer || ' instead.' ELSE {_ACTIONS} END || CASE WHEN coalesce(any_order, false) AND verdict IN ('justified', 'missing_requirement') THEN '{D.MANDATORY}' ELSE '' END
              || coalesce(' Name ' || unmet || ' too, or say why not.', '') AS action, coalesce(notes, '') AS notes, verdict = 'requires_human_verification' OR confidence < 0.6 OR coalesce(any_order, false) AS review
       FROM v LEFT JOIN g ON g.req_id = v.req_id LEFT JOIN un ON un.req_id = v.req_id LEFT JOIN o ON o.req_id = v.req_id LEFT JOIN sc ON sc.req_id = v.req_id LEFT JOIN e ON e.req_id = v.req_id""",
)
def r11_details(spark, sf):
    into = D.partitions(view(spark, sf, CHECKS))
    named = view(spark, sf, NAMED, {"lineitem": "l_orderkey"}, into)
    lists = named.groupBy("req_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "std_id"))), lambda x: x["std_id"]).alias("std_ids"))
    said = view(spark, sf, SAID).withColumn("evidence_ids", F.array("first_proof")).join(lists, "req_id", "left")
    checks = view(spark, sf, CHECKS, {"lineitem": "l_partkey"}, into).withColumn("unmet", F.filter(F.split("needs", ","), lambda x: x != ""))
    found = D.finding_details(said, named.where("std_id % 6 > 0"), checks, view(spark, sf, PROOFS))
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    d = F.col("dimensions")
    notes = F.transform(F.filter("notes", lambda n: n["usable"].isNotNull()), lambda n: F.concat_ws(":", n["std_id"].cast("string"), n["currentness"], n["action"]))
    return found.select(
        "req_id", "verdict", F.round("confidence", 6).alias("confidence"), "resolution", listed("applicable").alias("applicable"), listed("cited").alias("cited"), listed("evidence").alias("evidence"), F.array_join("unmet", ", ").alias("unmet"),
        d["currentness"]["label"].alias("label"), d["currentness"]["verdict"].alias("current_verdict"), d["scope"]["mismatch"].alias("scope_mismatch"), d["scope"]["designation"].alias("scope_of"), d["certification"]["notified"].alias("notified"),
        d["certification"]["ministry"].alias("ministry"), d["certification"]["so_number"].alias("so_number"), d["headline"]["axis"].alias("axis"), d["headline"]["note"].alias("note"), "reason", "action", F.array_join(notes, ";").alias("notes"), "review",
    )
