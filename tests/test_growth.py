"""Jobs whose work must grow with their input, and no faster: how their rows are dealt out and what their plans hold."""

import math
import random
import re

from pyspark.sql import functions as F

from tenderweave.functions import vocabulary as V
from tenderweave.operators import clauses as C
from tenderweave.operators import corpus as X
from tenderweave.operators import dom as D
from tenderweave.operators import notices as N
from tenderweave.operators import profile as P
from tenderweave.operators import retrieval as R
from tenderweave.operators import scope as S2
from tenderweave.operators import search as S
from tenderweave.operators import selection as A
from tenderweave.operators.catalogue import latest_edition
from tenderweave.operators.retrieval import ranked
from tenderweave.plans import clauses, evaluation, findings, notices, pages, profile
from tenderweave.plans.base import view


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tenders_of_one_file_are_many_tasks_and_their_text_is_not_moved(spark, sf_dir):
    dealt = view(spark, sf_dir, profile.PROFILES, profile._DEALT)
    assert dealt.rdd.getNumPartitions() == 4  # one file of one block is one task without it
    moved = P.tender_profile(dealt)._jdf.queryExecution().executedPlan().toString()
    assert moved.count("Exchange hashpartitioning") == 2, "only keys of orders, for each side of the join"


def test_counts_in_front_of_a_product(spark):
    texts = ["Supply of 12 nos. of the brass valves at site", "Supply of 3.5", "Supply of the"]
    rows = P.tender_profile(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.product for r in rows] == ["brass valves", P.NOT_STATED, P.NOT_STATED]


def test_records_walk_a_page_once(spark):
    html = "<table><tr><th>A b!<th>A b<th></tr><tr><td>1<td><a href=x>2</a><td>3<td>4</tr></table><table><tr><td>only heads</table>"
    rows = D.table_records(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string"))
    assert plan_of(rows).count("MapInArrow") == 1 and "Join" not in plan_of(rows)
    assert [(r.page_id, r.table, r.row, r.record) for r in rows.collect()] == [(1, 0, 1, {"a_b": "2", "a_b_link": "x", "col_2": "3", "col_3": "4"})]


def test_pages_of_one_file_are_many_tasks(spark, sf_dir):
    assert view(spark, sf_dir, pages.TENDER_PAGES, pages._DEALT).rdd.getNumPartitions() == 4


def test_orders_of_a_profile_are_found_once_and_their_pairs_are_not_shuffled(spark):
    rng = random.Random(3)
    words = ["a", "b", "c", "d"]
    profiles = [(p, w) for p in range(12) for w in words if rng.random() < 0.5]
    phrases = [(o, f, w) for o in range(30) for f in ("x", "y")[: rng.randrange(3)] for w in rng.sample(words, rng.randrange(1, 3))] + [(50, "x", "a"), (50, "x", None)]
    numbers = [(p, rng.randrange(40)) for p in range(12) for _ in range(4)]
    frame = spark.createDataFrame
    found = A.order_applicability(frame(profiles, "profile_id long, token string"), frame(numbers, "profile_id long, key long"), frame([(o, o) for o in range(30)], "order_id long, key long"), frame(phrases, "order_id long, phrase string, token string"))
    has = {p: {w for q, w in profiles if q == p} for p in range(12)}
    needs = {}
    for o, f, w in phrases:
        needs.setdefault((o, f), set()).add(w)
    by_phrase = {(p, o) for p in has for (o, _), ws in needs.items() if ws <= has[p]}
    by_number = {(p, k) for p, k in numbers if k < 30}
    want = {(p, o, "number+phrase" if (p, o) in by_phrase & by_number else "number" if (p, o) in by_number else "phrase") for p, o in by_phrase | by_number}
    got = [(r.profile_id, r.order_id, r.reasons) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "FullOuter" not in plan_of(found)


def test_best_hits_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["is", "steel", "pipe", "x1", "x2", "x3", "IS", "wire", "!"]) for _ in range(rng.randrange(n)))
    queries = spark.createDataFrame([(q, text(6)) for q in range(40)] + [(90, None), (91, "")], "query_id long, query_text string")
    rows = spark.createDataFrame([(s, f"IS {s % 9}" if s % 5 else None, f"x{s}", text(5)) for s in range(60)], "std_id long, number string, designation string, title string")
    fields, exact = {"number": "number", "title": "title"}, ["number", "designation"]
    want = ranked(S.search(queries, rows, fields, exact), [F.desc("score"), F.asc("std_id")], 3).collect()
    as_set = lambda found: {(r.query_id, r.std_id, r.score, r["rank"], tuple(r.matched)) for r in found}
    for rare in (0, 5, 1000):
        got = S.search_best(queries, rows, fields, exact, 3, rare=rare).collect()
        assert as_set(got) == as_set(want) and len(got) == len(want) > 60


def test_spans_are_dealt_before_their_text_is_made(spark, sf_dir):
    for name in ("x6_requirement_spans", "x11_requirements"):
        plan = clauses.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_small_files_are_dealt_before_their_text_is_made(spark, sf_dir):
    for module, name in ((pages, "p12_categories_of_rules"), (findings, "m7_labelled_examples"), (notices, "x13_catalogue_standards")):
        assert "REPARTITION_BY_NUM" in executed(module.QUERIES[name](spark, sf_dir)), name


def test_lines_of_a_page_are_met_where_they_lie(spark):
    rows = N.catalogue_standards(spark.createDataFrame([(1, "IS 732 : 1999\nCode of practice\nend"), (2, None)], "doc_id long, text string"))
    assert "lead(" not in plan_of(rows)
    assert [(r.doc_id, r.title) for r in rows.collect()] == [(1, "IS 732 : 1999 - Code of practice")]


def test_pairs_of_queries_and_rows_are_not_moved(spark):
    queries = spark.sql("SELECT * FROM VALUES (1L, 'steel pipe'), (2L, 'wire') AS t(query_id, query_text)")  # a size Spark knows, as a file has
    rows = spark.createDataFrame([(7, "Steel", "steel wire wire"), (8, None, "pipe"), (9, "x", "")], "std_id long, title string, text string")
    for scored in (R.lexical_score(queries, rows, {"title": "title", "scope": "text"}), R.bm25_score(queries, rows)):
        assert "hashpartitioning(query_id" not in executed(scored) and "hashpartitioning(std_id#" in executed(scored)
    got = {(r.query_id, r.std_id, r.score, r.matched) for r in R.lexical_score(queries, rows, {"title": "title", "scope": "text"}).collect()}
    assert got == {(1, 7, 4.5, "steel"), (1, 8, 1.5, "pipe"), (2, 7, 1.5, "wire")}
    idf, usual = math.log(1 + 2.5 / 1.5), 4 / 3
    want = idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / usual))
    assert abs(next(r.score for r in R.bm25_score(queries, rows).collect() if r.query_id == 2) - want) < 1e-12


def test_editions_of_one_designation_are_met_once(spark):
    catalogue = spark.createDataFrame([(1, "IS 1:2", 5), (1, "IS 1:2", 9), (1, "IS 1:3", None), (1, "IS 1:3", 9), (2, "IS 2:1", None)], "family long, designation string, published int")
    wanted = spark.createDataFrame([(1, "IS 1:3"), (1, "IS 1:8"), (2, "IS 2:2")], "family long, wanted string")
    found = latest_edition(wanted, catalogue)
    assert "max(published" in plan_of(found)
    assert sorted((r.wanted, r.designation, r.published) for r in found.collect()) == [("IS 1:3", "IS 1:3", 9), ("IS 1:8", "IS 1:2", 9), ("IS 2:2", "IS 2:1", None)]


def test_designations_are_not_carried_with_the_pairs(spark):
    standards = spark.createDataFrame([(k, f"{'PVC' if k % 2 else 'XLPE'} insulated cables", None, "", f"IS {k}", "active") for k in range(40)], "std_id long, title string, scope string, keywords string, designation string, status string")
    pairs = spark.createDataFrame([(1, 1, "XLPE insulated cable"), (2, 2, "XLPE insulated"), (3, 3, None)], "req_id long, std_id long, text string")
    checked = S2.scope_check(pairs, standards)
    assert "Window" not in plan_of(checked)
    worst = next(line for line in plan_of(checked).splitlines() if "min_by" in line)
    assert "designations" not in worst
    got = {r.req_id: r for r in checked.collect()}
    assert got[1].alternatives == sorted(f"IS {k}" for k in range(0, 40, 2)) and got[2].alternatives == got[3].alternatives == []


def test_hits_are_made_in_one_pass(spark, sf_dir):
    hits = evaluation._hits(spark, sf_dir)
    same = view(spark, sf_dir, evaluation.HITS)
    assert hits.columns == same.columns and hits.exceptAll(same).isEmpty() and same.exceptAll(hits).isEmpty()
    assert plan_of(hits).count("Relation") == 2
    modes = plan_of(evaluation.QUERIES["a11_match_modes"](spark, sf_dir))
    assert modes.count("row_number()") == 1  # hits of all modes and stages, and the list of stages, in one reading


def largest_method(df) -> int:
    """Bytes of the largest method of the whole-stage code; the JVM compiles none of over 8,000."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(mode))))


def small_methods(spark, df) -> bool:
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # its plans show their code only when they are run
    try:
        return largest_method(df()) <= 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_profiles_read_the_words_of_few_clauses(spark, sf_dir):
    found = profile.QUERIES["x10_tender_profile"](spark, sf_dir)
    assert "row_number()" not in plan_of(found) and "inline(" in plan_of(found)
    assert "BroadcastExchange" not in executed(found)
    assert small_methods(spark, lambda: profile.QUERIES["x10_tender_profile"](spark, sf_dir))


def test_buckets_are_found_in_one_pass(spark, sf_dir):
    found = profile.QUERIES["x9_profile_buckets"](spark, sf_dir)
    assert "Join" not in plan_of(found) and plan_of(found).count("Relation") == 1
    assert small_methods(spark, lambda: profile.QUERIES["x9_profile_buckets"](spark, sf_dir))


def test_lines_of_texts_that_hold_the_signs_that_cut(spark):
    text = "A\x01\x02\n\nThe first body weighs under 12 kg in all.\n\nThe next body weighs under 13 kg in all, no. 5 too.\x02 x"
    rows = P.profile_buckets(spark.createDataFrame([(1, text), (None, text)], "doc_id long, text string")).orderBy("nth").collect()
    line = lambda r: text[: [place for place, clause in placed if clause == r.clause][0]].count("\n") + 1
    placed = [(r.offset, r.clause) for r in C.split_clauses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()]
    assert [r.location for r in rows] == [f"Line {line(r)}" for r in rows] and [r.label for r in rows] == ["12 kg", "13 kg"]


def test_first_citations_are_those_of_the_scan(spark):
    texts = ["Rails to IS 3443 only, IS 5 too", "THE LIFE IS 15 YEARS, IS 8009 (Part 2/Sec 1):1980 and IS 7", "IS 230 V IS 4 m IS:1786:2008 amd 1", "IS 12 %", "is 5", "", None, "THIS 55", "x\U0001f600 IS 7 \U0001f600 IS 9"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = ["citation", "number", "part_section", "designation", "year", "amendment"]
    scanned = {r.doc_id: tuple(r[n] for n in names) for r in X.scan_citations(docs).where("pos = 0").collect()}
    assert {r.doc_id: tuple(r[n] for n in names) for r in X.with_citation(docs, "text").collect()} == {k: scanned.get(k, (None,) * 6) for k in range(len(texts))}
    assert scanned[1][0] == "IS 8009 (Part 2/Sec 1):1980" and scanned[2][4] == 2008 and sorted(scanned) == [0, 1, 2, 8]


def test_requirements_are_found_in_one_pass(spark, sf_dir):
    found = clauses.QUERIES["x11_requirements"](spark, sf_dir)
    assert "Join" not in plan_of(found) and "Union" not in plan_of(found) and plan_of(found).count("Relation") == 1
    assert small_methods(spark, lambda: clauses.QUERIES["x11_requirements"](spark, sf_dir))


def test_items_of_lists_in_their_row(spark):
    text = "before\n0. nought 0\n1) one\nmore of it\n\nb) bee\nb) again\nD) dee\nc. sea 2\nd) dee\n\n- one alone\nand its line\n\n2. single\na) x\n* s\n* t"
    got = [(r.text, r.structural) for r in C.requirement_spans(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("pos").collect()]
    assert got == [("nought 0", True), ("one more of it", True), ("bee b) again D) dee", True), ("sea 2", True), ("dee", True), ("- one alone\nand its line", False), ("s", True), ("t", True)]


def test_categories_of_lower_texts(spark):
    terms = [t.replace(r"\b", "").replace(r"\d+", "7") for _, ts in V.REQUIREMENT_CATEGORIES for t in ts]
    rows = spark.createDataFrame([(f"{a}{t.upper()}{b}", ref) for t in terms for a, b in (("", ""), ("x ", " y"), ("x", "y")) for ref in (None, "", "IS 5")], "text string, reference string").withColumn("low", F.lower("text"))
    text, reference = F.col("text"), F.col("reference")
    assert rows.where(V.category_of_lower(F.col("low"), reference) != V.requirement_category(text, reference)).isEmpty()
