import math

from tenderweave.operators.features import FEATURES, applicability_features, featurise_pairs


def test_features_of_a_pair(spark):
    rows = [(1, 1, "Lamp of 40 W, IP66, 10 mm", "lamp 40 W and 3 kg IP66", 0.5, None, 0.1), (1, 2, "Lamp of 40 W, IP66, 10 mm", "nothing alike", 0.9, 2.0, 0.2), (2, 1, None, "x", None, None, None)]
    df = spark.createDataFrame(rows, "q long, s long, requirement_text string, candidate_text string, semantic_score double, bm25_score double, rrf_score double")
    out = applicability_features(df, ["q"], "s")
    assert out.columns == ["q", "s", *FEATURES]
    got = {(r.q, r.s): r for r in out.collect()}
    a = got[1, 1]
    assert (a.embedding_cosine_sim_rank, a.rrf_rank, a.numeric_param_count_requirement, a.numeric_param_count_standard) == (2.0, 2.0, 2.0, 2.0)
    assert math.isnan(a.bm25_score) and math.isnan(a.bm25_score_rank) and got[1, 2].bm25_score_rank == 1.0
    assert a.numeric_param_match_ratio == 0.5 and a.technical_keyword_overlap_ratio == 1.0 and a.unit_overlap_ratio == 0.5
    assert abs(a.requirement_length_ratio - 7 / 7) < 1e-9 and 0 < a.tfidf_cosine_sim < 1 and got[1, 2].tfidf_cosine_sim == 0
    assert math.isnan(got[2, 1].tfidf_cosine_sim) and got[2, 1].token_jaccard == 0


def test_labelled_pairs_meet_catalogue_and_candidates(spark):
    labelled = spark.createDataFrame([(1, "lamp 5 W", " Lamp ", 1), (1, "lamp 5 W", "Rope", 0), (2, "rope", "none such", 1)], "group_id long, requirement_text string, standard_title string, label int")
    catalogue = spark.createDataFrame([(7, "lamp", '{"value": "for 5 W"}', None), (8, "Lamp", None, None), (9, "rope", "hemp", "cord")], "std_id long, title string, scope string, search_text string")
    candidates = spark.createDataFrame([(1, 7, 0.4, 1.0, 0.3), (1, 3, 0.8, 2.0, 0.1)], "group_id long, std_id long, semantic_score double, bm25_score double, rrf_score double")
    got = {(r.group_id, r.std_id): r for r in featurise_pairs(labelled, catalogue, candidates).collect()}
    assert set(got) == {(1, 7), (1, 9)}
    assert got[1, 7].embedding_cosine_sim_rank == 2.0 and got[1, 7].rrf_rank == 1.0 and math.isnan(got[1, 9].rrf_rank)
