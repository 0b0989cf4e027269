"""The 14 features by which a standard is judged applicable to a requirement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .corpus import tfidf_cosine

FEATURES = (
    "embedding_cosine_sim", "embedding_cosine_sim_rank", "bm25_score", "bm25_score_rank", "tfidf_cosine_sim", "token_jaccard", "technical_keyword_overlap_ratio",
    "numeric_param_match_ratio", "numeric_param_count_requirement", "numeric_param_count_standard", "unit_overlap_ratio", "rrf_score", "rrf_rank", "requirement_length_ratio",
)
# Fixed value: units of measured quantities.
UNITS = r"(?i)\b(?:W|kW|V|A|Hz|mm|cm|m|kg|g|lx|lm|cd|K|nm|dB|IP\d+)\b"


def _nan() -> Column:
    return F.lit(float("nan"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(_nan())


def _units(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(UNITS), 0), lambda u: F.upper(u)))


def applicability_features(pairs: DataFrame, group: list[str], item: str) -> DataFrame:
    """(group, item, and a column for each of FEATURES) of pairs with requirement_text, candidate_text,
    semantic_score, bm25_score and rrf_score.

    A pair is known by group (the requirement) and item (the candidate). A rank is the place among the
    group's candidates by falling score, ties by item; what can't be told is NaN. Null texts are empty.
    """
    pairs = pairs.withColumns({c: F.coalesce(c, F.lit("")) for c in ("requirement_text", "candidate_text")})
    req, cand = F.col("requirement_text"), F.col("candidate_text")
    known = lambda c: F.coalesce(F.col(c).cast("double"), _nan())
    place = lambda c: F.when(F.col(c).isNotNull(), F.row_number().over(Window.partitionBy(*group).orderBy(F.desc_nulls_last(c), item)).cast("double")).otherwise(_nan())
    a, b = (F.array_distinct(T.words(x)) for x in (req, cand))
    union = F.size(F.array_union(a, b))
    match, n_req, n_std = T.numeric_features(req, cand)
    u, v = _units(req), _units(cand)
    columns = {
        "embedding_cosine_sim": known("semantic_score"), "embedding_cosine_sim_rank": place("semantic_score"), "bm25": known("bm25_score"), "bm25_score_rank": place("bm25_score"),
        "token_jaccard": _share(F.size(F.array_intersect(a, b)), union), "technical_keyword_overlap_ratio": T.tech_keyword_overlap(req, cand),
        "numeric_param_match_ratio": match, "numeric_param_count_requirement": n_req, "numeric_param_count_standard": n_std,
        "unit_overlap_ratio": F.when(F.size(u) > 0, F.size(F.array_intersect(u, v)) / F.size(F.array_union(u, v))).otherwise(_nan()),
        "rrf": known("rrf_score"), "rrf_rank": place("rrf_score"), "requirement_length_ratio": _share(F.size(T.words(req)), F.size(T.words(cand))),
    }
    key = [*group, item]
    rows = pairs.select(*key, req, cand, *[c.alias(n) for n, c in columns.items()])
    cosine = tfidf_cosine(pairs.select(*key, req.alias("a"), cand.alias("b")), key)
    blank = (F.trim("requirement_text") == "") | (F.trim("candidate_text") == "")
    both = rows.join(cosine, key, "left").withColumn("tfidf_cosine_sim", F.when(blank, _nan()).otherwise(F.coalesce("cosine", F.lit(0.0))))
    return both.withColumnsRenamed({"bm25": "bm25_score", "rrf": "rrf_score"}).select(*key, *FEATURES)


def featurise_pairs(labelled: DataFrame, catalogue: DataFrame, candidates: DataFrame) -> DataFrame:
    """Labelled pairs (group_id, requirement_text, standard_title, label) with the features of the catalogue row of
    that title (std_id, title, scope, search_text) and its scores among the group's candidates (group_id, std_id,
    semantic_score, bm25_score, rrf_score). Of catalogue rows of one title the one with the least std_id counts;
    pairs whose title is in no row are left out; those that were not retrieved have NaN for what candidates tell."""
    from ..functions.vocabulary import candidate_text

    text = candidate_text(F.col("title"), F.col("scope"), F.col("search_text"))
    titled = catalogue.groupBy(F.lower(F.trim("title")).alias("key")).agg(F.min_by(F.struct("std_id", text.alias("candidate_text")), "std_id").alias("c"))
    wanted = labelled.withColumn("key", F.lower(F.trim("standard_title"))).join(titled, "key").select("group_id", "requirement_text", "label", "c.std_id", "c.candidate_text")
    every = candidates.join(wanted.select("group_id", "std_id", "requirement_text", "label", "candidate_text"), ["group_id", "std_id"], "full_outer")
    features = applicability_features(every, ["group_id"], "std_id")
    return wanted.select("group_id", "std_id", "label").join(features, ["group_id", "std_id"])
