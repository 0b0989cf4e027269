"""Column functions over texts, token lists and vectors. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
UNITS = r"(?i)\b\d+(?:\.\d+)?\s*(mm|cm|km|kg|kw|kv|kva|hz|mpa|lm|ip|m|v|w|a|g)\b"


def tokenize_set(text: Column) -> Column:
    """Distinct lower-case tokens of two characters or more; punctuation is deleted, not made a space. Null: none."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda t: F.length(t) >= 2))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct tokens; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")


def length_ratio(a: Column, b: Column) -> Column:
    """Words of the shorter text over words of the longer; 0 if either has none."""
    m, n = F.size(words(a)), F.size(words(b))
    return F.when((m > 0) & (n > 0), F.least(m, n) / F.greatest(m, n)).otherwise(0.0)


def units(text: Column) -> Column:
    """Upper-case units that follow a number, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNITS), 1), F.upper)))


def unit_overlap(requirement: Column, candidate: Column) -> Column:
    """Jaccard of units; NaN if the requirement has none."""
    a, b = units(requirement), units(candidate)
    return F.when(F.size(a) == 0, F.lit(float("nan"))).otherwise(jaccard(a, b))


def singularize(token: Column) -> Column:
    """ies to y in tokens of over four characters; a last s, not ss, goes in those of over three."""
    n = F.length(token)
    return F.when((n > 4) & token.endswith("ies"), F.concat(F.substr(token, F.lit(1), n - 3), F.lit("y"))).when((n > 3) & token.endswith("s") & ~token.endswith("ss"), F.substr(token, F.lit(1), n - 1)).otherwise(token)


def token_shape(token: Column) -> Column:
    """What makes a token no word: no_vowel, consonant_run (over 4), few_letters (under 3 distinct), else ok."""
    letters = F.array_distinct(F.filter(F.split(F.lower(token), ""), lambda c: c != ""))
    return F.when(~F.lower(token).rlike("[aeiouy]"), "no_vowel").when(F.lower(token).rlike("[bcdfghjklmnpqrstvwxz]{5}"), "consonant_run").when(F.size(letters) < 3, "few_letters").otherwise("ok")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def stable_id(number: Column, year: Column) -> Column:
    """md5 of number:year in the layout of a UUID."""
    h = F.md5(F.concat(number, F.lit(":"), F.coalesce(year.cast("string"), F.lit("None"))))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """A zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def clip(text: Column, n: int) -> Column:
    """White space collapsed; texts of over n characters end in an ellipsis, n characters in all."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit("…")))


def rescale_confidence(raw: Column) -> Column:
    return 0.70 + 0.29 * raw


def feature_coverage(columns: list[Column]) -> Column:
    """Share of values that are not NaN, to three places."""
    return F.bround(sum((~F.isnan(c)).cast("int") for c in columns) / len(columns), 3)


def classify_first(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The first label one of whose terms occurs in the text (lower-cased)."""
    low, out = F.lower(text), None
    for label, terms in rules:
        hit = low.contains(terms[0])
        for t in terms[1:]:
            hit = hit | low.contains(t)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def labels_of(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Every label one of whose terms occurs, in the order of the rules."""
    low = F.lower(text)
    return F.filter(F.array(*[F.when(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t)), label) for label, terms in rules]), lambda x: x.isNotNull())


TECHNICAL = r"\b(?:[A-Z]{2,}|IP\d+|\d+(?:\.\d+)?(?:W|kW|V|A|Hz|mm|cm|m|kg|lx|lm))\b"
NUMBER = r"\b\d+(?:\.\d+)?\b"


def _share_found(found: Column, text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.size(found) > 0, F.size(F.filter(found, lambda k: F.contains(low, F.lower(k)))) / F.size(found)).otherwise(F.lit(float("nan")))


def tech_keyword_overlap(requirement: Column, candidate: Column) -> Column:
    """Share of technical terms of the requirement that the candidate's text contains; NaN without any."""
    return _share_found(F.regexp_extract_all(requirement, F.lit(TECHNICAL), 0), candidate)


def numeric_features(requirement: Column, candidate: Column) -> tuple[Column, Column, Column]:
    """(share of the requirement's numbers found, how many it has, how many the candidate has)."""
    a, b = (F.regexp_extract_all(x, F.lit(NUMBER), 0) for x in (requirement, candidate))
    return _share_found(a, candidate), F.size(a).cast("double"), F.size(b).cast("double")


def hash_embedding(text: Column, dim: int = 8) -> Column:
    """A deterministic unit vector from the bytes of the text's sha256, for tests and fallbacks."""
    h = F.sha2(text, 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1)
    return l2_normalize(raw)


def search_text(parts: Column) -> Column:
    """Tokens of two characters or more of all parts, the first spelling of each (case apart), in order."""
    tokens = F.filter(F.split(F.array_join(parts, " "), r"\s+"), lambda t: F.length(t) >= 2)
    return F.array_join(F.filter(tokens, lambda t, i: F.array_position(F.transform(tokens, F.lower), F.lower(t)) == i + 1), " ")


def quantity_terms(text: Column) -> Column:
    """Array of (amount, unit): numbers with the word behind them, but for conjunctions."""
    found = F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?\s*[A-Za-z]+"), 0)
    terms = F.transform(found, lambda q: F.struct(F.regexp_extract(q, r"(\d+(?:\.\d+)?)", 1).alias("amount"), F.lower(F.regexp_extract(q, "([A-Za-z]+)$", 1)).alias("unit")))
    return F.filter(terms, lambda t: ~t["unit"].isin("and", "or", "to", "with"))
