"""URL filters: listed rules, and gradient-boosted trees over lexical features for all other URLs.

The trees are trained by Spark ML on all different URLs that the rules label. Features are DataFrame
functions of the URL: lengths, depth, share of digits, entropy of the host and of the path, counts of
parameters, hyphens and labels, and statistics of its suffix (the host's last label) and of its first
folder: their lengths, letters and how common they are among those URLs, each of them counted. How
rules judge a suffix or folder is no feature, so the trees learn from a URL's form.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
TREES = 16
DEPTH = 3
SLICE = 100_000  # URLs that one task trains on
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
FEATURES = [
    "f_length", "f_host", "f_path", "f_depth", "f_digits", "f_entropy", "f_path_entropy", "f_params", "f_hyphens", "f_labels", "f_longest", "f_secure", "f_fragment", "f_www", "f_vowels",
    "f_suffix_length", "f_suffix_vowels", "f_folder_length", "f_folder_first", "f_folder_last", "f_suffix_share", "f_folder_share",
]
_SHARES = ("f_suffix_share", "f_folder_share")


def parts(pages: DataFrame) -> DataFrame:
    """pages with host and path; both empty where the url is null or has no ://"""
    url = F.coalesce("url", F.lit(""))
    return pages.withColumn("host", F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER)).withColumn("path", F.regexp_extract(url, _PARTS, 2))


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one. Of equal rules the first counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, text in sorted(reversed(rules), key=lambda x: len(x[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars))
    return F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def lexical(rows: DataFrame) -> DataFrame:
    """rows with all features but those of the suffix, and the suffix: the host's last label."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    return rows.withColumns(
        {
            "f_length": F.length(url).cast("double"),
            "f_host": F.length(host).cast("double"),
            "f_path": F.length(path).cast("double"),
            "f_depth": count(path, "/[^/]"),
            "f_digits": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
            "f_entropy": _entropy(host),
            "f_params": count(url, "[?&][^=&#]*="),
            "f_hyphens": count(host, "-"),
            "f_labels": count(host, r"[^.]+"),
            "f_longest": F.coalesce(F.array_max(F.transform(F.split(host, r"\."), lambda x: F.length(x))), F.lit(0)).cast("double"),
            "f_secure": url.startswith("https://").cast("double"),
            "f_fragment": F.contains(url, F.lit("#")).cast("double"),
            "f_www": host.startswith("www.").cast("double"),
            "f_path_entropy": _entropy(path),
            "f_vowels": count(host, "[aeiou]") / F.greatest(F.length(host), F.lit(1)),
            "folder": F.regexp_extract(path, "^/([^/]*)", 1),
            "suffix": F.regexp_extract(host, r"([^.]*)$", 1),
        }
    ).withColumns(
        {
            "f_suffix_length": F.length("suffix").cast("double"),
            "f_suffix_vowels": count(F.col("suffix"), "[aeiou]"),
            "f_folder_length": F.length("folder").cast("double"),
            "f_folder_first": F.ascii(F.col("folder")).cast("double"),
            "f_folder_last": F.ascii(F.right(F.col("folder"), F.lit(1))).cast("double"),
        }
    )


def sampled(labelled: DataFrame, sample: int) -> DataFrame:
    """The first `sample` different URLs by hash. Only hashes are shuffled to find the last of them."""
    hashed = labelled.withColumn("h", F.xxhash64("url"))
    last = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    return hashed.where(F.col("h") <= (last if last is not None else 0)).dropDuplicates(["h"])


def trained(taken: DataFrame) -> tuple[GBTClassifier, dict[str, Column]]:
    """The trees of labelled URLs (label is 1 for block), and the features that rest on counts of them all."""
    total = taken.count()

    def looked_up(key: str) -> Column:
        shares = stored(taken.groupBy(F.col(key).alias("key")).agg((F.count("*") / total).alias("share")), "shares")
        usual = shares.agg(F.sum(F.col("share") * F.col("share"))).first()[0]  # what no labelled URL has counts as usual
        found = shares.where(F.col("key") == F.col(key).outer()).select(F.max("share")).scalar()  # a left join by the key
        return F.coalesce(found, F.lit(usual))

    known = {"f_suffix_share": looked_up("suffix"), "f_folder_share": looked_up("folder")}
    train = _vector().transform(taken.withColumns(known)).select("features", "label", F.xxhash64("url").alias("h"))
    train = train.repartition(total // SLICE + 1, "h").sortWithinPartitions("h").select("features", "label")
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=1).fit(train), known


def _vector() -> VectorAssembler:
    return VectorAssembler(inputCols=FEATURES, outputCol="features")


def filtered(pages: DataFrame, rules=RULES, sample: int | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, model (the trees' verdict) and score (their probability of block).

    pages has page_id and url; other columns don't matter. Null urls and urls without :// have empty
    host and path, so no rule fits them and the trees decide. Even odds allow. If the rules label no URL
    of one kind, there is nothing to tell apart: the model then says what the labelled ones are, or
    allow. URLs of any length are read whole. Repeated rows give a row each; no pages: no rows.
    The trees and their counts take all labelled URLs, or the first `sample` by hash where that is given.
    """
    rule, said = rule_of(rules)
    rows = lexical(parts(pages.select("page_id", "url")).withColumn("rule", rule).withColumn("said", said))
    labelled = rows.where("said is not null").select("url", "said", "host", "suffix", "folder", *[f for f in FEATURES if f not in _SHARES])
    different = sampled(labelled, sample) if sample else labelled.dropDuplicates(["url"])
    taken = stored(different, "labelled").withColumn("label", (F.col("said") == "block").cast("double"))
    kinds = [r[0] for r in taken.select("said").distinct().collect()]
    if len(kinds) < 2:
        only = F.lit(kinds[0] if kinds else "allow")
        return rows.select("page_id", "host", "path", "rule", F.coalesce("said", only).alias("verdict"), only.alias("model"), (only == "block").cast("double").alias("score"))
    model, known = trained(taken)
    scored = model.transform(_vector().transform(rows.withColumns(known)))
    score = vector_to_array("probability")[1]
    by_trees = F.when(score > 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", by_trees).alias("verdict"), by_trees.alias("model"), score.alias("score"))
