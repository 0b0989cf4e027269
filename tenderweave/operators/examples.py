"""Labelled requirement texts made of catalogue rows, and the labels of new texts."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The classes, the schemes that certify by themselves, words that call for a class.
OTHER = "OTHER"
SCHEMES = ("isi mark", "crs")
TEST_WORDS, PERFORMANCE_WORDS, MATERIAL_WORDS, INSTALLATION_WORDS = ("test", "method"), ("performance", "efficiency"), ("steel", "aluminium", "pvc"), ("installation", "practice", "code")
# End of the fixed values.

#: (class, how many of its sentences, each sentence); {w} is the row's keyword, {c} its category, {n} its number, {s} its scheme, {t} a test or its title.
SENTENCES = {
    "TECHNICAL_SPECIFICATION": (3, ["Each {w} offered shall be made to {n}.", "Bidders quote {c} to {n} only.", "Only {w} that meets {n} is accepted.", "The {c} of this work follows {n} in full.", "For the {w}, {n} is binding."]),
    "CERTIFICATION": (3, ["The maker holds a {s} registration for {n}.", "A copy of the {s} licence for {n} is enclosed with the bid.", "By order, {s} under {n} is compulsory."]),
    "TESTING": (1, ["A report of the type test for {t} by {n} is handed in.", "Samples of the {w} are tested for {t} as {n} says.", "Tests for {t} are done by the procedure of {n}."]),
    "TESTING_BY_TITLE": (1, ["Tests are done as {n} ({t}) lays down."]),
    "SAFETY": (2, ["The {w} is safe in use as {n} demands.", "Basic safety of the {c} is that of {n}.", "Protection from shock follows {n}."]),
    "PERFORMANCE": (2, ["Performance is judged by {n}.", "The {w} reaches the performance values of {n}."]),
    "MATERIAL": (2, ["The make-up of the material is that of {n}.", "Raw material is examined to {n}."]),
    "INSTALLATION": (2, ["The work is installed by the code of practice {n}.", "Erection at site follows {n}."]),
}


def _spoken(sentence: str, values: dict[str, Column]) -> Column:
    out = F.lit(sentence)
    for k, v in values.items():
        if f"{{{k}}}" in sentence:
            out = F.replace(out, F.lit(f"{{{k}}}"), v)
    return out


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(words)), F.lit(False))


def labelled_examples(rows: DataFrame) -> DataFrame:
    """(std_id, label, text) of catalogue rows (std_id, is_number, title, keyword, category, scope, standard_type,
    scheme, mandatory, tests): sentences of each class that the row calls for.

    Of a class with more sentences than it gives, those with the least md5 of number, class and place are
    chosen, the same in every run. Rows without a number or title give none; a null keyword is "product", a null
    category "material". A text is made once for each std_id.
    """
    named = rows.where("coalesce(is_number, '') <> '' and coalesce(title, '') <> ''")
    named = named.withColumn("w", F.lower(F.coalesce("keyword", F.lit("product")))).withColumn("c", F.lower(F.coalesce("category", F.lit("material")))).withColumn("s", F.coalesce(F.nullif("scheme", F.lit("")), F.lit("BIS certification")))
    tests = F.coalesce("tests", F.expr("cast(array() as array<string>)"))
    calls = {
        "TECHNICAL_SPECIFICATION": F.lit(True), "CERTIFICATION": F.coalesce("mandatory", F.lit(False)) | F.coalesce(F.lower("scheme").isin(*SCHEMES), F.lit(False)), "TESTING_BY_TITLE": (F.size(tests) == 0) & _holds(F.col("title"), TEST_WORDS),
        "SAFETY": _holds(F.concat_ws(" ", "title", "standard_type", "keyword"), ("safety",)), "PERFORMANCE": _holds(F.col("title"), PERFORMANCE_WORDS) | _holds(F.col("scope"), ("efficacy",)),
        "MATERIAL": _holds(F.col("title"), MATERIAL_WORDS) | _holds(F.col("scope"), ("material",)), "INSTALLATION": _holds(F.col("title"), INSTALLATION_WORDS),
    }

    def chosen(label: str, t: Column) -> Column:
        n, sentences = SENTENCES[label]
        values = {"w": F.col("w"), "c": F.col("c"), "n": F.col("is_number"), "s": F.col("s"), "t": t}
        made = [F.struct(F.md5(F.concat_ws("#", "is_number", F.lit(label), t, F.lit(str(k)))).alias("h"), F.lit(label.removesuffix("_BY_TITLE")).alias("label"), _spoken(x, values).alias("text")) for k, x in enumerate(sentences)]
        return F.slice(F.array_sort(F.array(*made)), 1, n)

    none = F.filter(chosen("SAFETY", F.col("title")), lambda x: F.lit(False))
    whole = F.concat(*[F.when(holds, chosen(label, F.col("title"))).otherwise(none) for label, holds in calls.items()], F.flatten(F.transform(tests, lambda t: chosen("TESTING", t))))
    return named.select("std_id", F.explode(whole).alias("x")).select("std_id", "x.label", "x.text").dropDuplicates(["std_id", "label", "text"])


def predict_type(texts: DataFrame, model: PipelineModel | None, labels: list[str]) -> DataFrame:
    """texts (text, ...) with the label that a model of train_text_classifier() gives; OTHER without a model."""
    if model is None:
        return texts.withColumn("label", F.lit(OTHER))
    table = F.array(*map(F.lit, labels))
    scored = model.transform(texts.withColumn("text", F.coalesce("text", F.lit(""))))
    return scored.select(*texts.columns, F.coalesce(F.get(table, F.col("prediction").cast("int")), F.lit(OTHER)).alias("label"))
