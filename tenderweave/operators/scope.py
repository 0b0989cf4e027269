"""Materials that titles state and requirements ask for, and whether a cited standard covers them.

A material is what stands before a word such as "insulated" or "sheathed": the attribute. Titles give the
vocabulary; in requirements only its aliases count, found by an equi-join on the word groups before
the attribute. Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Attributes and their forms, words that end a material's name, words that are no alias.
ATTRIBUTES = {
    "insulated": ("insulated", "insulation"),
    "sheathed": ("sheathed", "sheathing", "sheath"),
    "coated": ("coated", "coating"),
    "covered": ("covered",),
    "clad": ("clad", "cladding"),
    "lined": ("lined", "lining"),
    "plated": ("plated", "plating"),
    "galvanised": ("galvanised", "galvanized"),
    "bonded": ("bonded",),
}
FUNCTION_WORDS = (
    "a an and are as at be by for from in including is its of on or other per shall than the to up used with grade type types specification specifications methods method test tests requirements general part section sec"
).split()
NO_ALIAS = "electric electrical cable cables wire wires round flexible heavy duty power single double multi core".split()
LOOK_BACK = 80
MOST_WORDS = 4
# End of the fixed values.

_FORMS = {form: name for name, forms in ATTRIBUTES.items() for form in forms}
_FORM = rf"(?i)\b({'|'.join(sorted(_FORMS, key=len, reverse=True))})\b"
_BREAK = r"[,.;:!?\[\]/–—-]"


def _before(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, pos, attribute, before): each attribute word of a text, and what stands before it back to the
    last break, the attribute word before, or LOOK_BACK characters. A text is cut where it lies."""
    cut = rf"(?=(?i:\b(?:{'|'.join(_FORMS)})\b))"
    pieces = rows.select(*key, F.split(text, cut).alias("pieces"))
    places = F.transform("pieces", lambda p, i: F.struct(i.alias("pos"), p.alias("piece"), F.get("pieces", i - 1).alias("previous")))
    pieces = pieces.where(F.size("pieces") > 1).select(*key, F.explode(places).alias("p")).select(*key, "p.*")
    names = F.create_map(*[F.lit(x) for pair in _FORMS.items() for x in pair])
    found = pieces.withColumn("previous", F.right("previous", F.lit(LOOK_BACK))).withColumn("form", F.lower(F.regexp_extract("piece", "^" + _FORM.replace("(?i)", "(?i:", 1) + ")", 1)))
    return found.where("form <> '' and previous is not null").select(*key, "pos", names[F.col("form")].alias("attribute"), F.element_at(F.split("previous", _BREAK), -1).alias("before"))


def _any_of(token: Column, words) -> Column:
    return token.isin(*words)


def aliases(phrase: Column) -> Column:
    """Lower-case forms by which a material may be named: without brackets, and each short name in them."""
    bare = F.trim(F.regexp_replace(F.lower(F.regexp_replace(phrase, r"\([^)]*\)", " ")), r"\s+", " "))
    every = F.concat(F.array(bare), F.transform(F.regexp_extract_all(phrase, F.lit(r"\(([A-Za-z][A-Za-z0-9\-]{1,11})\)"), 1), lambda x: F.lower(x)))
    return F.array_distinct(F.filter(every, lambda x: (F.length(x) >= 3) & ~F.forall(F.split(x, " "), lambda w: _any_of(w, NO_ALIAS))))


def material_key(phrase: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(phrase), r"\s+", " "))


def materials_in(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, pos, attribute, phrase): the material stated before each attribute of a text, up to MOST_WORDS words
    back to a function word; the first of equal pairs. Rows have distinct keys."""
    found = _before(rows, key, text)
    words = F.reverse(F.slice(F.reverse(F.regexp_extract_all("before", F.lit(r"\(?[A-Za-z][A-Za-z0-9\-]*\)?"), 0)), 1, MOST_WORDS))
    back = F.reverse(words)
    stop = F.array_position(F.transform(back, lambda w: _any_of(F.lower(F.regexp_replace(w, r"[()]", "")), [*FUNCTION_WORDS, *_FORMS])), True)
    kept = F.when(stop > 0, F.slice(back, F.lit(1), (stop - 1).cast("int"))).otherwise(back)
    named = found.withColumn("phrase", F.array_join(F.reverse(kept), " ")).where("phrase <> ''").where(F.size(aliases(F.col("phrase"))) > 0)
    return named.groupBy(*key, "attribute", "phrase").agg(F.min("pos").alias("pos")).select(*key, "pos", "attribute", "phrase")


def material_vocabulary(standards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((attribute, alias, material), (attribute, material, spelling, designations)) of the titles of standards
    (std_id, title, designation, status). An alias of several materials is left out; withdrawn standards
    name materials, but don't cover them. The spelling is the first one by std_id."""
    stated = materials_in(standards, ["std_id"], "title").withColumn("material", material_key(F.col("phrase")))
    alias = stated.select("attribute", "material", F.explode(aliases(F.col("phrase"))).alias("alias")).groupBy("attribute", "alias").agg(F.min("material").alias("material"), F.max("material").alias("last"))
    spelling = stated.groupBy("material").agg(F.min_by("phrase", F.struct("std_id", "pos")).alias("spelling"))
    standing = stated.join(standards.select("std_id", "designation", "status"), "std_id")
    covered = standing.groupBy("attribute", "material").agg(F.array_sort(F.collect_set(F.when(F.coalesce("status", F.lit("")) != "withdrawn", F.col("designation")))).alias("designations"))
    return alias.where("material = last").drop("last"), covered.join(spelling, "material").select("attribute", "material", "spelling", "designations")


def required_materials(rows: DataFrame, key: list[str], text: str, alias: DataFrame) -> DataFrame:
    """(key, pos, attribute, material, alias): for each attribute word of a text the longest known alias in front of it."""
    found = _before(rows, key, text).withColumn("w", F.filter(F.split(F.lower("before"), "[^a-z0-9]+"), lambda x: x != ""))
    groups = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(2 * MOST_WORDS), F.size("w") - i + 1)), lambda n: F.array_join(F.slice("w", i, n), " "))))
    named = found.where(F.size("w") > 0).select(*key, "pos", "attribute", F.explode(F.array_distinct(groups)).alias("alias"))
    return named.join(alias, ["attribute", "alias"]).groupBy(*key, "pos", "attribute").agg(F.max_by(F.struct("material", "alias"), F.struct(F.length("alias"), "alias")).alias("m")).select(*key, "pos", "attribute", "m.material", "m.alias")


def scope_check(pairs: DataFrame, standards: DataFrame) -> DataFrame:
    """(req_id, std_id, checked, mismatch, attribute, required, as_written, covered, alternatives) for each of pairs
    (req_id, std_id, text) that cites one of standards (std_id, title, scope, keywords, designation, status).

    A mismatch needs a known material in the requirement, another one for the same attribute in the
    standard's title, and no mention of it in the standard's title, scope or keywords. A requirement that names
    several materials for an attribute says nothing about it. checked is false where nothing was compared.
    The designations that cover a material are listed once for it and met at the end, by the pairs that mismatch alone.
    """
    alias, covers = material_vocabulary(standards)
    key = ["req_id", "std_id"]
    asked = required_materials(pairs, key, "text", alias)
    several = asked.groupBy(*key, "attribute").agg(F.min("material").alias("a"), F.max("material").alias("b")).where("a = b").drop("a", "b")
    stated = materials_in(standards, ["std_id"], "title").groupBy("std_id", "attribute").agg(F.max_by("phrase", "pos").alias("covered"))
    text = F.lower(F.concat_ws(" ", "title", "scope", "keywords"))
    met = asked.join(several, [*key, "attribute"]).join(stated, ["std_id", "attribute"]).join(covers.drop("designations"), ["attribute", "material"]).join(standards.select("std_id", "designation", text.alias("said")), "std_id")
    mentioned = F.exists(aliases(F.col("spelling")), lambda a: F.regexp_like(F.col("said"), F.concat(F.lit(r"(?<![a-z0-9])\Q"), a, F.lit(r"\E(?![a-z0-9])"))))
    met = met.withColumn("mismatch", (material_key(F.col("covered")) != F.col("material")) & ~mentioned)
    result = F.struct("mismatch", "attribute", F.col("spelling").alias("required"), F.col("alias").alias("as_written"), "covered", "material", "designation")
    best = met.groupBy(*key).agg(F.min_by(result, F.struct((~F.col("mismatch")).alias("ok"), "pos")).alias("r"))
    bad = F.coalesce("r.mismatch", F.lit(False))
    listed = covers.select(F.col("attribute").alias("_a"), F.col("material").alias("_m"), "designations")  # as many rows as there are materials
    rows = pairs.select(*key).join(best, key, "left")
    rows = rows.join(F.broadcast(listed), bad & (F.col("r.attribute") == F.col("_a")) & (F.col("r.material") == F.col("_m")), "left")
    return rows.select(
        *key, F.col("r").isNotNull().alias("checked"), bad.alias("mismatch"), "r.attribute", "r.required", F.when(bad, F.col("r.as_written")).alias("as_written"), "r.covered", F.when(bad, F.array_remove(F.col("designations"), F.col("r.designation"))).otherwise(F.array().cast("array<string>")).alias("alternatives")
    )
