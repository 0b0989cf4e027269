import random

from pyspark.sql import functions as F

from tenderweave.functions import phrases as P
from tenderweave.functions import thesaurus, vocabulary


def test_all_phrases_that_a_text_holds(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab c.-") for _ in range(rng.randrange(1, 6))) for _ in range(60)} | {"a+b", "(x", "x|y", "ct/pt"})
    texts = ["".join(rng.choice("abcAB .-") for _ in range(rng.randrange(40))) for _ in range(150)] + ["a+b (x x|y CT/PT", "", None, "é ab"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [set(r[0]) for r in df.coalesce(1).select(P.phrases_in(F.col("t"), words)).collect()]
    assert got == [{w for w in words if w in (t or "").lower()} for t in texts]
    assert df.limit(1).select(P.phrases_in(F.col("t"), [])).first()[0] == []


def test_thesaurus_and_categories(spark):
    titles = ["Pump sets: submersible pump and valve", "XLPE cable on cable tray, 694", "Nothing here", None]
    got = spark.createDataFrame([(t,) for t in titles], "t string").coalesce(1).select(vocabulary.thesaurus_terms(F.col("t")), vocabulary.categories_of_rules(F.col("t"), F.lit("IS 1"))).collect()
    for (terms, cats), t in zip(got, titles):
        low = (t or "").lower()
        assert terms == " ".join(says for ps, says in thesaurus.THESAURUS if any(p in low for p in ps))
        assert cats == (list(dict.fromkeys(c for ps, c in thesaurus.CATEGORY_RULES if any(p in f"{low} is 1" for p in ps)))[:3] or ["General Standards"])
