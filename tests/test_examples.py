from tenderweave.operators import examples as X
from tenderweave.operators import learning
from tenderweave.operators.learning import train_text_classifier


def test_examples_and_a_model_of_them(spark):
    schema = "std_id long, is_number string, title string, keyword string, category string, scope string, standard_type string, scheme string, mandatory boolean, tests array<string>"
    rows = [(k, f"IS {k}", "Code of practice", "Lamp", None, None, None, "CRS" if k % 2 else "", None, ["heat"]) for k in range(1, 31)] + [(90, "", "x", None, None, None, None, None, None, None), (91, "IS 91", None, None, None, None, None, None, None, None)]
    made = X.labelled_examples(spark.createDataFrame(rows, schema)).collect()
    per = {}
    for r in made:
        per.setdefault(r.std_id, []).append(r.label)
    assert set(per) == set(range(1, 31))
    assert sorted(per[1]) == ["CERTIFICATION"] * 3 + ["INSTALLATION"] * 2 + ["TECHNICAL_SPECIFICATION"] * 3 + ["TESTING"]
    assert "CERTIFICATION" not in per[2] and not any("{" in r.text for r in made)
    labels = ["CERTIFICATION", "INSTALLATION", "TECHNICAL_SPECIFICATION", "TESTING"]
    train = spark.createDataFrame([(r.text, float(labels.index(r.label))) for r in made if r.std_id <= 20], "text string, label double")
    held = spark.createDataFrame([(r.text, r.label) for r in made if r.std_id > 20], "text string, want string")
    got = X.predict_type(held, train_text_classifier(train), labels).collect()
    assert sum(r.label == r.want for r in got) >= 0.9 * len(got)
    assert {r.label for r in X.predict_type(held, None, labels).collect()} == {"OTHER"}


def test_trees_hold_different_texts_only(spark, monkeypatch):
    held = []

    class Forest(learning.RandomForestClassifier):
        def fit(self, rows):
            held.extend((r.label, r.weight) for r in rows.collect())
            return super().fit(rows)

    monkeypatch.setattr(learning, "RandomForestClassifier", Forest)
    rows = [("steel pipe test", 0.0)] * 6 + [("copper wire sheet", 0.0)] * 4 + [("oak chair safety", 1.0)] * 5 + [("steel pipe test", 1.0)] * 5
    model = train_text_classifier(spark.createDataFrame(rows, "text string, label double"), trees=3)
    assert sorted((label, round(w, 6)) for label, w in held) == [(0.0, 4.0), (0.0, 6.0), (1.0, 5.0), (1.0, 5.0)]
    assert len(model.stages) == 8
