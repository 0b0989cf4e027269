"""Learning jobs on Spark ML: applicability of a standard to a requirement, and kinds of text."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, Imputer, NGram, RegexTokenizer, StandardScaler, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import classification_metrics

THRESHOLD = 0.49


def _applicability(features: list[str], trees: int, seed: int) -> Pipeline:
    filled = [f"{f}_filled" for f in features]
    stages = [
        Imputer(strategy="median", inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=filled + [f"{f}_missing" for f in features], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
        RandomForestClassifier(featuresCol="scaled", labelCol="label", numTrees=trees, maxDepth=6, seed=seed),
    ]
    return Pipeline(stages=stages)


def train_applicability(rows: DataFrame, features: list[str], trees: int = 40, seed: int = 7) -> PipelineModel:
    """Median imputation with indicators of what was missing, scaling, and a random forest over `label`.

    Every step reads the rows again, so they are dealt evenly, kept, and let go at the end.
    """
    ready = with_missing(_dealt(rows).select(*features, "label"), features).persist()
    model = _applicability(features, trees, seed).fit(ready)
    ready.unpersist()
    return model


def _dealt(rows: DataFrame) -> DataFrame:
    """rows in as many partitions as shuffles have, each in one order, by a hash of the whole row: what a seed draws then
    depends on the rows alone, not on files or joins, and no task has most of them."""
    whole = F.xxhash64(*rows.columns)
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), whole).sortWithinPartitions(whole)


def with_folds(rows: DataFrame, group: str, folds: int = 3) -> DataFrame:
    """rows with fold: all rows of a group have the same one, by a hash of the group."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.col(group).cast("string")), F.lit(folds)).cast("int"))


def best_threshold(scored: DataFrame) -> tuple[float, float]:
    """(threshold, F1) over scored (label, probability): of 0.01 to 0.99 the one of the greatest F1, the lowest of equal ones."""
    cell = F.floor(F.round(F.col("probability") * 100, 6)).cast("int")
    rows = scored.groupBy(cell.alias("at")).agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()  # 101 at most
    total = sum(r.good for r in rows)
    best = (0.5, 0.0)
    for t in range(1, 100):
        good, said = sum(r.good for r in rows if r["at"] >= t), sum(r.n for r in rows if r["at"] >= t)
        f1 = 2 * good / (said + total) if said + total else 0.0
        if f1 > best[1]:
            best = (t / 100, f1)
    return best


def train_by_folds(rows: DataFrame, features: list[str], group: str, folds: int = 3, depths: tuple[int, ...] = (4, 6), trees: int = 40, seed: int = 7) -> tuple[PipelineModel, DataFrame, dict[str, float]]:
    """(model, out-of-fold rows, what was chosen) over rows with group and label (0 or 1).

    Cross-validation by grouped folds chooses the depth of the trees by the area under precision and recall; the models of
    that depth score the fold that they have not seen; over these scores the threshold is chosen by F1. So no
    group counts on both sides, and the threshold is chosen on rows that no model was trained on. The model returned
    is trained on all rows. chosen: threshold, f1 (out of fold), depth.
    """
    ready = with_missing(with_folds(rows, group, folds), features)
    pipeline = _applicability(features, trees, seed)
    grid = ParamGridBuilder().addGrid(pipeline.getStages()[-1].maxDepth, list(depths)).build()
    judge = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderPR")
    found = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, foldCol="fold", collectSubModels=True, seed=seed).fit(ready)
    at = max(range(len(grid)), key=lambda k: (found.avgMetrics[k], -k))
    unseen = None
    for f in range(folds):
        scored = found.subModels[f][at].transform(ready.where(F.col("fold") == f)).withColumn("probability", F.round(vector_to_array("probability")[1], 4))
        scored = scored.select(*rows.columns, "fold", "probability")
        unseen = scored if unseen is None else unseen.unionByName(scored)
    threshold, f1 = best_threshold(unseen)
    return found.bestModel, unseen, {"threshold": threshold, "f1": f1, "depth": float(depths[at])}


def save_model(model: PipelineModel, path: str, features: list[str], threshold: float) -> None:
    """The model with the features it takes and its threshold, at path."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(features, threshold)], "features array<string>, threshold double").coalesce(1).write.mode("overwrite").json(f"{path}/chosen")


def score_saved(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """score_applicability by the model at path and its own threshold, with status SCORED; where there is no model the rows come
    back with nulls and status UNAVAILABLE, and scores of retrieval have to do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/model/metadata")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return rows.selectExpr("*", "cast(null AS double) AS probability", "cast(null AS boolean) AS applicable", "cast(null AS double) AS coverage", "'UNAVAILABLE' AS status")
    chosen = spark.read.schema("features array<string>, threshold double").json(f"{path}/chosen").first()
    return score_applicability(PipelineModel.load(f"{path}/model"), rows, chosen.features, chosen.threshold).withColumn("status", F.lit("SCORED"))


def with_missing(rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with an indicator for each feature; null counts as NaN."""
    rows = rows.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features})
    return rows.withColumns({f"{f}_missing": F.isnan(f).cast("double") for f in features})


def score_applicability(model: PipelineModel, rows: DataFrame, features: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """rows with probability (four places), applicable, and coverage (share of features that are there)."""
    scored = model.transform(with_missing(rows, features))
    p = F.round(vector_to_array("probability")[1], 4)
    coverage = F.round(1 - sum(F.col(f"{f}_missing") for f in features) / len(features), 3)
    return scored.select(*rows.columns, p.alias("probability"), (p >= threshold).alias("applicable"), coverage.alias("coverage"))


def train_text_classifier(rows: DataFrame, trees: int = 20, features: int = 5000, seed: int = 7, kind: str = "forest") -> PipelineModel:
    """TF-IDF of words and word pairs, and a random forest (or, for kind regression, a multinomial logistic regression)
    with balanced weights, over text and label (0, 1, ...)."""
    return train_text_classifiers(rows, (kind,), trees, features, seed)[kind]


def train_text_classifiers(rows: DataFrame, kinds: tuple[str, ...], trees: int = 20, features: int = 5000, seed: int = 7) -> dict[str, PipelineModel]:
    """train_text_classifier for each kind, on one set of features.

    Words and their document frequencies are those of all rows. Equal texts of one label then are one training row of their
    summed weight, so what the trees hold grows with the different texts; for a forest's samples they are one draw.
    """
    rows = rows.select("text", "label").persist()
    grouped = rows.groupBy("text", "label").agg(F.count("*").alias("n"))
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # labels are few
    total = sum(counts.values())
    weights = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, total / (len(counts) * n))])
    stages = [
        RegexTokenizer(inputCol="text", outputCol="every", pattern=r"\s+"),
        StopWordsRemover(inputCol="every", outputCol="words"),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        CountVectorizer(inputCol="words", outputCol="tf1", vocabSize=features, minDF=3),
        CountVectorizer(inputCol="pairs", outputCol="tf2", vocabSize=features, minDF=3),
        VectorAssembler(inputCols=["tf1", "tf2"], outputCol="tf"),
        IDF(inputCol="tf", outputCol="tfidf"),
    ]
    featured = Pipeline(stages=stages).fit(rows)
    # in one order in each partition, so that a seed draws the same samples in every run
    weighed = grouped.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "text").sortWithinPartitions("text", "label").withColumn("weight", F.col("n") * weights[F.col("label")])
    ready = featured.transform(weighed).select("tfidf", "label", "weight").persist()
    made = {
        "forest": RandomForestClassifier(featuresCol="tfidf", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=8, seed=seed),
        "regression": LogisticRegression(featuresCol="tfidf", labelCol="label", weightCol="weight", family="multinomial", regParam=0.01, maxIter=50),
    }
    found = {kind: PipelineModel(stages=[*featured.stages, made[kind].fit(ready)]) for kind in kinds}
    ready.unpersist()
    rows.unpersist()
    return found


def choose_text_classifier(train: DataFrame, test: DataFrame, trees: int = 20, seed: int = 7) -> tuple[PipelineModel, DataFrame]:
    """(model, report): the forest or the regression, whichever has the greater macro F1 on test; the forest if equal.

    report (model, accuracy, macro_precision, macro_recall, macro_f1, weighted_f1, chosen) has a row for each."""
    models, rows = train_text_classifiers(train, ("forest", "regression"), trees=trees, seed=seed), {}
    test = test.select("text", "label").persist()
    for kind in models:
        said = models[kind].transform(test).select(F.col("label").alias("y"), F.col("prediction").alias("p"))
        rows[kind] = classification_metrics(said).first().asDict()
    test.unpersist()
    best = max(rows, key=lambda k: (rows[k]["macro_f1"], k == "forest"))
    spark = train.sparkSession
    names = list(rows[best])
    report = spark.createDataFrame([(k, *[float(r[n]) for n in names], k == best) for k, r in rows.items()], "model string, " + ", ".join(f"{n} double" for n in names) + ", chosen boolean")
    return models[best], report
