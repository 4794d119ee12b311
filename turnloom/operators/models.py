"""Supervised models over utterances with MLlib: features, learners and grouped folds."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import CountVectorizer, IDF, NGram, Normalizer, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """``df`` with fold 0..k-1, one fold per group by a hash of its text form that any engine has."""
    return df.withColumn("fold", (F.conv(F.substring(F.md5(F.col(group).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % k).cast("int"))


def with_balance(df: DataFrame, label: str) -> DataFrame:
    """``df`` with weight n / (k * n_label); the label counts are one small row per class."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("c_"))
    total = per.agg(F.sum("c_").alias("n_"), F.count(F.lit(1)).alias("k_"))
    return df.join(F.broadcast(per.join(F.broadcast(total)).select(label, (F.col("n_") / (F.col("k_") * F.col("c_"))).alias("weight"))), label)


def text_pipeline(learner: str = "lr", text: str = "text", label: str = "label", extra: tuple[str, ...] = (), vocab: int = 20_000, min_df: float = 3.0, weight: str | None = None) -> Pipeline:
    """Word 1-2-gram TF-IDF with further numeric columns, and one of majority, nb, lr, svm, rf; ``weight`` names the column of row weights, see ``with_balance``.

    The majority floor is a naive Bayes whose smoothing drowns every word, so that only the class shares are left.
    """
    words = RegexTokenizer(inputCol=text, outputCol="w_", pattern=r"[a-z']+", gaps=False)
    two = NGram(n=2, inputCol="w_", outputCol="g_")
    stages = [StringIndexer(inputCol=label, outputCol="y_", handleInvalid="skip", stringOrderType="alphabetAsc"), words, two]
    for c in ("w", "g"):
        stages += [CountVectorizer(inputCol=f"{c}_", outputCol=f"{c}c_", vocabSize=vocab, minDF=min_df), IDF(inputCol=f"{c}c_", outputCol=f"{c}i_"), Normalizer(inputCol=f"{c}i_", outputCol=f"{c}n_")]
    stages.append(VectorAssembler(inputCols=["wn_", "gn_", *extra], outputCol="x_"))
    common = {"featuresCol": "x_", "labelCol": "y_"}
    if weight:
        common["weightCol"] = weight
    last = {
        "majority": lambda: NaiveBayes(smoothing=1e12, **common), "nb": lambda: NaiveBayes(smoothing=0.3, **common), "lr": lambda: LogisticRegression(regParam=0.01, maxIter=60, **common),
        "svm": lambda: OneVsRest(classifier=LinearSVC(regParam=0.01, maxIter=40), **common), "rf": lambda: RandomForestClassifier(numTrees=50, maxDepth=8, seed=1, **common),
    }[learner]()
    return Pipeline(stages=[*stages, last])


def fit_and_predict(train: DataFrame, test: DataFrame, learner: str, **options) -> tuple[PipelineModel, DataFrame]:
    """The fitted pipeline, and ``test`` with actual and predicted label names."""
    model = text_pipeline(learner, **options).fit(train)
    labels = model.stages[0].labels
    named = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1)
    return model, model.transform(test).select("*", named.alias("predicted"))


def out_of_fold(folds: DataFrame, learner: str, label: str = "label", k: int = 5, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """``(keep, label, predicted)`` of every row, each fold predicted by a fit on the others; rows of a class that the others lack count as '(not predicted)'."""
    out = None
    for i in range(k):
        train, test = folds.where(F.col("fold") != i), folds.where(F.col("fold") == i)
        if test.isEmpty():
            continue
        model, got = fit_and_predict(train, test, learner, label=label, **options)
        known = got.select(*keep, label, "predicted")
        unseen = test.where(~F.col(label).isin(model.stages[0].labels)).select(*keep, label, F.lit("(not predicted)").alias("predicted"))
        out = known.union(unseen) if out is None else out.union(known).union(unseen)
    return folds.select(*keep, label, F.lit(None).cast("string").alias("predicted")).limit(0) if out is None else out


def mlp_layers(n_inputs: int, n_classes: int, hidden: int = 128) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(featuresCol="x_", labelCol="y_", layers=[n_inputs, hidden, n_classes], seed=1)
