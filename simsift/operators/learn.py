"""Learned baseline: hashed words and a linear model, trained on Spark."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, RegexTokenizer, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .split import stratified_split


def fit_classifier(train: DataFrame, features: int = 1 << 12, iterations: int = 20) -> PipelineModel:
    """Fit on ``log`` and ``label``; the model adds ``predicted``."""
    index = StringIndexer(inputCol="label", outputCol="label_index", handleInvalid="keep").fit(train)
    return Pipeline(
        stages=[
            index,
            RegexTokenizer(inputCol="log", outputCol="words", pattern=r"[^A-Za-z_]+"),
            HashingTF(inputCol="words", outputCol="counts", numFeatures=features),
            IDF(inputCol="counts", outputCol="features"),
            LogisticRegression(
                featuresCol="features", labelCol="label_index", maxIter=iterations, regParam=1e-4,
                standardization=False,
            ),
            IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels),
        ]
    ).fit(train)


def fit_and_score(rows: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    """(split, total, correct, accuracy): trained on train, scored on all splits.

    The split is stored first: the passes of the fit and the scoring read its few columns and not the input again.
    """
    parts = stored(stratified_split(rows.select(*key, "log", "label"), key, seed=seed), "parts")
    model = fit_classifier(parts.filter("split = 'train'"))
    hit = F.col("predicted") == F.col("label")
    return model.transform(parts).groupBy("split").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("correct"),
        (F.count_if(hit) / F.count(F.lit(1))).alias("accuracy"),
    )
