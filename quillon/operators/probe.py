"""A linear probe: how well a standardised linear model tells a label from features."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.keys import md5_mod
from quillon.operators.inference import poisson_bootstrap_auc


def linear_probe(rows: DataFrame, key: str, features: str, label: str, train: str, strengths: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0), folds: int = 5, replicates: int = 2_000) -> DataFrame:
    """(auc, ci_low, ci_high, n_used, balanced_accuracy, c) on the rows whose ``train`` is false.

    L2 logistic regression with balanced class weights; its strength is chosen by AUC over folds that a hash of the key
    sets. ``key`` is unique; the label is 0 or 1 and both occur in every fold; rows with nulls are left out.
    """
    data = rows.select(F.col(key).alias("key"), array_to_vector(F.col(features).cast("array<double>")).alias("raw"), F.col(label).cast("double").alias("label"), F.col(train).alias("train")).dropna()
    data = data.withColumn("fold", md5_mod(F.concat(F.lit("fold|"), F.col("key").cast("string")), folds).cast("int"))
    fitted = data.filter("train")
    n, ones = fitted.agg(F.count("*"), F.sum("label")).first()
    fitted = fitted.withColumn("weight", F.when(F.col("label") == 1, n / (2 * ones)).otherwise(n / (2 * (n - ones))))
    model = LogisticRegression(featuresCol="x", weightCol="weight", standardization=False)
    grid = ParamGridBuilder().addGrid(model.regParam, [1 / (c * n) for c in strengths]).build()
    steps = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="x", withMean=True), model])
    best = CrossValidator(estimator=steps, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=folds, foldCol="fold", parallelism=4).fit(fitted)
    c = strengths[max(range(len(strengths)), key=lambda k: best.avgMetrics[k])]
    told = best.transform(data.filter("not train")).select("key", "label", "prediction", vector_to_array("probability")[1].alias("score"), F.lit(1).alias("g"))
    recall = lambda v: F.avg(F.when(F.col("label") == v, (F.col("prediction") == v).cast("double")))
    balanced = told.groupBy("g").agg(((recall(0.0) + recall(1.0)) / 2).alias("balanced_accuracy"))
    auc = poisson_bootstrap_auc(told.withColumn("label", F.col("label") == 1), ["g"], "score", "label", replicates)
    return auc.join(balanced, "g").drop("g").withColumn("c", F.lit(c))
