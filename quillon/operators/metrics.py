"""Classification metrics from a long prediction table: run columns, target, pred."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import prefix


def confusion(preds: DataFrame, run: list[str], classes: int) -> DataFrame:
    """Counts on the whole grid, zero cells included."""
    spark = preds.sparkSession
    labels = spark.range(classes).select(F.col("id").cast("int").alias("target"))
    grid = preds.select(*run).distinct().crossJoin(F.broadcast(labels)).crossJoin(F.broadcast(labels.withColumnRenamed("target", "pred")))
    found = preds.groupBy(*run, "target", "pred").agg(F.count("*").alias("n"))
    return grid.join(found, [*run, "target", "pred"], "left").na.fill(0, ["n"])


def per_class(preds: DataFrame, run: list[str], classes: int) -> DataFrame:
    """support, predicted, tp, precision, recall, f1 of every class; a zero denominator gives 0."""
    cells = confusion(preds, run, classes)
    t = cells.groupBy(*run, F.col("target").alias("class_idx")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("target") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    p = cells.groupBy(*run, F.col("pred").alias("class_idx")).agg(F.sum("n").alias("predicted"))
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = t.join(p, [*run, "class_idx"])
    return out.select(*run, "class_idx", "support", "predicted", "tp", over(F.col("tp"), F.col("predicted")).alias("precision"), over(F.col("tp"), F.col("support")).alias("recall"), over(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))


def averages(preds: DataFrame, run: list[str], classes: int) -> DataFrame:
    """accuracy, weighted F1 and both macro F1: over all classes, and over those in targets or predictions."""
    seen = (F.col("support") > 0) | (F.col("predicted") > 0)
    return per_class(preds, run, classes).groupBy(*run).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1_fixed"), F.avg(F.when(seen, F.col("f1"))).alias("macro_f1_observed"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.sum("support").alias("n"),
    )


def binary_auc(scores: DataFrame, group: list[str], score: str, label: str, few: int = prefix.FEW) -> DataFrame:
    """Mann-Whitney AUC with average ranks; null where a class is missing. Scores are ranked after being counted by
    value, so ties and repeated rows cost one row, and a group's values are ranked by many tasks."""
    cells = scores.groupBy(*group, score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    ranked = prefix.prefix_sums(cells, group, [score], {"before": "n"}, few).withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*group).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return sums.select(*group, F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))


def class_weights(rows: DataFrame, column: str) -> DataFrame:
    """Inverse frequencies scaled to mean 1."""
    found = rows.groupBy(column).agg(F.count("*").alias("n"))
    return found.withColumn("raw", 1.0 / F.greatest("n", F.lit(1))).withColumn("weight", F.col("raw") / F.avg("raw").over(Window.partitionBy())).drop("raw")


def batch_log_loss(rows: DataFrame, run: list[str], batch: str, p_true: str, weight: str, least: float = 1e-12) -> DataFrame:
    """Cross-entropy with class weights, averaged within batches by weight and over batches by size."""
    loss = -F.ln(F.greatest(p_true, F.lit(least)))
    each = rows.groupBy(*run, batch).agg((F.sum(loss * F.col(weight)) / F.sum(weight)).alias("loss"), F.count("*").alias("n"))
    return each.groupBy(*run).agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("log_loss"))
