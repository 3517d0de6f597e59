"""What several models get wrong together, and the online decision policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def consensus_failures(preds: DataFrame, item: list[str], least_wrong: int) -> DataFrame:
    """Items that at least so many arms get wrong: n_wrong, n_arms, the modal wrong labels (ties listed) and a tie flag."""
    votes = preds.filter("pred != target").groupBy(*item, "pred").agg(F.count("*").alias("votes"))
    top = votes.withColumn("r", F.rank().over(Window.partitionBy(*item).orderBy(F.desc("votes")))).filter("r = 1")
    modal = top.groupBy(*item).agg(F.array_sort(F.collect_list("pred")).alias("modal"))
    totals = preds.groupBy(*item).agg(F.count_if(F.col("pred") != F.col("target")).alias("n_wrong"), F.count("*").alias("n_arms"), F.min("target").alias("target"))
    out = totals.filter(F.col("n_wrong") >= least_wrong).join(modal, item)
    return out.select(*item, "target", "n_wrong", "n_arms", F.array_join(F.transform("modal", lambda x: x.cast("string")), ",").alias("modal_wrong"), (F.size("modal") > 1).alias("tie"))


def oracle_ceiling(preds: DataFrame, run: list[str], item: str, arm: str) -> DataFrame:
    """Accuracy if the best arm were known for each item, and of the best single arm."""
    any_right = preds.groupBy(*run, item).agg(F.max((F.col("pred") == F.col("target")).cast("int")).alias("ok")).groupBy(*run).agg(F.avg("ok").alias("oracle"))
    single = preds.groupBy(*run, arm).agg(F.avg((F.col("pred") == F.col("target")).cast("int")).alias("acc")).groupBy(*run).agg(F.max("acc").alias("best_arm"))
    return any_right.join(single, run)


def decide(rows: DataFrame, blur: float = 100.0, dark: float = 40.0, bright: float = 220.0, confident: float = 0.70, agree: float = 0.35) -> DataFrame:
    """status and reason of rows (blur, brightness, confidence, agreement, flagged): rejected, uncertain,
    retake_required or accepted, in that order; blurry before dark before bright."""
    reason = F.when(F.col("blur") < blur, "blurry").when(F.col("brightness") < dark, "dark").when(F.col("brightness") > bright, "bright")
    status = F.when(reason.isNotNull(), "rejected").when(F.col("confidence") < confident, "uncertain").when((F.col("agreement") < agree) | F.col("flagged"), "retake_required").otherwise("accepted")
    return rows.withColumns({"reason": reason, "status": status})


def ranked_failures(preds: DataFrame, item: list[str], run: list[str], least_wrong: int) -> DataFrame:
    """Items that at least so many arms get wrong: n_wrong, mean probability of the truth and of the modal wrong label,
    the confusion as a text (a tie is said), and their place in the run: most arms wrong first, then the surest."""
    by, wrong = [*item, *run], F.col("pred") != F.col("target")
    votes = preds.filter(wrong).groupBy(*by, "pred").agg(F.count("*").alias("v"), F.avg(1 - F.col("p_true")).alias("pm"))
    top = votes.withColumn("r", F.rank().over(Window.partitionBy(*by).orderBy(F.desc("v")))).filter("r = 1")
    modal = top.groupBy(*by).agg(F.min("pred").alias("modal"), (F.count("*") > 1).alias("tie"), F.avg("pm").alias("p_modal"))
    totals = preds.groupBy(*by).agg(F.min("target").alias("target"), F.count_if(wrong).alias("n_wrong"), F.round(F.avg("p_true"), 6).alias("p_mean"))
    label = F.concat(F.col("target").cast("string"), F.lit(" -> "), F.col("modal").cast("string"), F.when(F.col("tie"), " (tie)").otherwise(""))
    out = totals.filter(F.col("n_wrong") >= least_wrong).join(modal, by)
    place = F.row_number().over(Window.partitionBy(*run).orderBy(F.desc("n_wrong"), F.desc("p_mean"), *item))
    return out.select(*by, "target", "n_wrong", "p_mean", "p_modal", label.alias("label"), place.alias("place"))


def ceiling(preds: DataFrame, run: list[str], item: str, arm: str) -> DataFrame:
    """Items, those that one arm or all arms get wrong, the oracle's accuracy, and the best arm with its own."""
    right = (F.col("pred") == F.col("target")).cast("int")
    items = preds.groupBy(*run, item).agg(F.sum(1 - right).alias("wrong"), F.count("*").alias("arms"))
    out = items.groupBy(*run).agg(F.count("*").alias("n"), F.count_if(F.col("wrong") >= 1).alias("wrong_in_one"), F.count_if(F.col("wrong") == F.col("arms")).alias("wrong_in_all"))
    best = preds.groupBy(*run, arm).agg(F.avg(right).alias("a")).groupBy(*run).agg(F.max(F.struct("a", arm)).alias("b"))
    return out.join(best, run).select(*run, "n", "wrong_in_one", "wrong_in_all", (1 - F.col("wrong_in_all") / F.col("n")).alias("ceiling"), F.col("b.a").alias("best"), F.col(f"b.{arm}").alias("best_arm"))


def class_statistics(decided: DataFrame, label: str) -> DataFrame:
    """Of each class and over all: totals, what is eligible and accepted, confidences of what isn't rejected, and the
    share of the eligible that passes."""
    status, sure = F.col("status"), F.when(F.col("status") != "rejected", F.col("confidence"))
    d = decided.rollup(label).agg(F.count("*").alias("total"), F.count_if(~status.isin("rejected", "uncertain")).alias("eligible"), F.count_if(status == "accepted").alias("accepted"), F.min(sure).alias("confidence_min"), F.avg(sure).alias("confidence_mean"), F.max(sure).alias("confidence_max"))
    return d.select(F.coalesce(F.col(label).cast("string"), F.lit("Overall")).alias("class_name"), "total", "eligible", "accepted", "confidence_min", "confidence_mean", "confidence_max", F.try_divide(100.0 * F.col("accepted"), "eligible").alias("pass_percent"))
