"""Summaries over seeds, groups and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import prefix


def seed_summary(rows: DataFrame, by: list[str], seed: str, metrics: list[str]) -> DataFrame:
    """Distinct seeds, mean and sample deviation of each metric; one seed has a null deviation."""
    aggs = [f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return rows.groupBy(*by).agg(F.count_distinct(seed).alias("n_seeds"), *aggs)


def robustness(rows: DataFrame, run: list[str], condition: str, metric: str, clean: str = "clean") -> DataFrame:
    """Clean value, mean, worst and worst condition under stress, drop and mean ratio to clean."""
    own = rows.filter(F.col(condition) == clean).select(*run, F.col(metric).alias("clean"))
    met = rows.filter(F.col(condition) != clean).join(own, run)
    worst = F.min(F.struct(F.col(metric), F.col(condition))).alias("w")
    out = met.groupBy(*run, "clean").agg(F.avg(metric).alias("mean_stress"), worst, F.avg(F.try_divide(metric, "clean")).alias("mean_ratio"))
    return out.select(*run, "clean", "mean_stress", F.col(f"w.{metric}").alias("worst"), F.col(f"w.{condition}").alias("worst_condition"), (F.col("clean") - F.col("mean_stress")).alias("drop"), "mean_ratio")


def percentiles(rows: DataFrame, by: list[str], value: str, at: dict[str, float], few: int = prefix.FEW) -> DataFrame:
    """(by, n, one column for each of ``at``): percentiles by linear interpolation, nulls left out. Rows are counted by
    value first and the counts summed up in order by many tasks, so no buffer and no task holds a group."""
    counted = rows.groupBy(*by, F.col(value).alias("_v")).agg(F.count(value).alias("_c"))
    cells = prefix.prefix_sums(counted, by, ["_v"], {"_lo": "_c"}, few)
    sizes = cells.groupBy(*by).agg(F.sum("_c").alias("_n"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"c.{c}").eqNullSafe(F.col(f"s.{c}"))
    cells = cells.alias("c").join(sizes.alias("s"), same).select("c.*", "s._n") if by else cells.join(F.broadcast(sizes))  # one row
    held = lambda k: (F.col("_lo") <= k) & (k < F.col("_lo") + F.col("_c"))
    place = {name: (F.col("_n") - 1) * F.lit(float(p)) for name, p in at.items()}
    ends = [F.max(F.when(held(f(x)), F.col("_v").cast("double"))).alias(f"_{name}{k}") for name, x in place.items() for k, f in enumerate((F.floor, F.ceil))]
    out = cells.groupBy(*by).agg(F.max("_n").alias("_n"), *ends)
    return out.select(*by, F.col("_n").alias("n"), *((F.col(f"_{name}0") + (F.col(f"_{name}1") - F.col(f"_{name}0")) * (x - F.floor(x))).alias(name) for name, x in place.items()))


def percentile_bands(rows: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Percentiles by linear interpolation."""
    return percentiles(rows, by, value, at)


def best_with_ties(rows: DataFrame, block: list[str], value: str, digits: int) -> DataFrame:
    """Adds whether the rounded value is the block's largest."""
    r = F.round(value, digits)
    return rows.withColumn("is_best", r == F.max(r).over(Window.partitionBy(*block)))


def stratified_sample(rows: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """At most n rows a group, in the order of a hash of key and seed; the feature is the cap."""
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary"))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(draw, key))).filter(F.col("_r") <= n).drop("_r")


def value_shares(rows: DataFrame, column: str) -> DataFrame:
    """(value, n, share) of a column of few values."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counts.crossJoin(counts.agg(F.sum("n").alias("_all"))).select(column, "n", (F.col("n") / F.col("_all")).alias("share"))  # one row


def distribution(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, metric, n, median, q25, q75) of each metric; nulls don't count."""
    long = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))).alias("m")).select(*by, "m.metric", "m.value")
    return percentiles(long, [*by, "metric"], "value", {"median": 0.5, "q25": 0.25, "q75": 0.75})


def stage_latency(rows: DataFrame, stage: str, value: str, order: list[str], warm_up: int, network: float) -> DataFrame:
    """Mean latency of each stage without its first rounds, the total over stages, and that with the network's share.
    Rows need a total order. The last warm-up round is a grouped limit, which keeps a few rows a stage before the shuffle;
    stages are few."""
    first = rows.select(stage, *order).withColumn("_k", F.row_number().over(Window.partitionBy(stage).orderBy(*order))).filter(F.col("_k") <= warm_up)
    edge = first.groupBy(F.col(stage).alias("_s")).agg(F.max(F.struct(*order)).alias("_edge"))
    late = rows.join(F.broadcast(edge), F.col(stage).eqNullSafe(F.col("_s"))).filter(F.struct(*order) > F.col("_edge"))
    s = late.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("n"), F.avg(value).alias("mean_ms"))
    return s.crossJoin(s.agg(F.sum("mean_ms").alias("total_ms"))).withColumn("end_to_end_ms", F.col("total_ms") + network)  # one row


def in_declared_order(rows: DataFrame, column: str, order: list[str], last: int = 10_000) -> DataFrame:
    """Adds ``pos``, the place declared (unknown values last), and ``k``, the place among these few rows."""
    said = rows.sparkSession.createDataFrame(list(zip(order, range(len(order)))), f"{column} string, pos int")
    placed = rows.join(F.broadcast(said), column, "left").withColumn("pos", F.coalesce("pos", F.lit(last)))
    return placed.withColumn("k", F.row_number().over(Window.orderBy("pos", column)))


def mean_and_deviation(mean: str, deviation: str, digits: int) -> Column:
    """``mean ± deviation`` as a text; a null deviation (one seed) is left out."""
    number = f"%.{digits}f"
    return F.when(F.col(deviation).isNull(), F.format_string(number, mean)).otherwise(F.format_string(f"{number} ± {number}", mean, deviation))


def bounded_sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """At most n rows in the order of a hash of key and seed; the limit is the feature. A task sends n rows at most."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary")), key).limit(n)
