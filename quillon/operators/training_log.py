"""Order-dependent operators over epoch logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import prefix


def running_best(log: DataFrame, run: str, epoch: str, metric: str, patience: int) -> DataFrame:
    """Adds best so far, whether the epoch improved on all before it, epochs since the last improvement, and stop.
    One run's log is one window: logs are short."""
    w = Window.partitionBy(run).orderBy(epoch)
    before = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = log.withColumn("improved", before.isNull() | (F.col(metric) > before)).withColumn("best", F.max(metric).over(w))
    out = out.withColumn("since", F.col(epoch) - F.max(F.when(F.col("improved"), F.col(epoch))).over(w))
    return out.withColumn("stop", F.col("since") >= patience)


def smoothed(log: DataFrame, run: str, epoch: str, metric: str, decay: float, few: int = prefix.FEW) -> DataFrame:
    """(run, ema): the exponential moving average after the last epoch, started at the first value.

    The recurrence ``s = decay * s + (1 - decay) * x`` is a weighted sum: x counts by decay to the power of the epochs after it.
    So epochs are numbered by many tasks and the sum is one aggregation; no run is gathered. A run with a null has none.
    Rows of one epoch come in the order of their values.
    """
    placed = prefix.numbered(log.select(F.col(run), F.col(epoch).alias("_e"), F.col(metric).cast("double").alias("_x")), [run], ["_e", "_x"], "_k", few)
    sizes = placed.groupBy(F.col(run).alias("_run")).agg(F.count("*").alias("_n"))
    met = placed.join(sizes, F.col(run).eqNullSafe(F.col("_run")))
    after = F.pow(F.lit(float(decay)), F.col("_n") - 1 - F.col("_k"))
    weight = F.when(F.col("_k") == 0, after).otherwise((1 - decay) * after)
    out = met.groupBy(run).agg(F.sum(weight * F.col("_x")).alias("ema"), F.count("_x").alias("_m"), F.max("_n").alias("_n"))
    return out.select(run, F.when(F.col("_m") == F.col("_n"), F.col("ema")).alias("ema"))


def latest(log: DataFrame, run: str, epoch: str, n: int) -> DataFrame:
    return log.withColumn("_r", F.row_number().over(Window.partitionBy(run).orderBy(F.desc(epoch)))).filter(F.col("_r") <= n).drop("_r")
