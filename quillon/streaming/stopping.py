"""Early stopping over growing epoch logs: best so far, patience and silence, kept as state by run.

Rows (run, epoch, at, metric) wait in the run's state until the watermark has passed their time: then all earlier ones are
there, whatever order they came in. They are taken by epoch, against the best so far, as ``training_log.running_best``
does over a whole table. Defined cases:

* a row that comes again, unchanged, counts once (``dropDuplicatesWithinWatermark``); of several rows of an epoch the one of
  least time, then of least metric, counts;
* rows later than the watermark are left out, and so are epochs up to the last one taken (out of order in time);
* null metrics and times are left out; a null run is a run;
* a run that is silent for ``silence`` after its last epoch gets one row with the status "silent", and may go on later.

State and timers are in the stream's checkpoint: a call after a stop goes on where the last one ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.functions import workers

OUT = "run string, epoch long, metric double, improved boolean, best double, since long, stop boolean, status string"
NAMES = [c.split()[0] for c in OUT.split(", ")]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Patience(StatefulProcessor):
    def __init__(self, patience: int, silence_ms: int) -> None:
        self.patience, self.silence_ms = patience, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "last long, best double, best_epoch long, last_ms long, told boolean")
        self.held = handle.getMapState("held", "epoch long", "at_ms long, metric double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for epoch, at, metric in zip(batch["epoch"].tolist(), batch["at_ms"].tolist(), batch["metric"].tolist()):
                now = (int(at), float(metric))
                if self.held.containsKey((epoch,)):
                    now = min(now, tuple(self.held.getValue((epoch,))))
                self.held.updateValue((epoch,), now)
                self.handle.registerTimer(int(at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        ready = sorted((e[0], *v) for e, v in self.held.iterator() if v[0] <= passed)
        state = tuple(self.best.get()) if self.best.exists() else (None, None, None, None, False)
        last, best, best_epoch, last_ms, told = state
        out = []
        for epoch, at, metric in ready:
            self.held.removeKey((epoch,))
            if last is not None and epoch <= last:
                continue
            improved = best is None or metric > best
            if improved:
                best, best_epoch = metric, epoch
            last, last_ms, told = epoch, max(at, last_ms or at), False
            since = epoch - best_epoch
            out.append((key[0], epoch, metric, improved, best, since, since >= self.patience, "epoch"))
        if ready and last_ms is not None:
            self.handle.registerTimer(last_ms + self.silence_ms)
        elif last_ms is not None and not told and passed >= last_ms + self.silence_ms:
            told = True
            out.append((key[0], last, None, None, best, last - best_epoch, True, "silent"))
        if last is not None:
            self.best.update((last, best, best_epoch, last_ms, told))
        if out:
            yield pd.DataFrame(out, columns=NAMES).astype(object)

    def close(self) -> None:
        pass


def early_stops(rows: DataFrame, patience: int, silence: str, lateness: str) -> DataFrame:
    """(run, epoch, metric, improved, best, since, stop, status) of a stream (run, epoch, at, metric). The session needs the
    RocksDB state store (``stateful``)."""
    silence_ms = int(pd.Timedelta(silence) / pd.Timedelta(milliseconds=1))
    fine = rows.select(F.col("run").cast("string").alias("run"), F.col("epoch").cast("long").alias("epoch"), "at", F.col("metric").cast("double").alias("metric")).filter("at is not null and metric is not null and epoch is not null")
    once = fine.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["run", "epoch", "metric"])
    timed = once.withColumn("at_ms", F.unix_millis("at"))
    return timed.groupBy("run").transformWithStateInPandas(Patience(patience, silence_ms), outputStructType=OUT, outputMode="append", timeMode="EventTime")


def stateful(spark: SparkSession) -> None:
    workers.ready(spark)
    spark.conf.set(PROVIDER, ROCKS)


def follow_stops(spark: SparkSession, folder: str, out: str, checkpoint: str, patience: int, silence: str, lateness: str) -> None:
    """Takes in the Parquet files that came since the last call and appends what is decided by now."""
    stateful(spark)
    rows = spark.readStream.schema("run string, epoch long, at timestamp, metric double").parquet(folder)
    query = early_stops(rows, patience, silence, lateness).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
