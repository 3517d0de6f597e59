"""The streamed windows are those of the whole table, over several calls and a late row."""

from pyspark.sql import functions as F

from quillon.operators import training_log
from quillon.streaming import logs, stopping


def test_follow(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    shape = "at timestamp, run string, value double"
    rows = lambda *r: spark.createDataFrame([(f"2024-01-01 {t}", k, v) for t, k, v in r], "at string, run string, value double").withColumn("at", F.to_timestamp("at"))
    how = {"time": "at", "keys": ["run"], "value": "value", "width": "10 minutes", "lateness": "5 minutes"}
    batches = [rows(("00:01:00", "a", 1.0), ("00:04:00", "b", 2.0)), rows(("00:09:00", "a", 4.0), ("00:12:00", "a", 8.0)), rows(("00:31:00", "b", 1.0)), rows(("00:02:00", "a", 99.0), ("01:00:00", "a", 0.5)), rows(("02:00:00", "a", 0.0))]
    for k, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(folder)
        logs.follow(spark, folder, shape, out, state, **how)
    logs.follow(spark, folder, shape, out, state, **how)  # nothing new, nothing twice
    whole = spark.read.parquet(folder).filter("value <> 99 and at < '2024-01-01 02:00:00'")  # the late row, and the window still open
    told = lambda d: sorted(tuple(map(str, r)) for r in d.select("start", "run", "n", "total", "best").collect())
    assert told(spark.read.parquet(out)) == told(logs.windowed(whole, **how))


SHAPE = "run string, epoch long, at string, metric double"


def _log(spark, rows):
    return spark.createDataFrame([(r, e, f"2024-01-01 {t}", m) for r, e, t, m in rows], SHAPE).withColumn("at", F.to_timestamp("at"))


def _plain(rows, patience):
    """Early stopping by a loop over each run's epochs."""
    out, runs = [], {}
    for run, epoch, at, metric in rows:
        if metric is not None:
            runs.setdefault(run, {}).setdefault(epoch, []).append((at, metric))
    for run, epochs in runs.items():
        best = best_epoch = None
        for epoch in sorted(epochs):
            metric = min(epochs[epoch])[1]
            improved = best is None or metric > best
            if improved:
                best, best_epoch = metric, epoch
            out.append((run, epoch, metric, improved, best, epoch - best_epoch, epoch - best_epoch >= patience))
    return sorted(out, key=str)


def test_early_stops_equal_the_whole_table(spark, tmp_path):
    """Out of order, repeated, in several calls: as over the whole table at once."""
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    calls = [
        [("a", 2, "00:02:00", 0.5), ("a", 1, "00:01:00", 0.4), ("b", 1, "00:01:30", 0.9), (None, 1, "00:01:00", 0.1), ("a", 9, "00:01:00", None)],
        [("a", 4, "00:04:00", 0.45), ("a", 2, "00:02:00", 0.5), ("b", 2, "00:03:00", 0.8)],  # a's second epoch again
        [("a", 3, "00:03:00", 0.6), ("a", 3, "00:03:10", 0.95), ("b", 3, "00:05:00", 0.7)],  # comes after the fourth; twice, another metric
        [("a", 5, "00:06:00", 0.2), ("b", 4, "00:07:00", 0.99), (None, 2, "00:06:30", 0.2)],
    ]
    how = {"patience": 2, "silence": "30 minutes", "lateness": "5 minutes"}
    for rows in calls:
        _log(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        stopping.follow_stops(spark, folder, out, state, **how)
    first = spark.read.parquet(out).count()
    _log(spark, [("end", 1, "00:20:00", 0.0)]).coalesce(1).write.mode("append").parquet(folder)  # moves the watermark on
    stopping.follow_stops(spark, folder, out, state, **how)
    stopping.follow_stops(spark, folder, out, state, **how)  # nothing new, nothing twice
    got = spark.read.parquet(out).filter("status = 'epoch' and (run != 'end' or run is null)").collect()
    want = _plain([r for rows in calls for r in rows], 2)
    assert sorted((tuple(r)[:7] for r in got), key=str) == want and 0 < first < len(want)
    table = spark.read.parquet(folder).filter("metric is not null and (run != 'end' or run is null)")
    once = table.groupBy("run", "epoch").agg(F.min_by("metric", F.struct("at", "metric")).alias("metric"))
    best = training_log.running_best(once, "run", "epoch", "metric", 2).select("run", "epoch", "metric", "improved", "best", "since", "stop")
    assert sorted(map(tuple, best.collect()), key=str) == want
    # Late: before the watermark. Silent: no epoch for half an hour; the run may go on.
    _log(spark, [("a", 6, "00:01:00", 1.0), ("b", 5, "01:30:00", 0.5)]).coalesce(1).write.mode("append").parquet(folder)
    stopping.follow_stops(spark, folder, out, state, **how)
    _log(spark, [("b", 6, "01:40:00", 0.4), ("a", 7, "01:40:00", 2.0)]).coalesce(1).write.mode("append").parquet(folder)
    stopping.follow_stops(spark, folder, out, state, **how)
    _log(spark, [("end", 2, "02:00:00", 0.0)]).coalesce(1).write.mode("append").parquet(folder)
    stopping.follow_stops(spark, folder, out, state, **how)
    rows = spark.read.parquet(out).collect()
    silent = {(r.run, r.epoch) for r in rows if r.status == "silent"}
    assert {("a", 5), ("b", 4), (None, 2)} <= silent and not any(r.run == "a" and r.epoch == 6 for r in rows)
    assert [(r.improved, r.best, r.since) for r in rows if r.run == "a" and r.epoch == 7] == [(True, 2.0, 0)]
    assert [(r.metric, r.since, r.stop) for r in rows if r.run == "b" and r.epoch == 6] == [(0.4, 2, True)]
