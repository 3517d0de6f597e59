"""Paired comparisons of prediction tables."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.keys import md5_mod
from quillon.functions import workers
from quillon.operators import prefix
from quillon.operators.graph import written
from quillon.operators.metrics import averages, binary_auc


def contingency(pairs: DataFrame, group: list[str], a: str = "ok_a", b: str = "ok_b") -> DataFrame:
    """both, a_only, b_only, neither of two correctness flags, and the error-overlap coefficient."""
    x, y = F.col(a), F.col(b)
    out = pairs.groupBy(*group).agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("a_only"), F.count_if(~x & y).alias("b_only"), F.count_if(~x & ~y).alias("neither"))
    bt, ao, bo, ne = (F.col(c).cast("double") for c in ("both", "a_only", "b_only", "neither"))
    return out.withColumn("phi", F.try_divide(ne * bt - ao * bo, F.sqrt((ne + ao) * (bo + bt) * (ne + bo) * (ao + bt))))


def mcnemar(counts: DataFrame, a: str = "a_only", b: str = "b_only") -> DataFrame:
    """Adds the exact two-sided p-value of the discordant counts (binomial with one half)."""
    n, k = (F.col(a) + F.col(b)).cast("int"), F.least(a, b).cast("int")
    # Each term's logarithm from the last one: n over i + 1 is n over i times (n - i) / (i + 1).
    first = F.struct(F.exp(-n * math.log(2)).alias("sum"), (-n * math.log(2)).alias("log"))
    step = lambda s, i: F.struct((s["sum"] + F.exp(s["log"] + F.ln((n - i + 1) / i))).alias("sum"), (s["log"] + F.ln((n - i + 1) / i)).alias("log"))
    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), first, step)["sum"]
    return counts.withColumn("p_value", F.least(F.lit(1.0), 2 * tail))


def spearman(rows: DataFrame, group: list[str], x: str, y: str, few: int = prefix.FEW) -> DataFrame:
    """Correlation of average ranks, null first; null where a side has one value. Rows are counted by both values, and each
    value's ranks are summed up by many tasks."""
    cells = rows.groupBy(*group, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_w"))
    size = rows.groupBy(*group).agg(F.count("*").alias("_n"))
    at = lambda c: prefix.average_ranks(rows.select(*group, F.col(c).alias("_v")), group, "_v", "_r", few)

    def met(left: DataFrame, right: DataFrame, pairs: dict[str, str]) -> DataFrame:
        on = F.lit(True)
        for a, b in pairs.items():
            on = on & F.col(f"l.{a}").eqNullSafe(F.col(f"r.{b}"))
        taken = [c for c in right.columns if c not in pairs.values()]
        return left.alias("l").join(right.alias("r"), on).select("l.*", *(f"r.{c}" for c in taken))

    same = {g: g for g in group}
    cells = met(met(cells, at(x).drop("n_rows").withColumnRenamed("_r", "_rx"), same | {"_x": "_v"}), at(y).drop("n_rows").withColumnRenamed("_r", "_ry"), same | {"_y": "_v"})
    cells = met(cells, size, same)
    middle = (F.col("_n") + 1) / 2
    a, b, w = F.col("_rx") - middle, F.col("_ry") - middle, F.col("_w")
    sums = cells.groupBy(*group).agg(F.sum(w * a * b).alias("_ab"), F.sum(w * a * a).alias("_aa"), F.sum(w * b * b).alias("_bb"))
    return sums.select(*group, F.try_divide("_ab", F.sqrt(F.col("_aa")) * F.sqrt(F.col("_bb"))).alias("rho"))


PIECE = 4096  # draws that are made from one row


def resamples(sizes: DataFrame, group: list[str], key: str, replicates: int) -> DataFrame:
    """(group, rep, key): n draws from 0..n-1 for each replicate of a group of n; a draw is a hash of (replicate, position). Pieces
    of a replicate are dealt to all tasks before they are drawn."""
    spark = sizes.sparkSession
    pieces = sizes.select(*group, "n").join(spark.range(replicates).withColumnRenamed("id", "rep"))
    pieces = pieces.filter("n > 0").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long"))))
    pieces = pieces.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rep", "at")
    draws = pieces.select(*group, "rep", "n", F.explode(F.sequence("at", F.least(F.col("at") + PIECE, F.col("n")) - 1)).alias("pos"))
    return draws.select(*group, "rep", (md5_mod(F.concat_ws("|", F.col("rep").cast("string"), F.col("pos").cast("string")), 1 << 32) % F.col("n")).alias(key))


def _drawn(rows: DataFrame, sizes: DataFrame, group: list[str], key: str, replicates: int) -> DataFrame:
    """Rows (group, key, ...) once for each draw, with ``rep``. Groups of one size have the same draws, which are made once;
    they go by the key to the rows, which no task holds whole and the driver doesn't see."""
    draws = resamples(sizes.select(F.col("n").alias("_n")).distinct().withColumn("n", F.col("_n")), ["_n"], key, replicates)
    sized = rows.join(sizes.select(*group, F.col("n").alias("_n")), group)
    return draws.join(sized.hint("shuffle_hash"), ["_n", key]).drop("_n")


def _interval_of_ranges(placed: DataFrame, run: Callable, group: list[str], level: float) -> DataFrame:
    """(group, auc, ci_low, ci_high, n_used) of what ``run`` tells of each range of a group: by replicate, the first being the rows
    themselves, the pairs won within the range and the positive and negative weight."""
    key = placed.schema["_key"].dataType.simpleString()
    told = placed.mapInArrow(run, f"_key {key}, _part int, won array<double>, positive array<double>, negative array<double>")
    each = told.select("_key", "_part", F.posexplode(F.arrays_zip("won", "positive", "negative")).alias("rep", "x")).select("_key", "_part", "rep", "x.*")
    # one row a replicate and range of a group: as few as ranges times replicates
    earlier = F.coalesce(F.sum("negative").over(Window.partitionBy("_key", "rep").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    auc = each.withColumn("won", F.col("won") + F.col("positive") * earlier).groupBy("_key", "rep").agg(F.try_divide(F.sum("won"), F.sum("positive") * F.sum("negative")).alias("auc"))
    low, high = (1 - level) / 2, (1 + level) / 2
    drawn = F.when(F.col("rep") > 0, F.col("auc"))
    out = auc.groupBy("_key").agg(F.max(F.when(F.col("rep") == 0, F.col("auc"))).alias("auc"), F.percentile(drawn, F.array(F.lit(low), F.lit(high))).alias("ci"), F.count(drawn).alias("n_used"))
    return out.select(*(F.col("_key")[c].alias(c) for c in group), "auc", F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"), "n_used")


BUCKET, TOGETHER = 4096, 64  # neighbouring keys whose draws meet in one task; replicates that are drawn from one row


def resample_weights(sizes: DataFrame, key: str, replicates: int) -> DataFrame:
    """(n, key, w): how often each of n rows is drawn in each replicate, for every n of ``sizes`` once: the draws of ``resamples``,
    counted. w has one unsigned number a replicate, all of the least width that holds a bucket's. Draws go to their
    bucket of keys as packed numbers, so a task holds the counts of one bucket, whatever n is. Buckets that nobody drew
    are left out."""
    if BUCKET * replicates >= 1 << 32:
        raise ValueError(f"more than {(1 << 32) // BUCKET - 1} replicates")
    spark = sizes.sparkSession
    workers.bounded(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = sizes.select("n").distinct().crossJoin(F.broadcast(spark.range(0, replicates, TOGETHER).withColumnRenamed("id", "rep")))  # some dozens of rows
    pieces = pieces.filter("n > 0").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long"))))
    pieces = pieces.select(F.col("n").cast("long").alias("n"), "rep", "at").repartition(tasks, "rep", "at")

    def draw(batches):
        for batch in batches:
            for n, rep, at in zip(*(batch.column(c).to_pylist() for c in ("n", "rep", "at"))):
                last, end = min(rep + TOGETHER, replicates), min(at + PIECE, n)
                places = [b"%d" % k for k in range(at, end)]
                drawn = np.frombuffer(b"".join(hashlib.md5(b"%d|%b" % (r, k)).digest()[:4] for r in range(rep, last) for k in places), ">u4").astype(np.int64) % n
                packed = (drawn % BUCKET * replicates + np.repeat(np.arange(rep, last), end - at)).astype("<u4")
                order = np.argsort(drawn // BUCKET, kind="stable")
                found, starts = np.unique((drawn // BUCKET)[order], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(found), pa.int64()), pa.array(found, pa.int64()), pa.array([x.tobytes() for x in np.split(packed[order], starts[1:])], pa.binary())], ["n", "bucket", "draws"])

    def count(batches):
        at, sums = None, None

        def told():
            n, bucket = at
            width = next(w for w in ("<u1", "<u2", "<u4") if sums.max() <= np.iinfo(w).max)
            for k in range(0, len(sums), 512):
                part = sums[k : k + 512].astype(width)
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(part), pa.int64()), pa.array(np.arange(len(part)) + bucket * BUCKET + k, pa.int64()), pa.array([x.tobytes() for x in part], pa.binary())], ["n", key, "w"])

        for batch in batches:
            for n, bucket, draws in zip(batch.column("n").to_pylist(), batch.column("bucket").to_pylist(), batch.column("draws")):
                if at != (n, bucket):
                    if at is not None:
                        yield from told()
                    at, sums = (n, bucket), np.zeros((min(BUCKET, n - bucket * BUCKET), replicates), np.uint32)
                np.add.at(sums.reshape(-1), np.frombuffer(draws.as_buffer(), "<u4"), np.uint32(1))
        if at is not None:
            yield from told()

    met = pieces.mapInArrow(draw, "n long, bucket long, draws binary").repartition(tasks, "n", "bucket").sortWithinPartitions("n", "bucket")
    return met.mapInArrow(count, f"n long, `{key}` long, w binary")


def bootstrap_auc(rows: DataFrame, group: list[str], key: str, score: str, label: str, replicates: int, level: float = 0.95) -> DataFrame:
    """(group, auc, ci_low, ci_high, n_used): AUC with the percentile interval of its resamples; replicates that lack a class are
    left out and counted. ``key`` numbers the rows of a group from 0.

    Each row carries its number of draws in all replicates. Rows lie in ranges of the score; a task goes along its range
    with one running sum a replicate, as in ``poisson_bootstrap_auc``, so neither draws nor ranks are rows of a shuffle. Null
    scores come first, null labels count as false.
    """
    sizes = written(rows.groupBy(*group).agg(F.count("*").alias("n")))
    sized = rows.select(*group, F.col(key).cast("long").alias("_k"), F.col(score).alias("_s"), F.coalesce(label, F.lit(False)).alias("_p")).join(sizes, group)
    weighted = sized.join(resample_weights(sizes, "_k", replicates).hint("merge"), ["n", "_k"], "left")
    placed = prefix.ranges(weighted, group, ["_s"]).select("_key", "_g", "_part", F.xxhash64(F.col("_s").cast("double") + 0.0).alias("tie"), "_p", "w")
    size, chunk = replicates + 1, max(1, (1 << 20) // (replicates + 1))

    def run(batches):
        at, sums, tie, same = None, None, None, None

        def close() -> None:
            sums[0] += same[0] * (sums[2] + same[1] / 2)  # ties count half
            sums[1:] += same
            same[:] = 0

        def told() -> pa.RecordBatch:
            close()
            return pa.RecordBatch.from_arrays([at[1], at[2], *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in sums)], ["_key", "_part", "won", "positive", "negative"])

        for batch in batches:
            for low in range(0, batch.num_rows, chunk):
                part = batch.slice(low, chunk)
                g, t, ok = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_g", "tie", "_p"))
                w = np.zeros((len(g), size))
                w[:, 0] = 1  # the rows themselves
                for k, x in enumerate(part.column("w")):
                    if x.is_valid:
                        told_of = x.as_buffer()
                        w[k, 1:] = np.frombuffer(told_of, f"<u{told_of.size // replicates}")
                cuts = np.r_[0, np.flatnonzero((g[1:] != g[:-1]) | (t[1:] != t[:-1])) + 1]
                every, right = np.add.reduceat(w, cuts, 0), np.add.reduceat(w * ok[:, None], cuts, 0)
                for k, cut in enumerate(cuts):
                    if at is None or at[0] != g[cut]:
                        if at is not None:
                            yield told()
                        at, sums, same = (g[cut], part.column("_key").slice(cut, 1), part.column("_part").slice(cut, 1)), np.zeros((3, size)), np.zeros((2, size))
                    elif tie != t[cut]:
                        close()
                    tie = t[cut]
                    same[0] += right[k]
                    same[1] += every[k] - right[k]
        if at is not None:
            yield told()

    return _interval_of_ranges(placed, run, group, level)


def fisher_exact(counts: DataFrame, cells: tuple[str, str, str, str]) -> DataFrame:
    """Adds the two-sided p-value of a 2x2 table: all tables with its margins that are no likelier than it."""

    @F.pandas_udf("double")
    def p_value(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

        def one(a: int, b: int, c: int, d: int) -> float:
            rows, cols, n = a + b, a + c, a + b + c + d
            log = lambda k: choose(rows, k) + choose(n - rows, cols - k) - choose(n, cols)
            seen = log(a) + 1e-7
            return min(1.0, sum(math.exp(x) for k in range(max(0, rows + cols - n), min(rows, cols) + 1) if (x := log(k)) <= seen))

        return pd.Series([one(*map(int, r)) for r in zip(a, b, c, d)], dtype="float64")

    return counts.withColumn("fisher_p", p_value(*cells))


def _subset_tail(u: float, a: int, b: int) -> float:
    """Two-sided exact p-value of u without ties: the share of rank sets at least as far out, doubled, at most 1."""
    few, many = min(a, b), max(a, b)
    ways = [1]  # ways[s]: sets of the ranks so far whose excess over the least sum is s
    for k in range(1, few + 1):  # times (1 - x^(many + k)) / (1 - x^k), in whole numbers
        long = ways + [0] * (many + k)
        for s in range(len(ways)):
            long[s + many + k] -= ways[s]
        for s in range(k, len(long)):
            long[s] += long[s - k]
        ways = long[: few * many + 1]
    far = int(max(u, a * b - u))
    return min(1.0, 2 * sum(ways[far:]) / sum(ways))


def mann_whitney(rows: DataFrame, group: list[str], value: str, flag: str, exact: int = 8, most: int = 20_000) -> DataFrame:
    """u of the flagged rows, the tie-corrected z with continuity correction, and the two-sided p-value: the normal one,
    or the exact one if a side has at most ``exact`` rows, no values tie, and u has at most ``most`` values. Rows are
    counted by value first. A missing side, or all values equal, gives null z and p."""

    @F.pandas_udf("double")
    def tail(z: pd.Series, u: pd.Series, a: pd.Series, b: pd.Series, ties: pd.Series) -> pd.Series:
        def one(z, u, a, b, ties):
            if pd.isna(z):
                return None
            if ties == 0 and min(a, b) <= exact and a * b <= most:
                return _subset_tail(u, int(a), int(b))
            return math.erfc(z / math.sqrt(2))

        return pd.Series([one(*r) for r in zip(z, u, a, b, ties)], dtype="float64")

    cells = rows.groupBy(*group, value).agg(F.count("*").alias("t"), F.sum(F.col(flag).cast("long")).alias("k"))
    cells = prefix.prefix_sums(cells, group, [value], {"before": "t"})
    t = F.col("t").cast("double")
    sums = cells.withColumn("rank", F.col("before") + (F.col("t") + 1) / 2).groupBy(*group).agg(F.sum(F.col("rank") * F.col("k")).alias("r"), F.sum("k").alias("a"), F.sum("t").alias("n"), F.sum(t * t * t - t).alias("ties"))
    a, n = F.col("a").cast("double"), F.col("n").cast("double")
    b = n - a
    sums = sums.withColumn("u", F.col("r") - a * (a + 1) / 2)
    spread = F.sqrt(a * b / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    sums = sums.withColumn("z", F.greatest(F.lit(0.0), F.try_divide(F.abs(F.col("u") - a * b / 2) - 0.5, spread)))
    sums = sums.withColumn("z", F.when(spread > 0, F.col("z")))
    return sums.select(*group, "u", "z", tail("z", "u", a, b, "ties").alias("p_value"))


def alignment(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """How far two runs' rows match by key: rows on one side only, shared ones, and shared ones with other labels."""
    x, y = a.select(key, F.col(label).alias("_a"), F.lit(1).alias("_l")), b.select(key, F.col(label).alias("_b"), F.lit(1).alias("_r"))
    left, right = F.col("_l").isNotNull(), F.col("_r").isNotNull()
    return x.join(y, key, "full_outer").agg(F.count_if(left & ~right).alias("n_left_only"), F.count_if(right & ~left).alias("n_right_only"), F.count_if(left & right).alias("n_both"), F.count_if(left & right & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("n_label_mismatch"))


def reproduction(pairs: DataFrame, group: list[str], old: str, new: str, margin: str, flips: int = 2, near: float = 1e-3) -> DataFrame:
    """Whether scores were reproduced: exact, within (few flips, all nearly tied) or failed."""
    flip = ~F.col(old).eqNullSafe(F.col(new))
    out = pairs.groupBy(*group).agg(F.count_if(flip).alias("n_flips"), F.max(F.when(flip, F.col(margin))).alias("flip_margin"))
    return out.withColumn("verdict", F.when(F.col("n_flips") == 0, "exact").when((F.col("n_flips") <= flips) & (F.col("flip_margin") <= near), "within").otherwise("failed"))


def bootstrap_accuracy(pairs: DataFrame, group: list[str], key: str, replicates: int, level: float = 0.95) -> DataFrame:
    """Percentile interval of the accuracy difference of ok_a and ok_b over paired resamples.

    ``key`` numbers the rows of a group from 0. A draw is a hash of (replicate, position), the same for both sides;
    draws are summed by replicate as they are made.
    """
    rows = pairs.select(*group, key, (F.col("ok_b").cast("int") - F.col("ok_a").cast("int")).alias("d"))
    sizes = written(rows.groupBy(*group).agg(F.count("*").alias("n"), F.avg("d").alias("observed")))
    stats = _drawn(rows, sizes, group, key, replicates).groupBy(*group, "rep").agg(F.avg("d").alias("delta"))
    low, high = (1 - level) / 2, (1 + level) / 2
    out = stats.groupBy(*group).agg(F.percentile("delta", F.array(F.lit(low), F.lit(high))).alias("ci"), F.avg((F.col("delta") > 0).cast("int")).alias("fraction_above"), F.stddev_samp("delta").alias("se"))
    return out.join(sizes, group).select(*group, "observed", F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"), "fraction_above", (2.801585 * F.col("se")).alias("mde80"))


def power(hits: DataFrame, arm: str, item: str, hit: str, replicates: int) -> DataFrame:
    """(a, b, se, mde80, median_mde80) of the hit-rate difference of every pair of arms, all from one set of resamples.

    Items are numbered by id by many tasks; every arm holds every item. A pair's resamples need only each item's
    difference and its weight in the replicate, so weights are summed before they meet the arms; arms are few. Tables as
    long as the items are merged, however small they are thought to be: the driver sees none of them.
    """
    ids = hits.select(item).distinct()
    numbered = prefix.numbered(ids, [], [item], "_k")
    size = ids.agg(F.count("*").alias("n")).withColumn("g", F.lit(1))
    weights = resamples(size, ["g"], "_k", replicates).groupBy("rep", "_k").agg(F.count("*").alias("w"))
    own = hits.join(numbered.hint("merge"), item).select(arm, "_k", hit)
    left, right = own.select(F.col(arm).alias("a"), "_k", F.col(hit).alias("_x")), own.select(F.col(arm).alias("b"), "_k", F.col(hit).alias("_y"))
    each = left.join(right.hint("merge"), "_k").filter("a < b").select("a", "b", "_k", (F.col("_y") - F.col("_x")).alias("d")).join(weights.hint("merge"), "_k")
    deltas = each.groupBy("a", "b", "rep").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("delta"))
    se = deltas.groupBy("a", "b").agg(F.stddev_samp("delta").alias("se"))
    return se.crossJoin(se.agg((2.801585 * F.percentile("se", F.lit(0.5))).alias("median_mde80"))).withColumn("mde80", 2.801585 * F.col("se"))  # one row


def _macro_f1(target: np.ndarray, pred: np.ndarray, weights: np.ndarray, classes: int) -> np.ndarray:
    """Fixed-label macro-F1 of each row of weights over cells (target, pred); classes without rows give 0."""
    total = np.zeros(len(weights))
    for c in range(classes):
        tp = weights[:, (target == c) & (pred == c)].sum(1)
        both = weights[:, target == c].sum(1) + weights[:, pred == c].sum(1)
        total += np.divide(2 * tp, both, out=np.zeros(len(weights)), where=both > 0)
    return total / classes


def _accuracy(target: np.ndarray, pred: np.ndarray, weights: np.ndarray, classes: int) -> np.ndarray:
    return weights[:, pred == target].sum(1) / weights.sum(1)


#: A metric takes the targets and predictions of cells, a weight for each replicate and cell, and the number of classes.
Metric = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]
METRICS: dict[str, Metric] = {"macro_f1": _macro_f1, "accuracy": _accuracy}


def replicate_deltas(target: np.ndarray, a: np.ndarray, b: np.ndarray, counts: np.ndarray, metric: Metric, classes: int, replicates: int, seed: list[int]) -> tuple[float, np.ndarray]:
    """The metric's difference, b less a, of the counts themselves and of multinomial draws of them."""
    drawn = np.random.default_rng(seed).multinomial(int(counts.sum()), counts / counts.sum(), replicates)
    delta = lambda w: metric(target, b, w, classes) - metric(target, a, w, classes)
    return float(delta(counts[None].astype(float))[0]), delta(drawn)


def paired_bootstrap(pairs: DataFrame, group: str, classes: int, replicates: int, metric: str | Metric = "macro_f1", level: float = 0.95, seed: int = 1, part: int = 500, weight: str | None = None) -> DataFrame:
    """(group, n, observed, delta_mean, delta_std, ci_low, ci_high, fraction_above, excludes_zero, mde80) of the metric's
    difference, b less a, over paired resamples of rows (group, target, a, b).

    ``metric`` is macro_f1 (over ``classes`` fixed labels), accuracy or a function of one's own (see ``Metric``). All depend
    on the counts of (target, a, b) alone, of which there are classes**3 at most. So rows are counted first, and a replicate is one multinomial draw of these counts,
    the same for both sides: the very distribution of resampled rows, at a cost that doesn't depend on their number.
    Replicates are drawn in parts by the tasks. ``weight`` names a column by which a row stands for several.
    """
    if not callable(metric) and metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    found = metric if callable(metric) else METRICS[metric]
    workers.ready(pairs.sparkSession)
    kind = pairs.schema[group].dataType.simpleString()
    many = F.sum(weight) if weight else F.count("*")
    cells = pairs.groupBy(group).agg(many.alias("n")).join(
        pairs.groupBy(group, "target", "a", "b").agg(many.alias("c")).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("target", "a", "b", "c"))).alias("cells")), group
    )
    parts = cells.join(pairs.sparkSession.range(-(-replicates // part)).select(F.col("id").alias("part")), how="cross")  # a group's replicates, few rows

    def draw(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                y, a, b, counts = (np.array([x[k] for x in row["cells"]]) for k in ("target", "a", "b", "c"))
                size = min(part, replicates - row["part"] * part)
                observed, deltas = replicate_deltas(y, a, b, counts, found, classes, size, [seed, int(row["part"]), zlib.crc32(str(row[group]).encode())])
                out.append((row[group], row["n"], observed, deltas.tolist()))
            yield pd.DataFrame(out, columns=[group, "n", "observed", "deltas"])

    drawn = parts.repartition("part").mapInPandas(draw, f"{group} {kind}, n long, observed double, deltas array<double>")
    each = drawn.select(group, "n", "observed", F.explode("deltas").alias("d"))
    low, high = (1 - level) / 2, (1 + level) / 2
    out = each.groupBy(group).agg(F.max("n").alias("n"), F.max("observed").alias("observed"), F.avg("d").alias("delta_mean"), F.stddev_samp("d").alias("delta_std"), F.percentile("d", F.array(F.lit(low), F.lit(high))).alias("ci"), F.avg((F.col("d") > 0).cast("int")).alias("fraction_above"))
    out = out.select(group, "n", "observed", "delta_mean", "delta_std", F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"), "fraction_above")
    return out.withColumns({"excludes_zero": (F.col("ci_low") > 0) | (F.col("ci_high") < 0), "mde80": 2.801585 * F.col("delta_std")})


#: Upper bounds of a uniform number for 0, 1, 2, ... draws at one draw on average.
POISSON_ONE = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def _replicate_weights(cell: np.ndarray, count: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Poisson numbers (cells x replicates) with mean ``count``, told by the cell's hash alone. In front the counts themselves."""
    with np.errstate(over="ignore"):
        x = cell.astype(np.int64).view(np.uint64)[:, None] ^ (np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    out = np.searchsorted(POISSON_ONE, (x >> np.uint64(11)) * 2.0**-53, side="right").astype(float)
    out[count == 0] = 0
    for k in np.flatnonzero(count > 1):  # cells of several rows draw all of them at once
        out[k] = np.random.Generator(np.random.Philox(key=np.array([cell[k], seed], np.int64).view(np.uint64))).poisson(count[k], replicates)
    return np.concatenate([count[:, None].astype(float), out], 1)


def poisson_bootstrap_auc(rows: DataFrame, group: list[str], score: str, label: str, replicates: int, level: float = 0.95, seed: int = 1, parts: int | None = None) -> DataFrame:
    """(group, auc, ci_low, ci_high, n_used): AUC with the percentile interval of ``replicates`` Poisson resamples, in which each
    row counts 0, 1, 2, ... times, once on average, independently of the others.

    Rows are counted by score and label; a cell's weights follow from its hash, so partitioning changes nothing and no
    weight is shuffled. Cells lie in ranges of the score. A task goes along its range with one running sum a replicate:
    the weight of negatives so far, by which it counts the pairs that its own rows win; what lies in earlier ranges is
    added from each range's totals. So memory is some numbers a replicate, whatever the rows. Null scores and labels are
    left out; replicates that lack a class aren't used.
    """
    workers.ready(rows.sparkSession)
    cell = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*group, F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("q"))
    named = cell.withColumns({"hp": F.xxhash64(*group, "s", F.lit("p")), "hq": F.xxhash64(*group, "s", F.lit("q"))})
    placed = prefix.ranges(named, group, ["s"], parts).select("_key", "_g", "_part", "p", "q", "hp", "hq")
    n, chunk = replicates + 1, max(1, (1 << 20) // (replicates + 1))

    def run(batches):
        at, sums = None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([at[1], at[2], *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in sums)], ["_key", "_part", "won", "positive", "negative"])

        for batch in batches:
            g = batch.column("_g").to_numpy()
            cuts = np.r_[0, np.flatnonzero(g[1:] != g[:-1]) + 1, len(g)] if len(g) else np.zeros(1, int)
            for low, high in zip(cuts[:-1], cuts[1:]):
                if at is None or at[0] != g[low]:
                    if at is not None:
                        yield told()
                    at, sums = (g[low], batch.column("_key").slice(low, 1), batch.column("_part").slice(low, 1)), np.zeros((3, n))
                for k in range(low, high, chunk):
                    part = batch.slice(k, min(chunk, high - k))
                    p, q, hp, hq = (part.column(c).to_numpy() for c in ("p", "q", "hp", "hq"))
                    wins, lost = _replicate_weights(hp, p, replicates, seed), _replicate_weights(hq, q, replicates, seed)
                    below = np.cumsum(lost, 0) - lost / 2 + sums[2]  # ties count half
                    sums[0] += (wins * below).sum(0)
                    sums[1] += wins.sum(0)
                    sums[2] += lost.sum(0)
        if at is not None:
            yield told()

    return _interval_of_ranges(placed, run, group, level)


def power_in_full(preds: DataFrame, arm: str, item: str, classes: int, replicates: int, family: str | None = None, fraction: float = 0.5) -> DataFrame:
    """``paired_bootstrap`` of macro-F1 for every pair of arms (of one family, if a column is named), with what the set
    can resolve: ci_half_width, the pairs' median_mde80, the headroom (macro-F1 of an oracle that is right where any arm
    is, less that of the best arm, of equal ones the first by name), and whether the median is at most ``fraction`` of it.

    ``preds`` has one row an arm and item: arm, item, target, pred, each item with one target. A pair needs its counts of
    (target, a, b) alone, so its replicates are drawn by itself and no item is numbered; arms are few.
    """
    own = preds.select(arm, item, "target", "pred", *([family] if family else []))
    left = own.select(F.col(arm).alias("_l"), item, "target", F.col("pred").alias("a"), *([family] if family else []))
    right = own.select(F.col(arm).alias("_r"), item, F.col("pred").alias("b"), *([family] if family else []))
    pairs = left.join(right, [item, *([family] if family else [])]).filter("_l < _r")
    named = pairs.groupBy("_l", "_r", "target", "a", "b").agg(F.count("*").alias("_n")).withColumn("pair", F.to_json(F.array("_l", "_r")))
    out = paired_bootstrap(named, "pair", classes, replicates, weight="_n")
    f1 = averages(own, [arm], classes).select(arm, F.col("macro_f1_fixed").alias("_f1"))
    best = f1.agg(F.min(F.struct((-F.col("_f1")).alias("f"), F.col(arm).alias("arm"))).alias("_best"))  # one row
    hit = F.col("target") == F.col("pred")
    oracle = own.crossJoin(F.broadcast(best)).groupBy(item).agg(F.max("target").alias("target"), F.bool_or(hit).alias("_any"), F.max(F.when(F.col(arm) == F.col("_best.arm"), F.col("pred"))).alias("_own"))
    oracle = oracle.select(F.lit(0).alias("_run"), "target", F.when(F.col("_any"), F.col("target")).otherwise(F.col("_own")).alias("pred"))
    room = averages(oracle, ["_run"], classes).crossJoin(best).select((F.col("macro_f1_fixed") + F.col("_best.f")).alias("headroom"))  # one row
    median = out.agg(F.percentile("mde80", F.lit(0.5)).alias("median_mde80"))  # one row
    ends = F.from_json("pair", "array<string>")
    out = out.withColumns({"a": ends[0], "b": ends[1], "ci_half_width": (F.col("ci_high") - F.col("ci_low")) / 2}).drop("pair")
    return out.crossJoin(F.broadcast(median)).crossJoin(F.broadcast(room)).withColumn("go", F.col("median_mde80") <= fraction * F.col("headroom"))


def favoured(intervals: DataFrame, variant: str, ci_low: str, least: int = 2) -> DataFrame:
    """(variant, n_seeds, n_favoured, improves): a variant may be said to improve if its interval lies above zero on at
    least so many seeds."""
    out = intervals.groupBy(variant).agg(F.count("*").alias("n_seeds"), F.count_if(F.col(ci_low) > 0).alias("n_favoured"))
    return out.withColumn("improves", F.col("n_favoured") >= least)


def framing(claims: DataFrame, means: DataFrame, variant: str, metric: str, control: str) -> DataFrame:
    """Adds to ``favoured`` the variant's mean metric, the control arm's, and the framing: A if the variant improves and
    its mean is at least the control's, else B. ``means`` has one row a variant."""
    at = means.filter(F.col(variant) == control).select(F.col(metric).alias("control_mean"))  # one row
    out = claims.join(means.select(variant, F.col(metric).alias("mean")), variant).crossJoin(F.broadcast(at))
    return out.withColumn("framing", F.when(F.col("improves") & (F.col("mean") >= F.col("control_mean")), "A").otherwise("B"))


def clipped_fit(rows: DataFrame, group: list[str], x: str, y: str, low: float, high: float, least: int = 500) -> DataFrame:
    """(group, gain, shift, n_inner, n): the least squares line through the points within the bounds, or through all if
    fewer than ``least`` are."""
    inner = F.col(x).between(low, high)
    line = lambda f: F.when(F.col("n_inner") >= least, F.col(f"_{f}i")).otherwise(F.col(f"_{f}a"))
    at = lambda keep: (F.when(keep, F.col(y)), F.when(keep, F.col(x)))
    every = F.lit(True)
    out = rows.groupBy(*group).agg(
        F.count_if(inner).alias("n_inner"), F.count("*").alias("n"), F.regr_slope(*at(inner)).alias("_gi"), F.regr_slope(*at(every)).alias("_ga"), F.regr_intercept(*at(inner)).alias("_si"), F.regr_intercept(*at(every)).alias("_sa")
    )
    return out.select(*group, line("g").alias("gain"), line("s").alias("shift"), "n_inner", "n")
