"""Whole clusters dealt to train, val and test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import workers
from quillon.operators import prefix

SPLITS = ("train", "val", "test")


def _rank(s: int, j: np.ndarray, n: np.ndarray, want: np.ndarray, have: np.ndarray) -> np.ndarray:
    """When split ``s`` gets its j-th cluster (from 0) of a run of clusters of ``n`` rows each, if every cluster goes to the split
    that lacks most. A split lacks ``want - have`` before its first and n less before each further one, so a run deals the
    splits' lacks out in falling order, ties to the earlier split."""
    lack = lambda t, i: want[t] - (have[t] + i * n)
    own, out = lack(s, j), j.copy()
    for t in range(len(want)):
        if t == s:
            continue
        before = (lambda i: lack(t, i) >= own) if t < s else (lambda i: lack(t, i) > own)
        k = np.maximum(0, np.floor((lack(t, 0) - own) / n).astype(np.int64) - 1)
        while (more := before(k)).any():  # a few steps, for ties and rounding
            k += more
        while (less := (k > 0) & ~before(k - 1)).any():
            k -= less
        out = out + k
    return out


def picks(place: np.ndarray, n: np.ndarray, want: np.ndarray, have: np.ndarray) -> np.ndarray:
    """The split of the cluster at each place of its run, by bisection over how many each split has had."""
    out = np.full(len(place), -1)
    for s in range(len(want)):
        low, high = np.zeros(len(place), np.int64), place.copy()  # a split has had ``place`` of them at most
        while (low < high).any():
            mid = (low + high) // 2
            late = _rank(s, mid, n, want, have) >= place
            high, low = np.where(late, mid, high), np.where(late, low, np.minimum(mid + 1, high))
        out[_rank(s, low, n, want, have) == place] = s
    return out


def dealt(m: int, n: int, want: np.ndarray, have: np.ndarray) -> np.ndarray:
    """How many of a run of m clusters each split gets."""
    one = lambda v: np.asarray(v)[:, None]
    out = []
    for s in range(len(want)):
        low, high = 0, m
        while low < high:  # the first that comes after the run
            mid = (low + high) // 2
            if _rank(s, np.array([mid]), np.array([n]), one(want), one(have))[0] >= m:
                high = mid
            else:
                low = mid + 1
        out.append(low)
    return np.array(out)


def balanced_split(members: DataFrame, strata: str, cluster: str, shares: tuple[float, float, float] = (0.70, 0.15, 0.15), seed: str = "42", few: int = prefix.FEW) -> DataFrame:
    """(strata, cluster, n, split): largest clusters first, each to the split that lacks most rows of its share.

    Clusters of one size come in the order of a hash; ties between splits go to the earlier one. Each choice depends on
    all choices before it, but among clusters of one size it depends on their place alone: so only the sizes of a stratum,
    with how many clusters have them, pass through a task in order, and every cluster's split follows from its place in its
    size, numbered by many tasks. The result is that of dealing cluster by cluster. Null strata form one stratum.
    """
    workers.ready(members.sparkSession)
    sizes = members.groupBy(strata, cluster).agg(F.count("*").alias("n"))
    runs = sizes.groupBy(strata, "n").agg(F.count("*").alias("_m"))
    totals = runs.groupBy(F.col(strata).alias("_stratum")).agg(F.sum(F.col("n") * F.col("_m")).alias("_total"))
    found = runs.join(totals, F.col(strata).eqNullSafe(F.col("_stratum"))).drop("_stratum")
    ordered = found.repartition(strata).sortWithinPartitions(strata, F.desc("n"))
    kind = dict(sizes.dtypes)[strata]

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, have = object(), np.zeros(3, np.int64)
        for b in batches:
            out = []
            for s, n, m, total in zip(b[strata], b["n"], b["_m"], b["_total"]):
                s = None if pd.isna(s) else s
                if s != at:
                    at, have = s, np.zeros(3, np.int64)
                out.append((s, n, total, have.tolist()))
                have = have + int(n) * dealt(int(m), int(n), np.array([f * total for f in shares]), have)
            yield pd.DataFrame(out, columns=[strata, "n", "_total", "_have"])

    begun = ordered.mapInPandas(starts, f"`{strata}` {kind}, n long, _total long, _have array<long>")
    tag = F.md5(F.concat_ws("|", F.col(cluster).cast("string"), F.lit(seed)).cast("binary"))
    placed = prefix.numbered(sizes.withColumn("_tag", tag), [strata, "n"], ["_tag", cluster], "_p", few)
    met = placed.alias("a").join(begun.alias("b"), F.col(f"a.{strata}").eqNullSafe(F.col(f"b.{strata}")) & (F.col("a.n") == F.col("b.n"))).select("a.*", "b._total", "b._have")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                total, have = b.column("_total").to_numpy(), b.column("_have").flatten().to_numpy().reshape(-1, 3).T
                k = picks(b.column("_p").to_numpy(), b.column("n").to_numpy(), np.stack([f * total for f in shares]), have)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (strata, cluster, "n")), pa.array(np.array(SPLITS, object)[k])], [strata, cluster, "n", "split"])

    kinds = dict(met.dtypes)
    return met.mapInArrow(pick, f"`{strata}` {kinds[strata]}, `{cluster}` {kinds[cluster]}, n long, split string")


def inherited(derived: DataFrame, assigned: DataFrame, keys: list[str]) -> DataFrame:
    """Derived rows with their cluster's new split; orphans have none and are to be dropped and counted."""
    return derived.drop("split").join(assigned.select(*keys, "split"), keys, "left")
