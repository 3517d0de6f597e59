"""Prefix sums over many ranges against windows and plain loops, and what is built on them."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import inference, metrics, prefix, summary, training_log

SCHEMA = "g string, h int, k long, n long, x double"


@pytest.fixture(scope="module")
def rows(spark):
    """One group has most rows, so every border but a few cuts it."""
    rng = np.random.default_rng(1)
    out = [("hot" if k % 8 else (None, "b", "c")[k % 3], int(k % 2) if k % 8 else None, int(v), int(rng.integers(0, 5)), float(rng.random())) for k, v in enumerate(rng.permutation(4000))]
    return spark.createDataFrame([*out, ("one", 1, 5, 7, 0.5), ("nulls", 1, None, None, None)], SCHEMA).repartition(5).cache()


@pytest.mark.parametrize("group, order", [(["g", "h"], ["k"]), ([], ["k"]), (["g"], ["k desc"])])
@pytest.mark.parametrize("parts", [1, 13])
def test_prefix_sums(rows, group, order, parts):
    order = [F.desc("k")] if order == ["k desc"] else order
    got = prefix.prefix_sums(rows, group, order, {"a": "n", "b": "x"}, few=0, parts=parts)
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    want = rows.withColumns({"a": F.coalesce(F.sum("n").over(w), F.lit(0)), "b": F.coalesce(F.sum("x").over(w), F.lit(0.0))})
    key = lambda r: (str(r.g), str(r.h), -1 if r.k is None else r.k)
    pairs = list(zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key)))
    assert len(pairs) == 4002 and got.columns == want.columns and dict(got.dtypes)["a"] == "bigint"
    assert all(a[:6] == b[:6] and abs(a.b - b.b) < 1e-9 for a, b in pairs)
    few = prefix.prefix_sums(rows, group, order, {"a": "n", "b": "x"})
    assert sorted(map(str, few.collect())) == sorted(map(str, want.collect()))


def test_numbers_and_ranks(rows):
    got = prefix.numbered(rows, ["g"], ["k"], "i", few=0, parts=9).collect()
    for g in {r.g for r in got}:
        own = sorted((r for r in got if r.g == g), key=lambda r: (r.k is not None, r.k or 0))
        assert [r.i for r in own] == list(range(len(own)))
    dense = prefix.dense_numbers(rows, ["g", "h"], "n", "d", few=0, parts=9).collect()
    values = {}
    for r in dense:
        values.setdefault((r.g, r.h), set()).add(r.n)
    assert len(dense) == 4002 and all(r.d == sorted(values[r.g, r.h], key=lambda v: (v is not None, v)).index(r.n) for r in dense)
    ranks = prefix.average_ranks(rows.filter("g = 'hot'"), ["g"], "n", "r", few=0, parts=7).collect()
    flat = sorted(r.n for r in rows.filter("g = 'hot'").collect())
    at = {}
    for k, v in enumerate(flat):
        at.setdefault(v, []).append(k + 1)
    assert {tuple(r)[1:] for r in ranks} == {(v, len(x), sum(x) / len(x)) for v, x in at.items()}


def test_no_rows(rows):
    none = rows.filter("k > 99999")
    assert prefix.prefix_sums(none, ["g"], ["k"], {"a": "n"}, few=-1, parts=3).count() == 0
    assert summary.percentiles(none, ["g"], "x", {"m": 0.5}, few=-1).count() == 0
    assert inference.poisson_bootstrap_auc(none.withColumn("f", F.col("n") > 2), ["g"], "x", "f", 20).count() == 0


def test_percentiles_over_ranges(rows):
    got = {r.g: r for r in summary.percentiles(rows, ["g"], "x", {"low": 0.1, "mid": 0.5, "top": 1.0}, few=0).collect()}
    for g in ("hot", None, "b", "c", "one"):
        flat = [r.x for r in rows.collect() if r.g == g and r.x is not None]
        assert got[g].n == len(flat) and (got[g].low, got[g].mid, got[g].top) == pytest.approx(tuple(np.quantile(flat, [0.1, 0.5, 1.0])))


def test_auc_and_spearman_over_ranges(rows):
    data = rows.filter("g = 'hot'").withColumn("f", (F.col("x") + F.col("n") / 5) > 0.9)
    flat = data.collect()
    s, f = np.array([r.x for r in flat]), np.array([r.f for r in flat])
    want = np.mean([(s[f] > z).mean() + (s[f] == z).mean() / 2 for z in s[~f]])
    for few in (0, 10**6):
        assert metrics.binary_auc(data, ["g"], "x", "f", few).first().auc == pytest.approx(want)
    rank = lambda v: np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])
    rho = np.corrcoef(rank(np.array([r.n for r in flat])), rank(s))[0, 1]
    for few in (0, 10**6):
        assert inference.spearman(data, ["g"], "n", "x", few).first().rho == pytest.approx(rho)
    assert inference.spearman(data.withColumn("c", F.lit(1)), ["g"], "c", "x").first().rho is None


def test_poisson_weights():
    cell, count = np.arange(5000, dtype=np.int64) * 977 - 999, np.ones(5000, np.int64)
    w = inference._replicate_weights(cell, count, 40, 3)
    assert (w[:, 0] == 1).all() and abs(w[:, 1:].mean() - 1) < 0.01 and abs(w[:, 1:].var() - 1) < 0.03
    assert abs(np.corrcoef(w[:, 1], w[:, 2])[0, 1]) < 0.05 and abs(np.corrcoef(w[:-1, 1], w[1:, 1])[0, 1]) < 0.05
    assert (inference._replicate_weights(cell[7:9], count[7:9], 40, 3) == w[7:9]).all() and (inference._replicate_weights(cell, count, 40, 4) != w).any()
    many = inference._replicate_weights(cell[:300], np.full(300, 50), 200, 3)[:, 1:]
    assert abs(many.mean() - 50) < 0.3 and abs(many.var() - 50) < 3 and not inference._replicate_weights(cell[:3], np.zeros(3, np.int64), 9, 3).any()


def test_poisson_bootstrap_over_ranges(spark):
    """The same numbers whatever the ranges; the weighted AUC by loops; an interval like that of plain resampling."""
    rng = np.random.default_rng(7)
    label = rng.random(400) < 0.4
    score = np.round(rng.random(400) + 0.3 * label, 3)
    frame = spark.createDataFrame([(k % 2, float(s), bool(f)) for k, (s, f) in enumerate(zip(score, label))] + [(0, None, True), (1, 0.5, None)], "g int, s double, f boolean")
    got = {parts: {r.g: tuple(r) for r in inference.poisson_bootstrap_auc(frame.repartition(parts), ["g"], "s", "f", 800, parts=parts).collect()} for parts in (1, 6)}
    assert got[1] == got[6]
    auc = lambda s, f: np.mean([(x > z) + (x == z) / 2 for x in s[f] for z in s[~f]])
    for g in (0, 1):
        s, f = score[g::2], label[g::2]
        draws = [auc(s[k], f[k]) for k in (rng.integers(0, len(s), len(s)) for _ in range(400))]
        _, point, low, high, used = got[1][g]
        assert point == pytest.approx(auc(s, f)) and used == 800 and abs(low - np.quantile(draws, 0.025)) < 0.025 and abs(high - np.quantile(draws, 0.975)) < 0.025
    lone = inference.poisson_bootstrap_auc(frame.filter("f"), ["g"], "s", "f", 30).first()
    assert lone.auc is None and lone.n_used == 0


@pytest.mark.parametrize("few", [0, 10**6])
def test_moving_average_is_the_recurrence(spark, few):
    rng = np.random.default_rng(8)
    logs = {"a": rng.random(3000).tolist(), "b": [0.25], None: [1.0, 2.0, 4.0], "c": [1.0, None, 2.0]}
    rows = spark.createDataFrame([(r, k, x) for r, v in logs.items() for k, x in enumerate(v)], "run string, epoch long, x double").repartition(4)
    got = {r.run: r.ema for r in training_log.smoothed(rows, "run", "epoch", "x", 0.9, few).collect()}
    for r, v in logs.items():
        s = v[0]
        for x in v[1:]:
            s = None if x is None or s is None else 0.9 * s + 0.1 * x
        assert got[r] == (None if s is None else pytest.approx(s, rel=1e-9))
    assert training_log.smoothed(rows.limit(0), "run", "epoch", "x", 0.9, few).count() == 0
