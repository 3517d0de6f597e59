"""The metric index against all pairs."""

import math

import numpy as np
import pytest

from quillon.operators import metric, pairs


def rows_of(spark, vectors, classes=1):
    rows = [(k, f"c{k % classes}", None if v is None else [None if x is None else float(x) for x in v], k * 7919) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id long, class_name string, vector array<double>, word long").repartition(3)


def all_pairs(vectors, least, classes=1):
    fine = [v is not None and all(x is not None and math.isfinite(x) for x in v) for v in vectors]
    out = set()
    for i in range(len(vectors)):
        for j in range(i + 1, len(vectors)):
            if fine[i] and fine[j] and i % classes == j % classes and len(vectors[i]) == len(vectors[j]) and sum(a * b for a, b in zip(vectors[i], vectors[j])) >= least:
                out.add((i, j))
    return out


def found(index):
    got = index.pairs().select("i", "j").collect()
    return {tuple(r) for r in got}


def clustered(n, groups, width, spread, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, width))
    x = middle[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_clusters_cost_a_tenth(spark, monkeypatch):
    monkeypatch.setattr(metric, "PART", 300)
    x = clustered(2400, 150, 24, 0.08, 1)
    index = metric.MetricIndex(rows_of(spark, x), 0.92, [], most=60)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.92, 1)))}
    assert found(index) == want and len(want) > 10_000
    assert index.levels >= 1 and index.compared < 0.1 * 2400 * 2399 / 2


def test_classes_are_kept_apart(spark):
    x = clustered(500, 30, 8, 0.1, 2)
    index = metric.MetricIndex(rows_of(spark, x, 3), 0.9, ["class_name"], most=40)
    assert found(index) == all_pairs(x.tolist(), 0.9, 3) and index.levels >= 1


@pytest.mark.parametrize("least", [0.2, -0.5, float("-inf")])
def test_dense_vectors_fall_to_blocks(spark, monkeypatch, least):
    monkeypatch.setattr(metric, "BLOCK", 50)
    x = np.random.default_rng(3).normal(size=(260, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = metric.MetricIndex(rows_of(spark, x), least, [], most=30)
    assert found(index) == all_pairs(x.tolist(), least)


def test_equal_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    x = [[1.0, 0.0, 0.5]] * 150 + (rng.normal(size=(150, 3)) * rng.choice([0.1, 1, 5], size=(150, 1))).tolist()
    x += [None, [], [], [1.0], [2.0], [float("nan"), 1, 1], [float("inf"), 1, 1], [None, 1, 1], [0.0, 0.0, 0.0], [100.0, 0.0, 0.0], [9.0, 1.0]]
    for least in (1.0, 12.0, 0.0):
        index = metric.MetricIndex(rows_of(spark, x), least, [], most=40, levels=3)
        assert found(index) == all_pairs(x, least)
    assert not found(metric.MetricIndex(rows_of(spark, x).limit(0), 0.5, []))
    assert not found(metric.MetricIndex(rows_of(spark, x[:150]), 5.0, [], most=40))  # no two of these are that near


@pytest.mark.parametrize("mode, bits, cosine", [("both", 30, 0.2), ("both", 10, 0.1), ("any", 12, 0.8), ("any", 26, 0.8), ("hash", 24, None), ("hash", 9, None), ("vector", None, 0.7), ("vector", 3, 0.7), ("any", None, 0.9), ("both", None, 0.5)])
def test_near_pairs_modes(spark, mode, bits, cosine):
    rng = np.random.default_rng(5)
    x = clustered(90, 12, 6, 0.2, 6)
    words = [int(w) for w in rng.integers(-(2**63), 2**63 - 1, size=20)]
    own = [words[k % 20] ^ sum(1 << int(b) for b in rng.integers(0, 62, size=k % 8)) for k in range(90)]
    rows = spark.createDataFrame([(k, f"c{k % 2}", x[k].tolist(), own[k]) for k in range(90)], "id long, class_name string, vector array<double>, word long")
    want = set()
    for i in range(90):
        for j in range(i + 1, 90):
            near = bits is None or ((own[i] ^ own[j]) % (1 << 64)).bit_count() <= bits
            like = cosine is None or float(x[i] @ x[j]) >= cosine
            if i % 2 == j % 2 and {"both": near and like, "any": near or like, "hash": near, "vector": like}[mode]:
                want.add((i, j))
    got = pairs.near_pairs(rows, bits, cosine, mode).collect()
    assert len(got) == len(want) and {(r.i, r.j) for r in got} == want


def test_pairs_need_no_join_by_pair(spark):
    rows = spark.createDataFrame([(k, "c", v.tolist(), k * 7919, f"s{k % 3}") for k, v in enumerate(clustered(200, 9, 8, 0.3, 7))], "id long, class_name string, vector array<double>, word long, split string")
    met = pairs.near_pairs(rows, None, 0.3, "vector", carry=("split",))
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 2 and "Distinct" not in plan and plan.count("Aggregate") == 0  # candidates are made by blocks and each comes once
    got = met.collect()
    assert got and all((r.split_i, r.split_j) == (f"s{r.i % 3}", f"s{r.j % 3}") for r in got)


@pytest.mark.parametrize("groups", [1, 3])
def test_blocks_of_one_group_are_bounded_and_exact(spark, monkeypatch, groups):
    monkeypatch.setattr(metric, "BLOCK", 64)
    monkeypatch.setattr(metric, "STRIP", 500)
    x = np.repeat(np.random.default_rng(8).normal(size=(groups, 6)), 300 // groups, 0)  # copies: every pair of a group is one
    index = metric.MetricIndex(rows_of(spark, x), float((x**2).sum(1).min()) * 0.9, [])
    got = [tuple(r) for r in index.pairs().select("i", "j").collect()]
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= float((x**2).sum(1).min()) * 0.9, 1)))}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("n, leads", [(5, (64, 4096)), (40, (2, 10)), (10_000, (2, 10)), (40, ())])
def test_first_pairs_across_classes(spark, n, leads):
    x = clustered(120, 6, 5, 0.4, 9)
    want = [(i, j) for i in range(120) for j in range(i + 1, 120) if i % 4 != j % 4 and float(x[i] @ x[j]) >= 0.8]
    got = pairs.across_classes(rows_of(spark, x, 4), 0.8, n, leads).collect()
    assert [(r.i, r.j) for r in got] == want[:n] and all((r.class_i, r.class_j) == (f"c{r.i % 4}", f"c{r.j % 4}") for r in got)
