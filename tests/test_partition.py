"""Balanced splits against dealing cluster by cluster."""

import hashlib
import random

import numpy as np
import pytest

from quillon.operators import partition


def one_by_one(sizes, shares):
    """(split of each size in order) by the rule itself."""
    total, have, out = sum(sizes), [0, 0, 0], []
    for n in sizes:
        lacks = [f * total - h for f, h in zip(shares, have)]
        k = lacks.index(max(lacks))
        have[k] += n
        out.append(k)
    return out, have


@pytest.mark.parametrize("shares", [(0.7, 0.15, 0.15), (0.5, 0.25, 0.25), (1 / 3, 1 / 3, 1 / 3), (0.8, 0.2, 0.0)])
def test_runs_are_those_of_single_choices(shares):
    rng = random.Random(3)
    for _ in range(60):
        sizes = sorted((rng.choice([1, 1, 1, 2, 3, 7, 40]) for _ in range(rng.randint(1, 160))), reverse=True)
        want, total = one_by_one(sizes, shares)[0], sum(sizes)
        goal, have, at = np.array([f * total for f in shares]), np.zeros(3, np.int64), 0
        for n in sorted(set(sizes), reverse=True):
            m = sizes.count(n)
            got = partition.picks(np.arange(m), np.full(m, n), np.repeat(goal[:, None], m, 1), np.repeat(have[:, None], m, 1))
            assert got.tolist() == want[at : at + m]
            counts = partition.dealt(m, n, goal, have)
            assert counts.tolist() == [want[at : at + m].count(s) for s in range(3)]
            have, at = have + n * counts, at + m


@pytest.mark.parametrize("few", [0, 10**6])
def test_split_equals_single_choices(spark, few):
    rng = random.Random(4)
    rows = []
    for stratum in ("a", "b", None):
        for k in range(220):
            rows += [(stratum, f"k{k}")] * rng.choice([1, 1, 1, 2, 2, 5, 30])
    rng.shuffle(rows)
    got = {(r.c, r.k): (r["n"], r.split) for r in partition.balanced_split(spark.createDataFrame(rows, "c string, k string").repartition(5), "c", "k", few=few).collect()}
    for stratum in ("a", "b", None):
        own = {k: sum(1 for r in rows if r == (stratum, k)) for _, k in {r for r in rows if r[0] == stratum}}
        order = sorted(own, key=lambda k: (-own[k], hashlib.md5(f"{k}|42".encode()).hexdigest(), k))
        want, _ = one_by_one([own[k] for k in order], (0.70, 0.15, 0.15))
        assert [got[stratum, k] for k in order] == [(own[k], partition.SPLITS[s]) for k, s in zip(order, want)]


def test_a_long_run_costs_no_loop():
    m = 2_000_000
    got = partition.picks(np.arange(m), np.ones(m, np.int64), np.repeat(np.array([[0.7 * m], [0.15 * m], [0.15 * m]]), m, 1), np.zeros((3, m), np.int64))
    assert np.abs(np.bincount(got) - np.array([0.7, 0.15, 0.15]) * m).max() <= 1
