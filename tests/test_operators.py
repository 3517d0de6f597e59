"""Graph, inference, masks and file formats against plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import masks as M
from quillon.operators import graph, inference
from quillon.sources import sinks


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(5, 5), (None, 3), (7, None)] + [(0, k) for k in range(200, 260)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "i long, j long"), "i", "j").collect()}
    assert got == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "i long, j long"), "i", "j").count() == 0


@pytest.mark.parametrize("cells, p", [((1, 9, 11, 3), 0.002759456), ((3, 1, 1, 3), 0.485714286), ((0, 5, 0, 7), 1.0)])
def test_fisher(spark, cells, p):
    got = inference.fisher_exact(spark.createDataFrame([cells], "a int, b int, c int, d int"), ("a", "b", "c", "d")).first().fisher_p
    assert got == pytest.approx(p, abs=1e-8)


def test_mann_whitney(spark):
    a, b = [1.0, 2.0, 2.0, 5.0, 9.0], [2.0, 3.0, 4.0, 7.0, 8.0, 8.0]
    rows = spark.createDataFrame([(0, x, True) for x in a] + [(0, x, False) for x in b] + [(1, 4.0, True), (1, 4.0, False), (2, 1.0, True)], "g int, v double, f boolean")
    got = {r.g: r for r in inference.mann_whitney(rows, ["g"], "v", "f").collect()}
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    ties = sum(c**3 - c for c in ((a + b).count(x) for x in set(a + b)))
    z = (abs(u - 15) - 0.5) / math.sqrt(30 / 12 * (12 - ties / 110))
    assert (got[0].u, got[0].z, got[0].p_value) == pytest.approx((u, z, math.erfc(z / math.sqrt(2))))
    assert got[1].z is None and got[1].p_value is None and got[2].z is None


def test_masks(spark):
    rng = np.random.default_rng(1)
    maps = [rng.random(36).tolist(), [0.5] * 36]
    df = spark.createDataFrame([(k, m) for k, m in enumerate(maps)], "k int, v array<double>")
    rows = df.select(M.quantile(F.col("v"), 0.8).alias("q"), M.hottest(F.col("v"), 0.8).alias("h"), M.centre_energy(F.col("v"), 6, 1).alias("c"), M.min_max(F.col("v")).alias("m")).collect()
    for m, r in zip(maps, rows):
        a = np.array(m)
        assert r.q == pytest.approx(np.quantile(a, 0.8)) and r.h == np.flatnonzero(a >= np.quantile(a, 0.8)).tolist()
        assert r.c == pytest.approx(a.reshape(6, 6)[1:-1, 1:-1].sum() / a.sum())
    assert rows[1].m == [0.0] * 36 and (min(rows[0].m), max(rows[0].m)) == (0.0, 1.0)


def test_npy_and_reports(spark, tmp_path):
    (tmp_path / "arrays").mkdir()
    a = np.arange(12, dtype="float32").reshape(3, 2, 2)
    np.save(tmp_path / "arrays" / "a.npy", a)
    np.save(tmp_path / "arrays" / "none.npy", np.zeros((0, 4)))
    rows = sinks.npy_rows(spark, f"file://{tmp_path}/arrays").orderBy("pos").collect()
    assert [r["values"] for r in rows] == a.reshape(3, 4).tolist() and [r.pos for r in rows] == [0, 1, 2]
    report = spark.createDataFrame([("b_1", 2), ("a&c", None)], "name string, n int")
    sinks.write_csv(report, f"file://{tmp_path}/csv", ["name"])
    (file,) = (tmp_path / "csv").glob("part-*.csv")
    assert file.read_text().splitlines()[:2] == ["name,n", "a&c,"]
    for _ in range(2):
        sinks.append_json(report, f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json").count() == 4
    assert {r.line for r in sinks.latex_rows(report, ["name", "n"]).collect()} == {r"b\_1 & 2 \\", r"a\&c & -- \\"}


def test_neighbourhood_kernels(spark):
    import colorsys

    from quillon.operators import pixels as X

    rng = np.random.default_rng(4)
    a = rng.random((5, 7, 3))
    df = spark.createDataFrame([(1, y, x, *map(float, a[y, x])) for y in range(5) for x in range(7)], "image_id int, y int, x int, r double, g double, b double")
    got = {name: np.zeros_like(a) for name in ("hue_pos", "blur_light", "noise_heavy")}
    for r in X.perturbed(df, list(got)).collect():
        got[r.perturbation][r.y, r.x] = r.r, r.g, r.b
    turned = [[colorsys.hsv_to_rgb((h + 0.05) % 1, s, v) for h, s, v in (colorsys.rgb_to_hsv(*p) for p in row)] for row in a]
    assert np.allclose(got["hue_pos"], turned, atol=1e-6)
    k = np.exp(-np.arange(-3, 4) ** 2 / 2)
    k /= k.sum()
    wide = np.pad(a, ((3, 3), (3, 3), (0, 0)), mode="edge")
    want = sum(k[i] * k[j] * wide[i : i + 5, j : j + 7] for i in range(7) for j in range(7))
    assert np.allclose(got["blur_light"], want)
    assert 0.02 < np.abs(got["noise_heavy"] - a).mean() < 0.12 and got["noise_heavy"].min() >= 0
    q = X.quality(df).first()
    grey = 255 * (a @ [0.299, 0.587, 0.114])
    m = np.pad(grey, 1, mode="reflect")
    assert q.blur == pytest.approx((m[:-2, 1:-1] + m[2:, 1:-1] + m[1:-1, :-2] + m[1:-1, 2:] - 4 * grey).var()) and q.brightness == pytest.approx(grey.mean())


def test_balanced_split_keeps_clusters_whole(spark):
    from quillon.operators import partition

    rng = random.Random(11)
    rows = [(c, f"{c}{k}") for c in ("x", "y", None) for k in range(60) for _ in range(rng.choice((1, 1, 2, 7)))]
    got = partition.balanced_split(spark.createDataFrame(rows, "c string, k string"), "c", "k").collect()
    assert len(got) == len({(r.c, r.k) for r in got}) == 180 and sum(r.n for r in got) == len(rows)
    for c in ("x", "y", None):
        n = sum(r.n for r in got if r.c == c)
        for name, share in zip(partition.SPLITS, (0.70, 0.15, 0.15)):
            assert abs(sum(r.n for r in got if r.c == c and r.split == name) - share * n) <= 2
    assert partition.balanced_split(spark.createDataFrame([], "c string, k string"), "c", "k").count() == 0


def test_metric_documents_of_three_shapes(spark):
    from quillon.operators import contracts

    texts = ['{"a":{"f1":0.5,"recall":1},"b":{"recall":1}}', '{"f1":{"a":0.25},"macro":1}', '{"f1":[0.5,0.75]}', '{"f1":[1]}', "[]", None, "{"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = sorted(tuple(r) for r in contracts.metric_map(rows, ["id"], "text", "f1", ["a", "b"]).collect())
    assert got == [(0, "a", 0.5), (1, "a", 0.25), (2, "a", 0.5), (2, "b", 0.75)]


def test_strict_counts_raise(spark):
    from quillon.operators import contracts

    rows = spark.createDataFrame([("train",)] * 3, "split string")
    assert contracts.count_protocol(rows, "split", {"train": 3}, strict=True).count() == 1
    with pytest.raises(Exception, match="counts differ"):
        contracts.count_protocol(rows, "split", {"train": 4}, strict=True).collect()


def test_linear_probe_tells_a_planted_direction(spark):
    from quillon.operators import probe

    rng = random.Random(2)
    rows = [(k, [y * 1.5 + rng.gauss(0, 1), rng.gauss(0, 1)], y, k % 3 != 0) for k in range(240) for y in (int(rng.random() < 0.4),)]
    r = probe.linear_probe(spark.createDataFrame(rows, "k long, f array<double>, y int, train boolean"), "k", "f", "y", "train", (0.1, 1.0), 3, 50).first()
    assert 0.75 < r.auc < 0.95 and r.ci_low < r.auc < r.ci_high and r.n_used == 50 and r.balanced_accuracy > 0.65 and r.c in (0.1, 1.0)


def test_mann_whitney_exact_on_few_rows(spark):
    from itertools import combinations

    a, b = [1.5, 7.0, 9.5], [2.0, 3.0, 4.5, 5.5, 8.0, 10.0, 11.0]
    rows = spark.createDataFrame([(0, x, True) for x in a] + [(0, x, False) for x in b], "g int, v double, f boolean")
    r = inference.mann_whitney(rows, ["g"], "v", "f").first()
    every = [sum(s) - 3 for s in combinations(range(10), 3)]  # u of every way to deal the ranks
    far = max(r.u, 21 - r.u)
    assert r.u == sum(x > y for x in a for y in b) and r.p_value == pytest.approx(min(1, 2 * sum(u >= far for u in every) / len(every)))
    assert inference._subset_tail(0, 8, 30) == pytest.approx(2 / math.comb(38, 8))


def test_rules_and_fits(spark):
    ci = spark.createDataFrame([("x", 1, 0.1), ("x", 2, 0.2), ("x", 3, -0.1), ("y", 1, 0.1), ("y", 2, 0.0), ("y", 3, None)], "v string, seed int, lo double")
    means = spark.createDataFrame([("x", 0.5), ("y", 0.9), ("c", 0.6)], "v string, m double")
    got = {r.v: (r.n_favoured, r.improves, r.framing) for r in inference.framing(inference.favoured(ci, "v", "lo"), means, "v", "m", "c").collect()}
    assert got == {"x": (2, True, "B"), "y": (1, False, "B")}
    assert inference.framing(inference.favoured(ci, "v", "lo"), means, "v", "m", "x").filter("v = 'x'").first().framing == "A"
    pts = spark.createDataFrame([(0, float(x), 2.0 * x + 1 if 3 < x < 9 else 50.0) for x in range(12)], "g int, x double, y double")
    fit = inference.clipped_fit(pts, ["g"], "x", "y", 3.5, 8.5, 5).first()
    assert (fit.gain, fit.shift, fit.n_inner, fit.n) == (pytest.approx(2), pytest.approx(1), 5, 12)
    assert inference.clipped_fit(pts, ["g"], "x", "y", 3.5, 8.5, 6).first().gain != pytest.approx(2)


def test_draws_are_dealt_and_shared_by_size(spark):
    from pyspark.sql import functions as F

    from quillon.operators import inference

    sizes = spark.createDataFrame([("a", 9000), ("b", 9000), ("c", 5)], "g string, n long").coalesce(1)
    drawn = inference.resamples(sizes, ["g"], "k", 12).withColumn("task", F.spark_partition_id())
    by_task = [r.n for r in drawn.groupBy("task").agg(F.count("*").alias("n")).collect()]
    assert sum(by_task) == 12 * 18005 and len(by_task) >= 3 and max(by_task) < 0.7 * sum(by_task)
    rows = spark.range(9000).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("g"), F.col("id").alias("k"), (F.col("id") % 7 == 0).alias("ok_a"), (F.col("id") % 5 == 0).alias("ok_b"))
    plan = inference._drawn(rows, sizes, ["g"], "k", 12)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan  # neither the draws nor the rows go through the driver
    a, b = sorted(tuple(r)[1:] for r in inference.bootstrap_accuracy(rows, ["g"], "k", 12).collect())
    assert a == pytest.approx(b, rel=1e-9)


def test_power_sends_no_rows_through_the_driver(spark):
    from pyspark.sql import functions as F

    from quillon.operators import inference

    hits = spark.range(3000).select(F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), (F.col("id") % m > 0).cast("int").alias("hit")) for a, m in (("x", 3), ("y", 5), ("z", 7))))).alias("s"), F.col("id").alias("item")).select("s.arm", "item", "s.hit")
    out = inference.power(hits, "arm", "item", "hit", 20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    rows = {(r.a, r.b): r for r in out.collect()}
    assert set(rows) == {("x", "y"), ("x", "z"), ("y", "z")} and all(0 < r.se < 0.05 and r.mde80 == pytest.approx(2.801585 * r.se) for r in rows.values())


def test_bootstrap_auc_is_that_of_the_drawn_rows(spark):
    """All 2,000 replicates against plain loops, over ties, null scores and labels, a group of one class, and keys of several buckets."""
    import hashlib

    from quillon.plans import analyses

    assert {r.n_used for r in analyses.bootstrap_auc(spark, "/root/testdata/sf0.001").collect()} == {2000}
    rng = np.random.default_rng(5)
    score, label = np.round(rng.random(30), 1), rng.random(30) < 0.4
    rows = [("a", k, float(s) if k else None, bool(f) if k != 7 else None) for k, (s, f) in enumerate(zip(score, label))] + [("b", k, k / 9, True) for k in range(30)] + [("c", k, float(k % 11), k % 3 == 0) for k in range(5000)]
    frame = spark.createDataFrame(rows, "g string, k long, s double, f boolean").repartition(3)
    got = {r.g: r for r in inference.bootstrap_auc(frame, ["g"], "k", "s", "f", 70).collect()}

    def auc(s, f):
        w = [(x > z) + (x == z) / 2 for x in s[f] for z in s[~f]]
        return np.mean(w) if w else None

    draw = lambda n, rep: [int(hashlib.md5(b"%d|%d" % (rep, p)).hexdigest()[:8], 16) % n for p in range(n)]
    score[0], label[7] = -1, False
    every = [auc(score[k], label[k]) for k in (draw(30, rep) for rep in range(70))]
    assert got["a"].n_used == 70 and got["a"].auc == pytest.approx(auc(score, label), rel=1e-12)
    assert [got["a"].ci_low, got["a"].ci_high] == pytest.approx(np.quantile(every, [0.025, 0.975]), rel=1e-12)
    assert got["b"].auc is None and got["b"].ci_low is None and got["b"].n_used == 0 and got["c"].n_used == 70
    w = {r._k: np.frombuffer(r.w, np.uint8) for r in inference.resample_weights(spark.createDataFrame([(5000,)], "n long"), "_k", 70).collect()}
    want = np.bincount(draw(5000, 69), minlength=5000)
    assert set(w) == set(range(5000)) and [w[k][69] for k in range(5000)] == want.tolist() and sum(int(x.sum()) for x in w.values()) == 70 * 5000
