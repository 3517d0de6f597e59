"""Scans and sinks over a temporary folder, guards, and resampling against plain loops."""

import hashlib
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import keys as K
from quillon.operators import contracts, inference, metric, pairs, summary
from quillon.sources import scans, sinks, tables


def png(height, width, shade):
    """A PNG file of one shade, written by hand."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + bytes(shade) * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@pytest.fixture
def tree(tmp_path):
    for split, name, file in (("train", "b", "1.PNG"), ("train", "a", "2.png"), ("train", "a", "2_mask.png"), ("val", "a", "3.png"), ("val", "b", "4.png"), ("val", "b", "notes.txt")):
        (tmp_path / split / name).mkdir(parents=True, exist_ok=True)
        (tmp_path / split / name / file).write_bytes(png(2, 3, (255, 0, 51)) if "png" in file.lower() else b"x")
    (tmp_path / "val" / "b" / "bad.png").write_bytes(b"no image")
    return tmp_path


def test_image_index(spark, tree):
    rows = scans.image_index(spark, str(tree), ["train", "val"], ["a", "b"])
    assert sorted((r.split, r.class_name, r.filename, r.suffix) for r in rows.collect()) == [("train", "a", "2.png", "png"), ("train", "a", "2_mask.png", "png"), ("train", "b", "1.PNG", "png"), ("val", "a", "3.png", "png"), ("val", "b", "4.png", "png"), ("val", "b", "bad.png", "png")]
    with pytest.raises(ValueError, match="without images: .*'c'"):
        scans.image_index(spark, str(tree), ["train", "val"], ["a", "b", "c"])
    with pytest.raises(ValueError, match="not expected: .*'val'"):
        scans.image_index(spark, str(tree), ["train"], ["a", "b"])
    assert {(r.class_name, r.label) for r in scans.labelled_images(rows).collect()} == {("a", 0), ("b", 1)}
    masked = {r.filename: r.mask_path for r in scans.with_masks(rows.filter("filename not like '%mask%'"), rows).collect()}
    assert masked.pop("2.png").endswith("2_mask.png") and set(masked.values()) == {None}
    off = scans.folder_counts(rows, {("train", "a"): 2, ("train", "b"): 2, ("val", "a"): 1, ("val", "b"): 2, ("test", "a"): 1})
    assert sorted(tuple(r) for r in off.collect()) == [("test", "a", 0, 1), ("train", "b", 1, 2)]


def test_decoded(spark, tree):
    good, bad = scans.decoded(spark, str(tree))
    assert sorted(r.path.rsplit("/", 1)[1] for r in bad.collect()) == ["bad.png", "notes.txt"] and good.count() == 5
    p = scans.pixels(good.filter("path like '%3.png'")).orderBy("y", "x").collect()
    assert [(r.x, r.y) for r in p] == [(x, y) for y in range(2) for x in range(3)] and all((r.r, r.g, round(r.b, 3)) == (1.0, 0.0, 0.2) for r in p)


def test_logs_and_runs(spark, tmp_path):
    for name, text in (("log_s1.csv", "a,b\n1,2\n"), ("log_s22.csv", "a,c\n3,4\n"), ("log_sx.csv", "a\n9\n")):
        (tmp_path / "logs").mkdir(exist_ok=True)
        (tmp_path / "logs" / name).write_text(text)
    assert sorted(tuple(r) for r in scans.union_of_logs(spark, str(tmp_path / "logs"), r"log_s\d+\.csv").select("a", "b", "c", "file").na.fill("-").collect()) == [("1", "2", "-", "log_s1.csv"), ("3", "-", "4", "log_s22.csv")]
    with pytest.raises(FileNotFoundError):
        scans.union_of_logs(spark, str(tmp_path / "logs"), "none")
    for run, files in (("r1", ["done.json", "m.json"]), ("r2", ["m.json"]), ("r3", ["done.json"])):
        (tmp_path / "runs" / run).mkdir(parents=True)
        for f in files:
            (tmp_path / "runs" / run / f).write_text("{}")
    assert [(r.run, r.complete, r.missing) for r in scans.complete_runs(spark, str(tmp_path / "runs"), "done.json", ("m.json",)).orderBy("run").collect()] == [("r1", True, ""), ("r2", False, "done.json"), ("r3", False, "m.json")]


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b"\xef\xbb\xbfa,b\n1,x\n,y\n")
    assert sorted(map(tuple, tables.csv_table(spark, str(tmp_path / "t.csv")).na.fill("-").collect())) == [("-", "y"), ("1", "x")]
    assert tables.csv_table(spark, str(tmp_path / "t.csv")).columns == ["a", "b"]
    assert tables.csv_table(spark, str(tmp_path / "t.csv"), "a int, b string").agg(F.sum("a")).first()[0] == 1
    (tmp_path / "d.json").write_text(json.dumps({"k": {"x": 1.5}}, indent=1))
    assert [(r.k.x, r.path.rsplit("/", 1)[1]) for r in tables.json_documents(spark, str(tmp_path / "d.json"), "k struct<x: double>").collect()] == [(1.5, "d.json")]


def test_campaign(spark):
    made = scans.campaign("name: n\nseeds: [1, 2]\nepochs: 3\narms:\n  x: {lr: 0.1, big: true, old: false}\n  y:\n")
    grid = scans.campaign_grid(spark, made)
    assert {r.run: r.flags for r in grid.collect()} == {"x_s1": ["--lr", "0.1", "--big"], "x_s2": ["--lr", "0.1", "--big"], "y_s1": [], "y_s2": []}
    assert scans.command_flags({"a": [1, 2], "b": None}) == ["--a", "1", "--a", "2"]
    assert all(r.ok for r in scans.preflight(spark, ["json"], grid, 2, 2).collect())
    assert [r.ok for r in scans.preflight(spark, ["no_such_module", "no_such_package.sub", "json.no_such"], grid.limit(3), 2, 2).collect()] == [False] * 4
    for bad, said in (("name: n", "seeds is missing"), ("name: 1\nseeds: [1, 1]\nepochs: true\narms: {}\nx: 1", "name must be str.*epochs must be int.*seeds repeat|x is unknown"), ("- 1", "mapping")):
        with pytest.raises(ValueError, match=said):
            scans.campaign(bad)
    assert scans.environment(spark).first().spark == spark.version


def test_sinks(spark, tmp_path, tree):
    rows = spark.createDataFrame([(2, "b_%", [1.0, 2.0]), (1, None, [3.0, 4.0])], "id int, name string, v array<double>")
    sinks.write_json(rows, str(tmp_path / "r.json"), ["id"])
    assert json.loads((tmp_path / "r.json").read_text()) == [{"id": 1, "v": [3.0, 4.0]}, {"id": 2, "name": "b_%", "v": [1.0, 2.0]}]
    with pytest.raises(ValueError):
        sinks.write_json(rows, str(tmp_path / "r.json"), ["id"], most=1)
    sinks.write_npy(rows, str(tmp_path / "a" / "v.npy"), "v", ["id"])
    assert np.load(tmp_path / "a" / "v.npy").tolist() == [[3.0, 4.0], [1.0, 2.0]] and sinks.npy_rows(spark, str(tmp_path / "a")).count() == 2
    sinks.complete(spark, str(tmp_path / "a"), "done.json", {"n": 1})
    sinks.complete(spark, str(tmp_path / "a"), "done.json", {"n": 2})
    assert json.loads((tmp_path / "a" / "done.json").read_text()) == {"n": 2} and not list((tmp_path / "a").glob("*.tmp"))
    table = sinks.latex_table(rows, ["name", "id"], ["Name_x", "Id"], ["id"], "A 5% cap", "tab:x")
    assert "-- & 1 \\\\\nb\\_\\% & 2 \\\\" in table and "Name\\_x & Id \\\\\n" in table and "{lr}" in table
    page = "x <!-- begin t -->old\n<!-- end t --> y"
    assert sinks.embedded(page, "t", "new \\1") == "x <!-- begin t -->\nnew \\1\n<!-- end t --> y"
    with pytest.raises(ValueError):
        sinks.embedded(page, "u", "z")


def test_materialise_and_inventory(spark, tmp_path, tree):
    rows = scans.image_index(spark, str(tree), content=True)
    out = str(tmp_path / "out")
    assert {r.status for r in sinks.materialise(rows, out).collect()} == {"written"}
    assert {r.status for r in sinks.materialise(rows, out).collect()} == {"kept"} and {r.status for r in sinks.materialise(rows, out, overwrite=True).collect()} == {"replaced"}
    found = {r.path: (r.sha256, r.bytes) for r in sinks.inventory(spark, out).collect()}
    assert found["train/b/1.PNG"] == (hashlib.sha256(png(2, 3, (255, 0, 51))).hexdigest(), len(png(2, 3, (255, 0, 51)))) and len(found) == rows.count()
    files = tables.file_index(spark, out)
    lines = "\n".join(sorted(f"{r.sha256}  {r.path}" for r in files.collect()))
    counts = {(r.split, r.class_name): r["count"] for r in files.groupBy("split", "class_name").count().collect()}
    assert contracts.manifest_lock(files, hashlib.sha256(lines.encode()).hexdigest(), counts).count() == 0
    assert contracts.manifest_lock(files, "0", {**counts, ("val", "a"): 7, ("x", "y"): 1}).count() == 3


def test_epoch_log_and_saved_runs(spark, tmp_path):
    path = str(tmp_path / "log.csv")
    log = sinks.EpochLog(spark, path, ["epoch", "loss"])
    log.add(epoch=1, loss=0.5)
    log.add(epoch=2, loss=None)
    log = sinks.EpochLog(spark, path, ["epoch", "loss"])
    log.add(epoch=2, loss=0.25)
    assert (tmp_path / "log.csv").read_text() == "epoch,loss\n1,0.5\n2,0.25\n"
    with pytest.raises(ValueError):
        sinks.EpochLog(spark, path, ["epoch"])
    rows = spark.range(3)
    assert sinks.save_run(rows, str(tmp_path / "sweep"), "a") and not sinks.save_run(rows.limit(1), str(tmp_path / "sweep"), "a")
    (tmp_path / "sweep" / "run=a" / "_SUCCESS").unlink()
    assert sinks.save_run(rows.limit(2), str(tmp_path / "sweep"), "a") and spark.read.parquet(str(tmp_path / "sweep")).count() == 2


def test_scalars(spark):
    row = spark.range(1).select(K.relative_path(F.lit(r"C:\\d\\root\\a\\b.jpg"), "root"), K.slug(F.lit("--Ä Big, Name!")), K.safe_filename(F.lit('a: "b"?')), K.flags({"a": F.lit(1), "b": F.lit(True), "c": F.lit(False), "d": F.lit(None)})).first()
    assert tuple(row) == ("a/b.jpg", "big-name", "a_b_", "--a 1 --b")
    value, source = K.first_of({"x": F.lit(None).cast("int"), "y": F.lit(4)}, F.lit(1))
    assert tuple(spark.range(1).select(value, source).first()) == (4, "y")


def test_mcnemar_of_many(spark):
    from math import comb

    rows = [(0, 0), (1, 0), (3, 9), (40, 60), (600, 700), (50_000, 50_400)]
    got = {(r.a_only, r.b_only): r.p_value for r in inference.mcnemar(spark.createDataFrame(rows, "a_only long, b_only long")).collect()}
    for a, b in rows[:-1]:
        n = a + b
        assert abs(got[a, b] - min(1.0, 2 * sum(comb(n, k) for k in range(min(a, b) + 1)) / 2**n)) < 1e-9
    assert abs(got[50_000, 50_400] - 0.2076) < 2e-3


def test_mann_whitney_p(spark):
    rows = [(0, float(v), f) for v, f in ((1, 1), (2, 0), (2, 1), (3, 0), (5, 1), (7, 0), (8, 0), (8, 1), (9, 0))]
    got = inference.mann_whitney(spark.createDataFrame(rows, "g int, v double, f int"), ["g"], "v", "f").first()
    import math

    assert abs(got.p_value - math.erfc(got.z / math.sqrt(2))) < 1e-12 and 0 < got.p_value < 1


def test_percentiles_equal_the_exact_ones(spark):
    rows = spark.range(500).selectExpr("id % 3 g", "cast(hash(id) % 40 as double) v").union(spark.createDataFrame([(0, None), (9, 5.0), (8, None)], "g long, v double"))
    want = {r.g: tuple(r.p or (None,) * 3) for r in rows.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.975))).alias("p")).collect()}
    got = {r.g: (r.a, r.b, r.c) for r in summary.percentiles(rows, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.975}).collect()}
    assert got.keys() == want.keys() and all(x == y or abs(x - y) < 1e-9 for g in got for x, y in zip(got[g], want[g]))


def test_pair_blocks_change_nothing(spark, monkeypatch):
    rows = tables.vectors(spark, "/root/testdata/sf0.001").cache()
    told = lambda: sorted((r.i, r.j, r.hamming, round(r.cosine, 9)) for r in pairs.near_pairs(rows, 30, 0.1, "both").collect())
    across = lambda: [tuple(r) for r in pairs.across_classes(rows, 0.1, 50).collect()]
    one, first = told(), across()
    monkeypatch.setattr(metric, "BLOCK", 7)
    assert told() == one and across() == first and len(one) > 10 and all(i < j for i, j, *_ in one)


@pytest.mark.parametrize("metric", ["macro_f1", "accuracy"])
def test_paired_bootstrap_against_resampling(spark, metric):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 150)
    a, b = np.where(rng.random(150) < 0.3, rng.integers(0, 3, 150), y), np.where(rng.random(150) < 0.2, rng.integers(0, 3, 150), y)
    f1 = lambda t, p: np.mean([2 * ((t == c) & (p == c)).sum() / max(1, (t == c).sum() + (p == c).sum()) for c in range(4)])
    value = f1 if metric == "macro_f1" else lambda t, p: (t == p).mean()
    deltas = []
    for _ in range(3000):
        k = rng.integers(0, 150, 150)
        deltas.append(value(y[k], b[k]) - value(y[k], a[k]))
    rows = spark.createDataFrame([("g", int(t), int(p), int(q)) for t, p, q in zip(y, a, b)], "seed string, target int, a int, b int")
    got = inference.paired_bootstrap(rows, "seed", 4, 3100, metric).first()
    assert abs(got.observed - (value(y, b) - value(y, a))) < 1e-12 and got.n == 150
    assert abs(got.delta_std - np.std(deltas)) < 0.1 * np.std(deltas) and abs(got.ci_low - np.quantile(deltas, 0.025)) < 0.15 * np.std(deltas)
    assert abs(got.fraction_above - np.mean(np.array(deltas) > 0)) < 0.05
    again = inference.paired_bootstrap(rows.repartition(5), "seed", 4, 3100, metric).first()
    assert again == got
    with pytest.raises(ValueError):
        inference.paired_bootstrap(rows, "seed", 4, 10, "other")


def test_poisson_auc_against_resampling(spark):
    rng = np.random.default_rng(4)
    label = rng.random(120) < 0.4
    score = np.round(rng.random(120) + 0.3 * label, 1)
    auc = lambda s, f: np.mean([(x > z) + (x == z) / 2 for x in s[f] for z in s[~f]])
    draws = [auc(score[k], label[k]) for k in (rng.integers(0, 120, 120) for _ in range(600))]
    rows = spark.createDataFrame([(1, float(s), bool(f)) for s, f in zip(score, label)], "g int, s double, f boolean")
    got = inference.poisson_bootstrap_auc(rows, ["g"], "s", "f", 2000).first()
    assert abs(got.auc - auc(score, label)) < 1e-12 and got.n_used == 2000 and abs(got.ci_low - np.quantile(draws, 0.025)) < 0.03 and abs(got.ci_high - np.quantile(draws, 0.975)) < 0.03


def test_git_state(spark, tmp_path):
    import subprocess

    row = scans.environment(spark, str(tmp_path)).first()
    assert row.git_commit is None and row.git_changed is None and isinstance(row.devices, list)
    git = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@x", *a], cwd=tmp_path, check=True, capture_output=True, text=True).stdout.strip()
    git("init")
    (tmp_path / "f").write_text("1")
    git("add", "f")
    git("commit", "-m", "one")
    row = scans.environment(spark, str(tmp_path)).first()
    assert (row.git_commit, row.git_changed) == (git("rev-parse", "HEAD"), False)
    (tmp_path / "f").write_text("2")
    assert scans.environment(spark, str(tmp_path)).first().git_changed


def test_pixels_of_grey_and_alpha(spark):
    rows = spark.createDataFrame([("g", 1, 2, 1, bytearray(b"\x33\xff")), ("a", 1, 1, 4, bytearray(b"\x00\x33\xff\x80")), ("odd", 1, 1, 2, bytearray(b"\x00\x01"))], "path string, height int, width int, channels int, data binary")
    got = sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in scans.pixels(rows).collect())
    assert got == [("a", 0, 0, 1.0, 0.2, 0.0), ("g", 0, 0, 0.2, 0.2, 0.2), ("g", 1, 0, 1.0, 1.0, 1.0)]
