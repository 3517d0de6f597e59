"""Whole-image kernels against plain loops, and JPEG against the JVM's own encoder."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import rasters as R
from quillon.functions import registration as G
from quillon.operators import images, inference, pixels
from quillon.sources import scans


def rows_of(spark, arrays):
    return spark.createDataFrame([(k, *a.shape[:2], 3, bytearray(np.ascontiguousarray(a[:, :, ::-1]).tobytes())) for k, a in enumerate(arrays)], "id int, height int, width int, channels int, data binary")


def flooded(mask):
    """4-connected parts as sets, in the order of their first pixels."""
    left, parts = {tuple(map(int, p)) for p in np.argwhere(mask)}, []
    for start in sorted(left):
        if start not in left:
            continue
        part, todo = set(), [start]
        left.discard(start)
        while todo:
            y, x = todo.pop()
            part.add((y, x))
            for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if p in left:
                    left.discard(p)
                    todo.append(p)
        parts.append(part)
    return parts


def test_parts_and_holes():
    rng = np.random.default_rng(2)
    spiral = np.zeros((15, 15), bool)
    for k in range(0, 15, 2):
        spiral[k, :] = True
        if k < 14:
            spiral[k + 1, 14 if k % 4 == 0 else 0] = True
    for mask in [rng.random((9, 13)) < 0.55 for _ in range(20)] + [spiral, np.zeros((4, 4), bool), np.ones((3, 5), bool), np.ones((1, 1), bool)]:
        parts, n = R.labelled(mask)
        want = flooded(mask)
        assert n == len(want)
        for k, part in enumerate(want, 1):
            assert {tuple(map(int, p)) for p in np.argwhere(parts == k)} == part
        h, w = mask.shape
        edge = lambda p: any(y in (0, h - 1) or x in (0, w - 1) for y, x in p)
        closed = mask.copy()
        for part in flooded(~mask):
            if not edge(part):
                for y, x in part:
                    closed[y, x] = True
        assert (R.filled(mask) == closed).all()
        big = np.zeros_like(mask)
        for y, x in max(want, key=len, default=()):
            big[y, x] = True
        assert (R.largest(mask) == big).all()
        near = lambda y, x: [mask[b, a] if 0 <= b < h and 0 <= a < w else False for b, a in ((y, x), (y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1))]
        assert all(R.eroded(mask)[y, x] == all(near(y, x)) and R.dilated(mask)[y, x] == any(near(y, x)) for y in range(h) for x in range(w))


def test_resampling():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (12, 10, 3), dtype=np.uint8)
    assert (R.resized(a, 12, 10) == a).all() and (R.resized(np.full((30, 20), 77, np.uint8), 7, 9, "lanczos") == 77).all()
    assert (R.resized(a[..., 0], 6, 5, "area") == np.floor(R._byte(a[..., 0].reshape(12, 5, 2).mean(2)).reshape(6, 2, 5).mean(1) + 0.5)).all()
    row = np.array([[0, 0, 100, 0, 0, 0]], np.uint8)  # one tap of the cubic kernel, widened twice

    def cubic(x):
        x = abs(x)
        return 1 - 2.5 * x**2 + 1.5 * x**3 if x < 1 else 2 - 4 * x + 2.5 * x**2 - 0.5 * x**3 if x < 2 else 0

    want = []
    for k in range(3):
        taps = [cubic((i + 0.5 - (k + 0.5) * 2) / 2) for i in range(6)]
        want.append(min(255, max(0, math.floor(100 * taps[2] / sum(taps) + 0.5))))
    assert R.resized(row, 1, 3).tolist() == [want]
    assert R.centred(rng.integers(0, 256, (40, 90, 3), dtype=np.uint8)).shape == (224, 224, 3)


def test_hash(spark):
    rng = np.random.default_rng(4)
    arrays = [np.kron(rng.integers(0, 256, (8, 8, 3), dtype=np.uint8), np.ones((4, 4, 1), np.uint8)) for _ in range(3)]
    got = {r.id: r.word for r in images.perceptual_hashes(rows_of(spark, arrays), "id").collect()}
    for k, a in enumerate(arrays):
        g = [[(int(r) * 19595 + int(gr) * 38470 + int(b) * 7471 + 32768) >> 16 for r, gr, b in line] for line in a]
        low = [[sum(g[y][x] * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
        median = np.median(low)
        word = sum(1 << (63 - 8 * u - v) for u in range(8) for v in range(8) if low[u][v] > median)
        assert got[k] % (1 << 64) == word
    brighter = np.clip(arrays[0].astype(int) + 6, 0, 255).astype(np.uint8)
    near = images.perceptual_hashes(rows_of(spark, [arrays[0], brighter, arrays[1]]), "id").orderBy("id").collect()
    apart = lambda x, y: ((x.word ^ y.word) % (1 << 64)).bit_count()
    assert apart(near[0], near[1]) <= 6 < 16 <= apart(near[0], near[2])


def test_features(spark):
    import colorsys

    rng = np.random.default_rng(5)
    a = np.full((40, 50, 3), 240, np.uint8)  # paper
    a[5:33, 8:44] = (40, 150, 50)  # leaf
    a[10:14, 12:20] = (150, 90, 40)  # lesions, one of two pixels and one beside the leaf
    a[20:26, 30:33] = (140, 60, 30)
    a[29, 12:14] = (150, 90, 40)
    a[36:39, 46:49] = (150, 90, 40)
    a[16:18, 22:24] = 250  # a hole
    noisy = rng.integers(0, 256, (20, 20, 3), dtype=np.uint8)
    got = {r.id: r for r in images.features(rows_of(spark, [a, noisy, np.full((6, 6, 3), 255, np.uint8)]), "id", crop=False).collect()}
    for k, img in enumerate((a, noisy)):
        p = [[colorsys.rgb_to_hsv(*(int(c) / 255 for c in x)) for x in line] for line in img]
        flat = [x for line in p for x in line]
        hit = [(h * 360 <= 50 or h * 360 >= 330) and s >= 0.18 and 0.12 <= v <= 0.97 for h, s, v in flat]
        sick = [x for x, t in zip(flat, hit) if t]
        mean = lambda f, xs: sum(map(f, xs)) / len(xs)
        assert got[k].global_mean[:4] == pytest.approx([mean(lambda x: math.sin(2 * math.pi * x[0]), flat), mean(lambda x: math.cos(2 * math.pi * x[0]), flat), mean(lambda x: x[1], flat), mean(lambda x: x[2], flat)])
        assert got[k].lesion_frac_of_image == pytest.approx(sum(hit) / len(flat)) and got[k].lesion_sat == pytest.approx(mean(lambda x: x[1], sick))
        hist = Counter(min(int(round(x[2], 12) * 8), 7) for x in flat)
        assert got[k].global_hist[26:] == pytest.approx([hist[i] / len(flat) for i in range(8)], abs=1e-9)
        assert sum(got[k].global_hist[:18]) == pytest.approx(1) and got[k].lesion_all == got[k].lesion_colour + got[k].lesion_morph and len(got[k].lesion_all) == 30
        sizes = sorted(len(x) for x in flooded(np.array(hit).reshape(img.shape[:2])) if len(x) >= 4)
        assert got[k].n_components == len(sizes) and got[k].median_component_px == np.median(sizes)
        assert got[k].lesion_morph == pytest.approx([sum(hit) / len(flat), math.log1p(len(sizes)), math.log1p(np.median(sizes)), sizes[-1] / sum(sizes)])
    corner = 12  # an opening of two steps by a cross takes three pixels off each right-angled corner
    area = 28 * 36 - corner
    assert got[0].leaf_frac_of_image == pytest.approx(area / 2000) and got[0].lesion_frac_of_leaf == pytest.approx((32 + 18 + 2) / area)
    assert got[0].mask_frac_on_paper == pytest.approx(9 / 61) and got[0].n_components == 3 and got[0].mask_frac_on_margin == 0
    assert got[2].lesion_hue_deg is None and got[2].lesion_colour == [0.0] * 26 and got[2].leaf_frac_of_image == 0


def test_odd_images(spark):
    odd = spark.createDataFrame([(0, 2, 2, 3, None), (1, 2, 2, 3, bytearray(5)), (2, None, 2, 3, bytearray(12)), (3, 0, 0, 3, bytearray()), (4, 1, 1, 1, bytearray(b"\x80")), (None, 1, 2, 4, bytearray(b"\x01\x02\x03\xff" * 2))], "id int, height int, width int, channels int, data binary")
    assert {r.id for r in images.perceptual_hashes(odd, "id").filter("word is null").collect()} == {0, 1, 2, 3}
    assert images.features(odd, "id").filter("n_components is null").count() == 4 and images.centre_crops(odd, "id").filter("height = 224").count() == 2
    none = odd.filter("id > 90")
    assert images.features(none, "id").count() == 0 and images.derivative_parameters(none.withColumn("op", F.lit("flip")).withColumn("d", F.col("id")), none, ["id"], "d").count() == 0


def test_parameters(spark):
    rng = np.random.default_rng(6)
    source = rng.integers(30, 200, (40, 48, 3), dtype=np.uint8)
    g = R.grey(source)
    grey3 = lambda x: np.repeat(np.clip(np.rint(x), 0, 255).astype(np.uint8)[..., None], 3, 2)
    pad = np.pad(g.astype(float), 3, mode="reflect")
    k = np.exp(-0.5 * (np.arange(-3, 4) / 1.0) ** 2)
    k /= k.sum()
    blurred = sum(k[i] * k[j] * pad[i : i + 40, j : j + 48] for i in range(7) for j in range(7))
    assert np.allclose(R.gaussian(g, 1.0), blurred)
    made = [("blur", grey3(blurred)), ("blur", grey3(1.3 * g - 30)), ("contrast", grey3(1.1 * g + 5)), ("flip", source[:, ::-1]), ("flip", source[::-1, ::-1]), ("rotation", source), ("other", source), ("flip", np.kron(source[::-1], np.ones((2, 2, 1), np.uint8)))]
    d = rows_of(spark, [m for _, m in made]).withColumnRenamed("id", "d").withColumn("id", F.lit(0)).withColumn("op", F.element_at(F.array(*(F.lit(o) for o, _ in made)), F.col("d") + 1))
    d = d.unionByName(d.filter("d = 0").withColumns({"d": F.lit(99), "id": F.lit(5)}))  # without a parent
    got = {r.d: r for r in images.derivative_parameters(d, rows_of(spark, [source]), ["id"], "d").collect()}
    assert set(got) == set(range(8)) and got[0].sigma == 1.0 and got[1].status == "blur_fit_failed" and got[1].sigma is None
    assert (got[2].gain, got[2].offset) == pytest.approx((1.1, 5), abs=0.05) and [got[x].flip_axis for x in (3, 4, 7)] == ["hflip", "rot180", "vflip"]
    assert got[5].status == "affine_failed" and got[5].angle_deg is None and got[6].status == "ok" and got[6].gain is None


def cloudy(n, seed):
    """Grey noise at several sizes."""
    rng = np.random.default_rng(seed)
    a = sum(w * s * G.smooth(rng.normal(size=(n, n)), s) for s, w in ((2, 1), (4, 1.5), (8, 2)))
    return ((a - a.min()) / (a.max() - a.min()) * 255).astype(np.uint8)


@pytest.mark.parametrize("angle, zoom", [(0, 1), (30, 1), (-30, 1), (0, 0.8), (0, 1.25), (17.5, 1.1), (-12, 0.85), (90, 1), (179, 1.0)])
def test_planted_turns_and_zooms(angle, zoom):
    for seed in range(3):
        source = cloudy(128, seed)
        found = G.similarity(source, G.transformed(source, angle, zoom))
        assert found is not None and abs((found[0] - angle + 180) % 360 - 180) < 1 and abs(found[1] / zoom - 1) < 0.02


def test_transformed_by_plain_loops():
    a = cloudy(12, 3)
    assert (G.transformed(a, 0, 1) == a).all() and (G.transformed(a, 90, 1) == np.rot90(a, -1)).all()
    got = G.transformed(a, 20, 0.9)
    for y, x in itertools.product(range(12), repeat=2):
        c, s = math.cos(math.radians(20)) / 0.9, math.sin(math.radians(20)) / 0.9
        u, v = c * (x - 5.5) + s * (y - 5.5) + 5.5, -s * (x - 5.5) + c * (y - 5.5) + 5.5
        i, j = math.floor(v), math.floor(u)
        at = lambda p, q: float(a[p, q]) if 0 <= p < 12 and 0 <= q < 12 else 128.0
        want = sum(at(i + p, j + q) * (v - i if p else 1 - v + i) * (u - j if q else 1 - u + j) for p in (0, 1) for q in (0, 1))
        assert abs(got[y, x] - want) <= 0.5 + 1e-6


def test_unrelated_or_bare_images_have_no_turn():
    a = cloudy(128, 1)
    assert G.similarity(a, cloudy(128, 99)) is None and G.similarity(a, np.full((80, 90), 7, np.uint8)) is None
    assert G.similarity(a[:9, :9], a) is None and G.similarity(a, a[:, :1]) is None
    big = np.kron(cloudy(128, 5), np.ones((8, 8), np.uint8))  # 1,024 pixels, shrunken to 512
    assert abs(G.similarity(big, G.transformed(big, 10, 1))[0] - 10) < 1


def test_similarity_survives_wrong_matches():
    rng = np.random.default_rng(2)
    p = rng.random(60) * 100 + 1j * rng.random(60) * 100
    q = 1.1 * np.exp(1j * math.radians(25)) * p + (3 - 4j)
    q[:30] = rng.random(30) * 100 + 1j * rng.random(30) * 100
    f, o, n = G.consensus(p, q, G.Effort())
    assert n >= 30 and abs(f - 1.1 * np.exp(1j * math.radians(25))) < 0.01 and abs(o - (3 - 4j)) < 1


def test_affine_derivatives(spark):
    sources = [np.repeat(cloudy(128, k)[..., None], 3, 2) for k in range(4)]
    parents = rows_of(spark, sources).withColumnRenamed("id", "image_id")
    planted = parents.withColumns({"deg": F.col("image_id") * 9.0 - 12, "zoom": F.lit(1.0) + F.col("image_id") * 0.05})
    made = images.turned(planted, "image_id", "deg", "zoom")
    assert images.enlarged(parents, "image_id", 2).first().height == 256
    derived = made.withColumn("op", F.lit("rotation")).unionByName(made.withColumns({"op": F.lit("crop"), "image_id": F.pmod(F.col("image_id") + 1, F.lit(4))})).withColumn("d", F.monotonically_increasing_id())
    got = images.derivative_parameters(derived, parents, ["image_id"], "d")
    rows = got.collect()
    good = [r for r in rows if r.op == "rotation"]
    assert all(r.status == "ok" and abs(r.angle_deg - (r.image_id * 9 - 12)) < 1 and abs(r.scale / (1 + r.image_id * 0.05) - 1) < 0.02 and r.inliers >= 10 for r in good) and len(good) == 4
    assert {r.status for r in rows if r.op == "crop"} == {"affine_failed"}  # against another parent
    ranges = {(r.op, r.parameter): (r.n, r.low, r.high) for r in images.parameter_ranges(got).collect()}
    assert ranges["crop", "affine_failed"][0] == 4 and ranges["rotation", "angle_deg"][0] == 4 and 0 < ranges["rotation", "angle_deg"][1] < ranges["rotation", "angle_deg"][2] < 16


def encoded(spark, a, quality):
    """A JPEG of the JVM's encoder."""
    jvm = spark._jvm
    img = jvm.java.awt.image.BufferedImage(a.shape[1], a.shape[0], 1)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            r, g, b = (int(c) for c in a[y, x])
            img.setRGB(x, y, (r << 16) | (g << 8) | b)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()
    how.setCompressionMode(2)  # explicit
    how.setCompressionQuality(float(quality))
    out = jvm.java.io.ByteArrayOutputStream()
    sink = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(sink)
    writer.write(None, jvm.javax.imageio.IIOImage(img, None, None), how)
    sink.flush()
    writer.dispose()
    return bytes(out.toByteArray())


@pytest.fixture
def picture():
    y, x = np.mgrid[0:37, 0:45]
    return np.clip(np.stack([120 + 90 * np.sin(x / 5), 100 + 2 * y, 60 + 50 * np.cos((x + y) / 7)], -1) + np.random.default_rng(7).normal(0, 6, (37, 45, 3)), 0, 255).astype(np.uint8)


def test_jpeg(spark, picture, tmp_path):
    df = spark.createDataFrame([(1, y, x, *(float(c) / 255 for c in picture[y, x])) for y in range(37) for x in range(45)], "image_id int, y int, x int, r double, g double, b double")
    for name, quality in (("jpeg_q60", 0.6), ("jpeg_q30", 0.3)):
        (tmp_path / f"{name}.jpg").write_bytes(encoded(spark, picture, quality))
        real = np.zeros(picture.shape)
        good, _ = scans.decoded(spark, str(tmp_path / f"{name}.jpg"))
        for r in scans.pixels(good).collect():
            real[r.y, r.x] = r.r, r.g, r.b
        got = np.zeros(picture.shape)
        for r in pixels.perturbed(df, [name]).collect():
            got[r.y, r.x] = r.r, r.g, r.b
        assert np.abs(got - real).mean() * 255 < 1 < 5 < np.abs(got - picture / 255).mean() * 255
    whole = pixels.jpeg_tile(picture, 60)
    tiles = pixels.jpeg(60, 16)(df).collect()
    assert all(np.allclose((r.r * 255, r.g * 255, r.b * 255), whole[r.y, r.x]) for r in tiles) and len(tiles) == 37 * 45
    flat = np.full((16, 16, 3), 90)
    assert np.abs(pixels.jpeg_tile(flat, 30) - 90).max() <= 6


@pytest.mark.parametrize("tag", [1, 3, 6, 8, 5])
def test_upright(spark, picture, tmp_path, tag):
    plain = encoded(spark, picture, 0.9)
    tiff = b"MM\0*\0\0\0\x08\0\x02" + b"\x01\x0f\0\x02\0\0\0\x02ab\0\0" + b"\x01\x12\0\x03\0\0\0\x01" + tag.to_bytes(2, "big") + b"\0\0" + b"\0\0\0\0"
    part = b"Exif\0\0" + tiff
    (tmp_path / "x.jpg").write_bytes(plain[:2] + b"\xff\xe1" + (len(part) + 2).to_bytes(2, "big") + part + plain[2:])
    (tmp_path / "bad.jpg").write_bytes(b"\xff\xd8\xff\xe1\xff")
    flat = scans.decoded(spark, str(tmp_path / "x.jpg"))[0].first()
    seen = images._rgb(flat.height, flat.width, flat.channels, flat.data)
    turned = {1: seen, 3: np.rot90(seen, 2), 6: np.rot90(seen, -1), 8: np.rot90(seen, 1), 5: np.swapaxes(seen, 0, 1)}[tag]
    got = scans.upright(spark, str(tmp_path)).collect()
    assert len(got) == 1 and (images._rgb(got[0].height, got[0].width, got[0].channels, got[0].data) == turned).all()


def test_power_in_full(spark):
    rng = np.random.default_rng(8)
    n, classes = 300, 4
    y = rng.integers(0, classes, n)
    arms = {a: np.where(rng.random(n) < r, rng.integers(0, classes, n), y) for a, r in (("a", 0.2), ("b", 0.35), ("c", 0.5))}
    rows = [(a, i, int(y[i]), int(p[i]), "f" if a < "c" else "g") for a, p in arms.items() for i in range(n)]
    df = spark.createDataFrame(rows, "arm string, item int, target int, pred int, family string")

    def f1(t, p):
        return sum(2 * ((t == c) & (p == c)).sum() / max(1, (t == c).sum() + (p == c).sum()) for c in range(classes)) / classes

    draws = rng.integers(0, n, (1500, n))
    got = {(r.a, r.b): r for r in inference.power_in_full(df, "arm", "item", classes, 2000).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (a, b), r in got.items():
        deltas = [f1(y[d], arms[b][d]) - f1(y[d], arms[a][d]) for d in draws]
        assert r.observed == pytest.approx(f1(y, arms[b]) - f1(y, arms[a])) and r.n == n
        assert r.delta_std == pytest.approx(np.std(deltas, ddof=1), rel=0.1)
        assert r.ci_half_width == pytest.approx(np.subtract(*np.percentile(deltas, [97.5, 2.5])) / 2, rel=0.12) and r.mde80 == pytest.approx(2.801585 * r.delta_std)
    any_ = np.logical_or.reduce([p == y for p in arms.values()])
    best = max(arms, key=lambda a: f1(y, arms[a]))
    room = f1(y, np.where(any_, y, arms[best])) - f1(y, arms[best])
    one = got["a", "b"]
    assert one.headroom == pytest.approx(room) and one.median_mde80 == pytest.approx(np.median([r.mde80 for r in got.values()])) and one.go == (one.median_mde80 <= room / 2)
    assert [(r.a, r.b) for r in inference.power_in_full(df, "arm", "item", classes, 200, family="family").collect()] == [("a", "b")]


def test_command_line(tmp_path, capsys, spark):
    from quillon.__main__ import main

    assert main(["list", "--with-sql"]) == 0 and "leak_audit_summary" in capsys.readouterr().out
    assert main(["run", "value_shares", "--tables", "/root/testdata/sf0.001", "--out", f"{tmp_path}/out", "--format", "json"]) == 0
    assert spark.read.json(f"{tmp_path}/out").count() > 0
    with pytest.raises(SystemExit):
        main(["run", "no_such_query", "--tables", "x"])


def test_batches_of_images_are_bounded(spark, monkeypatch):
    images.workers.bounded(spark)
    one = np.zeros((120, 120, 3), np.uint8)
    rows = rows_of(spark, [one]).select("height", "width", "channels", "data").crossJoin(spark.range(1200).coalesce(1).withColumnRenamed("id", "id"))
    seen = rows.select("id", "data").mapInPandas(lambda batches: (b.assign(n=len(b))[["n"]][:1] for b in batches), "n long").collect()
    assert max(r.n for r in seen) * one.size <= 1.2 * images.workers.BATCH
    given = [len(f) for f in images._parts(((k, bytes(1 << 20)) for k in range(100)), ["k", "data"])]
    assert sum(given) == 100 and max(given) <= 33
    assert images.centre_crops(rows.limit(3), "id", 20, 10).filter("height = 10").count() == 3


def test_blurs_of_small_images_equal_those_of_large_ones():
    rng = np.random.default_rng(4)
    for h, w in ((8, 8), (3, 11), (1, 5)):
        a = rng.integers(0, 256, (h, w)).astype(np.uint8)
        down, along = R.blurs(h, images.SIGMAS), R.blurs(w, images.SIGMAS)
        for k, s in enumerate(images.SIGMAS):
            assert np.allclose(down[k] @ a.astype(float) @ along[k].T, R.gaussian(a, s))


@pytest.mark.parametrize("side", [8, 128])
def test_blur_needs_no_join_by_pixel(spark, side):
    a = np.random.default_rng(5).random((19, 26, 3))
    lacking = {(3, 4), (18, 25), (8, 8)}
    df = spark.createDataFrame([(7, y, x, *map(float, a[y, x])) for y in range(19) for x in range(26) if (y, x) not in lacking], "image_id long, y int, x int, r double, g double, b double").repartition(3)
    k = np.exp(-(np.arange(-3, 4) ** 2) / 2)
    k /= k.sum()
    there = np.ones((19, 26, 1))
    for p in lacking:
        there[p] = 0
    wide = sum(w * (a * there)[:, np.clip(np.arange(26) + s, 0, 25)] for s, w in zip(range(-3, 4), k)) * there
    want = sum(w * wide[np.clip(np.arange(19) + s, 0, 18)] for s, w in zip(range(-3, 4), k))
    made = pixels.blur(1.0, side)(df)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "hint" in plan.lower() or "shuffle_hash" in plan.lower()
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in made.collect()}
    assert set(got) == {(y, x) for y in range(19) for x in range(26)} - lacking
    assert all(np.allclose(got[p], want[p]) for p in got)


def test_images_are_not_broadcast(spark):
    """Enlarged images are thought to be a few KB a table; the driver must see none of them."""
    from quillon.plans import rasters

    found = rasters.affine_parameters(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert found.columns == ["image_id", "op", "status", "angle_deg", "scale", "inliers", "planted_deg", "planted_scale"] and dict(found.dtypes)["planted_deg"] == "double"
