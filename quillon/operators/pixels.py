"""Image kernels over pixel tables: image_id, y, x, and r, g, b in 0..1. Neighbourhoods are keyed sums or tiles, so an image
of any size is spread over tasks by its pixels."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillon.functions import workers
from quillon.functions.keys import md5_mod
from quillon.functions.vectors import hsv, luma

RGB = ("r", "g", "b")


def _each(f: Callable[[str], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda d: d.withColumns({c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), f(c))) for c in RGB})


def sizes(pixels: DataFrame) -> DataFrame:
    """(image_id, height, width, mean over all channels)."""
    return pixels.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), (F.avg("r") / 3 + F.avg("g") / 3 + F.avg("b") / 3).alias("mean"))


def brightness(delta: float):
    return _each(lambda c: F.col(c) + delta)


def contrast(factor: float):
    def f(d: DataFrame) -> DataFrame:
        return _each(lambda c: (F.col(c) - F.col("mean")) * factor + F.col("mean"))(d.join(sizes(d).select("image_id", "mean"), "image_id")).drop("mean")

    return f


def saturation(factor: float):
    grey = lambda: luma(F.col("r"), F.col("g"), F.col("b"))
    return _each(lambda c: grey() + (F.col(c) - grey()) * factor)


def hue(shift: float):
    """Turns the hue by a part of the circle; grey stays grey."""

    def f(d: DataFrame) -> DataFrame:
        h, s, v = hsv(F.col("r"), F.col("g"), F.col("b"))
        d = d.withColumns({"_h": F.pmod(h + shift, F.lit(1.0)) * 6, "_s": s, "_v": v})
        channel = lambda n: F.pmod(F.lit(float(n)) + F.col("_h"), F.lit(6.0))
        value = lambda n: F.col("_v") * (1 - F.col("_s") * F.greatest(F.lit(0.0), F.least(channel(n), 4 - channel(n), F.lit(1.0))))
        return d.withColumns({"r": value(5), "g": value(3), "b": value(1)}).drop("_h", "_s", "_v")

    return f


def noise(deviation: float, tag: str):
    """Normal noise by Box and Muller from hashes of tag, image, pixel and channel: the same at every run."""

    def draw(c: str, k: str) -> Column:
        key = F.concat_ws("|", F.lit(tag), F.col("image_id").cast("string"), F.col("y").cast("string"), F.col("x").cast("string"), F.lit(c + k))
        return (md5_mod(key, 1 << 32) + 0.5) / float(1 << 32)

    return _each(lambda c: F.col(c) + deviation * F.sqrt(-2 * F.ln(draw(c, "1"))) * F.cos(2 * math.pi * draw(c, "2")))


def shadow(side: str, strength: float = 0.35):
    def f(d: DataFrame) -> DataFrame:
        d = d.join(sizes(d).select("image_id", "width"), "image_id")
        ramp = F.coalesce(F.try_divide(F.col("x").cast("double"), F.col("width") - 1), F.lit(0.0))
        ramp = 1 - ramp if side == "left" else ramp
        return _each(lambda c: F.col(c) * (1 - strength * ramp))(d).drop("width")

    return f


def balance(gains: tuple[float, float, float]):
    return _each(lambda c: F.col(c) * gains[RGB.index(c)])


def _tiles(d: DataFrame, halo: int, side: int) -> DataFrame:
    """(image_id, _ty, _tx, height, width, c) of each tile of ``side``: its pixels and those up to ``halo`` around it."""
    workers.bounded(d.sparkSession)
    s = d.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    d = d.select("image_id", "y", "x", *(F.col(c).cast("double").alias(c) for c in RGB)).join(s.hint("shuffle_hash"), "image_id")  # not through the driver
    tile = lambda c, n: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - halo) / side)), F.least(F.floor((F.col(n) - 1) / side), F.floor((F.col(c) + halo) / side))))
    near = d.withColumn("_ty", tile("y", "height")).withColumn("_tx", tile("x", "width"))
    return near.groupBy("image_id", "_ty", "_tx", "height", "width").agg(*(F.collect_list(c).alias(c) for c in ("y", "x")), F.collect_list(F.array(*RGB)).alias("v"))


@lru_cache(maxsize=256)
def _weights(size: int, start: int, side: int, reach: int, sigma: float) -> tuple[int, np.ndarray]:
    """(first place, matrix) of a blur along an axis of ``size``: places of the tile from those within reach; edge pixels are
    repeated beyond the edge."""
    low, high, stop = max(0, start - reach), min(size, start + side + reach), min(size, start + side)
    k = np.arange(-reach, reach + 1)
    w = np.exp(-k * k / (2 * sigma * sigma))
    out = np.zeros((stop - start, high - low))
    at = np.clip(np.arange(start, stop)[:, None] + k, 0, size - 1) - low
    np.add.at(out, (np.arange(stop - start)[:, None], at), w / w.sum())
    return low, out


def blur(sigma: float, side: int = 128):
    """Gaussian, first along x and then along y, cut at three deviations; edge pixels are repeated beyond the edge, lacking ones
    add nothing. Tiles of ``side`` are done apart, each with the pixels around it."""
    reach = math.ceil(3 * sigma)

    def f(d: DataFrame) -> DataFrame:
        names = ["image_id", "y", "x", *RGB]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column("y").offsets.to_numpy()
                y, x = (batch.column(c).flatten().to_numpy() for c in "yx")
                v = batch.column("v").flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
                at = at - at[0]
                head = [batch.column(c).to_numpy() for c in ("_ty", "_tx", "height", "width")]
                who, made = [], []
                for k, (ty, tx, h, w) in enumerate(zip(*(c.tolist() for c in head))):
                    (top, down), (left, along) = _weights(h, ty * side, side, reach, sigma), _weights(w, tx * side, side, reach, sigma)
                    own = slice(at[k], at[k + 1])
                    a, there = np.zeros((down.shape[1], along.shape[1], 3)), np.zeros((down.shape[1], along.shape[1]))
                    a[y[own] - top, x[own] - left], there[y[own] - top, x[own] - left] = v[own], 1
                    inner_y, inner_x = ty * side - top, tx * side - left
                    wide = np.einsum("oj,ijc->ioc", along, a) * there[:, inner_x : inner_x + len(along), None]
                    out = np.einsum("oi,ijc->ojc", down, wide)
                    yy, xx = np.nonzero(there[inner_y : inner_y + len(down), inner_x : inner_x + len(along)])
                    who.append(np.full(len(yy), k))
                    made.append(np.column_stack([yy + ty * side, xx + tx * side, out[yy, xx]]))
                if made:
                    rows = np.concatenate(made)
                    ids = batch.column("image_id").take(pa.array(np.concatenate(who)))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(rows[:, c].astype(np.int64)).cast(kinds[n]) for c, n in enumerate("yx")), *(pa.array(np.ascontiguousarray(rows[:, c])) for c in (2, 3, 4))], names)

        kinds = {c: to_arrow_type(d.schema[c].dataType) for c in "yx"}
        kind = [d.schema[c].dataType.simpleString() for c in names[:3]]
        return _tiles(d, reach, side).mapInArrow(run, ", ".join(f"{c} {t}" for c, t in zip(names, [*kind, "double", "double", "double"])))

    return f


#: The quantisation tables of the JPEG standard's annex K, for brightness and for colour.
BRIGHT = (
    (16, 11, 10, 16, 24, 40, 51, 61),
    (12, 12, 14, 19, 26, 58, 60, 55),
    (14, 13, 16, 24, 40, 57, 69, 56),
    (14, 17, 22, 29, 51, 87, 80, 62),
    (18, 22, 37, 56, 68, 109, 103, 77),
    (24, 35, 55, 64, 81, 104, 113, 92),
    (49, 64, 78, 87, 103, 121, 120, 101),
    (72, 92, 95, 98, 112, 100, 103, 99),
)
COLOUR = (
    (17, 18, 24, 47, 99, 99, 99, 99),
    (18, 21, 26, 66, 99, 99, 99, 99),
    (24, 26, 56, 99, 99, 99, 99, 99),
    (47, 66, 99, 99, 99, 99, 99, 99),
    (99, 99, 99, 99, 99, 99, 99, 99),
    (99, 99, 99, 99, 99, 99, 99, 99),
    (99, 99, 99, 99, 99, 99, 99, 99),
    (99, 99, 99, 99, 99, 99, 99, 99),
)


def jpeg_tile(rgb: np.ndarray, quality: int) -> np.ndarray:
    """An 8-bit tile after JPEG's lossy steps: colour halved in both directions by averages, blocks of 8x8 transformed,
    quantised and brought back, colour doubled by three parts of the nearest value and one of the next in each direction.
    Entropy coding loses nothing and is left out."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    tables = [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (BRIGHT, COLOUR)]
    basis = np.sqrt(np.where(np.arange(8)[:, None] == 0, 1, 2) / 8) * np.cos(math.pi * (np.arange(8)[None] + 0.5) * np.arange(8)[:, None] / 8)
    h, w = rgb.shape[:2]
    a = np.pad(rgb.astype(float), ((0, -h % 16), (0, -w % 16), (0, 0)), mode="edge")

    def coded(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
        blocks = plane.reshape(plane.shape[0] // 8, 8, -1, 8).swapaxes(1, 2) - 128
        kept = np.rint(basis @ blocks @ basis.T / table) * table
        return np.clip(np.rint(basis.T @ kept @ basis + 128), 0, 255).swapaxes(1, 2).reshape(plane.shape)

    luma_ = np.rint(a @ [0.299, 0.587, 0.114])
    blue, red = (np.rint(128 + (a[..., c] - a @ [0.299, 0.587, 0.114]) / k) for c, k in ((2, 1.772), (0, 1.402)))

    def doubled(plane: np.ndarray) -> np.ndarray:
        plane = plane[: (h + 1) // 2, : (w + 1) // 2]
        for _ in range(2):  # along each axis in turn
            wide = np.pad(plane, ((1, 1), (0, 0)), mode="edge")
            plane = np.stack([(3 * plane + wide[:-2]) / 4, (3 * plane + wide[2:]) / 4], 1).reshape(-1, plane.shape[1]).T
        return np.rint(plane)[:h, :w]

    half = lambda p: np.rint(p.reshape(p.shape[0] // 2, 2, -1, 2).mean((1, 3)))
    y = coded(luma_, tables[0])[:h, :w]
    cb, cr = (doubled(coded(half(np.clip(p, 0, 255)), tables[1])) - 128 for p in (blue, red))
    back = np.stack([y + 1.402 * cr, y - (0.114 * 1.772 * cb + 0.299 * 1.402 * cr) / 0.587, y + 1.772 * cb], -1)
    return np.clip(np.rint(back), 0, 255)


def jpeg(quality: int, side: int = 128):
    """JPEG's losses at a quality. A pixel depends on its block of 16x16 and, by the doubled colour, on the blocks beside
    it; so tiles of ``side``, a multiple of 16, are done apart, each with one block around it. A tile lacking pixels
    raises."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x"])
        h, w = (int(rows[c].max() - rows[c].min() + 1) for c in ("y", "x"))
        rows[list(RGB)] = jpeg_tile(np.rint(rows[list(RGB)].to_numpy() * 255).reshape(h, w, 3), quality).reshape(-1, 3) / 255
        return rows[(rows["y"] // side == rows["_ty"]) & (rows["x"] // side == rows["_tx"])]

    def f(d: DataFrame) -> DataFrame:
        tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 16) / side), F.floor((F.col(c) + 16) / side)))
        d = d.select("image_id", "y", "x", *(F.col(c).cast("double").alias(c) for c in RGB))
        near = d.withColumn("_ty", tiles("y")).withColumn("_tx", tiles("x"))
        s = d.groupBy("image_id").agg(F.floor(F.max("y") / side).alias("_my"), F.floor(F.max("x") / side).alias("_mx"))
        near = near.join(s.hint("shuffle_hash"), "image_id").filter("_ty between 0 and _my and _tx between 0 and _mx").drop("_my", "_mx")
        return near.groupBy("image_id", "_ty", "_tx").applyInPandas(one, near.schema).drop("_ty", "_tx")

    return f


#: The named corruptions with their groups and strengths.
PERTURBATIONS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "unperturbed": ("unperturbed", lambda d: d),
    "brightness_up": ("brightness/contrast", brightness(0.20)),
    "brightness_down": ("brightness/contrast", brightness(-0.20)),
    "contrast_low": ("brightness/contrast", contrast(0.75)),
    "contrast_high": ("brightness/contrast", contrast(1.25)),
    "saturation_low": ("saturation", saturation(0.50)),
    "saturation_high": ("saturation", saturation(1.50)),
    "hue_pos": ("hue shift", hue(0.05)),
    "hue_neg": ("hue shift", hue(-0.05)),
    "noise_light": ("gaussian noise", noise(0.03, "noise_light")),
    "noise_heavy": ("gaussian noise", noise(0.08, "noise_heavy")),
    "blur_light": ("blur", blur(1.0)),
    "blur_heavy": ("blur", blur(2.5)),
    "jpeg_q60": ("jpeg compression", jpeg(60)),
    "jpeg_q30": ("jpeg compression", jpeg(30)),
    "shadow_left": ("shadow", shadow("left")),
    "shadow_right": ("shadow", shadow("right")),
    "wb_warm": ("white balance", balance((1.12, 1.03, 0.90))),
    "wb_cool": ("white balance", balance((0.90, 1.02, 1.12))),
}
if len(PERTURBATIONS) != 19:
    raise RuntimeError(f"18 corruptions and the unperturbed image are expected, found {len(PERTURBATIONS)} entries")


def perturbed(pixels: DataFrame, names: list[str]) -> DataFrame:
    """The pixels under each named corruption, with its name and group."""
    out = None
    for name in names:
        group, f = PERTURBATIONS[name]
        part = f(pixels).select(F.lit(name).alias("perturbation"), F.lit(group).alias("group"), "image_id", "y", "x", *RGB)
        out = part if out is None else out.unionByName(part)
    return out


def quality(pixels: DataFrame) -> DataFrame:
    """(image_id, blur, brightness): variance of the four-neighbour Laplacian, mirrored at the edges without repeating
    the edge itself, and mean grey, both on the scale 0..255. A side of one pixel has no neighbours of its own: it
    counts as equal to itself."""
    grey = pixels.select("image_id", "y", "x", (255 * luma(F.col("r"), F.col("g"), F.col("b"))).alias("v"))
    s = grey.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(w).alias("w")) for a, b, w in ((0, 0, -4.0), (1, 0, 1.0), (-1, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0)))))
    mirror = lambda p, n: F.when(n == 1, F.lit(0)).when(p < 0, -p).when(p >= n, 2 * n - 2 - p).otherwise(p)
    want = grey.join(s, "image_id").select("image_id", "y", "x", "v", "height", "width", steps.alias("s"))
    want = want.select("image_id", "y", "x", F.col("s.w").alias("w"), mirror(F.col("y") + F.col("s.dy"), F.col("height")).alias("ny"), mirror(F.col("x") + F.col("s.dx"), F.col("width")).alias("nx"))
    met = want.join(grey.select("image_id", F.col("y").alias("ny"), F.col("x").alias("nx"), "v"), ["image_id", "ny", "nx"])
    edge = met.groupBy("image_id", "y", "x").agg(F.sum(F.col("w") * F.col("v")).alias("e"), F.max(F.when(F.col("w") < 0, F.col("v"))).alias("v"))
    return edge.groupBy("image_id").agg(F.var_pop("e").alias("blur"), F.avg("v").alias("brightness"))


def lesion_share(pixels: DataFrame, warm: float = 50.0, wrap: float = 330.0, least_s: float = 0.2, v: tuple[float, float] = (0.1, 0.9)) -> DataFrame:
    """(image_id, n, share): pixels of warm hue within the bounds of saturation and value."""
    h, s, value = hsv(F.col("r"), F.col("g"), F.col("b"))
    hit = ((h * 360 <= warm) | (h * 360 >= wrap)) & (s >= least_s) & value.between(*v)
    return pixels.groupBy("image_id").agg(F.count_if(hit).alias("n"), F.avg(hit.cast("int")).alias("share"))


FLIPS = ("identity", "hflip", "vflip", "rot180")


def flip_axis(source: DataFrame, target: DataFrame) -> DataFrame:
    """(image_id, axis, mae): the flip of the source nearest to the target by mean absolute grey difference; of equal
    ones (to nine digits) the first of FLIPS. Images of one id must have one size; pixels without a partner don't count."""
    grey = lambda d: d.select("image_id", "y", "x", luma(F.col("r"), F.col("g"), F.col("b")).alias("v"))
    s = grey(source).join(source.groupBy("image_id").agg(F.max("y").alias("_h"), F.max("x").alias("_w")), "image_id")
    k = F.explode(F.array(*map(F.lit, range(4)))).alias("k")
    s = s.select("image_id", "y", "x", "_h", "_w", F.col("v").alias("_v"), k)
    y, x = F.when(F.col("k") >= 2, F.col("_h") - F.col("y")).otherwise(F.col("y")), F.when(F.col("k") % 2 == 1, F.col("_w") - F.col("x")).otherwise(F.col("x"))
    met = s.select("image_id", y.alias("y"), x.alias("x"), "k", "_v").join(grey(target), ["image_id", "y", "x"])
    mae = met.groupBy("image_id", "k").agg(F.avg(F.abs(F.col("_v") - F.col("v"))).alias("mae"))
    best = mae.groupBy("image_id").agg(F.min(F.struct(F.round("mae", 9).alias("mae"), "k")).alias("m"))
    return best.select("image_id", F.element_at(F.array(*map(F.lit, FLIPS)), F.col("m.k") + 1).alias("axis"), "m.mae")


def colour_moments(pixels: DataFrame) -> DataFrame:
    """(image_id, sin_hue, cos_hue, s_mean, v_mean, s_std, v_std), deviations of the population."""
    h, s, v = hsv(F.col("r"), F.col("g"), F.col("b"))
    p = pixels.select("image_id", (2 * math.pi * h).alias("_t"), s.alias("_s"), v.alias("_v"))
    return p.groupBy("image_id").agg(F.avg(F.sin("_t")).alias("sin_hue"), F.avg(F.cos("_t")).alias("cos_hue"), F.avg("_s").alias("s_mean"), F.avg("_v").alias("v_mean"), F.stddev_pop("_s").alias("s_std"), F.stddev_pop("_v").alias("v_std"))


def colour_histogram(pixels: DataFrame, bins: tuple[int, int, int] = (18, 8, 8)) -> DataFrame:
    """(image_id, channel, bin, share) of hue, saturation and value over equal bins of 0..1, the last one closed; empty
    bins are left out."""
    parts = F.array(*(F.struct(F.lit(c).alias("channel"), F.least(F.floor(x * n), F.lit(n - 1)).cast("int").alias("bin")) for c, x, n in zip("hsv", hsv(F.col("r"), F.col("g"), F.col("b")), bins)))
    cells = pixels.select("image_id", F.explode(parts).alias("c")).groupBy("image_id", "c.channel", "c.bin").agg(F.count("*").alias("n"))
    size = pixels.groupBy("image_id").agg(F.count("*").alias("_size"))
    return cells.join(size, "image_id").select("image_id", "channel", "bin", (F.col("n") / F.col("_size")).alias("share"))
