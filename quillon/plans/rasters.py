"""Registered queries of image features. Whole-image kernels have no twin: the tests hold them against plain loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import images, pixels
from quillon.plans.analyses import GRID, _grid
from quillon.plans.catalog import query


def _images(spark, sf_dir):
    return images.pack(_grid(spark, sf_dir))


@query(None)
def perceptual_hashes(spark, sf_dir):
    return images.perceptual_hashes(_images(spark, sf_dir), "image_id")


@query(None)
def centre_crops(spark, sf_dir):
    """Sizes and content digests of the images as a classifier would see them."""
    return images.centre_crops(_images(spark, sf_dir), "image_id").select("image_id", "height", "width", F.sha2("data", 256).alias("sha256"))


@query(None)
def image_features(spark, sf_dir):
    """Colour and lesion features of every image; the grid images are read as they are, as most of a crop of them would be
    interpolated."""
    return images.features(_images(spark, sf_dir), "image_id", crop=False)


@query(None)
def derivative_parameters(spark, sf_dir):
    """What made a derivative from its parent: each image against a blurred, a brighter, a mirrored and a turned one."""
    grid = _grid(spark, sf_dir)
    px = lambda **c: grid.select("image_id", *(c.get(k, F.col(k)).alias(k) for k in ("y", "x", "r", "g", "b")))
    made = {
        "blur": pixels.blur(0.8)(grid),
        "brightness": px(**{c: F.col(c) * 0.8 + 0.1 for c in "rgb"}),
        "flip": px(x=7 - F.col("x")),
        "rotation": px(y=F.col("x"), x=7 - F.col("y")),
    }
    derived = None
    for op, rows in made.items():
        part = images.pack(rows).withColumn("op", F.lit(op))
        derived = part if derived is None else derived.unionByName(part)
    derived = derived.withColumn("derivative", F.concat_ws("_", F.col("image_id").cast("string"), "op"))
    return images.derivative_parameters(derived, _images(spark, sf_dir), ["image_id"], "derivative")


@query(None)
def affine_parameters(spark, sf_dir):
    """Each grid image at sixteen times its size against itself turned by up to 30 degrees and zoomed by 0.8 to 1.25, both
    told by its id: what was planted and what was found."""
    small = _images(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "image_id")  # small rows, much work each
    plant = lambda d: d.withColumn("planted_deg", F.pmod(F.col("image_id") * 17, F.lit(61)) - 30).withColumn("planted_scale", 0.8 + F.pmod(F.col("image_id") * 7, F.lit(46)) / 100)
    whole = images.enlarged(small, "image_id", 16)
    planted = plant(whole)
    made = images.turned(planted, "image_id", "planted_deg", "planted_scale").withColumn("op", F.when(F.abs("planted_deg") > 5, "rotation").otherwise("zoom"))
    found = images.derivative_parameters(made.withColumnRenamed("image_id", "derivative").withColumn("image_id", F.col("derivative")), whole, ["image_id"], "derivative")
    told = plant(found.select("image_id", "op", "status", "angle_deg", "scale", "inliers"))  # by the id, as before
    return told.withColumn("planted_deg", F.col("planted_deg").cast("double"))


@query(None)
def derivative_ranges(spark, sf_dir):
    """The usual range of each operation's recovered figures, and how many derivatives have none."""
    return images.parameter_ranges(derivative_parameters(spark, sf_dir))


COLOURS = f"""WITH {GRID}, m AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM px),
 h0 AS (SELECT *, CASE WHEN d < 1e-10 THEN 0 WHEN v = r THEN (g - b) / (d + 1e-10) WHEN v = g THEN (b - r) / (d + 1e-10) + 2 ELSE (r - g) / (d + 1e-10) + 4 END / 6 AS h0, CASE WHEN v > 0 THEN d / (v + 1e-10) ELSE 0 END AS s FROM m),
 c AS (SELECT image_id, CASE WHEN h0 < 0 THEN h0 + 1 ELSE h0 END AS h, s, v FROM h0)"""


@query(COLOURS + " SELECT image_id, round(avg(sin(2 * pi() * h)), 6) AS sin_hue, round(avg(cos(2 * pi() * h)), 6) AS cos_hue, round(avg(s), 6) AS s_mean, round(avg(v), 6) AS v_mean, round(stddev_pop(s), 6) AS s_std, round(stddev_pop(v), 6) AS v_std FROM c GROUP BY 1")
def colour_moments(spark, sf_dir):
    return pixels.colour_moments(_grid(spark, sf_dir))


@query(COLOURS + """, b AS (SELECT image_id, unnest([{'channel': 'h', 'bin': least(floor(h * 18), 17)::INTEGER}, {'channel': 's', 'bin': least(floor(s * 8), 7)::INTEGER}, {'channel': 'v', 'bin': least(floor(v * 8), 7)::INTEGER}]) AS c FROM c)
 SELECT image_id, c.channel AS channel, c.bin AS bin, round(count(*) / 64.0, 6)::DOUBLE AS share FROM b GROUP BY 1, 2, 3""")
def colour_histogram(spark, sf_dir):
    return pixels.colour_histogram(_grid(spark, sf_dir))
