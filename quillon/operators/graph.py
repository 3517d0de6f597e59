"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import workers


def _checkpoints(spark: SparkSession) -> None:
    workers.ready(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, made, True)
        sc.setCheckpointDir(made)


def written(df: DataFrame) -> DataFrame:
    """The rows as Parquet below the checkpoint folder, read back: it cuts the lineage and outlives executors, and goes when
    the JVM ends."""
    spark = df.sparkSession
    _checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (u, v) with u > v: all of a node's larger (or smaller) neighbours go to the least of its own."""
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = seen.join(least, "u")
    moved = met.filter("v > u") if large else met
    out = moved.select(F.col("v").alias("a"), "m")
    if not large:
        out = out.unionByName(least.select(F.col("u").alias("a"), "m"))
    return out.filter("a != m").select(F.col("a").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): the least id that is linked, for every id with an edge to another. Loops, repeated and null
    edges are left out. Each pass is checkpointed, so lost executors cost no more than a pass."""
    _checkpoints(edges.sparkSession)
    e = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().checkpoint()
    state = None
    while True:
        e = _star(_star(e, large=True), large=False).checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def star_edges(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """(i, j): each row of a group with the group's least key, so a group costs one edge a row."""
    least = rows.groupBy(*by).agg(F.min(key).alias("j"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(least, by).select(F.col(key).alias("i"), "j").filter("i != j")
