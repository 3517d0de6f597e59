"""Readers and the assets, pairs and predictions that the registered queries bind to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.keys import canonical_id, is_derived, md5_mod, split_of
from quillon.functions.vectors import sign_word


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; without a schema all columns are strings and a byte-order mark is dropped."""
    found = spark.read.option("header", True)
    found = found.schema(schema).csv(path) if schema else found.csv(path)
    return found.withColumnRenamed(found.columns[0], found.columns[0].lstrip("﻿")) if found.columns else found


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON file, with its path."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))


def file_index(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, split, class_name, filename, bytes, sha256) of root/split/class/file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -3).alias("split"), F.element_at(parts, -2).alias("class_name"), F.element_at(parts, -1).alias("filename"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as an asset table; families and derivatives come from the id."""
    d = table(spark, sf_dir, "documents")
    mark = F.when(F.col("doc_id") % 7 == 3, "_aug_flip").when(F.col("doc_id") % 7 == 5, "_AUGrot").otherwise("")
    d = d.select("doc_id", F.col("lang").alias("class_name"), "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("md5"), split_of(F.col("doc_id")).alias("split"), F.concat(F.lit("doc_"), (F.col("doc_id") % 400).cast("string"), mark, F.lit(".jpg")).alias("filename"))
    return d.withColumns({"canonical_id": canonical_id(F.col("filename")), "is_derived": is_derived(F.col("filename"))})


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("class_name"), sign_word(F.col("embedding")).alias("word"), F.col("embedding").alias("vector"), split_of(F.col("vec_id")).alias("split"))


ARMS = {"A0": 6, "A1": 9, "A2": 12, "A3": 20}
SEEDS = (42, 1337, 2026)
CLASSES = 10


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arm, seed, image_id, target, pred, p_true): arms err at their own rate, by hashes."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").cast("int").alias("target"))
    arms = spark.createDataFrame([(a, s, r) for a, r in ARMS.items() for s in SEEDS], "arm string, seed int, rate int")
    key = lambda *parts: F.concat_ws("|", *(F.col(p).cast("string") if p != "x" else F.lit("x") for p in parts))
    p = e.crossJoin(F.broadcast(arms))  # arms x seeds is a fixed dozen of rows
    pred = F.when(md5_mod(key("arm", "seed", "image_id"), 100) < F.col("rate"), md5_mod(key("x", "image_id"), CLASSES)).otherwise(F.col("target"))
    return p.select("arm", "seed", "image_id", "target", pred.cast("int").alias("pred"), ((md5_mod(key("image_id", "arm"), 1000) + 1) / 1001.0).alias("p_true"))
