"""Leakage audits of a partitioned asset table: split, class_name, filename, md5, canonical_id, is_derived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVALUATION = ("val", "test")


def leaking(assets: DataFrame, keys: list[str]) -> DataFrame:
    """Training rows whose key occurs in an evaluation split."""
    held = assets.filter(F.col("split").isin(*EVALUATION)).select(*keys).distinct()
    return assets.filter("split = 'train'").join(held, keys, "left_semi")


def without_leaks(assets: DataFrame, *key_sets: list[str]) -> DataFrame:
    """All rows but the training rows that leak by any of the key sets."""
    for keys in key_sets:
        held = assets.filter(F.col("split").isin(*EVALUATION)).select(*keys).distinct().withColumn("_train", F.lit("train"))
        match = [F.col("split") == F.col("_train"), *(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)]
        cond = match[0]
        for m in match[1:]:
            cond = cond & m
        assets = assets.join(held.select("_train", *(F.col(k).alias(f"_{k}") for k in keys)), cond, "left_anti")
    return assets


def groups_over(assets: DataFrame, keys: list[str], across_splits: bool) -> DataFrame:
    """Groups of equal keys with n and the sorted distinct splits; several rows, or several splits."""
    found = assets.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("split")).alias("splits"))
    return found.filter(F.size("splits") > 1 if across_splits else F.col("n") > 1)


def audit(assets: DataFrame) -> DataFrame:
    """(check, n_rows, n_groups): what a clean partition has none of."""
    exact, family = leaking(assets, ["md5"]), leaking(assets, ["class_name", "canonical_id"])
    stray = assets.filter(F.col("is_derived") & F.col("split").isin(*EVALUATION))
    parts = [("exact", exact, ["md5"]), ("family", family, ["class_name", "canonical_id"]), ("derivative_in_evaluation", stray, ["class_name", "canonical_id"])]
    rows = [d.agg(F.count("*").alias("n_rows"), F.count_distinct(*(F.col(k) for k in keys)).alias("n_groups")).select(F.lit(name).alias("check"), "*") for name, d, keys in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def counts_by_split(assets: DataFrame, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    found = assets.groupBy("class_name").pivot("split", list(splits)).count().na.fill(0)
    total = F.col(splits[0])
    for s in splits[1:]:
        total = total + F.col(s)
    return found.withColumn("total", total)


def parents(assets: DataFrame) -> DataFrame:
    """Derived rows with their parent's split; of several parents the last by doc_id. A missing parent gives null."""
    own = assets.filter(~F.col("is_derived")).groupBy("class_name", "canonical_id").agg(F.max_by("split", "doc_id").alias("parent_split"))
    return assets.filter("is_derived").join(own, ["class_name", "canonical_id"], "left")


def drift(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status) of keys that are missing, added or changed; nulls are values."""
    o, n = old.select(key, F.col(value).alias("_o"), F.lit(1).alias("_ho")), new.select(key, F.col(value).alias("_n"), F.lit(1).alias("_hn"))
    status = F.when(F.col("_hn").isNull(), "missing").when(F.col("_ho").isNull(), "added").when(~F.col("_o").eqNullSafe(F.col("_n")), "changed")
    return o.join(n, key, "full_outer").select(key, status.alias("status")).filter("status is not null")


def table_digest(rows: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """SHA-256 of each group's rows in key order. One group's keys meet in one task: for lists of
    locked names. Tables have ``merkle.tree``."""
    line = F.concat_ws("|", *(F.col(k).cast("string") for k in keys))
    return rows.groupBy(group).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("sha256"), F.count("*").alias("n"))
