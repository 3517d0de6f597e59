"""The corpus pipeline: each stage works on all that its predecessor kept.

Cases (nulls, empty and long texts, ties, repeated rows, empty tables) are defined by the operators that the stages
call. Columns beside those of ``documents`` pass through unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import Workspace
from quillon.llm.decontaminate import decontaminated
from quillon.llm.exact_dedup import distinct_texts
from quillon.llm.jaccard_join import one_of_each_group
from quillon.llm.mixing import mixed
from quillon.llm.quality import of_quality
from quillon.llm.queries import read


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return of_quality(docs, read(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return distinct_texts(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles and a similarity of 0.8."""
    return one_of_each_group(docs, size=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, read(spark, sf_dir, "benchmark"))


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


STAGES = [("quality", good_quality), ("exact_dedup", exact_copies), ("jaccard_join", near_copies), ("decontamination", benchmark_leaks), ("mixing", target_mix)]

#: Iterative fitting, fitted classifiers and tiling aren't plain SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; each stage is written as Parquet and read again."""
    ws, docs = Workspace(spark, "pipeline"), read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return docs
