"""Python workers and this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def ready(spark: SparkSession) -> None:
    """Lets Python workers that share this folder import the package; elsewhere it is installed or sent by --py-files."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


BATCH = 32 << 20  # bytes of large rows that a task takes or gives at once
BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """``ready``, and Arrow batches of the session have BATCH bytes at most, for rows as large as images."""
    ready(spark)
    spark.conf.set(BYTES_CONF, str(BATCH))
