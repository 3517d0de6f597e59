"""The operators from SQL: functions and table functions of a session, and metrics of one's own in the bootstrap.

``register(spark, metrics)`` adds, for the session:

* SQL functions, which Catalyst inlines: ``canonical_id``, ``is_derived``, ``split_of_key``, ``hamming``, ``inner_product``,
  ``cosine``, ``error_overlap``;
* ``leak_audit(TABLE(assets) PARTITION BY (md5), 'md5')``: (leak_key, n_train, n_evaluation, splits) of the keys that both training
  and evaluation rows have. A partition's state is its counts by split, whatever its rows;
* ``bootstrap(TABLE(pairs) PARTITION BY (run), 'run', 'macro_f1', classes, replicates)``: (group_key, n, observed, delta_mean,
  delta_std, ci_low, ci_high, fraction_above) of rows (target, a, b). A partition's state is its counts of (target, a, b).

Keys are named once more as an argument, several with commas, as a table function isn't told its partition's columns; null
keys are one key. Rows come in Arrow batches and are counted by Arrow. Metrics by name: those of ``inference.METRICS`` and
``metrics``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from quillon.functions import workers
from quillon.operators.audit import EVALUATION
from quillon.operators.inference import METRICS, Metric, replicate_deltas

#: Bodies must say the same as the column builders in ``functions``; a test holds them against each other.
FUNCTIONS = {
    "canonical_id(filename STRING) RETURNS STRING": r"regexp_replace(regexp_replace(filename, r'(?<=.)\.[^.]*$', ''), r'(?i)_aug.*$', '')",
    "is_derived(filename STRING) RETURNS BOOLEAN": "filename RLIKE '(?i)_aug'",
    "split_of_key(key STRING) RETURNS STRING": "CASE WHEN CAST(conv(substring(md5(CAST(key AS BINARY)), 1, 8), 16, 10) AS BIGINT) % 100 < 70 THEN 'train' WHEN CAST(conv(substring(md5(CAST(key AS BINARY)), 1, 8), 16, 10) AS BIGINT) % 100 < 85 THEN 'val' ELSE 'test' END",
    "hamming(a BIGINT, b BIGINT) RETURNS INT": "bit_count(a ^ b)",
    "inner_product(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "try_divide(inner_product(a, b), sqrt(inner_product(a, a)) * sqrt(inner_product(b, b)))",
    "error_overlap(both BIGINT, a_only BIGINT, b_only BIGINT, neither BIGINT) RETURNS DOUBLE": "try_divide(double(neither) * both - double(a_only) * b_only, sqrt(double(neither + a_only) * (both + b_only) * (neither + b_only) * (a_only + both)))",
}


def _key(rows: pa.RecordBatch, names: pa.Array) -> str | None:
    values = [rows.column(n.strip())[0].as_py() for n in names[0].as_py().split(",")]
    return None if all(v is None for v in values) else "|".join("" if v is None else str(v) for v in values)


class LeakAudit:
    def __init__(self) -> None:
        self.key, self.splits = None, Counter()

    def eval(self, rows: pa.RecordBatch, names: pa.Array) -> Iterator[pa.Table]:
        if rows.num_rows:
            self.key = _key(rows, names)
            for x in rows.column("split").value_counts().to_pylist():
                self.splits[x["values"]] += x["counts"]
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        held = sum(self.splits[s] for s in EVALUATION)
        if self.splits["train"] and held:
            told = ",".join(sorted(s for s in self.splits if s is not None))
            yield pa.table({"leak_key": pa.array([self.key], pa.string()), "n_train": pa.array([self.splits["train"]], pa.int64()), "n_evaluation": pa.array([held], pa.int64()), "splits": pa.array([told])})


def _bootstrap(known: dict[str, Metric]) -> type:
    class Bootstrap:
        def __init__(self) -> None:
            self.key, self.cells, self.how = None, Counter(), None

        def eval(self, rows: pa.RecordBatch, names: pa.Array, metric: pa.Array, classes: pa.Array, replicates: pa.Array) -> Iterator[pa.Table]:
            if rows.num_rows:
                self.key, self.how = _key(rows, names), (metric[0].as_py(), classes[0].as_py(), replicates[0].as_py())
                if self.how[0] not in known:
                    raise ValueError(f"unknown metric {self.how[0]}")
                counted = pa.table(rows.select(["target", "a", "b"])).group_by(["target", "a", "b"]).aggregate([([], "count_all")])
                for x in counted.to_pylist():
                    self.cells[x["target"], x["a"], x["b"]] += x["count_all"]
            return iter(())

        def terminate(self) -> Iterator[pa.Table]:
            if self.how is None:
                return
            metric, classes, replicates = self.how
            order = sorted(self.cells)
            y, a, b = (np.array(x) for x in zip(*order))
            seen, d = replicate_deltas(y, a, b, np.array([self.cells[k] for k in order]), known[metric], classes, replicates, [1, zlib.crc32(str(self.key).encode())])
            low, high = np.quantile(d, [0.025, 0.975])
            row = {"n": sum(self.cells.values()), "observed": seen, "delta_mean": d.mean(), "delta_std": d.std(ddof=1) if len(d) > 1 else None, "ci_low": low, "ci_high": high, "fraction_above": (d > 0).mean()}
            yield pa.table({"group_key": pa.array([self.key], pa.string()), **{k: pa.array([v], pa.int64() if k == "n" else pa.float64()) for k, v in row.items()}})

    return Bootstrap


def register(spark: SparkSession, metrics: dict[str, Metric] | None = None) -> None:
    workers.ready(spark)
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("leak_audit", arrow_udtf(LeakAudit, returnType="leak_key string, n_train long, n_evaluation long, splits string"))
    told = "group_key string, n long, observed double, delta_mean double, delta_std double, ci_low double, ci_high double, fraction_above double"
    spark.udtf.register("bootstrap", arrow_udtf(_bootstrap({**METRICS, **(metrics or {})}), returnType=told))
