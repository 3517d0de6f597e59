"""Sums over all rows that come before, in an order, with no group in one task.

Rows are dealt by ranges of group and order, so each task has a run of the order; it sums up its own rows, group by group.
What a group has in earlier ranges is added after: only the groups that a border cuts have rows in several ranges, at most
one a border, so these totals are as few as the ranges. Ranks, dense numbers and percentiles are such sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.graph import _checkpoints

FEW = 1_000_000  # rows that a window sums up as well, counted first; as many as a range has
RANGE = 1_000_000  # rows of a range


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ranges(rows: DataFrame, group: list[str], order: list[str | Column], parts: int | None = None, size: int | None = None) -> DataFrame:
    """Rows in ranges of (group, order), sorted, with the range's number ``_part`` and the group as ``_key`` and ``_g``."""
    n = parts or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // RANGE))
    by = [*(F.col(c) for c in group), *map(_column, order)]
    key = F.struct(*group) if group else F.struct(F.lit(0))
    dealt = rows.withColumns({"_key": key, "_g": F.xxhash64(*group) if group else F.lit(0).cast("long")}).repartitionByRange(n, *by)
    return dealt.withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*by)


def exclusive(values: np.ndarray, groups: np.ndarray, carry: dict) -> np.ndarray:
    """Sums before each row within its run of equal ``groups``; ``carry`` holds the last run's group and sum."""
    new = np.r_[True, groups[1:] != groups[:-1]]
    start = np.maximum.accumulate(np.where(new, np.arange(len(groups)), 0))
    upto = np.cumsum(values)
    before = upto - values
    local = before - before[start]
    if carry.get("group") == groups[0]:
        local[start == 0] += carry["sum"]
    carry.update(group=groups[-1], sum=local[-1] + values[-1])
    return local


def prefix_sums(rows: DataFrame, group: list[str], order: list[str | Column], sums: dict[str, str], few: int = FEW, parts: int | None = None) -> DataFrame:
    """Rows with, for each item of ``sums``, a column of that name: the sum of the item's column (whole numbers or doubles, null
    as 0) over the group's rows that come before, 0 for the first. The order must be total within a group. Tables of up to
    ``few`` rows, counted first, are summed up in a window."""
    _checkpoints(rows.sparkSession)
    rows = rows.checkpoint()
    n, kinds = rows.count(), {k: "double" if rows.schema[c].dataType.typeName() in ("double", "float") else "long" for k, c in sums.items()}
    if n <= few:
        w = Window.partitionBy(*group).orderBy(*map(_column, order)).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({k: F.coalesce(F.sum(F.col(c).cast(kinds[k])).over(w), F.lit(0).cast(kinds[k])) for k, c in sums.items()})
    placed = ranges(rows.withColumns({f"_v_{k}": F.coalesce(F.col(c).cast(kinds[k]), F.lit(0).cast(kinds[k])) for k, c in sums.items()}), group, order, parts, n)

    def run(batches):
        carries: dict[str, dict] = {k: {} for k in sums}
        for batch in batches:
            if batch.num_rows:
                g = batch.column("_g").to_numpy()
                made = [pa.array(exclusive(batch.column(f"_v_{k}").to_numpy(), g, carries[k])) for k in sums]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *sums])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema) + "".join(f", `{k}` {kinds[k]}" for k in sums)
    local = placed.mapInArrow(run, schema).checkpoint()
    totals = local.groupBy("_key", "_part").agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums))
    cut = totals.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1").select("_key")
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.join(F.broadcast(cut), "_key")  # fewer than the ranges
    offsets = offsets.select("_key", "_part", *(F.sum(f"_t_{k}").over(before).alias(f"_o_{k}") for k in sums)).checkpoint()
    out = local.join(F.broadcast(offsets), ["_key", "_part"], "left")
    return out.select(*rows.columns, *((F.col(k) + F.coalesce(f"_o_{k}", F.lit(0).cast(kinds[k]))).alias(k) for k in sums))


def numbered(rows: DataFrame, group: list[str], order: list[str | Column], name: str, few: int = FEW, parts: int | None = None) -> DataFrame:
    """Rows numbered from 0 within their group; the order must be total."""
    return prefix_sums(rows.withColumn("_one", F.lit(1)), group, order, {name: "_one"}, few, parts).drop("_one")


def dense_numbers(rows: DataFrame, group: list[str], column: str, name: str, few: int = FEW, parts: int | None = None) -> DataFrame:
    """Rows with the place of their value among the group's distinct values, from 0."""
    found = numbered(rows.select(*group, column).distinct(), group, [column], name, few, parts)
    keys = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (*group, column)]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    return rows.alias("r").join(found.alias("f"), on).select("r.*", f"f.{name}")


def average_ranks(rows: DataFrame, group: list[str], column: str, name: str, few: int = FEW, parts: int | None = None) -> DataFrame:
    """(group, column, n_rows, name): each distinct value once, with its rows and the mean of their ranks from 1."""
    cells = rows.groupBy(*group, column).agg(F.count("*").alias("n_rows"))
    out = prefix_sums(cells, group, [column], {"_before": "n_rows"}, few, parts)
    return out.select(*group, column, "n_rows", (F.col("_before") + (F.col("n_rows") + 1) / 2).alias(name))
