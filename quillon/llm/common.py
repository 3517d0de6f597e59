"""Plumbing shared by the training-data operators: text access, written intermediates, batch maps."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = re.compile(r"[^\W\d_]+")
_LOCAL_BASES: dict[str, str] = {}
BATCH_BYTES = 4 << 20  # of rows with texts that a task takes at once
BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def byte_words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and returns the words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes; null has none.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is exactly that rule.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def named(column: str) -> Column:
    """The column of exactly this name, whatever marks the name has."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names`` made unlike each of ``columns``, whatever the letters' case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: str = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(named(column), F.lit(""))


def bucket_of(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus


def base_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Only a local master without it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_BASES.get(spark.sparkContext.applicationId)
    if found:
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="quillon-")
    import atexit

    atexit.register(shutil.rmtree, made, True)
    return _LOCAL_BASES.setdefault(spark.sparkContext.applicationId, made)


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers that share this folder import the package; elsewhere it is installed or sent by --py-files.
    Arrow batches of the session have BATCH_BYTES at most (or one row): by rows alone, 10,000 whole texts are one batch,
    which the executor holds twice on its way to the worker and back, and the worker beside the one before."""
    spark.conf.set(BYTES_CONF, str(BATCH_BYTES))
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


class Workspace:
    """Intermediate tables in the shared folder: they cut lineage and outlive executors.

    A table is written once and read back, so a lost executor costs a re-read, not a recomputation.
    ``drop`` removes a table whose successors are written; the rest goes when the JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{base_folder(spark).rstrip('/')}/quillon/{name}-{uuid.uuid4().hex[:12]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)


def shard_bits(spark: SparkSession, least: int = 6) -> int:
    """log2 of how many shards packed arrays are dealt into: four a shuffle partition, so that one fits in memory
    wherever the shuffle partitions are sized to."""
    return max(least, min(20, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, rows: int = 512) -> DataFrame:
    """Maps slices of at most ``rows`` rows: ``make()`` runs once a task and returns a function from
    {column: list} to {column: list or array}. Columns go over Arrow; only the slice is held as Python objects."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    on_workers(df.sparkSession)
    kind = _parse_datatype_string(schema)
    names = [f.name for f in kind.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, arrow = make(), to_arrow_schema(kind)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = step({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(made[n], arrow.field(n).type) for n in names], schema=arrow)

    return df.mapInArrow(run, kind)


def filter_rows(df: DataFrame, make: Callable[[], Callable[[list], list]], text_column: str = "text", rows: int = 256) -> DataFrame:
    """Rows whose text passes: ``make()`` runs once a task and returns a function from texts to booleans. All columns
    stay as they are, nothing is shuffled, and rows are judged one by one whatever their ids."""
    on_workers(df.sparkSession)
    at, plain = df.columns.index(text_column), df.toDF(*(f"c{k}" for k in range(len(df.columns))))  # names may have dots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def met_by(small: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table as the small side of a join: broadcast up to ``most`` rows, counted first, shuffled beyond."""
    return F.broadcast(small) if small.count() <= most else small


def without_ids(df: DataFrame, ids: DataFrame, column: str, most: int = 1_000_000) -> DataFrame:
    """Rows whose id isn't in ``ids`` (one column of that name, written before). Up to ``most`` ids are broadcast,
    counted first; more are met by a shuffled join. A null id is an id like others."""
    (tag,) = fresh(df.columns, "_gone")
    gone = met_by(ids.select(named(column).alias(tag)).distinct(), most)
    return df.join(gone, named(column).eqNullSafe(F.col(tag)), "left_anti")


def met_evenly(rows: DataFrame, told: DataFrame, on: list[str], count: str, hot: int = 20_000) -> DataFrame:
    """Inner join of rows with ``told``, a written table with one row a key whose column ``count`` says how many rows have
    the key. Keys of more than ``hot`` rows, or of a 100,000th of all, are broadcast: so there are at most 100,000 of them.
    The rest is shuffled, and no task gets more than that many rows of one key."""
    total = told.agg(F.sum(count)).first()[0] or 0
    often = F.col(count) > max(hot, total // 100_000)
    if told.filter(often).isEmpty():
        return rows.join(told, on)
    few, many = told.filter(often), told.filter(~often)
    keys = F.broadcast(few.select(*on))
    return rows.join(F.broadcast(few), on).unionByName(rows.join(keys, on, "left_anti").join(many, on))
