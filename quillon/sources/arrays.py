"""NumPy's array files as a data source: ``spark.read.format("npy")`` and ``df.write.format("npy")``.

Reading: a path is a file, a folder or a pattern. A file's header is read once, on the driver; its rows, or those from the
option ``first`` to before ``last``, (entries of the first
axis, the rest flattened) are dealt into ranges of some ``range_mb``, and each task seeks to its own. Arrays in column order
are read column by column; pickled ones and those without numbers are refused. A folder with a manifest is read by it alone.

Writing has two phases. ``layout`` "file" fills one file: rows carry their place ``pos`` from 0, ``rows`` and ``width`` say the
shape, each task writes its rows at their own offsets of a file aside, and the commit checks that all rows came and renames
it. A task that runs twice writes the same bytes to the same place. This needs a folder that all executors mount.
``layout`` "parts" suits any store: each task writes an array of its own under a name of its attempt, and the commit writes
``_manifest.json`` last, which lists the parts that count; what a killed task leaves is in no manifest.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MANIFEST = "_manifest.json"
STEP_VALUES = 1 << 18  # read or written at a time


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path within it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def _header(f) -> tuple[np.dtype, bool, tuple[int, ...], int]:
    """(type, column order, shape, offset of the first value)."""
    from numpy.lib import format as npy

    version = npy.read_magic(f)
    shape, fortran, dtype = (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(f)
    if dtype.hasobject or dtype.kind not in "biuf":
        raise ValueError(f"an array of {dtype}: numbers only")
    return dtype, bool(fortran), shape, f.tell()


def _head(dtype: np.dtype, rows: int, width: int) -> bytes:
    import io

    from numpy.lib import format as npy

    out = io.BytesIO()
    npy.write_array_header_1_0(out, {"descr": npy.dtype_to_descr(dtype), "fortran_order": False, "shape": (rows, width)})
    return out.getvalue()


@dataclass
class Range(InputPartition):
    path: str
    dtype: str
    fortran: bool
    shape: tuple
    offset: int
    first: int
    count: int
    before: int  # rows of the table in earlier parts


class NpyReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.range_bytes = options["path"], int(float(options.get("range_mb", 64)) * (1 << 20))
        self.first, self.last = int(options.get("first", 0)), int(options.get("last", 1 << 62))

    def _files(self) -> list[tuple[str, int]]:
        """(path, rows before it in the table) in order."""
        store, at = _store(self.path)
        if any(c in os.path.basename(at) for c in "*?["):
            import fnmatch

            found = store.get_file_info(pafs.FileSelector(os.path.dirname(at)))
            return [(f.path, 0) for f in sorted(found, key=lambda f: f.path) if f.is_file and fnmatch.fnmatch(f.base_name, os.path.basename(at))]
        info = store.get_file_info(at)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.is_file:
            return [(at, 0)]
        found = {f.base_name: f.path for f in store.get_file_info(pafs.FileSelector(at)) if f.is_file}
        if MANIFEST in found:
            with store.open_input_stream(found[MANIFEST]) as f:
                out, before = [], 0
                for part in json.loads(f.read())["parts"]:
                    out.append((f"{at}/{part['name']}", before))
                    before += part["rows"]
                return out
        return [(p, 0) for n, p in sorted(found.items()) if n.endswith(".npy")]

    def partitions(self) -> list[InputPartition]:
        store, out = _store(self.path)[0], []
        for path, before in self._files():
            with store.open_input_file(path) as f:
                dtype, fortran, shape, offset = _header(f)
            rows, width = (shape[0] if shape else 1), math.prod(shape[1:])
            step = max(1, self.range_bytes // max(1, width * dtype.itemsize))
            low, high = max(0, self.first - before), min(rows, self.last - before)
            out += [Range(path, dtype.str, fortran and len(shape) > 1, tuple(shape), offset, k, min(step, high - k), before) for k in range(low, high, step)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no ranges at all
            return
        p, dtype = partition, np.dtype(partition.dtype)
        rest, width = p.shape[1:], math.prod(p.shape[1:])
        step = max(1, STEP_VALUES // max(1, width))
        with _store(self.path)[0].open_input_file(p.path) as f:

            def values(at: int, n: int) -> np.ndarray:
                f.seek(p.offset + at * dtype.itemsize)
                data = f.read(n * dtype.itemsize)
                if len(data) < n * dtype.itemsize:
                    raise ValueError(f"{p.path} ends too early")
                return np.frombuffer(data, dtype)

            for k in range(p.first, p.first + p.count, step):
                n = min(step, p.first + p.count - k)
                if p.fortran:
                    block = np.stack([values(c * p.shape[0] + k, n) for c in range(width)]) if width else np.zeros((0, n))
                    block = block.reshape(*rest[::-1], n).T.reshape(n, width)
                else:
                    block = values(k * width, n * width).reshape(n, width)
                flat = pa.array(np.ascontiguousarray(block, dtype=np.float64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), flat)
                yield pa.RecordBatch.from_arrays([pa.array([p.path] * n), pa.array(np.arange(k, k + n) + p.before), lists], ["path", "pos", "values"])


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    first: int


class NpyWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.layout, self.dtype, self.overwrite = options["path"], options.get("layout", "file"), options.get("dtype", "float32"), overwrite
        if np.dtype(self.dtype).kind not in "biuf" or self.layout not in ("file", "parts"):
            raise ValueError("dtype: numbers; layout: file or parts")
        self.token = uuid.uuid4().hex[:12]
        if self.layout == "file":
            self.rows, self.width = int(options["rows"]), int(options["width"])
            if os.path.exists(_store(self.path)[1]) and not overwrite:
                raise FileExistsError(self.path)
            self.aside = f"{_store(self.path)[1]}.{self.token}.tmp"
            os.makedirs(os.path.dirname(self.aside), exist_ok=True)
            with open(self.aside, "wb") as f:
                f.write(_head(np.dtype(self.dtype), self.rows, self.width))
                f.truncate(f.tell() + self.rows * self.width * np.dtype(self.dtype).itemsize)

    def _blocks(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in iterator:
            lists = batch.column("values").cast(pa.list_(pa.float64()))
            if batch.num_rows == 0:
                continue
            sizes = np.unique(np.asarray(lists.value_lengths().fill_null(-1)))
            if len(sizes) > 1 or lists.flatten().null_count or sizes[0] < 0:
                raise ValueError("arrays of one length without nulls are wanted")
            width = int(sizes[0])
            pos = batch.column("pos").to_numpy() if "pos" in batch.schema.names else np.arange(batch.num_rows)
            yield pos, lists.flatten().to_numpy().reshape(batch.num_rows, width).astype(self.dtype)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task, total = TaskContext.get(), 0
        if self.layout == "file":
            size, head = self.width * np.dtype(self.dtype).itemsize, len(_head(np.dtype(self.dtype), self.rows, self.width))
            with open(self.aside, "r+b") as f:
                for pos, block in self._blocks(iterator):
                    if block.shape[1] != self.width or pos.min() < 0 or pos.max() >= self.rows:
                        raise ValueError("a row doesn't fit the shape said")
                    order = np.argsort(pos, kind="stable")
                    cuts = np.flatnonzero(np.diff(pos[order]) != 1) + 1
                    for part in np.split(order, cuts):  # runs of neighbours go in one write
                        f.seek(head + int(pos[part[0]]) * size)
                        f.write(block[part].tobytes())
                    total += len(pos)
                f.flush()
                os.fsync(f.fileno())
            return Written("", total, 0)
        name = f"part-{task.partitionId():05d}-{self.token}-{task.taskAttemptId()}.npy"
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        # The header says how many rows follow, which is known at the end: the body is written first and copied behind it.
        head, width = None, 0
        with store.open_output_stream(f"{at}/{name}.body") as f:
            for pos, block in self._blocks(iterator):
                if head is not None and block.shape[1] != width:
                    raise ValueError("arrays of one length are wanted")
                head, width, total = True, block.shape[1], total + len(pos)
                f.write(block.tobytes())
        if total:
            with store.open_input_stream(f"{at}/{name}.body") as body, store.open_output_stream(f"{at}/{name}") as f:
                f.write(_head(np.dtype(self.dtype), total, width))
                while data := body.read(1 << 22):
                    f.write(data)
        store.delete_file(f"{at}/{name}.body")
        if not total:
            return Written("", 0, 0)
        return Written(name, total, task.partitionId())

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        if self.layout == "file":
            if sum(m.rows for m in done) != self.rows:
                os.remove(self.aside)
                raise ValueError(f"{sum(m.rows for m in done)} of {self.rows} rows came")
            _store(self.path)[0].move(self.aside, _store(self.path)[1])
            return
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        manifest, old = f"{at}/{MANIFEST}", []
        if store.get_file_info(manifest).is_file:
            with store.open_input_stream(manifest) as f:
                old = json.loads(f.read())["parts"]
        parts = [{"name": m.name, "rows": m.rows} for m in sorted((m for m in done if m.name), key=lambda m: m.first)]
        with store.open_output_stream(f"{manifest}.{self.token}") as f:
            f.write(json.dumps({"parts": parts if self.overwrite else old + parts}).encode())
        store.move(f"{manifest}.{self.token}", manifest)  # from here on the new parts count, all at once
        if self.overwrite:
            for p in old:
                store.delete_file(f"{at}/{p['name']}")

    def abort(self, messages: list[Written | None]) -> None:
        store, at = _store(self.path)
        if self.layout == "file":
            if os.path.exists(self.aside):
                os.remove(self.aside)
            return
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{at}/{m.name}")


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "path string, pos long, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return NpyWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    from quillon.functions import workers

    workers.ready(spark)
    spark.dataSource.register(NpySource)


def read_arrays(spark: SparkSession, path: str, range_mb: float = 64, first: int = 0, last: int | None = None) -> DataFrame:
    """(path, pos, values) of array files, as many tasks as ranges; only the rows from ``first`` to before ``last`` are read."""
    register(spark)
    found = spark.read.format("npy").option("path", path).option("range_mb", str(range_mb)).option("first", str(first))
    return (found if last is None else found.option("last", str(last))).load()


def write_array(rows: DataFrame, path: str, values: str, by: list[str], dtype: str = "float32", overwrite: bool = True) -> None:
    """One array file of equally long arrays in the order of ``by`` (total), filled by the tasks. Null arrays are refused."""
    from pyspark.sql import functions as F

    from quillon.operators import prefix

    register(rows.sparkSession)
    placed = prefix.numbered(rows.select(*dict.fromkeys([*by, values])), [], [*by], "pos").select("pos", F.col(values).cast("array<double>").alias("values"))
    n, width = placed.agg(F.count("*"), F.max(F.size("values"))).first()
    placed.write.format("npy").mode("overwrite" if overwrite else "append").option("path", path).option("layout", "file").option("dtype", dtype).option("rows", str(n)).option("width", str(max(width or 0, 0))).save()


def write_parts(rows: DataFrame, path: str, values: str, dtype: str = "float32", overwrite: bool = True) -> None:
    """A folder of array files, one a task, and the manifest that makes them count."""
    from pyspark.sql import functions as F

    register(rows.sparkSession)
    rows.select(F.col(values).cast("array<double>").alias("values")).write.format("npy").mode("overwrite" if overwrite else "append").option("path", path).option("layout", "parts").option("dtype", dtype).save()
