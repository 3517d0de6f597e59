"""A tree of files published at once, on any store: files under names of their task attempts, and a manifest committed last.

Below the root lie ``files/<attempt>/split/class/name``, ``_manifests/<job>`` (Parquet: path, stored, bytes, sha256) and
``_releases/<number>.json``, which names a manifest. Spark's own commit keeps the rows of one attempt of each task, so a
manifest lists whole files alone; a release counts from the moment its number is created, which fails if another writer
took it. What killed tasks and failed jobs leave is in no manifest, and readers follow the latest one. Nothing is renamed.

Cases: null contents are left out; a path that comes twice stops the release, as do null parts of a path. Publishing no
rows gives a release like the last one. A root without a release has no files.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import workers
from quillon.sources.arrays import _store
from quillon.sources.sinks import _fs, read_text

MANIFEST = "path string, stored string, bytes long, sha256 string"


def latest(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """(number, manifest's name) of the latest release; (0, None) without."""
    fs, at = _fs(spark, f"{root}/_releases")
    found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    numbers = [int(n.removesuffix(".json")) for n in found if n.removesuffix(".json").isdigit()]
    if not numbers:
        return 0, None
    return max(numbers), json.loads(read_text(spark, f"{root}/_releases/{max(numbers):08d}.json"))["manifest"]


def files(spark: SparkSession, root: str, manifest: str | None = None) -> DataFrame:
    """(path, stored, bytes, sha256) of the latest release, or of the manifest named."""
    name = manifest or latest(spark, root)[1]
    return spark.createDataFrame([], MANIFEST) if name is None else spark.read.schema(MANIFEST).parquet(f"{root}/_manifests/{name}")


def publish(rows: DataFrame, root: str, overwrite: bool = False) -> DataFrame:
    """Publishes rows (split, class_name, filename, content) beside what the last release has; (path, status): written, kept (it
    was there) or replaced. All of it counts at once, or nothing."""
    spark = rows.sparkSession
    workers.ready(spark)
    number, before = latest(spark, root)
    had, job = files(spark, root, before) if before else spark.createDataFrame([], MANIFEST), uuid.uuid4().hex[:12]
    named = rows.filter("content is not null").select(F.concat("split", F.lit("/"), "class_name", F.lit("/"), "filename").alias("path"), "content")
    wanted = named if overwrite else named.join(had.select("path"), "path", "left_anti")

    def put(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        store, at = _store(root)
        folder = f"files/{job}-{task.partitionId():05d}-{task.taskAttemptId()}"
        for batch in batches:
            out: list[tuple] = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                if path is None or ".." in path.split("/") or path.count("/") != 2:
                    raise ValueError(f"a path of three parts is wanted, not {path}")
                stored = f"{folder}/{path}"
                store.create_dir(f"{at}/{stored.rpartition('/')[0]}", recursive=True)
                data = content.as_buffer()
                with store.open_output_stream(f"{at}/{stored}") as f:
                    f.write(data)
                out.append((path, stored, data.size, hashlib.sha256(data).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))], ["path", "stored", "bytes", "sha256"])

    fresh = wanted.mapInArrow(put, MANIFEST)
    folder = f"{root}/_manifests/{job}"
    fresh.write.parquet(f"{folder}/new=1")
    new = spark.read.schema(MANIFEST).parquet(f"{folder}/new=1")
    twice = new.groupBy("path").count().filter("count > 1").select("path").limit(3).collect()
    if twice:
        raise ValueError(f"paths that come twice: {', '.join(r.path for r in twice)}")
    had.join(new.select("path"), "path", "left_anti").write.parquet(f"{folder}/new=0")
    fs, at = _fs(spark, f"{root}/_releases/{number + 1:08d}.json")
    out = fs.create(at, False)  # fails if another release has the number
    out.write(bytearray(json.dumps({"manifest": f"{job}/*", "before": number}).encode()))
    out.close()
    status = F.when(F.col("new") & F.col("old"), "replaced").when(F.col("new"), "written").otherwise("kept")
    asked = named.select("path").distinct()
    told = asked.join(new.select("path", F.lit(True).alias("new")), "path", "left").join(had.select("path", F.lit(True).alias("old")), "path", "left").na.fill(False, ["new", "old"])
    return told.select("path", status.alias("status"))


def contents(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the latest release."""
    listed = files(spark, root)
    if listed.isEmpty():
        return spark.createDataFrame([], "path string, content binary")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/files")
    stored = F.regexp_extract("path", r"/(files/[^/]+/[^/]+/[^/]+/[^/]+)$", 1).alias("stored")
    return found.select(stored, "content").join(listed.select("path", "stored"), "stored").select("path", "content")


def strays(spark: SparkSession, root: str) -> DataFrame:
    """(stored) of the files that no release's manifest lists: what killed tasks left. Older releases keep theirs."""
    fs, at = _fs(spark, f"{root}/files")
    if not fs.exists(at):
        return spark.createDataFrame([], "stored string")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/files").select(F.regexp_extract("path", r"/(files/[^/]+/[^/]+/[^/]+/[^/]+)$", 1).alias("stored"))
    listed = spark.createDataFrame([], "stored string")
    for n in range(1, latest(spark, root)[0] + 1):
        name = json.loads(read_text(spark, f"{root}/_releases/{n:08d}.json"))["manifest"]
        listed = listed.unionByName(files(spark, root, name).select("stored"))
    return found.join(listed, "stored", "left_anti")
