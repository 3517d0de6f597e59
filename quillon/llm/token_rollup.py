"""Token counts as delta-maintained rollups.

A rollup is a folder with a log of numbered commits. Each commit points to a batch's data: signed rows of single
documents (the ledger) and their sums by source, language and tokenizer version (the deltas). Totals are plain sums
of deltas, so sums of sums agree.

A change names a document, a version and a new count, or no count to delete it. Committing a batch retracts what the
ledger holds of the changed documents and adds the new rows: insert, revise and delete are one rule, and an insert of
what is there already revises it.

A commit is computed against the log as it stands, its data are written aside, and then its number is taken by a
rename that never overwrites (``_publish``). Whoever finds the number taken reads the log again and computes anew, so
writers that overlap give the totals of one after the other. A batch id that the log holds is left alone, so a retry
or a second delivery changes nothing; data without a number are never read.

The ledger is cut into ``buckets`` by a hash of the document id. A commit reads the buckets that it touches, of the
last snapshot and the commits after it. When the commits after a snapshot hold as many rows as it has, or are
``most_commits``, a new snapshot is committed: the work for a batch follows its size, not the length of the history.

Tokens are counted by words (``[^\\x20\\x09-\\x0D]+``) and by byte-level BPE ranks from a file whose path is a
parameter.

Cases: null text counts no tokens; null source or language is the empty string; a null document id is a document of
its own name (null). The type of document ids is that of the first batch; a batch of another type is refused. Several
changes of one document and version in a batch: the highest ``seq`` wins, among equals the larger count. A deletion
whose version is null takes all versions. Deleting or retracting what isn't there does nothing. Empty batches commit
and count as delivered. Very long texts are read whole. Other columns are not read.
"""

from __future__ import annotations

import base64
import json
import os
import uuid
from importlib.util import find_spec
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import base_folder, byte_words, map_batches, named, text_of

KEYS = ("source", "lang", "version")
SUMS = "source string, lang string, version string, docs bigint, tokens bigint"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranks_path(folder: str | None = None) -> str:
    """The BPE ranks file: in ``folder``, else in the installed folder of public tokenizers."""
    if folder is None:
        found = find_spec("public_tokenizers")
        if found is None:
            raise RuntimeError("the package public_tokenizers isn't installed: pass the path of a file of BPE ranks")
        folder = str(Path(found.origin).parent)
    return str(Path(folder) / "byte_bpe_50k.tiktoken")


def counted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", ranks: str | None = None) -> DataFrame:
    """(doc_id, source, lang, version, n_tokens): two rows per input row, one for each tokenizer version."""
    path, id_type = ranks or ranks_path(), docs.schema[id_column].dataType.simpleString()

    def make():
        import tiktoken

        with open(path, "rb") as lines:
            pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={})

        def step(cols: dict) -> dict:
            words = [len(byte_words(t)) for t in cols["text"]]
            pieces = [len(bpe.encode_ordinary(t)) for t in cols["text"]]
            return {"doc_id": cols["_id"] * 2, "source": cols["source"] * 2, "lang": cols["lang"] * 2, "version": ["words-1"] * len(words) + ["bpe50k-1"] * len(words), "n_tokens": words + pieces}

        return step

    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(named(id_column).alias("_id"), plain("source"), plain("lang"), text_of(text_column).alias("text"))
    return map_batches(rows, make, f"doc_id {id_type}, source string, lang string, version string, n_tokens bigint", rows=256)


class TokenRollup:
    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = 64, most_commits: int = 64, part_rows: int = 1_000_000) -> None:
        """``buckets`` counts for a new folder; one that has commits keeps its own. A task holds a part of a bucket of a batch,
        some ``part_rows`` rows."""
        self.spark, self.buckets, self.most_commits, self.part_rows = spark, buckets, most_commits, part_rows
        self.folder = folder or f"{base_folder(spark).rstrip('/')}/quillon/rollup-{uuid.uuid4().hex[:12]}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._known: dict[str, dict] = {}  # commits that were read: they never change
        if folder is None:
            self._fs.deleteOnExit(self._path(self.folder))

    # The log.

    def _commits(self) -> list[dict]:
        """All commits in order."""
        at = self._path(f"{self.folder}/log")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []
        for name in names:
            if name.endswith(".json") and name not in self._known:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(self._fs.open(self._path(f"{self.folder}/log/{name}")), "UTF-8")
                self._known[name] = {**json.loads(text), "n": int(name[:-5])}
        return [self._known[n] for n in names if n.endswith(".json")]

    @staticmethod
    def _live(commits: list[dict]) -> list[dict]:
        """The last snapshot and what follows it."""
        last = max((k for k, c in enumerate(commits) if c["batch"] is None), default=0)
        return commits[last:]

    def _publish(self, n: int, commit: dict) -> bool:
        """Takes number n of the log; False if it is taken. The file is whole before it has its name: a hard link on a
        local or mounted file system, else a rename without overwriting, which the file system must offer."""
        text, home = json.dumps(commit), f"{self.folder}/log/{n:012d}.json"
        aside = f"{self.folder}/log/{n:012d}-{uuid.uuid4().hex[:12]}.tmp"
        self._fs.mkdirs(self._path(f"{self.folder}/log"))
        out = self._fs.create(self._path(aside), False)
        out.write(bytearray(text, "utf-8"))
        out.close()
        uri = self._fs.makeQualified(self._path(home)).toUri()
        try:
            if uri.getScheme() == "file":
                os.link(self._fs.makeQualified(self._path(aside)).toUri().getPath(), uri.getPath())
                return True
            jvm = self.spark._jvm
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self.spark._jsc.hadoopConfiguration())
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(self._path(aside), self._path(home), none)
            return True
        except FileExistsError:
            return False
        except Exception as e:  # of the file system, by way of the JVM
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self._fs.delete(self._path(aside), False)

    def batches(self) -> list[str]:
        return sorted(c["batch"] for c in self._commits() if c["batch"] is not None)

    # The data.

    def _ledger_schema(self, id_type: str) -> str:
        return f"doc_id {id_type}, {SUMS}, bucket int"

    def _read(self, commits: list[dict], what: str, schema: str) -> DataFrame:
        found = None
        for c in self._live(commits):
            part = self.spark.read.schema(schema).option("basePath", f"{self.folder}/data/{c['data']}/{what}").parquet(f"{self.folder}/data/{c['data']}/{what}")
            found = part if found is None else found.unionByName(part)
        return self.spark.createDataFrame([], schema) if found is None else found

    @staticmethod
    def _summed(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")

    def ledger(self) -> DataFrame:
        """The documents that count now: doc_id, source, lang, version, docs, tokens."""
        commits = self._commits()
        rows = self._read(commits, "ledger", self._ledger_schema(commits[0]["id_type"] if commits else "bigint"))
        return self._summed(rows, "doc_id", *KEYS)

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens; cells that have become empty are left out."""
        return self._summed(self._read(self._commits(), "deltas", SUMS), *KEYS)

    def _write(self, rows: DataFrame, id_type: str) -> tuple[str, int]:
        """Writes a ledger by bucket and its sums; returns the folder's name and the ledger's rows."""
        data = uuid.uuid4().hex
        at = f"{self.folder}/data/{data}"
        rows.write.partitionBy("bucket").parquet(f"{at}/ledger")
        written = self.spark.read.schema(self._ledger_schema(id_type)).parquet(f"{at}/ledger")
        written.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")).write.parquet(f"{at}/deltas")
        return data, self.spark.read.parquet(f"{at}/deltas").agg(F.sum("n")).first()[0] or 0

    def _drop(self, data: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/data/{data}"), True)

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """changes: doc_id, source, lang, version, n_tokens (null deletes), seq. False if the batch is there already."""
        id_type = changes.schema["doc_id"].dataType.simpleString()
        commits, staged = self._commits(), f"{self.folder}/staging/{uuid.uuid4().hex}"
        if any(c["batch"] == batch_id for c in commits):
            return False
        buckets = commits[0]["buckets"] if commits else self.buckets
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket")
        kept = changes.select(bucket, "doc_id", F.col("source").cast("string"), F.col("lang").cast("string"), F.col("version").cast("string"), F.col("n_tokens").cast("long"), F.col("seq").cast("long"))
        try:
            kept.write.parquet(staged)  # counted once, whatever the number of attempts
            changes = self.spark.read.schema(kept.schema).parquet(staged)
            while not any(c["batch"] == batch_id for c in commits):
                if commits and (commits[0]["id_type"], commits[0]["buckets"]) != (id_type, buckets):
                    raise TypeError(f"this rollup has {commits[0]['buckets']} buckets of {commits[0]['id_type']} ids, not {buckets} of {id_type}")
                data, n = self._write(self._signed(commits, changes, id_type, buckets), id_type)
                if self._publish(len(commits), {"batch": batch_id, "data": data, "rows": n, "id_type": id_type, "buckets": buckets}):
                    self._compact()
                    return True
                self._drop(data)  # another writer was first
                commits = self._commits()
            return False
        finally:
            self._fs.delete(self._path(staged), True)

    def _spread(self, rows: DataFrame, n: int, buckets: int) -> DataFrame:
        """Rows dealt by bucket and ``_part``: a bucket has as many parts, by the document's hash, as keep a part near
        ``part_rows``, so a large batch isn't held to one task a bucket. A bucket is then as many files."""
        parts = max(1, -(-n // (buckets * self.part_rows)))
        dealt = rows.withColumn("_part", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(parts)).cast("int"))
        return dealt.repartition("bucket", "_part") if parts == 1 else dealt.repartition(min(buckets * parts, 100_000), "bucket", "_part")

    def _signed(self, commits: list[dict], changes: DataFrame, id_type: str, buckets: int) -> DataFrame:
        """The ledger rows of a batch, given the commits before it."""
        last = self._spread(changes, changes.count(), buckets).groupBy("bucket", "_part", "doc_id", "version").agg(F.max_by(F.struct("source", "lang", "n_tokens"), F.struct("seq", "n_tokens")).alias("x")).select("bucket", "doc_id", "version", "x.*")
        blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
        added = last.filter("n_tokens is not null and version is not null").select("doc_id", blank("source"), blank("lang"), "version", F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens"), "bucket")
        if not commits:
            return added
        touched = last.select("bucket", F.col("doc_id").alias("_d"), F.col("version").alias("_v"))
        held = self._read(commits, "ledger", self._ledger_schema(id_type))
        asked = [r[0] for r in changes.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if len(asked) < buckets:
            held = held.filter(F.col("bucket").isin(asked))
        held = held.withColumnRenamed("bucket", "_b")
        on = (held["_b"] == touched["bucket"]) & held["doc_id"].eqNullSafe(touched["_d"])
        of_docs = held.join(touched.filter("_v is null"), on, "left_semi")
        of_versions = touched.filter("_v is not null")
        exact = on & (held["version"] == touched["_v"])
        gone = held.join(of_versions, exact, "left_semi").unionByName(of_docs.join(of_versions, exact, "left_anti"))
        back = self._summed(gone, "_b", "doc_id", *KEYS).withColumnRenamed("_b", "bucket")
        return added.unionByName(back.withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")}))

    def _compact(self) -> None:
        """Commits a snapshot if what follows the last one has grown as large; lets it be if another writer is first."""
        commits = self._commits()
        first, *later = self._live(commits)
        if not later or (sum(c["rows"] for c in later) < first["rows"] and len(later) < self.most_commits):
            return
        id_type = first["id_type"]
        held = self._spread(self._read(commits, "ledger", self._ledger_schema(id_type)), sum(c["rows"] for c in (first, *later)), first["buckets"])
        data, n = self._write(self._summed(held, "bucket", "_part", "doc_id", *KEYS).drop("_part"), id_type)
        if not self._publish(len(commits), {"batch": None, "data": data, "rows": n, "id_type": id_type, "buckets": first["buckets"]}):
            self._drop(data)

    def vacuum(self) -> int:
        """Deletes data that no live commit needs, when no reader or writer is at work; returns how many folders."""
        live = {c["data"] for c in self._live(self._commits())}
        at = self._path(f"{self.folder}/data")
        gone = [s.getPath() for s in self._fs.listStatus(at) if s.getPath().getName() not in live] if self._fs.exists(at) else []
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)
