"""Writers of single-file reports, and arrays in NumPy's format."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """One CSV file with a header, in the order of the columns named: for reports, whose size is a report's."""
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_json(rows: DataFrame, path: str) -> None:
    """JSON lines, added to those there."""
    rows.write.mode("append").json(path)


def latex(text):
    """A text column with LaTeX's special characters escaped."""
    return F.regexp_replace(text, r"([&%$#_{}])", r"\\$1")


def latex_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``line``: the row of a LaTeX table; nulls are dashes."""
    cells = [F.coalesce(latex(F.col(c).cast("string")), F.lit("--")) for c in columns]
    return rows.withColumn("line", F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\")))


def npy_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, values) of .npy files, as ``arrays.read_arrays`` reads them: by row ranges, many tasks a file."""
    from quillon.sources.arrays import read_arrays

    return read_arrays(spark, path)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_text(spark: SparkSession, path: str, text: str | bytes) -> None:
    """Writes a small file whole: to a name aside, then renamed, so a reader sees all of it or the old one."""
    fs, at = _fs(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode() if isinstance(text, str) else text))
    out.close()
    if not fs.rename(aside, at):  # some file systems don't rename onto a file
        fs.delete(at, False)
        if not fs.rename(aside, at):
            raise OSError(f"can't write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_json(rows: DataFrame, path: str, order: list[str], most: int = 100_000) -> None:
    """One indented JSON file with the rows in order: for reports. More than ``most`` rows are refused."""
    found = [json.loads(r[0]) for r in rows.orderBy(*order).select(F.to_json(F.struct("*"))).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"a report of over {most} rows: write a table instead")
    write_text(rows.sparkSession, path, json.dumps(found, indent=2, ensure_ascii=False))


def complete(spark: SparkSession, folder: str, marker: str, facts: dict) -> None:
    """The marker that a folder is whole, written last and at once."""
    write_text(spark, f"{folder}/{marker}", json.dumps(facts, indent=2, sort_keys=True))


def write_npy(rows: DataFrame, path: str, values: str, by: list[str], dtype: str = "float32") -> None:
    """One .npy file of a column of equally long arrays, in the order of ``by``, filled by the tasks."""
    from quillon.sources.arrays import write_array

    write_array(rows, path, values, by, dtype)


def materialise(rows: DataFrame, root: str, overwrite: bool = False) -> DataFrame:
    """Writes rows (split, class_name, filename, content) as root/split/class/file from the tasks; (path, status): written,
    kept (it was there) or replaced. Files are written aside and moved, so a retried task does no harm; ``releases.publish``
    makes a whole tree count at once."""
    from quillon.functions import workers
    from quillon.sources.arrays import _store

    workers.ready(rows.sparkSession)

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = _store(root)
        for batch in batches:
            out = []
            for split, name, file, content in zip(batch["split"], batch["class_name"], batch["filename"], batch["content"]):
                path = f"{at}/{split}/{name}/{file.rpartition('/')[2]}"
                there = store.get_file_info(path).is_file
                if overwrite or not there:
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    aside = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
                    with store.open_output_stream(aside) as f:
                        f.write(content)
                    store.move(aside, path)
                out.append((path, "replaced" if there and overwrite else "kept" if there else "written"))
            yield pd.DataFrame(out, columns=["path", "status"])

    return rows.select("split", "class_name", "filename", "content").mapInPandas(copy, "path string, status string")


def embedded(document: str, name: str, block: str) -> str:
    """The document with the text between its marks ``<!-- begin name -->`` and ``<!-- end name -->`` replaced; both must
    be there, once."""
    begin, end = f"<!-- begin {name} -->", f"<!-- end {name} -->"
    if document.count(begin) != 1 or document.count(end) != 1 or document.index(begin) > document.index(end):
        raise ValueError(f"the document needs one pair of marks for {name}")
    return re.sub(f"{re.escape(begin)}.*?{re.escape(end)}", lambda _: f"{begin}\n{block.strip()}\n{end}", document, flags=re.S)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256, bytes) of all files below root, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    fs, at = _fs(spark, root)
    base = fs.makeQualified(at).toUri().getPath().rstrip("/") + "/"
    plain = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    return files.select(F.substr(plain, F.instr(plain, F.lit(base)) + len(base)).alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


class EpochLog:
    """A CSV log that is rewritten whole after each epoch, and gate rows that are appended; both survive a restart. Files
    are small: a row an epoch."""

    def __init__(self, spark: SparkSession, path: str, columns: list[str]) -> None:
        self.spark, self.path, self.columns = spark, path, columns
        fs, at = _fs(spark, path)
        lines = read_text(spark, path).splitlines() if fs.exists(at) else []
        if lines and lines[0] != ",".join(columns):
            raise ValueError("the log has other columns")
        self.rows = [line.split(",") for line in lines[1:]]

    def add(self, **values) -> None:
        """Adds a row, or replaces that of the same first column (an epoch that is run again), and saves the log."""
        row = ["" if values.get(c) is None else str(values[c]) for c in self.columns]
        if any("," in v or "\n" in v for v in row):
            raise ValueError("values of the log have no commas or line ends")
        self.rows = [r for r in self.rows if r[0] != row[0]] + [row]
        write_text(self.spark, self.path, "\n".join(map(",".join, [self.columns, *self.rows])) + "\n")


def save_run(rows: DataFrame, path: str, run: str) -> bool:
    """Writes the rows of one run below path/run=<name> unless they are there whole; False if they were. A sweep that
    saves each run so goes on after a stop where it was."""
    fs, at = _fs(rows.sparkSession, f"{path}/run={run}")
    if fs.exists(rows.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/run={run}/_SUCCESS")):
        return False
    rows.write.mode("overwrite").parquet(f"{path}/run={run}")
    return True


def latex_table(rows: DataFrame, columns: list[str], heads: list[str], order: list[str], caption: str, label: str, most: int = 10_000) -> str:
    """A whole LaTeX table of a report's rows: escaped cells, a head, numbers to the right."""
    kinds = dict(rows.dtypes)
    found = latex_rows(rows, columns).orderBy(*order).select("line").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a table of over {most} lines")
    sides = "".join("l" if kinds[c] == "string" else "r" for c in columns)
    escaped = lambda t: re.sub(r"([&%$#_{}])", r"\\\1", t)
    head = " & ".join(map(escaped, heads)) + r" \\"
    return "\n".join([r"\begin{table}", rf"\caption{{{escaped(caption)}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{sides}}}", r"\hline", head, r"\hline", *(r[0] for r in found), r"\hline", r"\end{tabular}", r"\end{table}"]) + "\n"
