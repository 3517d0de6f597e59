"""Scans of folders: labelled images, run folders, logs by name, configurations, side inputs and the environment."""

from __future__ import annotations

import importlib.metadata
import platform
import re
import sys
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import rasters
from quillon.operators import images as whole

IMAGES = ("jpg", "jpeg", "png", "bmp", "webp")


def _place(path, back: int):
    return F.element_at(F.split(path, "/"), -back)


def image_index(spark: SparkSession, root: str, splits: list[str] | None = None, classes: list[str] | None = None, suffixes: tuple[str, ...] = IMAGES, content: bool = False) -> DataFrame:
    """(path, split, class_name, filename, suffix, bytes) of root/split/class/file, suffixes in any case, others left out.

    With splits and classes the grid is strict: a folder of it that holds no image raises, as does an image outside it.
    Without them what is there is taken. ``content`` adds the files' bytes.
    """
    letters = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for s in [",".join(suffixes)] for c in s)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + letters + "}").load(root)
    rows = files.select("path", _place("path", 3).alias("split"), _place("path", 2).alias("class_name"), _place("path", 1).alias("filename"), F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).alias("suffix"), F.col("length").alias("bytes"), *(["content"] if content else []))
    if splits is not None and classes is not None:
        found = {(r[0], r[1]) for r in rows.select("split", "class_name").distinct().collect()}  # folders, as many as the grid
        wanted = {(s, c) for s in splits for c in classes}
        if found != wanted:
            raise ValueError(f"folders without images: {sorted(wanted - found)}; folders not expected: {sorted(found - wanted)}")
    return rows


def labelled_images(rows: DataFrame) -> DataFrame:
    """Adds ``label``: the class's place among the sorted class names, from 0."""
    names = rows.select("class_name").distinct()
    numbered = names.withColumn("label", F.row_number().over(Window.orderBy("class_name")) - 1)  # class names are few
    return rows.join(F.broadcast(numbered), "class_name")


def with_masks(rows: DataFrame, masks: DataFrame, suffix: str = "_mask") -> DataFrame:
    """Adds ``mask_path``: the file of the same folder and name with the suffix before its extension, null if none."""
    stem = F.regexp_replace("path", r"\.[^.]*$", "")
    beside = masks.select(F.regexp_replace("path", rf"{suffix}\.[^.]*$", "").alias("_stem"), F.col("path").alias("mask_path")).filter(F.col("_stem") != F.regexp_replace("mask_path", r"\.[^.]*$", ""))
    return rows.withColumn("_stem", stem).join(beside, "_stem", "left").drop("_stem")


def decoded(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(readable, unreadable) images: path, height, width, channels and data in BGR order; and the paths that don't
    decode. The decoder doesn't turn images by their orientation tag."""
    found = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(root)
    rows = found.select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
    return rows.filter("height > 0"), rows.filter("height <= 0").select("path")


def upright(spark: SparkSession, root: str) -> DataFrame:
    """Readable images under a folder, turned as their orientation tags ask. Files are read twice: decoded, and whole for
    the tag; only the tags are joined."""

    @F.pandas_udf("int")
    def tag(content: pd.Series) -> pd.Series:
        return content.map(rasters.orientation)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    tags = files.select("path", tag("content").alias("orientation")).filter("orientation != 1")
    plain = lambda: F.regexp_replace("path", "^file:/+", "/").alias("_plain")
    good, _ = decoded(spark, root)
    met = good.withColumn("_plain", plain()).join(tags.select(plain(), "orientation"), "_plain", "left").drop("_plain")
    return whole.upright(met, "path")


def pixels(images: DataFrame) -> DataFrame:
    """(path, x, y, r, g, b), values from 0 to 1, of decoded images; one channel is grey, a fourth is left out, images of
    other channels are."""
    at = lambda k: F.conv(F.hex(F.substring("data", F.col("_p") * F.col("channels") + F.least(F.lit(k), "channels"), F.lit(1))), 16, 10).cast("double") / 255
    rows = images.filter("channels in (1, 3, 4)").withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)))
    return rows.select("path", (F.col("_p") % F.col("width")).cast("int").alias("x"), F.floor(F.col("_p") / F.col("width")).cast("int").alias("y"), at(3).alias("r"), at(2).alias("g"), at(1).alias("b"))


def folder_counts(rows: DataFrame, expected: dict[tuple[str, str], int]) -> DataFrame:
    """(split, class_name, n, expected) where the number of files isn't the one expected, folders of either side alone too."""
    want = rows.sparkSession.createDataFrame([(*k, n) for k, n in expected.items()], "split string, class_name string, expected long")
    have = rows.groupBy("split", "class_name").agg(F.count("*").alias("n"))
    return have.join(want, ["split", "class_name"], "full_outer").na.fill(0, ["n", "expected"]).filter("n != expected").select("split", "class_name", "n", "expected")


def _files(spark: SparkSession, pattern: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(s.getPath().toString() for s in found or [])


def union_of_logs(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The CSV files of a folder whose whole name matches, united by column names, with ``file``; columns that a file lacks
    are null. Names aren't enough for a glob (``log_s<digits>.csv``), so they are matched here; files are few."""
    out = None
    for path in _files(spark, f"{folder}/*"):
        base = PurePosixPath(path).name
        if re.fullmatch(name, base):
            part = spark.read.option("header", True).csv(path).withColumn("file", F.lit(base))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no file of {folder} is named like {name}")
    return out


def complete_runs(spark: SparkSession, folder: str, marker: str, needs: tuple[str, ...] = ()) -> DataFrame:
    """(run, path, complete, missing) of the folders in ``folder``: one is complete with its marker and all it needs."""
    rows = []
    for path in _files(spark, f"{folder}/*"):
        held = {PurePosixPath(p).name for p in _files(spark, f"{path}/*")}
        if held:
            lacks = [n for n in (marker, *needs) if n not in held]
            rows.append((PurePosixPath(path).name, path, not lacks, ",".join(lacks)))
    return spark.createDataFrame(rows, "run string, path string, complete boolean, missing string")


#: A campaign's keys and the types of their values.
CAMPAIGN = {"name": str, "seeds": list, "arms": dict, "epochs": int}


def campaign(text: str, keys: dict[str, type] = CAMPAIGN) -> dict:
    """A YAML campaign. Missing, unknown and wrongly typed keys are all named in one error; seeds must not repeat."""
    import yaml

    made = yaml.safe_load(text)
    if not isinstance(made, dict):
        raise ValueError("a campaign is a mapping")
    wrong = [f"{k} is missing" for k in keys if k not in made] + [f"{k} is unknown" for k in made if k not in keys]
    wrong += [f"{k} must be {t.__name__}" for k, t in keys.items() if k in made and (not isinstance(made[k], t) or isinstance(made[k], bool))]
    if isinstance(made.get("seeds"), list) and len(set(map(str, made["seeds"]))) < len(made["seeds"]):
        wrong.append("seeds repeat")
    if wrong:
        raise ValueError("; ".join(wrong))
    return made


def campaign_grid(spark: SparkSession, made: dict) -> DataFrame:
    """(run, arm, seed, flags): one row for each arm and seed of a campaign."""
    rows = [(f"{arm}_s{seed}", arm, int(seed), command_flags(settings or {})) for arm, settings in made["arms"].items() for seed in made["seeds"]]
    return spark.createDataFrame(rows, "run string, arm string, seed int, flags array<string>")


def command_flags(settings: dict) -> list[str]:
    """``--key value``; true stands alone, false and null are left out, a list repeats its key."""
    out: list[str] = []
    for key, value in settings.items():
        for v in value if isinstance(value, list) else [value]:
            if v is True:
                out.append(f"--{key}")
            elif v is not None and v is not False:
                out += [f"--{key}", str(v)]
    return out


def _told(*command: str, cwd: str | None = None) -> str | None:
    """What a command prints, or None if it isn't there or fails."""
    import subprocess

    try:
        return subprocess.run(command, cwd=cwd, capture_output=True, text=True, timeout=20, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def environment(spark: SparkSession, folder: str = ".") -> DataFrame:
    """One row: versions of Python, Java and Spark, the system, the installed packages, the commit of the git work tree that
    ``folder`` is in and whether tracked files differ from it (null outside one), and the devices that the resource manager
    or the vendor's tool names (empty without)."""
    packages = sorted({f"{d.metadata['Name']}=={d.version}" for d in importlib.metadata.distributions()})
    java = spark._jvm.java.lang.System.getProperty("java.version")
    commit = _told("git", "rev-parse", "HEAD", cwd=folder)
    changed = None if commit is None else bool(_told("git", "status", "--porcelain", "--untracked-files=no", cwd=folder))
    devices = [f"{name}:{a}" for name, r in spark.sparkContext.resources.items() for a in r.addresses] or (_told("nvidia-smi", "--query-gpu=name,memory.total,driver_version", "--format=csv,noheader") or "").splitlines()
    row = (sys.version.split()[0], java, spark.version, platform.platform(), packages, commit, changed, devices)
    return spark.createDataFrame([row], "python string, java string, spark string, system string, packages array<string>, git_commit string, git_changed boolean, devices array<string>")


def _importable(module: str) -> bool:
    from importlib.util import find_spec

    try:
        return find_spec(module) is not None
    except (ImportError, ValueError):  # a package on the way is missing, or is no package
        return False


def preflight(spark: SparkSession, modules: list[str], grid: DataFrame, arms: int, seeds: int) -> DataFrame:
    """(check, ok): each module is importable, and the grid has each of arms x seeds once."""
    found = grid.agg(F.count("*"), F.count_distinct("arm", "seed"), F.count_distinct("arm"), F.count_distinct("seed")).first()
    rows = [(f"module {m}", _importable(m)) for m in modules] + [("grid", tuple(found) == (arms * seeds, arms * seeds, arms, seeds))]
    return spark.createDataFrame(rows, "check string, ok boolean")
