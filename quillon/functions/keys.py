"""Column builders for asset names, runs and deterministic draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(filename: Column) -> Column:
    """The name without its extension; a leading dot starts a name, not an extension."""
    return F.regexp_replace(filename, r"(?<=.)\.[^.]*$", "")


def canonical_id(filename: Column) -> Column:
    """The source's name: the stem up to the first ``_aug`` in any case."""
    return F.regexp_replace(stem(filename), r"(?i)_aug.*$", "")


def is_derived(filename: Column) -> Column:
    return filename.rlike(r"(?i)_aug")


def operation(filename: Column) -> Column:
    """The lower-cased operation after ``_aug``, null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(filename, r"(?i)_aug[_-]?([a-z]+)", 1)), F.lit(""))


def source_prefix(name: Column) -> Column:
    return F.regexp_replace(name, r"_[^_]*$", "")


def run_parts(run: Column) -> tuple[Column, Column]:
    """(experiment, seed) of ``experiment_s<seed>``, cut at the last ``_s``."""
    return F.regexp_extract(run, "^(.*)_s(.*)$", 1), F.regexp_extract(run, "^(.*)_s(.*)$", 2)


def as_flag(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("1", "true", "t", "yes", "y")


def finite(value: Column) -> Column:
    """NaN, infinities and the sentinel -1 become null."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")) | (value == -1.0), None).otherwise(value)


def md5_mod(key: Column, n: int) -> Column:
    """A deterministic draw from 0..n-1 that other engines reproduce."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint") % n


def split_of(key: Column, train: int = 70, val: int = 15) -> Column:
    draw = md5_mod(key.cast("string"), 100)
    return F.when(draw < train, "train").when(draw < train + val, "val").otherwise("test")


def bare_parameter(name: Column) -> Column:
    """A parameter's name without the wrapper's prefix."""
    return F.regexp_replace(name, r"^module\.", "")


def relative_path(path: Column, root: str) -> Column:
    """What follows the first folder named ``root``, with forward slashes."""
    return F.regexp_replace(F.regexp_replace(path, r"[\\/]+", "/"), rf"^(?:.*?/)?{root}/", "")


def slug(text: Column) -> Column:
    """Lower-case letters and digits, runs of others as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def safe_filename(text: Column) -> Column:
    """Runs of marks that file systems refuse, and blanks, as one underscore."""
    return F.regexp_replace(text, r'[\\/:*?"<>| ]+', "_")


def first_of(named: dict[str, Column], default: Column) -> tuple[Column, Column]:
    """The first value that isn't null in the order given, and the name it was found under."""
    source = F.lit("default")
    for name, value in reversed(named.items()):
        source = F.when(value.isNotNull(), name).otherwise(source)
    return F.coalesce(*named.values(), default), source


def flags(named: dict[str, Column]) -> Column:
    """Command-line flags: a boolean stands alone if true and is left out if not, nulls are left out."""
    parts = [F.when(F.typeof(v) == "boolean", F.when(v.cast("string") == "true", f"--{k}")).when(v.isNotNull(), F.concat(F.lit(f"--{k} "), v.cast("string"))) for k, v in named.items()]
    return F.concat_ws(" ", *parts)


def power_of_ten(text: Column) -> Column:
    """A number written with an exponent, such as 5e-04, as LaTeX."""
    part = F.split(text, "e")
    return F.concat(F.lit("$"), part[0], F.lit(r"\times10^{"), part[1].cast("int").cast("string"), F.lit("}$"))


def review_note(verdict: Column) -> Column:
    """Ambiguous stays; any other verdict suspects the label; none is a dash."""
    return F.when(verdict == "Ambiguous", "Ambiguous").when(verdict != "", "Suspected mislabel").otherwise("--")
