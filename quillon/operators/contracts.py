"""Contracts of a campaign: each returns rows that say what is missing, extra or different."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def incomplete(expected: DataFrame, found: DataFrame, keys: list[str], run: list[str]) -> DataFrame:
    """(run, n_missing, missing): runs that lack artifacts of the expected grid, a few a run."""
    gone = expected.join(found.select(*keys).distinct(), keys, "left_anti")
    rest = [k for k in keys if k not in run]
    return gone.groupBy(*run).agg(F.count("*").alias("n_missing"), F.array_join(F.array_sort(F.collect_set(F.concat_ws("/", *rest))), ",").alias("missing"))


def layout(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, status): expected cells without rows are missing, found ones that nobody expects are extra."""
    counts = found.groupBy(*keys).agg(F.count("*").alias("n"))
    both = expected.select(*keys, F.lit(True).alias("_e")).join(counts, keys, "full_outer")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("_e").isNull(), "extra").otherwise("ok")
    return both.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


def count_protocol(rows: DataFrame, column: str, published: dict[str, int], strict: bool = False) -> DataFrame:
    """(value, n, published, ok) of a column's published counts; strict raises where one differs."""
    wanted = rows.sparkSession.createDataFrame(list(published.items()), f"{column} string, published long")
    got = rows.groupBy(column).agg(F.count("*").alias("n"))
    out = wanted.join(got, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"), "published")
    out = out.withColumn("ok", F.col("n") == F.col("published"))
    if strict:
        out = out.filter(F.assert_true("ok", F.concat(F.lit("counts differ for "), column)).isNull())
    return out


def foreign(rows: DataFrame, run: list[str], campaign: Column) -> DataFrame:
    """(run, n_foreign): runs with rows of another campaign; null counts as another."""
    return rows.groupBy(*run).agg(F.count_if(~F.coalesce(campaign, F.lit(False))).alias("n_foreign")).filter("n_foreign > 0")


def within_budget(rows: DataFrame, actual: str, expected: str, tolerance: float) -> DataFrame:
    """Adds ``off`` and ``ok``: whether a count is within the tolerance of its formula; no formula is always met."""
    off = F.abs(F.col(actual) - F.col(expected))
    return rows.withColumns({"off": off, "ok": F.coalesce(off <= tolerance, F.lit(True))})


def token_parameters(width: Column, ratio: Column) -> tuple[Column, Column]:
    """Parameters of the colour-token module and of the matched adapter, by feature width and expansion ratio."""
    return 6 * width * width + 8 * width + 1, 2 * ratio * width * width + (ratio + 5) * width + 1


def metric_map(rows: DataFrame, keys: list[str], text: str, metric: str, classes: list[str]) -> DataFrame:
    """(keys, class, value) of a JSON metric document in one of three shapes, tried in this order: {class: {metric: x}},
    {metric: {class: x}, ...}, {metric: [x of each class], ...}. Other documents give no rows."""
    m = F.from_json(text, "map<string,string>")
    one = F.element_at(F.col("_m"), metric)
    nested = F.forall(F.map_values("_m"), lambda v: F.coalesce(v.startswith("{"), F.lit(False))) & (F.size("_m") > 0)
    by_class = F.transform_values("_m", lambda _, v: F.element_at(F.from_json(v, "map<string,double>"), metric))
    listed = F.from_json(one, "array<double>")
    names = F.array(*(F.lit(c) for c in classes))
    shape = F.when(nested, F.map_filter(by_class, lambda _, v: v.isNotNull())).when(one.startswith("{"), F.from_json(one, "map<string,double>"))
    shape = shape.when(one.startswith("[") & (F.size(listed) == len(classes)), F.map_from_arrays(names, listed))
    return rows.withColumn("_m", m).select(*keys, F.explode(shape).alias("class", "value"))


def compared_sets(a: DataFrame, b: DataFrame, key: str, n: int) -> DataFrame:
    """(side, n, sample, equal): how many values each side has alone, its first n, and whether none has any."""
    left, right = a.select(F.col(key).alias("k")).distinct(), b.select(F.col(key).alias("k")).distinct()
    alone = left.subtract(right).select(F.lit("left_only").alias("side"), "k").unionByName(right.subtract(left).select(F.lit("right_only").alias("side"), "k"))
    counts = alone.groupBy("side").agg(F.count("*").alias("n"))
    first = alone.withColumn("i", F.row_number().over(Window.partitionBy("side").orderBy("k"))).filter(F.col("i") <= n).groupBy("side").agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("sample"))
    sides = a.sparkSession.createDataFrame([("left_only",), ("right_only",)], "side string")
    out = sides.join(counts, "side", "left").join(first, "side", "left").na.fill(0, ["n"]).na.fill("", ["sample"])
    return out.crossJoin(out.agg((F.sum("n") == 0).alias("equal")))  # one row


def violations(rows: DataFrame, rules: list[tuple]) -> DataFrame:
    """Rows that break a rule, with ``problems``: the names of those broken. A rule is a name (a text or a column) and a
    condition under which it is broken; null counts as kept."""
    said = [F.when(broken, F.lit(name) if isinstance(name, str) else name) for name, broken in rules]
    return rows.withColumn("problems", F.concat_ws(",", *said)).filter("problems <> ''")


def false_claims(rows: DataFrame, said: str, holds: str) -> DataFrame:
    """Rows whose claim and finding differ, with ``conflict``."""
    conflict = F.when(F.col(said) & ~F.col(holds), "claimed, not shown").when(~F.col(said) & F.col(holds), "shown, not claimed")
    return rows.withColumn("conflict", conflict).filter("conflict is not null")


def changed_settings(began: DataFrame, now: DataFrame, run: str, config: str) -> DataFrame:
    """(run, problem) where the settings at resume aren't those at the start: missing, or changed."""
    both = began.select(run, F.col(config).alias("a")).join(now.select(run, F.col(config).alias("b")), run, "left").filter(~F.col("a").eqNullSafe(F.col("b")))
    return both.select(run, F.when(F.col("b").isNull(), "missing").otherwise("changed").alias("problem"))


def manifest_lock(files: DataFrame, manifest_sha256: str, counts: dict[tuple[str, str], int]) -> DataFrame:
    """(problem) of a locked set of files (path, split, class_name, sha256): the digest of its sorted lines must be the
    one locked, and each split and class must have its count. The lines are sorted in one task, as one text is hashed."""
    spark = files.sparkSession
    lines = files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("  ", "sha256", "path"))), "\n"), 256).alias("is"))
    wrong = lines.filter(F.col("is") != manifest_sha256).select(F.concat(F.lit("manifest is "), "is").alias("problem"))
    want = spark.createDataFrame([(*k, n) for k, n in counts.items()], "split string, class_name string, want long")
    have = files.groupBy("split", "class_name").agg(F.count("*").alias("have"))
    off = want.join(have, ["split", "class_name"], "full_outer").filter("not want <=> have")
    return wrong.unionByName(off.select(F.format_string("%s/%s: %s, not %s", "split", "class_name", F.coalesce(F.col("have").cast("string"), F.lit("none")), F.coalesce(F.col("want").cast("string"), F.lit("none"))).alias("problem")))


def shared_items(rows: DataFrame, run: list[str], columns: list[str]) -> DataFrame:
    """(run, n, low, high, agrees): rows of each run, two sums of hashes of the columns, and whether all three are those of
    the first run. The order of rows doesn't count; null columns count as the word null."""
    text = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns)))
    part = lambda k: F.sum(F.conv(F.substring(text, k, 8), 16, 10).cast("long"))
    out = rows.groupBy(*run).agg(F.count("*").alias("n"), part(1).alias("low"), part(9).alias("high"))
    first = out.agg(F.min(F.struct(*run, "n", "low", "high")).alias("_f"))  # one row
    same = (F.col("n") == F.col("_f.n")) & (F.col("low") == F.col("_f.low")) & (F.col("high") == F.col("_f.high"))
    return out.crossJoin(F.broadcast(first)).withColumn("agrees", same).drop("_f")
