"""LaTeX tables of a campaign: bodies as rows (block, pos, line), made by grouping and pivoting, and the frame around them.

``order`` gives the arms: (arm, family, block, pos, label). A rule goes between blocks. Cells: shares are shown as percentages
with two decimals, ``mean \\pm deviation`` over seeds (without the deviation for one seed), differences with their sign in
points; what is missing is ``--``. Text is escaped. Tables are reports: their rows are arms, classes or images of a list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.sources.sinks import latex

END = " \\\\"


def _number(x: Column, digits: int, sign: bool = False) -> Column:
    return F.when(x.isNull(), "--").otherwise(F.format_string(f"%{'+' if sign else ''}.{digits}f", F.round(x, digits)))


def share(x: Column) -> Column:
    return _number(100 * x, 2)


def points(x: Column) -> Column:
    return _number(100 * x, 2, sign=True)


def spread(mean: Column, deviation: Column) -> Column:
    """``$mean \\pm deviation$`` of shares."""
    both = F.concat(F.lit("$"), share(mean), F.lit(" \\pm "), share(deviation), F.lit("$"))
    return F.when(mean.isNull(), "--").when(deviation.isNull(), F.concat(F.lit("$"), share(mean), F.lit("$"))).otherwise(both)


def thousands(n: Column) -> Column:
    return F.when(n.isNull(), "--").otherwise(F.replace(F.format_number(n, 0), F.lit(","), F.lit("{,}")))


def _line(*cells: Column) -> Column:
    return F.concat(F.concat_ws(" & ", *(F.coalesce(c, F.lit("--")) for c in cells)), F.lit(END)).alias("line")


def _ordered(rows: DataFrame, order: DataFrame) -> DataFrame:
    """Every arm of the order, with or without rows."""
    return order.select("arm", "family", "block", "pos", F.col("label").alias("_label")).join(rows.drop("family", "block", "pos"), "arm", "left")


def results(summary: DataFrame, order: DataFrame, metrics: list[str]) -> DataFrame:
    """Arm, label, seeds, each metric's mean and deviation, parameters and GFLOPs. ``summary``: (arm, n_seeds, <metric>_mean,
    <metric>_std, params_m, gflops)."""
    size = F.when(F.col("params_m").isNotNull(), F.concat(_number(F.col("params_m"), 2), F.lit("M / "), _number(F.col("gflops"), 2)))
    cells = [spread(F.col(f"{m}_mean"), F.col(f"{m}_std")) for m in metrics]
    return _ordered(summary, order).select("block", "pos", _line(F.col("arm"), latex(F.col("_label")), F.coalesce("n_seeds", F.lit(0)).cast("string"), *cells, size))


def by_class(rows: DataFrame, arms: list[str], classes: list[str]) -> DataFrame:
    """A line a class, a column an arm: mean and deviation. ``rows``: (arm, class_name, mean, std)."""
    said = rows.sparkSession.createDataFrame(list(enumerate(classes)), "pos int, class_name string")
    cells = rows.groupBy("class_name").agg(*(F.max(F.when(F.col("arm") == a, spread(F.col("mean"), F.col("std")))).alias(f"c{k}") for k, a in enumerate(arms)))
    return said.join(cells, "class_name", "left").select(F.lit(0).alias("block"), "pos", _line(latex(F.col("class_name")), *(F.col(f"c{k}") for k in range(len(arms)))))


def intervals(rows: DataFrame, contrasts: DataFrame, seeds: list[int]) -> DataFrame:
    """Family, contrast, each seed's difference with its interval, their mean, and on how many seeds it is above zero. ``rows``:
    (a, b, seed, delta, ci_low, ci_high); ``contrasts``: (a, b, family, block, pos)."""
    cell = F.concat(F.lit("$"), points(F.col("delta")), F.lit("$ $["), points(F.col("ci_low")), F.lit(", "), points(F.col("ci_high")), F.lit("]$"))
    known = rows.filter(F.col("seed").isin(seeds))
    own = known.groupBy("a", "b").agg(*(F.max(F.when(F.col("seed") == s, cell)).alias(f"s{s}") for s in seeds), F.avg("delta").alias("mean"), F.count_if(F.col("delta") > 0).alias("above"))
    met = contrasts.join(own, ["a", "b"], "left")
    mean = F.when(F.col("mean").isNotNull(), F.concat(F.lit("$"), points(F.col("mean")), F.lit("$")))
    above = F.when(F.col("above").isNotNull(), F.concat(F.col("above").cast("string"), F.lit(f"/{len(seeds)}")))
    return met.select("block", "pos", _line(latex(F.col("family")), F.concat("a", F.lit(" $-$ "), "b"), *(F.col(f"s{s}") for s in seeds), mean, above))


def excluding_zero(rows: DataFrame) -> DataFrame:
    """The intervals that a caption must not call inconclusive."""
    return rows.filter((F.col("ci_low") > 0) | (F.col("ci_high") < 0)).select("a", "b", "seed")


def complexity(models: DataFrame, order: DataFrame, base: dict[str, str]) -> DataFrame:
    """Arm, label, millions of parameters, those added to the family's base, GFLOPs. ``models``: (arm, params_m, gflops)."""
    held = _ordered(models, order)
    bases = held.filter(F.col("arm").isin(list(base.values()))).select("family", F.col("arm").alias("_base"), F.col("params_m").alias("_of"))
    met = held.join(F.broadcast(bases), "family", "left")
    added = F.when(F.col("arm") != F.col("_base"), thousands(F.round((F.col("params_m") - F.col("_of")) * 1e6).cast("long")))
    return met.select("block", "pos", _line(F.col("arm"), latex(F.col("_label")), _number(F.col("params_m"), 2), added, _number(F.col("gflops"), 2)))


def consensus(failures: DataFrame, seeds: list[int]) -> DataFrame:
    """Items that all runs of all seeds get wrong: name, label, prediction (mixed if runs differ), whether it is the same, and the
    review's note. ``failures``: (image_id, seed, true_label, wrong_label, unanimous, verdict); verdicts that differ between
    seeds, or confirm the label, give the note ``check``."""
    own = failures.groupBy("image_id").agg(F.count_distinct("seed").alias("n"), F.first("true_label").alias("label"), F.array_sort(F.collect_set("wrong_label")).alias("wrong"), F.bool_and("unanimous").alias("all"), F.array_sort(F.collect_set(F.nullif("verdict", F.lit("")))).alias("said"))
    same = (F.size("wrong") == 1) & F.col("all")
    verdict = F.get("said", F.lit(0))
    note = F.when((F.size("said") > 1) | (verdict == F.col("label")), "check").when(verdict == "Ambiguous", "Ambiguous").when(verdict.isNotNull(), "Suspected mislabel")
    name = F.concat(F.lit("\\texttt{"), latex(F.element_at(F.split("image_id", "/"), -1)), F.lit("}"))
    kept = own.filter(F.col("n") == len(seeds))
    return kept.select(F.lit(0).alias("block"), F.col("image_id").alias("pos"), _line(name, latex(F.col("label")), F.when(same, latex(F.get("wrong", F.lit(0)))).otherwise("mixed"), F.when(same, "yes").otherwise("no"), note))


def confusions(counts: DataFrame, order: DataFrame) -> DataFrame:
    """Arm, both directions of a pair of classes summed over seeds, and their sum. ``counts``: (arm, seed, there, back)."""
    own = counts.groupBy("arm").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    return _ordered(own, order).select("block", "pos", _line(F.col("arm"), F.col("there").cast("string"), F.col("back").cast("string"), (F.col("there") + F.col("back")).cast("string")))


def stress(runs: DataFrame, order: DataFrame, columns: list[str]) -> DataFrame:
    """Arm, seeds, mean and sample deviation of each column over seeds. ``runs``: (arm, seed, <columns>)."""
    own = runs.groupBy("arm").agg(F.count_distinct("seed").alias("n"), *(f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "m"), (F.stddev_samp, "s"))))
    return _ordered(own, order).select("block", "pos", _line(F.col("arm"), F.coalesce("n", F.lit(0)).cast("string"), *(spread(F.col(f"{c}_m"), F.col(f"{c}_s")) for c in columns)))


def grouped(rows: DataFrame, order: DataFrame, groups: list[str], digits: int = 1) -> DataFrame:
    """Arm, the mean of each group of conditions; a family's highest values as shown are bold, ties all. ``rows``: (arm, group,
    value)."""
    shown = rows.groupBy("arm", "group").agg(F.round(100 * F.avg("value"), digits).alias("v"))
    named = shown.join(F.broadcast(order.select("arm", "family")), "arm")
    top = named.groupBy("family", "group").agg(F.max("v").alias("top"))
    text = _number(F.col("v"), digits)
    cell = F.when(F.col("v") == F.col("top"), F.concat(F.lit("\\textbf{"), text, F.lit("}"))).otherwise(text)
    own = named.join(top, ["family", "group"]).groupBy("arm").agg(*(F.max(F.when(F.col("group") == g, cell)).alias(f"g{k}") for k, g in enumerate(groups)))
    return _ordered(own, order).select("block", "pos", _line(F.col("arm"), *(F.col(f"g{k}") for k in range(len(groups)))))


def settings(configs: DataFrame, families: list[str], labels: dict[str, str]) -> DataFrame:
    """A line a setting, a column a family. ``configs``: (family, run, key, value as text); runs of a family that differ in a
    setting give ``differs``."""
    said = configs.sparkSession.createDataFrame([(k, key, label) for k, (key, label) in enumerate(labels.items())], "pos int, key string, label string")
    own = configs.groupBy("family", "key").agg(F.count_distinct(F.coalesce("value", F.lit("--"))).alias("n"), F.max("value").alias("v"))
    text = F.when(F.col("n") > 1, "differs").otherwise(latex(F.col("v")))
    wide = own.groupBy("key").agg(*(F.max(F.when(F.col("family") == f, text)).alias(f"f{k}") for k, f in enumerate(families)))
    return said.join(wide, "key", "left").select(F.lit(0).alias("block"), "pos", _line(latex(F.col("label")), *(F.col(f"f{k}") for k in range(len(families)))))


def power_of_ten(x: Column) -> Column:
    """One digit times a power of ten, as LaTeX."""
    part = F.split(F.format_string("%.0e", x), "e")
    return F.concat(F.lit("$"), part[0], F.lit("\\times10^{"), part[1].cast("int").cast("string"), F.lit("}$"))


@dataclass(frozen=True)
class Frame:
    caption: str
    label: str
    columns: str
    heads: tuple[str, ...]
    wide: bool = False
    scaled: bool = False


def framed(lines: DataFrame, frame: Frame, most: int = 10_000) -> str:
    """The whole table; more than ``most`` lines are refused."""
    rows = lines.orderBy("block", "pos").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of over {most} lines")
    kind = "table*" if frame.wide else "table"
    out = [f"\\begin{{{kind}}}[t]", "\\centering", f"\\caption{{{frame.caption}}}", f"\\label{{{frame.label}}}"]
    out += ["\\resizebox{\\textwidth}{!}{%"] if frame.scaled else []
    out += [f"\\begin{{tabular}}{{{frame.columns}}}", "\\toprule", " & ".join(f"\\textbf{{{h}}}" for h in frame.heads) + END, "\\midrule"]
    for k, r in enumerate(rows):
        if k and r.block != rows[k - 1].block:
            out.append("\\midrule")
        out.append(r.line)
    out += ["\\bottomrule", "\\end{tabular}" + ("%" if frame.scaled else "")] + (["}"] if frame.scaled else [])
    return "\n".join([*out, f"\\end{{{kind}}}"]) + "\n"
