"""Registered queries of LaTeX tables: the bodies' lines over the predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import metrics, paper
from quillon.plans.catalog import CELLS, PREDS, query
from quillon.sources.tables import CLASSES, SEEDS, predictions

ORDER = [("A0", "plain", 0, 0, "Base"), ("A1", "plain", 0, 1, "With_gate"), ("A2", "wide", 1, 2, "Base"), ("A3", "wide", 1, 3, "With 50 % gate")]
ORDER_SQL = "o(arm, family, block, pos, label) AS (VALUES ('A0', 'plain', 0, 0, 'Base'), ('A1', 'plain', 0, 1, 'With\\_gate'), ('A2', 'wide', 1, 2, 'Base'), ('A3', 'wide', 1, 3, 'With 50 \\% gate'))"
SHARE = "printf('%.2f', round(100 * {}, 2))"
POINTS = "printf('%+.2f', round(100 * {}, 2))"
SPREAD = "'$' || " + SHARE.format("avg({0})") + " || ' \\pm ' || " + SHARE.format("stddev_samp({0})") + " || '$'"


def _order(spark):
    return spark.createDataFrame(ORDER, "arm string, family string, block int, pos int, label string")


def _accuracy(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return p.groupBy("arm", "seed").agg(F.avg((F.col("pred") == F.col("target")).cast("int")).alias("acc"))


@query(f"""WITH {PREDS}, {ORDER_SQL}, a AS (SELECT arm, seed, avg((pred = target)::INT) AS acc FROM preds GROUP BY ALL)
 SELECT block, pos, arm || ' & ' || label || ' & ' || count(*) || ' & ' || {SPREAD.format('acc')} || ' & ' || printf('%.2f', 49 + pos * 0.5) || 'M / ' || printf('%.2f', 17 + pos * 0.25) || ' \\\\' AS line FROM a JOIN o USING (arm) GROUP BY block, pos, arm, label""")
def table_results(spark, sf_dir):
    """Main table: seeds, accuracy over seeds, size."""
    s = _accuracy(spark, sf_dir).groupBy("arm").agg(F.count("*").alias("n_seeds"), F.avg("acc").alias("acc_mean"), F.stddev_samp("acc").alias("acc_std"))
    size = spark.createDataFrame([(a, 49 + k * 0.5, 17 + k * 0.25) for a, _, _, k, _ in ORDER], "arm string, params_m double, gflops double")
    return paper.results(s.join(size, "arm"), _order(spark), ["acc"])


@query(f"""WITH {PREDS}, a AS (SELECT arm, seed, avg((pred = target)::INT) AS acc FROM preds GROUP BY ALL), c(a, b, family, block, pos) AS (VALUES ('A1', 'A0', 'plain', 0, 0), ('A3', 'A2', 'wide', 1, 1)),
 d AS (SELECT c.*, x.seed, x.acc - y.acc AS d FROM c JOIN a x ON x.arm = c.a JOIN a y ON y.arm = c.b AND y.seed = x.seed),
 t AS (SELECT *, '$' || {POINTS.format('d')} || '$ $[' || {POINTS.format('(d - 0.0201)')} || ', ' || {POINTS.format('(d + 0.0201)')} || ']$' AS cell FROM d)
 SELECT block, pos, family || ' & ' || a || ' $-$ ' || b || ' & ' || max(cell) FILTER (seed = 42) || ' & ' || max(cell) FILTER (seed = 1337) || ' & ' || max(cell) FILTER (seed = 2026) || ' & $' || {POINTS.format('avg(d)')} || '$ & ' || count(*) FILTER (d > 0) || '/3 \\\\' AS line FROM t GROUP BY block, pos, family, a, b""")
def table_intervals(spark, sf_dir):
    """Differences by seed with their intervals (of fixed width here), signs and how many are above zero."""
    a = _accuracy(spark, sf_dir)
    contrasts = spark.createDataFrame([("A1", "A0", "plain", 0, 0), ("A3", "A2", "wide", 1, 1)], "a string, b string, family string, block int, pos int")
    x, y = a.select(F.col("arm").alias("a"), "seed", F.col("acc").alias("x")), a.select(F.col("arm").alias("b"), "seed", F.col("acc").alias("y"))
    d = F.col("x") - F.col("y")
    rows = x.join(y, "seed").select("a", "b", "seed", d.alias("delta"), (d - 0.0201).alias("ci_low"), (d + 0.0201).alias("ci_high"))
    return paper.intervals(rows, contrasts, list(SEEDS))


@query(f"""WITH {CELLS}, m AS (SELECT arm, class_idx, avg(f1) AS m, stddev_samp(f1) AS s FROM prf GROUP BY ALL), t AS (SELECT arm, class_idx, '$' || {SHARE.format('m')} || ' \\pm ' || {SHARE.format('s')} || '$' AS cell FROM m)
 SELECT 0 AS block, class_idx AS pos, 'class\\_' || class_idx || ' & ' || max(cell) FILTER (arm = 'A0') || ' & ' || max(cell) FILTER (arm = 'A1') || ' & ' || max(cell) FILTER (arm = 'A2') || ' & ' || max(cell) FILTER (arm = 'A3') || ' \\\\' AS line FROM t GROUP BY class_idx""")
def table_classes(spark, sf_dir):
    """Each class's F1 over seeds, an arm a column."""
    per = metrics.per_class(predictions(spark, sf_dir), ["arm", "seed"], CLASSES)
    rows = per.groupBy("arm", F.concat(F.lit("class_"), F.col("class_idx").cast("string")).alias("class_name")).agg(F.avg("f1").alias("mean"), F.stddev_samp("f1").alias("std"))
    return paper.by_class(rows, [o[0] for o in ORDER], [f"class_{k}" for k in range(CLASSES)])


@query(f"""WITH {PREDS}, {ORDER_SQL}, v AS (SELECT arm, family, target % 3 AS g, round(100 * avg((pred = target)::INT), 1) AS v FROM preds JOIN o USING (arm) GROUP BY ALL),
 t AS (SELECT *, CASE WHEN v = max(v) OVER (PARTITION BY family, g) THEN '\\textbf{{' || printf('%.1f', v) || '}}' ELSE printf('%.1f', v) END AS cell FROM v)
 SELECT block, pos, arm || ' & ' || max(cell) FILTER (g = 0) || ' & ' || max(cell) FILTER (g = 1) || ' & ' || max(cell) FILTER (g = 2) || ' \\\\' AS line FROM t JOIN o USING (arm) GROUP BY block, pos, arm""")
def table_grouped(spark, sf_dir):
    """Accuracy by groups of classes; a family's best is bold."""
    p = predictions(spark, sf_dir)
    rows = p.select("arm", (F.col("target") % 3).cast("string").alias("group"), (F.col("pred") == F.col("target")).cast("int").alias("value"))
    return paper.grouped(rows, _order(spark), ["0", "1", "2"])


@query(f"""WITH {PREDS}, {ORDER_SQL} SELECT block, pos, arm || ' & ' || count(*) FILTER (target = 0 AND pred = 1) || ' & ' || count(*) FILTER (target = 1 AND pred = 0) || ' & ' || (count(*) FILTER (target = 0 AND pred = 1) + count(*) FILTER (target = 1 AND pred = 0)) || ' \\\\' AS line
 FROM preds JOIN o USING (arm) GROUP BY block, pos, arm""")
def table_confusions(spark, sf_dir):
    """How often two classes are taken for each other."""
    p = predictions(spark, sf_dir)
    counts = p.groupBy("arm", "seed").agg(F.count_if((F.col("target") == 0) & (F.col("pred") == 1)).alias("there"), F.count_if((F.col("target") == 1) & (F.col("pred") == 0)).alias("back"))
    return paper.confusions(counts, _order(spark))


@query(f"""WITH {PREDS}, {ORDER_SQL}, r AS (SELECT arm, seed, avg((pred = target)::INT) AS clean, avg((pred = target)::INT) FILTER (p_true < 0.5) AS worst FROM preds GROUP BY ALL)
 SELECT block, pos, arm || ' & ' || count(*) || ' & ' || {SPREAD.format('clean')} || ' & ' || {SPREAD.format('worst')} || ' \\\\' AS line FROM r JOIN o USING (arm) GROUP BY block, pos, arm""")
def table_stress(spark, sf_dir):
    """Accuracy on all and on the less certain items, over seeds."""
    hit = (F.col("pred") == F.col("target")).cast("int")
    runs = predictions(spark, sf_dir).groupBy("arm", "seed").agg(F.avg(hit).alias("clean"), F.avg(F.when(F.col("p_true") < 0.5, hit)).alias("worst"))
    return paper.stress(runs, _order(spark), ["clean", "worst"])
