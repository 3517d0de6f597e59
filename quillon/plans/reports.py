"""Registered queries of the reports: summaries over seeds and groups, consensus, guards, cost sums and text scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import keys as K
from quillon.functions import masks as M
from quillon.functions import vectors as V
from quillon.operators import consensus, contracts, inference, merkle, metrics, pairs, prefix, summary
from quillon.plans.catalog import AB, ASSETS, CELLS, DECIDE, PREDS, VECTORS, _ab, _decided, _pairs, query
from quillon.sources.tables import ARMS, CLASSES, assets, predictions, table, vectors

FAMILY = {"A0": "plain", "A1": "plain", "A2": "wide", "A3": "wide"}
TITLES = {"A0": "Baseline", "A1": "Baseline, longer", "A2": "Wide"}


def _named(spark, pairs: dict, key: str, value: str):
    return F.broadcast(spark.createDataFrame(list(pairs.items()), f"{key} string, {value} string"))  # a handful of rows


@query(f"""WITH {CELLS} SELECT arm, class_idx, round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_std, count(*) AS n_seeds,
 CASE WHEN count(*) > 1 THEN printf('%.3f ± %.3f', avg(f1), stddev_samp(f1)) ELSE printf('%.3f', avg(f1)) END AS cell FROM prf GROUP BY ALL""")
def per_class_over_seeds(spark, sf_dir):
    """Mean and deviation of a class's F1 over seeds, as numbers and as a cell; one seed has no deviation."""
    rows = metrics.per_class(predictions(spark, sf_dir), ["arm", "seed"], CLASSES)
    out = rows.groupBy("arm", "class_idx").agg(F.avg("f1").alias("f1_mean"), F.stddev_samp("f1").alias("f1_std"), F.count("*").alias("n_seeds"))
    return out.withColumn("cell", summary.mean_and_deviation("f1_mean", "f1_std", 3))


ROBUST = """r AS (SELECT l_suppkey AS run, l_returnflag AS experiment, CASE WHEN l_linenumber = 1 THEN 'clean' WHEN l_linenumber % 2 = 0 THEN 'even' ELSE 'odd' END AS grp, l_linenumber AS cond, avg(l_extendedprice) AS m FROM lineitem GROUP BY ALL)"""


def _conditions(spark, sf_dir):
    group = F.when(F.col("l_linenumber") == 1, "clean").when(F.col("l_linenumber") % 2 == 0, "even").otherwise("odd")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run"), F.col("l_returnflag").alias("experiment"), group.alias("grp"), F.col("l_linenumber").alias("cond")).agg(F.avg("l_extendedprice").alias("m"))


@query(f"WITH {ROBUST} SELECT experiment, grp, count(*) AS n, round(avg(m), 3) AS m_mean, round(stddev_samp(m), 3) AS m_std FROM r GROUP BY ALL", digits=3)
def robustness_by_group(spark, sf_dir):
    return _conditions(spark, sf_dir).groupBy("experiment", "grp").agg(F.count("*").alias("n"), F.avg("m").alias("m_mean"), F.stddev_samp("m").alias("m_std"))


WIDE = {"qty": "l_quantity", "price": "l_extendedprice", "disc": "l_discount", "tax": "l_tax", "net": "l_extendedprice * (1 - l_discount)"}


@query(
    "WITH r AS (SELECT l_returnflag AS experiment, l_linenumber AS seed, " + ", ".join(f"{f}({e}) AS {n}_{f}" for n, e in WIDE.items() for f in ("avg", "min", "max")) + " FROM lineitem GROUP BY ALL) SELECT experiment, count(*) AS n, "
    + ", ".join(f"round(avg({n}_{f}), 4) AS {n}_{f}_mean, round(stddev_samp({n}_{f}), 4) AS {n}_{f}_std" for n in WIDE for f in ("avg", "min", "max")) + " FROM r GROUP BY 1",
    digits=4,
)
def fifteen_metrics(spark, sf_dir):
    """Mean and deviation over seeds of fifteen metrics, with flattened names."""
    names = [f"{n}_{f}" for n in WIDE for f in ("avg", "min", "max")]
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("experiment"), F.col("l_linenumber").alias("seed")).agg(*(F.expr(f"{f}({e})").alias(f"{n}_{f}") for n, e in WIDE.items() for f in ("avg", "min", "max")))
    return rows.groupBy("experiment").agg(F.count("*").alias("n"), *(g(m).alias(f"{m}_{s}") for m in names for g, s in ((F.avg, "mean"), (F.stddev_samp, "std"))))


@query(f"WITH {CELLS}, m AS (SELECT arm, seed, sum(tp) / sum(support)::DOUBLE AS x, avg(f1) AS y FROM prf GROUP BY ALL), a AS (SELECT arm, avg(x) AS x, avg(y) AS y FROM m GROUP BY 1) SELECT arm, round(x, 6) AS x, round(y, 6) AS y, round(min(x) OVER () - 0.05 * (max(x) OVER () - min(x) OVER ()), 6) AS x_low, round(max(y) OVER () + 0.05 * (max(y) OVER () - min(y) OVER ()), 6) AS y_high FROM a")
def scatter_points(spark, sf_dir):
    """Means by arm for a scatter plot, with padded bounds of the axes."""
    m = metrics.averages(predictions(spark, sf_dir), ["arm", "seed"], CLASSES).groupBy("arm").agg(F.avg("accuracy").alias("x"), F.avg("macro_f1_fixed").alias("y"))
    ends = m.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    out = m.crossJoin(ends)  # one row
    return out.select("arm", "x", "y", (F.col("x0") - 0.05 * (F.col("x1") - F.col("x0"))).alias("x_low"), (F.col("y1") + 0.05 * (F.col("y1") - F.col("y0"))).alias("y_high"))


@query(f"""WITH {ROBUST}, g AS (SELECT grp, experiment, round(avg(m), 2) AS v FROM r GROUP BY ALL), p AS (SELECT grp, max(v) FILTER (experiment = 'A') AS "A", max(v) FILTER (experiment = 'N') AS "N", max(v) FILTER (experiment = 'R') AS "R" FROM g GROUP BY 1), t AS (SELECT *, greatest("A", "N", "R") AS top FROM p)
 SELECT grp, "A", "N", "R", CASE grp WHEN 'odd' THEN 0 WHEN 'clean' THEN 1 ELSE 10000 END AS pos, concat_ws(',', CASE WHEN "A" = top THEN 'A' END, CASE WHEN "N" = top THEN 'N' END, CASE WHEN "R" = top THEN 'R' END) AS best FROM t""", digits=2)
def pivot_by_experiment(spark, sf_dir):
    """Groups by experiments in a declared order, with the names of each row's best, ties included."""
    wanted = ["A", "N", "R"]
    p = _conditions(spark, sf_dir).groupBy("grp").pivot("experiment", wanted).agg(F.round(F.avg("m"), 2))
    top = F.greatest(*wanted)
    best = F.concat_ws(",", *(F.when(F.col(c) == top, c) for c in wanted))
    return p.select("grp", *wanted, F.when(F.col("grp") == "odd", 0).when(F.col("grp") == "clean", 1).otherwise(10_000).alias("pos"), best.alias("best"))


@query(f"""WITH {CELLS} SELECT arm, seed, round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy, round(avg(precision) FILTER (support + predicted > 0), 6) AS macro_precision, round(avg(recall) FILTER (support + predicted > 0), 6) AS macro_recall, round(avg(f1) FILTER (support + predicted > 0), 6) AS macro_f1,
 round(2.0 * sum(tp) / (sum(support) + sum(predicted)), 6)::DOUBLE AS micro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM prf GROUP BY ALL""")
def averages_in_full(spark, sf_dir):
    """Macro, micro and weighted averages over the labels that occur in targets or predictions."""
    seen = F.col("support") + F.col("predicted") > 0
    over = lambda c: F.avg(F.when(seen, F.col(c)))
    rows = metrics.per_class(predictions(spark, sf_dir), ["arm", "seed"], CLASSES).groupBy("arm", "seed")
    return rows.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), over("precision").alias("macro_precision"), over("recall").alias("macro_recall"), over("f1").alias("macro_f1"), (2.0 * F.sum("tp") / (F.sum("support") + F.sum("predicted"))).alias("micro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


@query(f"""WITH {PREDS}, c AS (SELECT target, count(*) AS n FROM (SELECT DISTINCT image_id, target FROM preds) GROUP BY 1), w AS (SELECT target, (1.0 / n) / avg(1.0 / n) OVER () AS w FROM c),
 x AS (SELECT arm, seed, floor(image_id / 64) AS batch, sum(-ln(p_true) * w) / sum(w) AS loss, count(*) AS n FROM preds JOIN w USING (target) GROUP BY ALL) SELECT arm, seed, round(sum(loss * n) / sum(n), 6) AS log_loss FROM x GROUP BY ALL""")
def weighted_log_loss(spark, sf_dir):
    """Class-weighted cross-entropy of batches of 64, averaged by the batches' sizes."""
    p = predictions(spark, sf_dir)
    w = metrics.class_weights(p.select("image_id", "target").distinct(), "target").select("target", "weight")
    return metrics.batch_log_loss(p.join(F.broadcast(w), "target").withColumn("batch", F.floor(F.col("image_id") / 64)), ["arm", "seed"], "batch", "p_true", "weight")


MODAL = f"""{PREDS}, w AS (SELECT image_id, seed, pred, count(*) AS v, avg(1 - p_true) AS pm FROM preds WHERE pred <> target GROUP BY ALL), t AS (SELECT * FROM w QUALIFY rank() OVER (PARTITION BY image_id, seed ORDER BY v DESC) = 1),
 m AS (SELECT image_id, seed, min(pred) AS modal, count(*) > 1 AS tie, avg(pm) AS p_modal FROM t GROUP BY ALL),
 c AS (SELECT image_id, seed, min(target) AS target, count(*) FILTER (pred <> target) AS n_wrong, avg(p_true) AS p_mean FROM preds GROUP BY ALL HAVING count(*) FILTER (pred <> target) >= 2)"""


@query(f"""WITH {MODAL}, f AS (SELECT *, round(p_mean, 6) AS pr FROM c JOIN m USING (image_id, seed)) SELECT image_id, seed, target, n_wrong, pr AS p_mean, round(p_modal, 6) AS p_modal, target || ' -> ' || modal || CASE WHEN tie THEN ' (tie)' ELSE '' END AS label,
 row_number() OVER (PARTITION BY seed ORDER BY n_wrong DESC, pr DESC, image_id) AS place FROM f""")
def ranked_failures(spark, sf_dir):
    """Images that two arms or more get wrong, ranked within their seed by arms wrong and mean probability of the truth."""
    return consensus.ranked_failures(predictions(spark, sf_dir), ["image_id"], ["seed"], 2)


@query(f"WITH {MODAL}, f AS (SELECT * FROM c JOIN m USING (image_id, seed)) SELECT seed, 'class' AS kind, target::VARCHAR AS name, count(*) AS n FROM f GROUP BY ALL UNION ALL SELECT seed, 'confusion', target || ' -> ' || modal, count(*) FROM f GROUP BY ALL")
def failure_counters(spark, sf_dir):
    """How many ranked failures each class has, and each confusion."""
    f = consensus.ranked_failures(predictions(spark, sf_dir), ["image_id"], ["seed"], 2)
    kinds = F.array(F.struct(F.lit("class").alias("kind"), F.col("target").cast("string").alias("name")), F.struct(F.lit("confusion").alias("kind"), F.regexp_replace("label", r" \(tie\)$", "").alias("name")))
    return f.select("seed", F.explode(kinds).alias("k")).groupBy("seed", "k.kind", "k.name").agg(F.count("*").alias("n"))


@query(f"""WITH {PREDS}, i AS (SELECT seed, image_id, count(*) FILTER (pred <> target) AS wrong, count(*) AS arms FROM preds GROUP BY ALL), s AS (SELECT seed, arm, avg((pred = target)::INT) AS a FROM preds GROUP BY ALL), b AS (SELECT seed, max(a) AS best, arg_max(arm, (a, arm)) AS best_arm FROM s GROUP BY 1)
 SELECT seed, count(*) AS n, count(*) FILTER (wrong >= 1) AS wrong_in_one, count(*) FILTER (wrong = arms) AS wrong_in_all, round(1 - count(*) FILTER (wrong = arms) / count(*)::DOUBLE, 6) AS ceiling, round(any_value(best), 6) AS best, any_value(best_arm) AS best_arm FROM i JOIN b USING (seed) GROUP BY seed""")
def ceiling_in_full(spark, sf_dir):
    """The oracle's ceiling, the best single arm, and how many images one arm or all get wrong."""
    return consensus.ceiling(predictions(spark, sf_dir), ["seed"], "image_id", "arm")


@query(f"""WITH {PREDS}, q AS (SELECT *, (target IN (0, 1)) AND pred <> target AND pred IN (0, 1) AS confused, CASE WHEN pred <> target THEN 1 - p_true ELSE (1 - p_true) / 9 END AS p_cross FROM preds)
 SELECT arm, seed, round(avg(p_cross) FILTER (target = 0), 6) AS cross_ab, round(avg(p_cross) FILTER (target = 1), 6) AS cross_ba, count(*) FILTER (confused) AS confused FROM q GROUP BY ALL""")
def pair_cross_probability(spark, sf_dir):
    """Mean probability that two classes' images are given away from them, and how many are taken for the other."""
    p = _confused(spark, sf_dir)
    return p.groupBy("arm", "seed").agg(F.avg(F.when(F.col("target") == 0, F.col("p_cross"))).alias("cross_ab"), F.avg(F.when(F.col("target") == 1, F.col("p_cross"))).alias("cross_ba"), F.count_if("confused").alias("confused"))


def _confused(spark, sf_dir):
    p, wrong = predictions(spark, sf_dir), F.col("pred") != F.col("target")
    return p.withColumns({"confused": F.col("target").isin(0, 1) & wrong & F.col("pred").isin(0, 1), "p_cross": F.when(wrong, 1 - F.col("p_true")).otherwise((1 - F.col("p_true")) / 9)})


@query(f"""WITH {PREDS} SELECT image_id, seed, count(*) FILTER (pred <> target) AS n_wrong, count(*) FILTER (target IN (0, 1) AND pred <> target AND pred IN (0, 1)) AS n_confused,
 count(*) FILTER (target IN (0, 1) AND pred <> target AND pred IN (0, 1)) * 2 > count(*) AS majority FROM preds GROUP BY ALL HAVING count(*) FILTER (pred <> target) > 0""")
def image_confusions(spark, sf_dir):
    """By image and seed: arms wrong, arms that confuse the pair, and whether most do."""
    out = _confused(spark, sf_dir).groupBy("image_id", "seed").agg(F.count_if(F.col("pred") != F.col("target")).alias("n_wrong"), F.count_if("confused").alias("n_confused"), F.count("*").alias("_n"))
    return out.filter("n_wrong > 0").select("image_id", "seed", "n_wrong", "n_confused", (F.col("n_confused") * 2 > F.col("_n")).alias("majority"))


@query(f"""WITH {DECIDE} SELECT coalesce(label::VARCHAR, 'Overall') AS class_name, count(*) AS total, count(*) FILTER (status NOT IN ('rejected', 'uncertain')) AS eligible, count(*) FILTER (status = 'accepted') AS accepted, round(min(confidence) FILTER (status <> 'rejected'), 6) AS confidence_min,
 round(avg(confidence) FILTER (status <> 'rejected'), 6) AS confidence_mean, round(max(confidence) FILTER (status <> 'rejected'), 6) AS confidence_max, round(100.0 * count(*) FILTER (status = 'accepted') / nullif(count(*) FILTER (status NOT IN ('rejected', 'uncertain')), 0), 6)::DOUBLE AS pass_percent FROM x GROUP BY ROLLUP (label)""")
def class_statistics_in_full(spark, sf_dir):
    return consensus.class_statistics(_decided(spark, sf_dir), "label")


EYES = """e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS m1, list_transform(embedding, lambda x: -x::DOUBLE) AS m2, list_transform(embedding, lambda x: abs(x)::DOUBLE) AS m3 FROM embeddings)"""


def _maps(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    each = {"m1": lambda x: x.cast("double"), "m2": lambda x: -x.cast("double"), "m3": lambda x: F.abs(x).cast("double")}
    return e.select("vec_id", *(F.transform("embedding", f).alias(n) for n, f in each.items()))


IOU = "len(list_intersect(h{0}, h{1}))::DOUBLE / nullif(len(list_distinct(list_concat(h{0}, h{1}))), 0)"


@query(f"""WITH {EYES}, h AS (SELECT vec_id, {', '.join(f"[i FOR i IN range(1, len(m{k}) + 1) IF m{k}[i] >= list_aggregate(m{k}, 'quantile_cont', 0.8)] AS h{k}" for k in (1, 2, 3))} FROM e)
 SELECT vec_id, round(({IOU.format(1, 2)} + {IOU.format(1, 3)} + {IOU.format(2, 3)}) / 3, 6) AS mean_iou FROM h""")
def mask_agreement(spark, sf_dir):
    """Mean overlap of all pairs of three heat maps' hottest fifths."""
    h = _maps(spark, sf_dir).select("vec_id", *(M.hottest(F.col(f"m{k}"), 0.8).alias(f"h{k}") for k in (1, 2, 3)))
    pairs = [M.overlap(F.col(f"h{a}"), F.col(f"h{b}")) for a, b in ((1, 2), (1, 3), (2, 3))]
    return h.select("vec_id", (sum(pairs[1:], pairs[0]) / 3).alias("mean_iou"))


INNER = "list_sum([CASE WHEN (i - 1) // 8 BETWEEN 2 AND 5 AND (i - 1) % 8 BETWEEN 2 AND 5 THEN abs({0}[i]) ELSE 0 END FOR i IN range(1, 65)]) / nullif(list_sum([abs({0}[i]) FOR i IN range(1, 65)]), 0)"


@query(f"""WITH {EYES}, g AS (SELECT vec_id, {INNER.format('m1')} AS e1, list_sum([CASE WHEN (i - 1) // 8 BETWEEN 2 AND 5 AND (i - 1) % 8 BETWEEN 2 AND 5 THEN m1[i] * m1[i] ELSE 0 END FOR i IN range(1, 65)]) / nullif(list_sum([m1[i] * m1[i] FOR i IN range(1, 65)]), 0) AS e2,
  list_sum([CASE WHEN (i - 1) // 8 BETWEEN 2 AND 5 AND (i - 1) % 8 BETWEEN 2 AND 5 THEN greatest(m1[i], 0) ELSE 0 END FOR i IN range(1, 65)]) / nullif(list_sum([greatest(m1[i], 0) FOR i IN range(1, 65)]), 0) AS e3 FROM e)
 SELECT vec_id, (e1 < 0.25)::INT + (e2 < 0.25)::INT + coalesce((e3 < 0.25)::INT, 0) >= 2 AS background, round((e1 + e2 + coalesce(e3, 0)) / 3, 6) AS mean_energy FROM g""")
def background_flags(spark, sf_dir):
    """Images of which two of three readings have little energy at the centre, and the readings' mean energy."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("m"))
    readings = [F.transform("m", F.abs), F.transform("m", lambda x: x * x), F.transform("m", lambda x: F.greatest(x, F.lit(0.0)))]
    e = v.select("vec_id", F.array(*(M.centre_energy(r, 8, 2) for r in readings)).alias("e"))
    low = F.size(F.filter("e", lambda x: x < 0.25))
    return e.select("vec_id", (low >= 2).alias("background"), (F.aggregate("e", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) / 3).alias("mean_energy"))


@query(f"""WITH {EYES}, a AS (SELECT vec_id, [(m1[i] + m2[i] / 2 + m3[i]) / 3 FOR i IN range(1, 65)] AS c FROM e), s AS (SELECT vec_id, list_min(c) AS low, list_max(c) AS high, c FROM a)
 SELECT vec_id, round(CASE WHEN high - low < 1e-8 THEN 0 ELSE (list_avg(c) - low) / (high - low) END, 6) AS mean_level, CASE WHEN high - low < 1e-8 THEN 1 ELSE list_position(c, high) END::INT AS peak FROM s""")
def consensus_map(spark, sf_dir):
    """The mean of the valid heat maps, cell by cell, scaled to 0..1: its mean level and where it peaks."""
    maps = _maps(spark, sf_dir).select("vec_id", "m1", F.transform("m2", lambda x: x / 2).alias("m2"), "m3")
    out = maps.select("vec_id", M.min_max(M.mean_of([F.col("m1"), F.col("m2"), F.col("m3")])).alias("c"))
    return out.select("vec_id", (M.total(F.col("c")) / F.size("c")).alias("mean_level"), F.array_position("c", F.array_max("c")).cast("int").alias("peak"))


BLOCKS = [("stem", 3, 32, 3, 112), ("stage1", 32, 64, 3, 56), ("stage2", 64, 128, 3, 28), ("mix", 128, 128, 1, 28), ("head", 128, 10, 1, 1)]


@query("WITH b(name, cin, cout, k, side) AS (VALUES " + ", ".join(str(b) for b in BLOCKS) + ") SELECT coalesce(name, 'total') AS name, sum(cin * cout * k * k + cout)::BIGINT AS parameters, sum(cin * cout * k * k * side * side)::BIGINT AS multiplications FROM b GROUP BY ROLLUP (name)")
def block_costs(spark, sf_dir):
    """Parameters and multiplications of a list of convolutions, and their sums."""
    b = spark.createDataFrame(BLOCKS, "name string, cin long, cout long, k long, side long")
    weights = F.col("cin") * F.col("cout") * F.col("k") * F.col("k")
    out = b.rollup("name").agg(F.sum(weights + F.col("cout")).alias("parameters"), F.sum(weights * F.col("side") * F.col("side")).alias("multiplications"))
    return out.withColumn("name", F.coalesce("name", F.lit("total")))


@query("""WITH c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY 1),
 x AS (SELECT label, list_transform(embedding, lambda v: v::DOUBLE) AS v, c FROM embeddings JOIN c USING (label))
 SELECT label, count(*) AS n, round(avg(sqrt(list_inner_product(v, v) / len(v))), 6) AS rms, round(avg(list_inner_product(v, c) / nullif(sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(c, c)), 0)), 6) AS cosine FROM x GROUP BY 1""")
def vector_diagnostics(spark, sf_dir):
    """By class: the vectors' mean root mean square, and their mean cosine with the class's mean vector."""
    e = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    each = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    means = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))  # a vector's values
    size = lambda a: F.sqrt(V.dot(a, a))
    x = e.join(F.broadcast(means), "label")  # one row a class
    return x.groupBy("label").agg(F.count("*").alias("n"), F.avg(F.sqrt(V.dot(F.col("v"), F.col("v")) / F.size("v"))).alias("rms"), F.avg(F.try_divide(V.dot(F.col("v"), F.col("c")), size(F.col("v")) * size(F.col("c")))).alias("cosine"))


@query(f"WITH {PREDS}, t(arm, title) AS (VALUES ('A0', 'Baseline'), ('A1', 'Baseline, longer'), ('A2', 'Wide')) SELECT arm, coalesce(title, arm) AS title, round(avg((pred = target)::INT), 6) AS accuracy FROM preds LEFT JOIN t USING (arm) GROUP BY ALL")
def titled_summary(spark, sf_dir):
    """A summary with display names; what has none keeps its own."""
    s = predictions(spark, sf_dir).groupBy("arm").agg(F.avg((F.col("pred") == F.col("target")).cast("int")).alias("accuracy"))
    return s.join(_named(spark, TITLES, "arm", "title"), "arm", "left").select("arm", F.coalesce("title", "arm").alias("title"), "accuracy")


@query(f"WITH {PREDS}, f(arm, family) AS (VALUES ('A0', 'plain'), ('A1', 'plain'), ('A2', 'wide'), ('A3', 'wide')), m AS (SELECT arm, family, avg((pred = target)::INT) AS a FROM preds JOIN f USING (arm) GROUP BY ALL) SELECT x.family, x.arm AS arm_a, y.arm AS arm_b, round(y.a - x.a, 6) AS delta FROM m x JOIN m y ON x.family = y.family AND x.arm < y.arm")
def family_pairs(spark, sf_dir):
    """Unordered pairs of arms of one family."""
    m = predictions(spark, sf_dir).groupBy("arm").agg(F.avg((F.col("pred") == F.col("target")).cast("int")).alias("a")).join(_named(spark, FAMILY, "arm", "family"), "arm")
    x, y = m.select("family", F.col("arm").alias("arm_a"), F.col("a").alias("x")), m.select("family", F.col("arm").alias("arm_b"), F.col("a").alias("y"))
    return x.join(y, "family").filter("arm_a < arm_b").select("family", "arm_a", "arm_b", (F.col("y") - F.col("x")).alias("delta"))


@query(f"WITH {ASSETS} SELECT doc_id, class_name, row_number() OVER (PARTITION BY class_name ORDER BY doc_id) - 1 AS pos, dense_rank() OVER (PARTITION BY class_name ORDER BY canonical_id) - 1 AS root FROM assets WHERE split <> 'train' AND NOT is_derived")
def dense_positions(spark, sf_dir):
    """Rows that a filter left, numbered anew within their class, and their roots mapped to 0..k."""
    kept = assets(spark, sf_dir).filter("split <> 'train' and not is_derived").select("doc_id", "class_name", "canonical_id")
    placed = prefix.numbered(kept, ["class_name"], ["doc_id"], "pos")
    return prefix.dense_numbers(placed, ["class_name"], "canonical_id", "root").select("doc_id", "class_name", "pos", "root")


@query("SELECT epoch, round(least(1.0, epoch / 10.0), 6)::DOUBLE AS gate, round(CASE WHEN epoch <= 5 THEN 0.001 * epoch / 5 ELSE 1e-5 + 0.5 * (0.001 - 1e-5) * (1 + cos(pi() * (epoch - 5) / 45.0)) END, 10)::DOUBLE AS rate FROM (SELECT range AS epoch FROM range(1, 51))", digits=10)
def ramps(spark, sf_dir):
    """A gate that opens over ten epochs, and a warm-up followed by half a cosine."""
    e = spark.range(1, 51).withColumnRenamed("id", "epoch")
    return e.select("epoch", F.round(F.least(F.lit(1.0), F.col("epoch") / 10.0), 6).alias("gate"), V.warm_up_cosine(F.col("epoch"), 5, 50, 0.001, 1e-5).alias("rate"))


@query("SELECT doc_id, source FROM documents ORDER BY md5(doc_id::VARCHAR || 's11'), doc_id LIMIT 200")
def bounded_sample(spark, sf_dir):
    """At most 200 rows of the whole table by a seeded draw; the limit is the feature."""
    return summary.bounded_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 200, "s11")


SIDES = f"""{ASSETS}, l AS (SELECT DISTINCT canonical_id AS k FROM assets WHERE split = 'train'), r AS (SELECT DISTINCT canonical_id AS k FROM assets WHERE split <> 'train'), a AS (SELECT 'left_only' AS side, k FROM (FROM l EXCEPT FROM r) UNION ALL SELECT 'right_only', k FROM (FROM r EXCEPT FROM l))"""


@query(f"WITH {SIDES}, n AS (SELECT side, k, row_number() OVER (PARTITION BY side ORDER BY k) AS i FROM a) SELECT s.side, count(n.k) AS n, coalesce(string_agg(k, ',' ORDER BY i) FILTER (i <= 10), '') AS sample, (SELECT count(*) = 0 FROM a) AS equal FROM (VALUES ('left_only'), ('right_only')) s(side) LEFT JOIN n USING (side) GROUP BY 1")
def set_comparison(spark, sf_dir):
    """What each of two sets has alone, with the first ten names, and whether the sets are equal."""
    a = assets(spark, sf_dir)
    return contracts.compared_sets(a.filter("split = 'train'").select("canonical_id"), a.filter("split <> 'train'").select("canonical_id"), "canonical_id", 10)


@query(f"""WITH {ASSETS} SELECT doc_id, 'root/' || split || '/' || class_name || '/' || filename AS path, split || '/' || class_name || '/' || filename AS sample_id, trim(regexp_replace(lower(source || ' ' || filename), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
 regexp_replace(source || ': ' || filename, '[\\\\/:*?"<>| ]+', '_', 'g') AS safe_name, CASE class_name WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 ELSE -1 END AS class_idx FROM assets""")
def name_scalars(spark, sf_dir):
    """Sample ids from paths, slugs, file names without marks that file systems refuse, and class numbers."""
    a = assets(spark, sf_dir).withColumn("path", F.concat_ws("/", F.lit("root"), "split", "class_name", "filename"))
    number = F.array_position(F.array(*map(F.lit, ("de", "en", "es", "fr"))), F.col("class_name")).cast("int") - 1
    return a.select("doc_id", "path", K.relative_path(F.col("path"), "root").alias("sample_id"), K.slug(F.concat_ws(" ", "source", "filename")).alias("slug"), K.safe_filename(F.concat_ws(": ", "source", "filename")).alias("safe_name"), F.coalesce(number, F.lit(-1)).alias("class_idx"))


@query("""WITH c AS (SELECT o_orderkey AS run, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 END AS lr, CASE WHEN o_orderkey % 3 <> 2 THEN o_orderkey % 5 END AS learning_rate FROM orders)
 SELECT run, coalesce(lr, learning_rate, 9)::INT AS rate, CASE WHEN lr IS NOT NULL THEN 'lr' WHEN learning_rate IS NOT NULL THEN 'learning_rate' ELSE 'default' END AS read_from, '--rate ' || coalesce(lr, learning_rate, 9) || CASE WHEN run % 2 = 0 THEN ' --resume' ELSE '' END AS flags FROM c""")
def config_fallbacks(spark, sf_dir):
    """Settings read under their new or old name or by default, and as command-line flags: a true one stands alone, a
    false one is left out."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 7).alias("lr"), F.when(F.col("o_orderkey") % 3 != 2, F.col("o_orderkey") % 5).alias("learning_rate"))
    value, source = K.first_of({"lr": F.col("lr"), "learning_rate": F.col("learning_rate")}, F.lit(9))
    return o.select("run", value.cast("int").alias("rate"), source.alias("read_from"), K.flags({"rate": value, "resume": F.col("run") % 2 == 0}).alias("flags"))


@query(f"""WITH {PREDS}, d AS (SELECT arm, seed, min(p_true) AS field, CASE WHEN seed = 2026 AND arm = 'A1' THEN 'test' ELSE 'val' END AS split, NOT (arm = 'A2' AND seed = 42) AS before_training FROM preds GROUP BY arm, seed)
 SELECT arm, seed, concat_ws(',', CASE WHEN NOT before_training THEN 'not marked as before training' END, CASE WHEN split <> 'val' THEN 'split is ' || split END, CASE WHEN seed NOT IN (42, 1337, 2026) THEN 'unknown seed' END) AS problems FROM d WHERE NOT before_training OR split <> 'val'""")
def diagnostic_fields(spark, sf_dir):
    """Diagnostic rows that break a rule, with the rules they break; none should be left."""
    d = predictions(spark, sf_dir).groupBy("arm", "seed").agg(F.min("p_true").alias("field"))
    d = d.withColumns({"split": F.when((F.col("seed") == 2026) & (F.col("arm") == "A1"), "test").otherwise("val"), "before_training": ~((F.col("arm") == "A2") & (F.col("seed") == 42))})
    rules = [("not marked as before training", ~F.col("before_training")), (F.concat(F.lit("split is "), "split"), F.col("split") != "val"), ("unknown seed", ~F.col("seed").isin(42, 1337, 2026))]
    return contracts.violations(d, rules).select("arm", "seed", "problems")


@query(f"""WITH {AB}, k AS (SELECT seed, b_only, a_only, b_only > a_only AS said, (b_only - a_only) / sqrt(nullif(a_only + b_only, 0)) > 1.96 AS holds FROM t)
 SELECT seed, CASE WHEN said AND NOT coalesce(holds, FALSE) THEN 'claimed, not shown' ELSE 'shown, not claimed' END AS conflict FROM k WHERE said <> coalesce(holds, FALSE)""")
def caption_guards(spark, sf_dir):
    """Runs whose caption would be false: it says that one arm is better, and the discordant counts don't bear it out."""
    t = inference.contingency(_ab(spark, sf_dir), ["seed"])
    holds = F.coalesce(F.try_divide(F.col("b_only") - F.col("a_only"), F.sqrt((F.col("a_only") + F.col("b_only")).cast("double"))) > 1.96, F.lit(False))
    return contracts.false_claims(t.withColumns({"said": F.col("b_only") > F.col("a_only"), "holds": holds}), "said", "holds").select("seed", "conflict")


@query("""WITH c AS (SELECT o_orderkey AS run, o_orderpriority AS a, CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 'other' ELSE o_orderpriority END AS b FROM orders)
 SELECT run, CASE WHEN b IS NULL THEN 'missing' ELSE 'changed' END AS problem FROM c WHERE a IS DISTINCT FROM b""")
def resumed_settings(spark, sf_dir):
    """Runs whose settings at resume differ from those they began with."""
    o = table(spark, sf_dir, "orders")
    began = o.select(F.col("o_orderkey").alias("run"), F.to_json(F.struct(F.col("o_orderpriority").alias("priority"))).alias("config"))
    later = F.when(F.col("o_orderkey") % 97 == 0, None).when(F.col("o_orderkey") % 89 == 0, "other").otherwise(F.col("o_orderpriority"))
    now = o.select(F.col("o_orderkey").alias("run"), F.when(later.isNotNull(), F.to_json(F.struct(later.alias("priority")))).alias("config"))
    return contracts.changed_settings(began, now, "run", "config")


@query(f"""WITH {ASSETS}, {VECTORS.strip()}, near AS (SELECT count(*) AS n FROM pairs WHERE cosine >= 0.3 AND hamming <= 24 AND split_i <> split_j), ev AS (SELECT * FROM assets WHERE split <> 'train')
 SELECT 'exact' AS "check", count(*) AS n FROM assets WHERE split = 'train' AND md5 IN (SELECT md5 FROM ev) UNION ALL SELECT 'family', count(*) FROM assets WHERE split = 'train' AND (class_name, canonical_id) IN (SELECT (class_name, canonical_id) FROM ev)
 UNION ALL SELECT 'derivative_in_evaluation', count(*) FROM ev WHERE is_derived UNION ALL SELECT 'near_duplicate', n FROM near""")
def four_checks(spark, sf_dir):
    """The audit with its fourth leg: near-duplicate pairs across splits."""
    from quillon.operators import audit

    near = _pairs(spark, sf_dir).filter("cosine >= 0.3 and hamming <= 24 and split_i <> split_j").agg(F.count("*").alias("n"))
    return audit.audit(assets(spark, sf_dir)).select("check", F.col("n_rows").alias("n")).unionByName(near.select(F.lit("near_duplicate").alias("check"), "n"))


@query(f"""WITH {PREDS}, s AS (SELECT a.seed, avg((a.pred = a.target)::INT) - avg((b.pred = b.target)::INT) AS d FROM preds a JOIN preds b ON a.seed = b.seed AND a.image_id = b.image_id AND a.arm = 'A1' AND b.arm = 'A3' GROUP BY 1)
 SELECT count(*) AS n, round(avg(d), 6) AS d_mean, round(stddev_samp(d), 6) AS d_std, count(*) FILTER (d > 0) AS n_above, sum((d > 0.02)::INT)::BIGINT AS n_clear FROM s""")
def delta_summary(spark, sf_dir):
    """How the differences of two arms spread over seeds."""
    p = predictions(spark, sf_dir)
    acc = lambda arm, c: p.filter(F.col("arm") == arm).groupBy("seed").agg(F.avg((F.col("pred") == F.col("target")).cast("int")).alias(c))
    d = acc("A1", "x").join(acc("A3", "y"), "seed").select((F.col("x") - F.col("y")).alias("d"))
    return d.agg(F.count("*").alias("n"), F.avg("d").alias("d_mean"), F.stddev_samp("d").alias("d_std"), F.count_if(F.col("d") > 0).alias("n_above"), F.sum((F.col("d") > 0.02).cast("long")).alias("n_clear"))


@query("""WITH p AS (SELECT vec_id, label, abs(embedding[1])::DOUBLE * 4 AS r, abs(embedding[2])::DOUBLE * 4 AS g, abs(embedding[3])::DOUBLE * 4 AS b FROM embeddings), t AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM p),
 h AS (SELECT *, mx - mn AS d, CASE WHEN mx - mn < 1e-10 THEN 0 WHEN mx = r THEN (g - b) / (mx - mn + 1e-10) WHEN mx = g THEN (b - r) / (mx - mn + 1e-10) + 2 ELSE (r - g) / (mx - mn + 1e-10) + 4 END / 6 AS h0 FROM t),
 f AS (SELECT *, h0 - floor(h0) AS h, CASE WHEN mx > 0 THEN d / (mx + 1e-10) ELSE 0 END AS s FROM h)
 SELECT label, round(avg(sin(2 * pi() * h)), 6) AS sin_hue, round(avg(cos(2 * pi() * h)), 6) AS cos_hue, round(avg((s - 0.5) / 0.25), 6) AS s_norm, round(avg((mx - 0.5) / 0.25), 6) AS v_norm, round(degrees(atan2(avg(sin(2 * pi() * h)), avg(cos(2 * pi() * h)))), 4) AS signed_hue FROM f GROUP BY 1""", digits=6)
def hue_channels(spark, sf_dir):
    """Hue as sine and cosine, normalised saturation and value, and the circular mean hue in signed degrees."""
    size = lambda k: F.abs(F.col("embedding")[k].cast("double")) * 4
    h, s, v = V.hsv(size(0), size(1), size(2))
    e = table(spark, sf_dir, "embeddings").select("label", (2 * F.pi() * h).alias("h"), s.alias("s"), v.alias("v"))
    norm = lambda c: F.avg((F.col(c) - 0.5) / 0.25)
    out = e.groupBy("label").agg(F.avg(F.sin("h")).alias("sin_hue"), F.avg(F.cos("h")).alias("cos_hue"), norm("s").alias("s_norm"), norm("v").alias("v_norm"))
    return out.withColumn("signed_hue", F.round(F.degrees(F.atan2("sin_hue", "cos_hue")), 4))


@query(f"WITH {VECTORS} SELECT i, j, hamming, round(cosine, 6) AS cosine FROM pairs WHERE hamming <= 9")
def close_words(spark, sf_dir):
    """Pairs by their words alone, at a distance that the bands answer."""
    from quillon.operators import pairs

    return pairs.near_pairs(vectors(spark, sf_dir), 9, None, "hash").select("i", "j", "hamming", "cosine")


@query(None)
def paired_bootstrap(spark, sf_dir):
    """Macro-F1 difference of two arms over 10,000 paired resamples a seed; the tests hold it against plain resampling."""
    p = predictions(spark, sf_dir)
    one = lambda arm, c: p.filter(F.col("arm") == arm).select("seed", "image_id", "target", F.col("pred").alias(c))
    return inference.paired_bootstrap(one("A0", "a").join(one("A3", "b"), ["seed", "image_id", "target"]), "seed", CLASSES, 10_000, "macro_f1")


@query(None)
def bootstrap_auc_in_full(spark, sf_dir):
    """AUC with the interval of 2,000 resamples; replicates that lack a class are left out."""
    p = predictions(spark, sf_dir).filter(F.col("arm") == list(ARMS)[-1]).withColumn("ok", F.col("pred") == F.col("target"))
    return inference.poisson_bootstrap_auc(p, ["seed"], "p_true", "ok", 2_000)


@query(None)
def power_in_full(spark, sf_dir):
    """What the evaluation set can resolve: macro-F1 of every pair of arms over 2,000 resamples, and go or no-go."""
    return inference.power_in_full(predictions(spark, sf_dir).filter("seed = 42"), "arm", "image_id", CLASSES, 2_000)


@query(f"""WITH {PREDS}, d AS (SELECT a.arm, a.seed, avg((a.pred = a.target)::INT - (b.pred = b.target)::INT) AS m, stddev_samp((a.pred = a.target)::INT - (b.pred = b.target)::INT) / sqrt(count(*)) AS se FROM preds a JOIN preds b ON a.seed = b.seed AND a.image_id = b.image_id AND b.arm = 'A2' WHERE a.arm <> 'A2' GROUP BY ALL),
 f AS (SELECT arm, count(*) AS n_seeds, count(*) FILTER (m - 1.959964 * se > 0) AS n_favoured FROM d GROUP BY 1), acc AS (SELECT arm, avg((pred = target)::INT) AS m FROM preds GROUP BY 1)
 SELECT f.*, n_favoured >= 2 AS improves, round(acc.m, 6) AS mean, round(c.m, 6) AS control_mean, CASE WHEN n_favoured >= 2 AND acc.m >= c.m THEN 'A' ELSE 'B' END AS framing FROM f JOIN acc USING (arm) JOIN acc c ON c.arm = 'A1'""")
def framing_decision(spark, sf_dir):
    """Which arms may be said to improve on one arm, and the framing that this and a control arm decide; intervals are
    normal ones of the accuracy's difference, so that SQL can say them."""
    p = predictions(spark, sf_dir).withColumn("hit", (F.col("pred") == F.col("target")).cast("int"))
    base = p.filter("arm = 'A2'").select("seed", "image_id", F.col("hit").alias("_b"))
    d = p.filter("arm != 'A2'").join(base, ["seed", "image_id"]).groupBy("arm", "seed").agg((F.avg(F.col("hit") - F.col("_b")) - 1.959964 * F.stddev_samp(F.col("hit") - F.col("_b")) / F.sqrt(F.count("*"))).alias("ci_low"))
    means = p.groupBy("arm").agg(F.avg("hit").alias("accuracy"))
    return inference.framing(inference.favoured(d, "arm", "ci_low"), means, "arm", "accuracy", "A1")


@query("""WITH g AS (SELECT l_suppkey % 40 AS grp, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), f AS (SELECT grp, count(*) FILTER (x BETWEEN 5 AND 45) AS n_inner, count(*) AS n, regr_slope(y, x) FILTER (x BETWEEN 5 AND 45) AS gi, regr_slope(y, x) AS ga, regr_intercept(y, x) FILTER (x BETWEEN 5 AND 45) AS si, regr_intercept(y, x) AS sa FROM g GROUP BY 1)
 SELECT grp, round(CASE WHEN n_inner >= 500 THEN gi ELSE ga END, 6) AS gain, round(CASE WHEN n_inner >= 500 THEN si ELSE sa END, 6) AS shift, n_inner, n FROM f""")
def clipped_fit(spark, sf_dir):
    """A linear fit without the clipped ends, or of all points where fewer than 500 are left."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("grp"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return inference.clipped_fit(rows, ["grp"], "x", "y", 5, 45)


@query("""WITH c AS (SELECT o_orderkey AS run, printf('%.0e', ((o_orderkey % 9 + 1) / pow(10, o_orderkey % 5 + 1))::DOUBLE) AS e, CASE o_orderkey % 4 WHEN 0 THEN 'Ambiguous' WHEN 1 THEN 'Blight' WHEN 2 THEN '' END AS verdict FROM orders)
 SELECT run, '$' || split_part(e, 'e', 1) || '\\times10^{' || split_part(e, 'e', 2)::INT || '}$' AS rate, CASE WHEN verdict = 'Ambiguous' THEN 'Ambiguous' WHEN verdict <> '' THEN 'Suspected mislabel' ELSE '--' END AS note FROM c""")
def report_cells(spark, sf_dir):
    """Learning rates as mantissa and power of ten, and review verdicts as notes."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("run"), F.format_string("%.0e", (k % 9 + 1) / F.pow(F.lit(10.0), k % 5 + 1)).alias("e"), F.when(k % 4 == 0, "Ambiguous").when(k % 4 == 1, "Blight").when(k % 4 == 2, "").alias("verdict"))
    return o.select("run", K.power_of_ten(F.col("e")).alias("rate"), K.review_note(F.col("verdict")).alias("note"))


@query(f"""WITH {PREDS}, t AS (SELECT arm, seed, image_id, CASE WHEN arm = 'A2' AND seed = 1337 AND image_id = 3 THEN -1 ELSE target END AS target FROM preds),
 d AS (SELECT arm, seed, count(*) AS n, sum(('0x' || substr(md5(image_id || '|' || target), 1, 8))::BIGINT)::BIGINT AS low, sum(('0x' || substr(md5(image_id || '|' || target), 9, 8))::BIGINT)::BIGINT AS high FROM t GROUP BY ALL)
 SELECT *, (n, low, high) = (SELECT (n, low, high) FROM d ORDER BY arm, seed LIMIT 1) AS agrees FROM d""")
def runs_share_items(spark, sf_dir):
    """Whether every run holds the items and targets of the first one, by sums of hashes; one target is made to differ."""
    p = predictions(spark, sf_dir).withColumn("target", F.when((F.col("arm") == "A2") & (F.col("seed") == 1337) & (F.col("image_id") == 3), -1).otherwise(F.col("target")))
    return contracts.shared_items(p, ["arm", "seed"], ["image_id", "target"])


@query(f"""WITH {VECTORS}, p AS (SELECT * FROM pairs WHERE cosine >= 0.2), b AS (SELECT i, j, split_i, split_j, hamming FROM p UNION ALL SELECT j, i, split_j, split_i, hamming FROM p),
 one AS (SELECT i AS id, min((CASE split_i WHEN 'test' THEN 0 ELSE 1 END, hamming, j)) AS m FROM b WHERE split_i <> 'train' AND split_j = 'train' GROUP BY 1) SELECT id, m[3] AS partner, m[1] AS severity FROM one""")
def prune_keeping_val_test(spark, sf_dir):
    """The prune with pairs of validation and test rows let be."""
    return pairs.prune(_pairs(spark, sf_dir), keep_val_test=True)


#: A later state of the orders: some have another price, some are gone, some are there twice.
LATER = """l AS (SELECT * REPLACE (CASE WHEN o_orderkey % 997 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE o_orderkey % 1009 <> 5
  UNION ALL SELECT * FROM orders WHERE o_orderkey % 1013 = 7 AND o_orderkey % 997 <> 3 AND o_orderkey % 1009 <> 5)"""


def _later(orders):
    edited = orders.filter("o_orderkey % 1009 != 5").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 997 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return edited.unionByName(orders.filter("o_orderkey % 1013 = 7 and o_orderkey % 997 != 3 and o_orderkey % 1009 != 5"))


@query(f"""WITH {LATER}, x AS (SELECT 'left' AS side, * FROM (SELECT * FROM orders EXCEPT ALL SELECT * FROM l) UNION ALL SELECT 'right', * FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM orders))
 SELECT side, o_orderpriority, o_orderkey, count(*) AS n FROM x GROUP BY ALL""")
def changed_rows(spark, sf_dir):
    """Rows that two states of a table don't share, found from the roots of their hash trees down."""
    orders = table(spark, sf_dir, "orders")
    return merkle.changed_rows(orders, _later(orders), ["o_orderpriority"], ["o_orderkey"], 64).select("side", "o_orderpriority", "o_orderkey", "n")


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def table_roots(spark, sf_dir):
    """Rows of each priority's hash tree; the digest itself is left out, as it follows from Spark's JSON."""
    return merkle.tree(table(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_orderkey"], 64).roots().select("o_orderpriority", "n")
