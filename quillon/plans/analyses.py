"""More registered queries: comparisons of runs, components, heat maps, completeness checks and report texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import keys as K
from quillon.functions import masks as M
from quillon.functions import vectors as V
from quillon.operators import graph, inference, metrics, pairs, pixels, prefix, probe
from quillon.plans.catalog import AB, ASSETS, CELLS, PIXELS, PREDS, VECTORS, _ab, _epochs, _pairs, query
from quillon.sources import sinks
from quillon.sources.tables import ARMS, CLASSES, SEEDS, assets, predictions, table, vectors


@query(f"""WITH RECURSIVE {ASSETS}, links AS (SELECT doc_id AS i, min(doc_id) OVER (PARTITION BY md5) AS j FROM assets UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY class_name, canonical_id) FROM assets),
 e AS (SELECT i, j FROM links WHERE i <> j UNION SELECT j, i FROM links WHERE i <> j), r AS (SELECT doc_id AS id, doc_id AS seen FROM assets UNION SELECT r.id, e.j FROM r JOIN e ON e.i = r.seen),
 c AS (SELECT id AS doc_id, min(seen) AS component FROM r GROUP BY 1) SELECT doc_id, component, count(*) OVER (PARTITION BY component) AS size FROM c""")
def leak_components(spark, sf_dir):
    """Assets linked by equal content or family, with their component's size."""
    a = assets(spark, sf_dir)
    found = graph.components(graph.star_edges(a, "doc_id", ["md5"]).unionByName(graph.star_edges(a, "doc_id", ["class_name", "canonical_id"])), "i", "j")
    all_ids = a.select("doc_id").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    return all_ids.join(all_ids.groupBy("component").agg(F.count("*").alias("size")), "component")


@query(f"WITH {VECTORS} SELECT CASE WHEN hamming <= 15 THEN '0-15' WHEN hamming <= 25 THEN '16-25' WHEN hamming <= 30 THEN '26-30' ELSE 'over 30' END AS band, count(*) AS n_pairs, count(*) FILTER (split_i <> split_j) AS n_cross FROM pairs WHERE cosine >= 0.2 GROUP BY 1")
def pair_bands(spark, sf_dir):
    return pairs.bands(_pairs(spark, sf_dir), [15, 25, 30])


@query(f"WITH {VECTORS} SELECT a.id AS i, b.id AS j, a.class_name AS class_i, b.class_name AS class_j, round(list_dot_product(a.vector::DOUBLE[], b.vector::DOUBLE[]), 6) AS cosine FROM v a JOIN v b ON a.id < b.id AND a.class_name <> b.class_name WHERE list_dot_product(a.vector::DOUBLE[], b.vector::DOUBLE[]) >= 0.3 ORDER BY 1, 2 LIMIT 500")
def cross_class_screen(spark, sf_dir):
    return pairs.across_classes(vectors(spark, sf_dir), 0.3, 500)


@query(f"WITH {PREDS}, a AS (SELECT image_id, target FROM preds WHERE arm = 'A0' AND seed = 42), b AS (SELECT image_id, CASE WHEN image_id % 17 = 0 THEN target + 1 ELSE target END AS target FROM preds WHERE arm = 'A1' AND seed = 42 AND image_id % 13 <> 0) SELECT count(*) FILTER (b.image_id IS NULL) AS n_left_only, count(*) FILTER (a.image_id IS NULL) AS n_right_only, count(*) FILTER (a.image_id = b.image_id) AS n_both, count(*) FILTER (a.image_id = b.image_id AND a.target IS DISTINCT FROM b.target) AS n_label_mismatch FROM a FULL JOIN b ON a.image_id = b.image_id")
def run_alignment(spark, sf_dir):
    """Two runs, of which the second lacks some items and has some other labels."""
    p = predictions(spark, sf_dir).filter("seed = 42")
    b = p.filter("arm = 'A1' and image_id % 13 != 0").withColumn("target", F.when(F.col("image_id") % 17 == 0, F.col("target") + 1).otherwise(F.col("target")))
    return inference.alignment(p.filter("arm = 'A0'"), b, "image_id", "target")


@query(f"WITH {PREDS} SELECT arm, image_id FROM preds GROUP BY ALL HAVING count(DISTINCT seed) FILTER (pred <> target) = 3")
def wrong_in_all_seeds(spark, sf_dir):
    wrong = predictions(spark, sf_dir).filter("pred != target")
    return wrong.groupBy("arm", "image_id").agg(F.count_distinct("seed").alias("n")).filter(F.col("n") == len(SEEDS)).drop("n")


PAIR = """pc2 AS (SELECT arm, seed, count(*) FILTER (target = 0 AND pred = 1) AS a_to_b, count(*) FILTER (target = 1 AND pred = 0) AS b_to_a, round(avg((pred = 0)::INT) FILTER (target = 0), 6) AS recall_a, round(avg((pred = 1)::INT) FILTER (target = 1), 6) AS recall_b FROM preds GROUP BY ALL)"""


@query(f"WITH {PREDS}, {PAIR} SELECT x.*, x.a_to_b + x.b_to_a - y.a_to_b - y.b_to_a AS delta FROM pc2 x JOIN pc2 y ON x.seed = y.seed AND y.arm = 'A0'")
def pair_confusion(spark, sf_dir):
    """Confusions of two classes by arm, against the baseline arm of the same seed."""
    t, p = F.col("target"), F.col("pred")
    c = predictions(spark, sf_dir).groupBy("arm", "seed").agg(F.count_if((t == 0) & (p == 1)).alias("a_to_b"), F.count_if((t == 1) & (p == 0)).alias("b_to_a"), F.avg(F.when(t == 0, (p == 0).cast("int"))).alias("recall_a"), F.avg(F.when(t == 1, (p == 1).cast("int"))).alias("recall_b"))
    base = c.filter("arm = 'A0'").select("seed", (F.col("a_to_b") + F.col("b_to_a")).alias("base"))
    return c.join(base, "seed").withColumn("delta", F.col("a_to_b") + F.col("b_to_a") - F.col("base")).drop("base")


ACC = f"WITH {PREDS}, acc AS (SELECT arm, seed, avg((pred = target)::INT) AS acc FROM preds GROUP BY ALL)"


def _acc(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("arm", "seed").agg(F.avg((F.col("pred") == F.col("target")).cast("int")).alias("acc"))


@query(ACC + " SELECT a.arm AS arm_a, b.arm AS arm_b, count(*) AS n_seeds, round(avg(a.acc - b.acc), 6) AS delta FROM acc a JOIN acc b ON a.seed = b.seed AND a.arm < b.arm GROUP BY ALL")
def arm_pairs(spark, sf_dir):
    """Unordered pairs of arms over their shared seeds."""
    a = _acc(spark, sf_dir)
    met = a.select("seed", F.col("arm").alias("arm_a"), F.col("acc").alias("x")).join(a.select("seed", F.col("arm").alias("arm_b"), F.col("acc").alias("y")), "seed").filter("arm_a < arm_b")
    return met.groupBy("arm_a", "arm_b").agg(F.count("*").alias("n_seeds"), F.avg(F.col("x") - F.col("y")).alias("delta"))


@query(ACC + ", d AS (SELECT a.arm, a.acc, a.acc - b.acc AS d FROM acc a JOIN acc b ON a.seed = b.seed AND b.arm = 'A3' AND a.arm <> 'A3') SELECT arm, count(*) FILTER (d > 0) AS n_better, round(avg(d), 6) AS mean_delta, count(*) FILTER (d > 0) >= 2 AND avg(d) >= 0.05 AS favoured FROM d GROUP BY 1")
def decision_rule(spark, sf_dir):
    """An arm is favoured if it beats the reference arm on two seeds or more and by enough on average."""
    a = _acc(spark, sf_dir)
    d = a.filter("arm != 'A3'").join(a.filter("arm = 'A3'").select("seed", F.col("acc").alias("base")), "seed").withColumn("d", F.col("acc") - F.col("base"))
    return d.groupBy("arm").agg(F.count_if(F.col("d") > 0).alias("n_better"), F.avg("d").alias("mean_delta")).withColumn("favoured", (F.col("n_better") >= 2) & (F.col("mean_delta") >= 0.05))


@query(f"""WITH {AB}, lf AS (SELECT *, both_ AS a, a_only AS b, b_only AS c, neither AS d FROM (SELECT seed, "both" AS both_, a_only, b_only, neither FROM t)),
 g AS (SELECT *, [lgamma(a+b+1) - lgamma(k+1) - lgamma(a+b-k+1) + lgamma(c+d+1) - lgamma(a+c-k+1) - lgamma(d-a+k+1) - lgamma(a+b+c+d+1) + lgamma(a+c+1) + lgamma(b+d+1) FOR k IN range(greatest(0, a-d), least(a+b, a+c) + 1)] AS logs,
  lgamma(a+b+1) - lgamma(a+1) - lgamma(b+1) + lgamma(c+d+1) - lgamma(c+1) - lgamma(d+1) - lgamma(a+b+c+d+1) + lgamma(a+c+1) + lgamma(b+d+1) AS seen FROM lf)
 SELECT seed, round(least(1.0, list_sum([exp(x) FOR x IN logs IF x <= seen + 1e-7])), 6) AS fisher_p FROM g""")
def fisher_exact(spark, sf_dir):
    return inference.fisher_exact(inference.contingency(_ab(spark, sf_dir), ["seed"]), ("both", "a_only", "b_only", "neither")).select("seed", "fisher_p")


@query(f"""WITH {PREDS}, r AS (SELECT arm, seed, pred = target AS ok, rank() OVER (PARTITION BY arm, seed ORDER BY p_true) + (count(*) OVER (PARTITION BY arm, seed, p_true) - 1) / 2.0 AS rk FROM preds),
 tt AS (SELECT arm, seed, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT arm, seed, count(*) AS c FROM preds GROUP BY arm, seed, p_true) GROUP BY ALL),
 s AS (SELECT arm, seed, sum(rk) FILTER (ok)::DOUBLE AS r, count(*) FILTER (ok)::DOUBLE AS a, count(*)::DOUBLE AS n FROM r GROUP BY ALL), u AS (SELECT *, r - a * (a + 1) / 2 AS u, a * (n - a) / 2 AS mid, sqrt(a * (n - a) / 12 * (n + 1 - ties / (n * (n - 1)))) AS sd FROM s JOIN tt USING (arm, seed))
 SELECT arm, seed, round(u, 6) AS u, round(CASE WHEN sd > 0 THEN greatest(0, (abs(u - mid) - 0.5) / sd) END, 6) AS z FROM u""")
def mann_whitney(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("ok", F.col("pred") == F.col("target"))
    return inference.mann_whitney(p, ["arm", "seed"], "p_true", "ok").drop("p_value")


@query(f"""WITH {PREDS}, k AS (SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY image_id) - 1 AS k, p_true, pred = target AS ok FROM preds WHERE arm = 'A3'), s AS (SELECT seed, count(*) AS n FROM k GROUP BY 1),
 dr AS (SELECT s.seed, rep, ('0x' || substr(md5(rep::VARCHAR || '|' || pos::VARCHAR), 1, 8))::BIGINT % s.n AS k FROM s, (SELECT range AS rep FROM range(0, 2000)), (SELECT range AS pos FROM range(0, (SELECT max(n) FROM s))) WHERE pos < s.n),
 x AS (SELECT dr.seed, rep, p_true, ok FROM dr JOIN k ON k.seed = dr.seed AND k.k = dr.k UNION ALL SELECT seed, -1, p_true, ok FROM k),
 rk AS (SELECT seed, rep, ok, rank() OVER (PARTITION BY seed, rep ORDER BY p_true) + (count(*) OVER (PARTITION BY seed, rep, p_true) - 1) / 2.0 AS rk FROM x),
 au AS (SELECT seed, rep, ((sum(rk) FILTER (ok) - count(*) FILTER (ok) * (count(*) FILTER (ok) + 1) / 2.0) / nullif(count(*) FILTER (ok) * count(*) FILTER (NOT ok), 0))::DOUBLE AS auc FROM rk GROUP BY ALL)
 SELECT seed, round(max(auc) FILTER (rep = -1), 6) AS auc, round(quantile_cont(auc, 0.025) FILTER (rep >= 0), 6) AS ci_low, round(quantile_cont(auc, 0.975) FILTER (rep >= 0), 6) AS ci_high, count(auc) FILTER (rep >= 0) AS n_used FROM au GROUP BY seed""")
def bootstrap_auc(spark, sf_dir):
    """AUC with the interval of 2,000 resamples, as the reference has them."""
    p = predictions(spark, sf_dir).filter("arm = 'A3'").withColumn("ok", F.col("pred") == F.col("target"))
    p = prefix.numbered(p, ["seed"], ["image_id"], "k")
    return inference.bootstrap_auc(p, ["seed"], "k", "p_true", "ok", 2_000)


@query(f"WITH {PREDS}, two AS (SELECT a.arm, a.pred AS old, b.pred AS new, abs(2 * a.p_true - 1) AS margin FROM preds a JOIN preds b ON a.arm = b.arm AND a.image_id = b.image_id AND a.seed = 42 AND b.seed = 1337), f AS (SELECT arm, count(*) FILTER (old <> new) AS n_flips, max(margin) FILTER (old <> new) AS m FROM two GROUP BY 1) SELECT arm, n_flips, round(m, 6) AS flip_margin, CASE WHEN n_flips = 0 THEN 'exact' WHEN n_flips <= 2 AND m <= 1e-3 THEN 'within' ELSE 'failed' END AS verdict FROM f")
def score_reproduction(spark, sf_dir):
    p = predictions(spark, sf_dir)
    old, new = p.filter("seed = 42"), p.filter("seed = 1337").select("arm", "image_id", F.col("pred").alias("new"))
    return inference.reproduction(old.withColumn("margin", F.abs(2 * F.col("p_true") - 1)).join(new, ["arm", "image_id"]), ["arm"], "pred", "new", "margin")


@query("SELECT range::INTEGER AS class_idx, round(coalesce(avg(l_quantity), 0), 6)::DOUBLE AS mean, round(coalesce(stddev_pop(l_quantity), 0), 6)::DOUBLE AS std, count(l_quantity) AS n FROM range(0, 10) LEFT JOIN lineitem ON l_linenumber = range GROUP BY 1")
def gate_statistics(spark, sf_dir):
    """Mean, population deviation and count of every class; an empty class gives zeros."""
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("class_idx")).agg(F.avg("l_quantity").alias("mean"), F.stddev_pop("l_quantity").alias("std"), F.count("l_quantity").alias("n"))
    return spark.range(10).select(F.col("id").cast("int").alias("class_idx")).join(found, "class_idx", "left").na.fill(0, ["mean", "std", "n"])


@query("WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT source, n, round(max(n) OVER () / n::DOUBLE, 6) AS ratio, n < (SELECT median(n) FROM c) / 2 AS below_half, n < 10 AS scarce FROM c")
def imbalance(spark, sf_dir):
    c = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    whole = c.agg(F.max("n").alias("top"), F.percentile("n", 0.5).alias("mid"))  # one row
    return c.crossJoin(F.broadcast(whole)).select("source", "n", (F.col("top") / F.col("n")).alias("ratio"), (F.col("n") < F.col("mid") / 2).alias("below_half"), (F.col("n") < 10).alias("scarce"))


@query("WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL) SELECT l_orderkey, count(*) AS n_conditions, sum(c)::BIGINT AS n_rows, count(*) = 7 AS complete, max(c) > 1 AS repeated FROM k GROUP BY 1")
def condition_completeness(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("c"))
    return keys.groupBy("l_orderkey").agg(F.count("*").alias("n_conditions"), F.sum("c").alias("n_rows"), (F.count("*") == 7).alias("complete"), (F.max("c") > 1).alias("repeated"))


@query("SELECT p_brand, count(*) AS n, min(p_size) = max(p_size) AS size_agrees, min(p_type) = max(p_type) AS type_agrees FROM part GROUP BY 1")
def family_settings(spark, sf_dir):
    same = lambda c: F.min(c) == F.max(c)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), same("p_size").alias("size_agrees"), same("p_type").alias("type_agrees"))


LOGITS = "l AS (SELECT vec_id, label, [exp(x::DOUBLE * 10) FOR x IN embedding] AS e FROM embeddings), p AS (SELECT vec_id, [x / list_sum(e) FOR x IN e] AS p, label + 1 AS k FROM l)"


@query(f"WITH {LOGITS} SELECT vec_id, (list_position(p, list_max(p)) - 1)::INTEGER AS top, round(list_max(p) - list_reverse_sort(p)[2], 6) AS margin, round(list_sum([x * x FOR x IN p]), 6) AS collision, round(-ln(greatest(p[k], 1e-12)), 6) AS nll, round(-ln(0.8 * p[k] + 0.2 / 64), 6) AS mixed_nll FROM p")
def confidence_scores(spark, sf_dir):
    """Softmax of the vectors as logits: top class, margin, collision probability, and losses with and without a uniform share."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * 10).alias("v"))
    s = e.select("vec_id", "label", V.softmax(F.col("v")).alias("p"))
    own = F.element_at("p", (F.col("label") + 1).cast("int"))
    return s.select("vec_id", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("top"), V.top_margin(F.col("p")).alias("margin"), M.total(F.transform("p", lambda x: x * x)).alias("collision"), (-F.ln(F.greatest(own, F.lit(1e-12)))).alias("nll"), (-F.ln(0.8 * own + 0.2 / 64)).alias("mixed_nll"))


@query(f"WITH {PIXELS}, hh AS (SELECT vec_id % 11 AS grp, 2 * pi() * CASE WHEN h0 < 0 THEN h0 + 1 ELSE h0 END AS a FROM h), m2 AS (SELECT grp, avg(sin(a)) AS s, avg(cos(a)) AS c FROM hh GROUP BY 1) SELECT grp, round(CASE WHEN degrees(atan2(s, c)) < 0 THEN degrees(atan2(s, c)) + 360 ELSE degrees(atan2(s, c)) END, 4) AS hue, round(sqrt(s * s + c * c), 6) AS strength FROM m2")
def hue_means(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", *((F.col("vec_id") % n / float(n)).alias(c) for c, n in (("r", 7), ("g", 5), ("b", 3))))
    angle = 2 * F.pi() * V.hsv(F.col("r"), F.col("g"), F.col("b"))[0]
    m = e.groupBy((F.col("vec_id") % 11).alias("grp")).agg(F.avg(F.sin(angle)).alias("s"), F.avg(F.cos(angle)).alias("c"))
    return m.select("grp", F.round(V.circular_mean(F.col("s"), F.col("c")), 4).alias("hue"), F.hypot("s", "c").alias("strength"))


@query("WITH b AS (SELECT c_mktsegment, least(floor((c_acctbal + 1000) / 11000 * 18), 17)::INTEGER AS bin FROM customer WHERE c_acctbal BETWEEN -1000 AND 10000) SELECT c_mktsegment, bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY c_mktsegment), 6)::DOUBLE AS share FROM b GROUP BY 1, 2")
def fixed_histogram(spark, sf_dir):
    """Eighteen bins over a fixed range, the last one closed; values outside are left out."""
    c = table(spark, sf_dir, "customer").filter(F.col("c_acctbal").between(-1000, 10000))
    b = c.groupBy("c_mktsegment", F.least(F.floor((F.col("c_acctbal") + 1000) / 11000 * 18), F.lit(17)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return b.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("c_mktsegment")))


@query("""WITH e AS (SELECT vec_id, [abs(x)::DOUBLE FOR x IN embedding] AS h, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT vec_id, h, [i FOR i IN range(1, 65) IF h[i] >= list_aggregate(h, 'quantile_cont', 0.8)] AS a, [i FOR i IN range(1, 65) IF v[i] >= list_aggregate(v, 'quantile_cont', 0.8)] AS b FROM e)
 SELECT vec_id, len(a) AS n_hot, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS iou, round(list_sum([CASE WHEN (i // 8) BETWEEN 2 AND 5 AND i % 8 BETWEEN 2 AND 5 THEN h[i + 1] ELSE 0 END FOR i IN range(0, 64)]) / list_sum(h), 6) AS centre, round(list_avg([(x - list_min(h)) / (list_max(h) - list_min(h)) FOR x IN h]), 6) AS level FROM m""")
def heat_maps(spark, sf_dir):
    """Vectors read as 8x8 heat maps: the overlap of two top-fifth masks, centre energy, and mean scaled level."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("h"), F.col("embedding").alias("v"))
    e = e.select("vec_id", "h", M.hottest(F.col("h"), 0.8).alias("a"), M.hottest(F.col("v"), 0.8).alias("b"))
    return e.select("vec_id", F.size("a").cast("long").alias("n_hot"), M.overlap(F.col("a"), F.col("b")).alias("iou"), M.centre_energy(F.col("h"), 8, 2).alias("centre"), (M.total(M.min_max(F.col("h"))) / F.size("h")).alias("level"))


@query(f"WITH arms(arm, pos) AS (VALUES {', '.join(f'({a!r}, {k})' for k, a in enumerate(ARMS))}), seeds(seed) AS (VALUES {', '.join(f'({s})' for s in SEEDS)}) SELECT arm || '_s' || seed AS run, arm AS experiment, seed::VARCHAR AS seed, (CASE arm WHEN 'A2' THEN 0 WHEN 'A0' THEN 1 ELSE 10000 END)::INTEGER AS rank FROM arms, seeds")
def job_grid(spark, sf_dir):
    """Experiments by seeds, with names that parse back and a declared order; unknown ones come last."""
    grid = spark.createDataFrame([(f"{a}_s{s}",) for a in ARMS for s in SEEDS], "run string")
    experiment, seed = K.run_parts(F.col("run"))
    place = F.array_position(F.array(F.lit("A2"), F.lit("A0")), F.col("experiment")).cast("int")
    return grid.select("run", experiment.alias("experiment"), seed.alias("seed")).withColumn("rank", F.when(place > 0, place - 1).otherwise(10_000)).orderBy("rank", "experiment", "seed")


@query("WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value FROM events) SELECT user_id, epoch, round((epoch % 5 + 1) / sum(epoch % 5 + 1) OVER (PARTITION BY user_id, (epoch - 1) // 4), 6)::DOUBLE AS weight FROM e")
def accumulation_weights(spark, sf_dir):
    """A batch's share of its group of four, the last group shorter."""
    size = F.col("epoch") % 5 + 1
    return _epochs(spark, sf_dir).select("user_id", "epoch", (size / F.sum(size).over(Window.partitionBy("user_id", F.floor((F.col("epoch") - 1) / 4)))).alias("weight"))


@query(f"WITH {ASSETS} SELECT doc_id, ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT AS noise_seed FROM (SELECT doc_id, sha256(class_name || '/' || filename || '|noise') AS h FROM assets)")
def noise_seeds(spark, sf_dir):
    key = F.concat(F.concat_ws("/", "class_name", "filename"), F.lit("|noise"))
    turned = F.concat(*(F.substring(F.sha2(key, 256), k, 2) for k in (7, 5, 3, 1)))  # the first four bytes, least first
    return assets(spark, sf_dir).select("doc_id", F.conv(turned, 16, 10).cast("long").alias("noise_seed"))


@query(f"""WITH {ASSETS}, tr AS (SELECT DISTINCT canonical_id FROM assets WHERE split = 'train'), va AS (SELECT DISTINCT canonical_id FROM assets WHERE split = 'val')
 SELECT 'both' AS op, * FROM (FROM tr INTERSECT FROM va) UNION ALL SELECT 'train_only', * FROM (FROM tr EXCEPT FROM va) UNION ALL SELECT 'val_only', * FROM (FROM va EXCEPT FROM tr) UNION ALL SELECT 'any', * FROM (FROM tr UNION FROM va)""")
def split_sets(spark, sf_dir):
    a = assets(spark, sf_dir)
    tr, va = (a.filter(F.col("split") == s).select("canonical_id") for s in ("train", "val"))
    named = lambda name, d: d.select(F.lit(name).alias("op"), "canonical_id")
    return named("both", tr.intersect(va)).unionByName(named("train_only", tr.subtract(va))).unionByName(named("val_only", va.subtract(tr))).unionByName(named("any", tr.union(va).distinct()))


@query(f"WITH {VECTORS} SELECT i, j, printf('near-duplicate of %s image %d (Hamming %d, cosine %.3f)', split_j, j, hamming, cosine) AS reason FROM pairs WHERE cosine >= 0.2 AND hamming <= 25")
def reason_texts(spark, sf_dir):
    return _pairs(spark, sf_dir).filter("hamming <= 25").select("i", "j", F.format_string("near-duplicate of %s image %d (Hamming %d, cosine %.3f)", "split_j", "j", "hamming", "cosine").alias("reason"))


@query("SELECT p_partkey, replace(replace(replace(p_brand, '#', '\\#'), '_', '\\_'), '%', '\\%') || ' & ' || p_size || ' & ' || coalesce(nullif(p_size % 3, 0)::VARCHAR, '--') || ' \\\\' AS line FROM part")
def latex_lines(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("rest", F.nullif(F.col("p_size") % 3, F.lit(0)))
    return sinks.latex_rows(p, ["p_brand", "p_size", "rest"]).select("p_partkey", "line")


@query(f"WITH {CELLS}, auc AS (SELECT p.arm, p.seed, l.c, p.target = l.c AS y, CASE WHEN p.pred = l.c THEN p.p_true ELSE (1 - p.p_true) / 9 END AS s FROM preds p, lab l), r AS (SELECT *, rank() OVER (PARTITION BY arm, seed, c ORDER BY s) + (count(*) OVER (PARTITION BY arm, seed, c, s) - 1) / 2.0 AS rk FROM auc), a AS (SELECT arm, seed, c, ((sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / nullif(count(*) FILTER (y) * count(*) FILTER (NOT y), 0))::DOUBLE AS auc FROM r GROUP BY ALL) SELECT arm, seed, round(avg(auc), 6) AS macro_auc, count(auc) AS n_classes FROM a GROUP BY ALL")
def macro_auc(spark, sf_dir):
    """One-vs-rest AUC averaged over the classes that have one."""
    p = predictions(spark, sf_dir).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(CLASSES - 1))))
    p = p.withColumns({"y": F.col("target") == F.col("c"), "s": F.when(F.col("pred") == F.col("c"), F.col("p_true")).otherwise((1 - F.col("p_true")) / 9)})
    return metrics.binary_auc(p, ["arm", "seed", "c"], "s", "y").groupBy("arm", "seed").agg(F.avg("auc").alias("macro_auc"), F.count("auc").alias("n_classes"))


GRID = "px AS (SELECT vec_id AS image_id, (i // 8)::INTEGER AS y, (i % 8)::INTEGER AS x, least(abs(embedding[i + 1]::DOUBLE) * 4, 1) AS r, ((vec_id + i) % 5) / 5.0::DOUBLE AS g, ((vec_id * 3 + i) % 7) / 7.0::DOUBLE AS b FROM embeddings, (SELECT unnest(range(0, 64)) AS i))"
CLIP = "least(1.0, greatest(0.0, {}))"


def _grid(spark, sf_dir):
    """Vectors as 8x8 images: red from the values, green and blue from positions."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "v"))
    return e.select("image_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.least(F.abs(F.col("v").cast("double")) * 4, F.lit(1.0)).alias("r"), ((F.col("image_id") + F.col("i")) % 5 / 5.0).alias("g"), ((F.col("image_id") * 3 + F.col("i")) % 7 / 7.0).alias("b"))


def _clipped(name: str, r: str, g: str, b: str) -> str:
    return f"SELECT '{name}' AS perturbation, round(avg({CLIP.format(r)}), 6) AS r, round(avg({CLIP.format(g)}), 6) AS g, round(avg({CLIP.format(b)}), 6) AS b FROM px2"


_each_sql = lambda name, f: _clipped(name, *(f.replace("@", c) for c in "rgb"))
POINTWISE = [
    _each_sql("unperturbed", "@"), _each_sql("brightness_up", "@ + 0.2"), _each_sql("brightness_down", "@ - 0.2"), _each_sql("contrast_low", "(@ - mean) * 0.75 + mean"), _each_sql("contrast_high", "(@ - mean) * 1.25 + mean"),
    _each_sql("saturation_low", "grey + (@ - grey) * 0.5"), _each_sql("saturation_high", "grey + (@ - grey) * 1.5"), _each_sql("shadow_left", "@ * (1 - 0.35 * (1 - x / 7.0))"), _each_sql("shadow_right", "@ * (1 - 0.35 * x / 7.0)"),
    _clipped("wb_warm", "r * 1.12", "g * 1.03", "b * 0.9"), _clipped("wb_cool", "r * 0.9", "g * 1.02", "b * 1.12"),
]


@query(f"WITH {GRID}, px2 AS (SELECT *, avg((r + g + b) / 3) OVER (PARTITION BY image_id) AS mean, 0.299 * r + 0.587 * g + 0.114 * b AS grey FROM px) " + " UNION ALL ".join(POINTWISE))
def perturbed_colours(spark, sf_dir):
    """Mean channels under the corruptions that read a pixel alone."""
    names = ["unperturbed", "brightness_up", "brightness_down", "contrast_low", "contrast_high", "saturation_low", "saturation_high", "shadow_left", "shadow_right", "wb_warm", "wb_cool"]
    return pixels.perturbed(_grid(spark, sf_dir), names).groupBy("perturbation").agg(*(F.avg(c).alias(c) for c in pixels.RGB))


@query(None)
def perturbed_neighbourhoods(spark, sf_dir):
    """Mean channels under hue turns, noise, blur and JPEG's losses; the tests hold the kernels against NumPy."""
    names = ["hue_pos", "hue_neg", "noise_light", "noise_heavy", "blur_light", "blur_heavy", "jpeg_q60", "jpeg_q30"]
    return pixels.perturbed(_grid(spark, sf_dir), names).groupBy("perturbation").agg(*(F.avg(c).alias(c) for c in pixels.RGB))


@query(f"""WITH {GRID}, gr AS (SELECT image_id, y, x, 255 * (0.299 * r + 0.587 * g + 0.114 * b) AS v FROM px),
 m AS (SELECT image_id, y, x, v, CASE WHEN y = 7 THEN 6 ELSE y + 1 END AS yd, CASE WHEN y = 0 THEN 1 ELSE y - 1 END AS yu, CASE WHEN x = 7 THEN 6 ELSE x + 1 END AS xr, CASE WHEN x = 0 THEN 1 ELSE x - 1 END AS xl FROM gr)
 SELECT m.image_id, round(var_pop(a.v + b.v + c.v + d.v - 4 * m.v), 2) AS blur, round(avg(m.v), 2) AS brightness FROM m JOIN gr a ON a.image_id = m.image_id AND a.y = m.yd AND a.x = m.x JOIN gr b ON b.image_id = m.image_id AND b.y = m.yu AND b.x = m.x
 JOIN gr c ON c.image_id = m.image_id AND c.y = m.y AND c.x = m.xr JOIN gr d ON d.image_id = m.image_id AND d.y = m.y AND d.x = m.xl GROUP BY 1""", 2)
def image_quality(spark, sf_dir):
    return pixels.quality(_grid(spark, sf_dir))


@query(f"WITH {GRID}, t AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM px), hs AS (SELECT *, CASE WHEN d < 1e-10 THEN 0 WHEN v = r THEN (g - b) / (d + 1e-10) WHEN v = g THEN (b - r) / (d + 1e-10) + 2 ELSE (r - g) / (d + 1e-10) + 4 END * 60 AS h0, CASE WHEN v > 0 THEN d / (v + 1e-10) ELSE 0 END AS s FROM t), f AS (SELECT image_id, ((CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END <= 50 OR CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END >= 330) AND s >= 0.2 AND v BETWEEN 0.1 AND 0.9)::INT AS hit FROM hs) SELECT image_id, sum(hit)::BIGINT AS n, round(avg(hit), 6) AS share FROM f GROUP BY 1")
def lesion_shares(spark, sf_dir):
    return pixels.lesion_share(_grid(spark, sf_dir))


@query(f"""WITH {GRID}, s AS (SELECT image_id, y, x, 0.299 * r + 0.587 * g + 0.114 * b AS v FROM px), d AS (SELECT image_id, CASE WHEN image_id % 4 >= 2 THEN 7 - y ELSE y END AS y, CASE WHEN image_id % 2 = 1 THEN 7 - x ELSE x END AS x, v + 0.05 AS v FROM s),
 f(k, axis) AS (VALUES (0, 'identity'), (1, 'hflip'), (2, 'vflip'), (3, 'rot180')), m AS (SELECT d.image_id, f.k, f.axis, round(avg(abs(s.v - d.v)), 9) AS mae FROM d CROSS JOIN f JOIN s ON s.image_id = d.image_id AND s.y = CASE WHEN f.k >= 2 THEN 7 - d.y ELSE d.y END AND s.x = CASE WHEN f.k % 2 = 1 THEN 7 - d.x ELSE d.x END GROUP BY ALL)
 SELECT image_id, axis, round(mae, 6)::DOUBLE AS mae FROM m QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY mae, k) = 1""")
def flip_detection(spark, sf_dir):
    """Images flipped by their id and made brighter, told by their flip."""
    g = _grid(spark, sf_dir)
    i = F.col("image_id")
    y, x = F.when(i % 4 >= 2, 7 - F.col("y")).otherwise(F.col("y")), F.when(i % 2 == 1, 7 - F.col("x")).otherwise(F.col("x"))
    return pixels.flip_axis(g, g.select("image_id", y.alias("y"), x.alias("x"), *((F.col(c) + 0.05).alias(c) for c in pixels.RGB)))


@query(None)
def linear_probe(spark, sf_dir):
    """Class 0 against the others, from the vectors."""
    v = vectors(spark, sf_dir).select("id", "vector", (F.col("class_name") == 0).cast("int").alias("is_zero"), (F.col("split") == "train").alias("train"))
    return probe.linear_probe(v, "id", "vector", "is_zero", "train")
