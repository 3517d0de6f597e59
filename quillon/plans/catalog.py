"""Registered queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import keys as K
from quillon.functions import vectors as V
from quillon.operators import audit, consensus, inference, metrics, pairs, prefix, summary, training_log
from quillon.sources.tables import CLASSES, assets, predictions, table, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

HASH = "(('0x' || substr(md5({}), 1, 8))::BIGINT % {})"
SPLIT = "CASE WHEN " + HASH.format("{0}::VARCHAR", 100) + " < 70 THEN 'train' WHEN " + HASH.format("{0}::VARCHAR", 100) + " < 85 THEN 'val' ELSE 'test' END"
ASSETS = f"""
a0 AS (SELECT doc_id, lang AS class_name, source, n_chars, md5(text) AS md5, {SPLIT.format('doc_id')} AS split,
  'doc_' || (doc_id % 400)::VARCHAR || CASE WHEN doc_id % 7 = 3 THEN '_aug_flip' WHEN doc_id % 7 = 5 THEN '_AUGrot' ELSE '' END || '.jpg' AS filename FROM documents),
assets AS (SELECT *, 'doc_' || (doc_id % 400)::VARCHAR AS canonical_id, doc_id % 7 IN (3, 5) AS is_derived FROM a0)"""
PREDS = f"""
arms(arm, rate) AS (VALUES ('A0', 6), ('A1', 9), ('A2', 12), ('A3', 20)), seeds(seed) AS (VALUES (42), (1337), (2026)),
preds AS (SELECT arm, seed, vec_id AS image_id, label AS target,
  CASE WHEN {HASH.format("arm || '|' || seed::VARCHAR || '|' || vec_id::VARCHAR", 100)} < rate THEN {HASH.format("'x|' || vec_id::VARCHAR", 10)} ELSE label END::INTEGER AS pred,
  ({HASH.format("vec_id::VARCHAR || '|' || arm", 1000)} + 1) / 1001.0::DOUBLE AS p_true FROM embeddings, arms, seeds)"""
VECTORS = f"""
v AS (SELECT vec_id AS id, label AS class_name, embedding AS vector, {SPLIT.format('vec_id')} AS split,
  list_sum([CASE WHEN embedding[k + 1] > 0 THEN (1::BIGINT << k) ELSE 0 END FOR k IN range(0, 63)])::BIGINT AS word FROM embeddings),
pairs AS (SELECT a.class_name, a.id AS i, b.id AS j, bit_count(xor(a.word, b.word))::INTEGER AS hamming, list_dot_product(a.vector::DOUBLE[], b.vector::DOUBLE[]) AS cosine, a.split AS split_i, b.split AS split_j
  FROM v a JOIN v b ON a.class_name = b.class_name AND a.id < b.id)"""
CELLS = PREDS + f"""
, lab AS (SELECT range::INTEGER AS c FROM range(0, {CLASSES})), runs AS (SELECT DISTINCT arm, seed FROM preds),
pc AS (SELECT r.arm, r.seed, l.c AS class_idx, count(*) FILTER (p.target = l.c) AS support, count(*) FILTER (p.pred = l.c) AS predicted, count(*) FILTER (p.target = l.c AND p.pred = l.c) AS tp
  FROM runs r CROSS JOIN lab l JOIN preds p ON p.arm = r.arm AND p.seed = r.seed GROUP BY ALL),
prf AS (SELECT *, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(support + predicted, 0)::DOUBLE, 0) AS f1 FROM pc)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(sql: str | None, digits: int = 6):
    """Registers a query under its function's name; doubles are rounded as in its twin."""

    def take(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return take


@query(f"""WITH {ASSETS}, ev AS (SELECT * FROM assets WHERE split <> 'train'),
 x AS (SELECT 'exact' AS "check", doc_id, md5 AS k1, '' AS k2 FROM assets WHERE split = 'train' AND md5 IN (SELECT md5 FROM ev)
  UNION ALL SELECT 'family', doc_id, class_name, canonical_id FROM assets WHERE split = 'train' AND (class_name, canonical_id) IN (SELECT (class_name, canonical_id) FROM ev)
  UNION ALL SELECT 'derivative_in_evaluation', doc_id, class_name, canonical_id FROM ev WHERE is_derived),
 c(name) AS (VALUES ('exact'), ('family'), ('derivative_in_evaluation'))
 SELECT name AS "check", count(x.doc_id) AS n_rows, count(DISTINCT CASE WHEN x.doc_id IS NOT NULL THEN (k1, k2) END) AS n_groups FROM c LEFT JOIN x ON x."check" = c.name GROUP BY name""")
def leak_audit_summary(spark, sf_dir):
    return audit.audit(assets(spark, sf_dir))


@query(f"WITH {ASSETS} SELECT doc_id, filename, canonical_id, is_derived, CASE doc_id % 7 WHEN 3 THEN 'flip' WHEN 5 THEN 'rot' END AS op, 'doc' AS prefix, split, class_name || '/' || filename AS image_id FROM assets")
def asset_keys(spark, sf_dir):
    a, name = assets(spark, sf_dir), F.col("filename")
    return a.select("doc_id", "filename", "canonical_id", "is_derived", K.operation(name).alias("op"), K.source_prefix(F.col("canonical_id")).alias("prefix"), "split", F.concat_ws("/", "class_name", "filename").alias("image_id"))


@query(f"WITH {ASSETS} SELECT doc_id, md5 FROM assets WHERE split = 'train' AND md5 IN (SELECT md5 FROM assets WHERE split <> 'train')")
def exact_leak_semi(spark, sf_dir):
    return audit.leaking(assets(spark, sf_dir), ["md5"]).select("doc_id", "md5")


@query(f"WITH {ASSETS} SELECT doc_id, class_name, canonical_id FROM assets WHERE split = 'train' AND (class_name, canonical_id) IN (SELECT (class_name, canonical_id) FROM assets WHERE split <> 'train')")
def family_leak_semi(spark, sf_dir):
    return audit.leaking(assets(spark, sf_dir), ["class_name", "canonical_id"]).select("doc_id", "class_name", "canonical_id")


@query(f"""WITH {ASSETS}, ev AS (SELECT * FROM assets WHERE split <> 'train') SELECT doc_id, split FROM assets
 WHERE split <> 'train' OR (md5 NOT IN (SELECT md5 FROM ev) AND (class_name, canonical_id) NOT IN (SELECT (class_name, canonical_id) FROM ev))""")
def clean_anti(spark, sf_dir):
    return audit.without_leaks(assets(spark, sf_dir), ["md5"], ["class_name", "canonical_id"]).select("doc_id", "split")


@query(f"WITH {ASSETS} SELECT md5, count(*) AS n, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM assets GROUP BY md5 HAVING count(*) > 1")
def dup_groups_splits(spark, sf_dir):
    return audit.groups_over(assets(spark, sf_dir), ["md5"], False).withColumn("splits", F.array_join("splits", ","))


@query(f"WITH {ASSETS} SELECT class_name, canonical_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM assets GROUP BY ALL HAVING count(DISTINCT split) > 1")
def cross_split_families(spark, sf_dir):
    return audit.groups_over(assets(spark, sf_dir), ["class_name", "canonical_id"], True).withColumn("splits", F.array_join("splits", ","))


@query(f"WITH {ASSETS} SELECT class_name, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, count(*) AS total FROM assets GROUP BY 1")
def counts_pivot(spark, sf_dir):
    return audit.counts_by_split(assets(spark, sf_dir))


@query(f"WITH {ASSETS} SELECT class_name, round(100.0 * count(*) FILTER (split = 'train') / count(*), 6)::DOUBLE AS train_pct, round(100.0 * count(*) FILTER (split = 'val') / count(*), 6)::DOUBLE AS val_pct, round(100.0 * count(*) FILTER (split = 'test') / count(*), 6)::DOUBLE AS test_pct FROM assets GROUP BY 1")
def split_percentages(spark, sf_dir):
    c = audit.counts_by_split(assets(spark, sf_dir))
    return c.select("class_name", *((100.0 * F.col(s) / F.col("total")).cast("double").alias(f"{s}_pct") for s in ("train", "val", "test")))


@query(f"""WITH {ASSETS}, p AS (SELECT class_name, canonical_id, arg_max(split, doc_id) AS parent_split FROM assets WHERE NOT is_derived GROUP BY ALL)
 SELECT coalesce(parent_split, 'orphan') AS parent_split, a.split, count(*) AS n FROM assets a LEFT JOIN p USING (class_name, canonical_id) WHERE is_derived GROUP BY ALL""")
def derivative_parents(spark, sf_dir):
    return audit.parents(assets(spark, sf_dir)).groupBy(F.coalesce("parent_split", F.lit("orphan")).alias("parent_split"), "split").agg(F.count("*").alias("n"))


@query(f"""WITH {ASSETS}, o AS (SELECT doc_id, md5 FROM assets WHERE doc_id % 10 <> 1), n AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'x' ELSE md5 END AS md5 FROM assets WHERE doc_id % 10 <> 2)
 SELECT * FROM (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'missing' WHEN o.doc_id IS NULL THEN 'added' WHEN o.md5 IS DISTINCT FROM n.md5 THEN 'changed' END AS status FROM o FULL JOIN n ON o.doc_id = n.doc_id) WHERE status IS NOT NULL""")
def inventory_drift(spark, sf_dir):
    """Two inventories made from one: one lacks ids ending in 1, the other those in 2, and ids ending in 3 changed."""
    a = assets(spark, sf_dir).select("doc_id", "md5")
    new = a.filter("doc_id % 10 != 2").withColumn("md5", F.when(F.col("doc_id") % 10 == 3, "x").otherwise(F.col("md5")))
    return audit.drift(a.filter("doc_id % 10 != 1"), new, "doc_id", "md5")


@query("SELECT r_name AS grp, sha256(string_agg(n_nationkey::VARCHAR || '|' || n_name, chr(10) ORDER BY n_nationkey::VARCHAR || '|' || n_name)) AS sha256, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def order_locked_digest(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumnRenamed("r_name", "grp")
    return audit.table_digest(n, "grp", ["n_nationkey", "n_name"])


@query(f"WITH {VECTORS} SELECT class_name, i, j, hamming, round(cosine, 6) AS cosine FROM pairs WHERE hamming <= 30 AND cosine >= 0.2")
def near_dup_pairs_both(spark, sf_dir):
    return pairs.near_pairs(vectors(spark, sf_dir), 30, 0.2, "both")


@query(f"WITH {VECTORS} SELECT class_name, i, j, hamming, round(cosine, 6) AS cosine FROM pairs WHERE hamming <= 20 OR cosine >= 0.3")
def near_dup_pairs_any(spark, sf_dir):
    return pairs.near_pairs(vectors(spark, sf_dir), 20, 0.3, "any")


def _pairs(spark, sf_dir):
    return pairs.near_pairs(vectors(spark, sf_dir), None, 0.2, "vector", carry=("split",))


@query(f"""WITH {VECTORS}, g(max_hamming, min_cosine) AS (VALUES (20, 0.2), (25, 0.2), (25, 0.3), (30, 0.25))
 SELECT max_hamming, min_cosine::DOUBLE AS min_cosine, count(i) AS n_pairs, count(i) FILTER (split_i <> split_j) AS n_cross FROM g LEFT JOIN pairs ON hamming <= max_hamming AND cosine >= min_cosine AND cosine >= 0.2 GROUP BY ALL""")
def threshold_sweep(spark, sf_dir):
    return pairs.sweep(_pairs(spark, sf_dir), [(20, 0.2), (25, 0.2), (25, 0.3), (30, 0.25)])


@query(f"""WITH {VECTORS}, p AS (SELECT * FROM pairs WHERE cosine >= 0.2), b AS (SELECT i, j, split_i, split_j, hamming FROM p UNION ALL SELECT j, i, split_j, split_i, hamming FROM p),
 one AS (SELECT i AS id, min((CASE split_i WHEN 'test' THEN 0 ELSE 1 END, hamming, j)) AS m FROM b WHERE split_i <> 'train' AND split_j = 'train' GROUP BY 1),
 two AS (SELECT i AS id, min((2, hamming, j)) AS m FROM b WHERE split_i = 'val' AND split_j = 'test' AND i NOT IN (SELECT id FROM one) AND j NOT IN (SELECT id FROM one) GROUP BY 1)
 SELECT id, m[3] AS partner, m[1] AS severity FROM (SELECT * FROM one UNION ALL SELECT * FROM two)""")
def prune_closed_form(spark, sf_dir):
    return pairs.prune(_pairs(spark, sf_dir))


@query(CELLS.replace("arms(arm", "WITH arms(arm", 1) + " SELECT p.arm, p.seed, t.c AS target, q.c AS pred, coalesce(n, 0) AS n FROM runs p CROSS JOIN lab t CROSS JOIN lab q LEFT JOIN (SELECT arm, seed, target, pred, count(*) AS n FROM preds GROUP BY ALL) x ON x.arm = p.arm AND x.seed = p.seed AND x.target = t.c AND x.pred = q.c")
def confusion_grid(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir), ["arm", "seed"], CLASSES)


@query(f"WITH {CELLS} SELECT arm, seed, class_idx, support, predicted, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf")
def per_class_prf(spark, sf_dir):
    return metrics.per_class(predictions(spark, sf_dir), ["arm", "seed"], CLASSES)


@query(f"WITH {CELLS} SELECT arm, seed, round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy, round(avg(f1), 6) AS macro_f1_fixed, round(avg(f1) FILTER (support + predicted > 0), 6) AS macro_f1_observed, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, sum(support)::BIGINT AS n FROM prf GROUP BY ALL")
def f1_averages(spark, sf_dir):
    return metrics.averages(predictions(spark, sf_dir), ["arm", "seed"], CLASSES)


@query(f"""WITH {PREDS}, r AS (SELECT arm, seed, target = pred AS ok, rank() OVER (PARTITION BY arm, seed ORDER BY p_true) + (count(*) OVER (PARTITION BY arm, seed, p_true) - 1) / 2.0 AS rk FROM preds)
 SELECT arm, seed, round((sum(rk) FILTER (ok) - count(*) FILTER (ok) * (count(*) FILTER (ok) + 1) / 2.0) / nullif(count(*) FILTER (ok) * count(*) FILTER (NOT ok), 0), 6)::DOUBLE AS auc FROM r GROUP BY ALL""")
def auc_of_confidence(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("ok", F.col("pred") == F.col("target"))
    return metrics.binary_auc(p, ["arm", "seed"], "p_true", "ok")


@query(f"WITH {PREDS} SELECT arm, seed, round(-avg(ln(greatest(p_true, 1e-12))), 6) AS log_loss FROM preds GROUP BY ALL")
def log_loss(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("arm", "seed").agg((-F.avg(F.ln(F.greatest("p_true", F.lit(1e-12))))).alias("log_loss"))


@query("SELECT label, n, round((1.0 / n) / avg(1.0 / n) OVER (), 6)::DOUBLE AS weight FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)")
def class_weights(spark, sf_dir):
    return metrics.class_weights(table(spark, sf_dir, "embeddings"), "label")


@query(f"WITH {CELLS}, m AS (SELECT arm, seed, sum(tp) / sum(support)::DOUBLE AS acc, avg(f1) AS f1 FROM prf GROUP BY ALL) SELECT arm, count(DISTINCT seed) AS n_seeds, round(avg(acc), 6) AS acc_mean, round(stddev_samp(acc), 6) AS acc_std, round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_std FROM m GROUP BY 1")
def seed_summary(spark, sf_dir):
    m = metrics.averages(predictions(spark, sf_dir), ["arm", "seed"], CLASSES).select("arm", "seed", F.col("accuracy").alias("acc"), F.col("macro_f1_fixed").alias("f1"))
    return summary.seed_summary(m, ["arm"], "seed", ["acc", "f1"])


@query("""WITH r AS (SELECT l_suppkey AS run, CASE l_linenumber WHEN 1 THEN 'clean' ELSE 'p' || l_linenumber::VARCHAR END AS cond, avg(l_extendedprice) AS m FROM lineitem GROUP BY ALL), c AS (SELECT run, m AS clean FROM r WHERE cond = 'clean')
 SELECT run, round(clean, 2) AS clean, round(avg(m), 2) AS mean_stress, round(min(m), 2) AS worst, arg_min(cond, m) AS worst_condition, round(clean - avg(m), 2) AS "drop", round(avg(m / nullif(clean, 0)), 2) AS mean_ratio FROM r JOIN c USING (run) WHERE cond <> 'clean' GROUP BY run, clean""")
def robustness_summary(spark, sf_dir):
    cond = F.when(F.col("l_linenumber") == 1, "clean").otherwise(F.concat(F.lit("p"), F.col("l_linenumber").cast("string")))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run"), cond.alias("cond")).agg(F.avg("l_extendedprice").alias("m"))
    return rounded(summary.robustness(rows, ["run"], "cond", "m"), 2)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1, 2")
def percentile_bands(spark, sf_dir):
    return rounded(summary.percentile_bands(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p95": 0.95}), 4)


@query(f"WITH {CELLS}, m AS (SELECT arm, seed, avg(f1) AS f1 FROM prf GROUP BY ALL) SELECT arm, seed, round(f1, 6) AS f1, round(f1, 2) = max(round(f1, 2)) OVER (PARTITION BY seed) AS is_best FROM m")
def best_with_ties(spark, sf_dir):
    m = metrics.averages(predictions(spark, sf_dir), ["arm", "seed"], CLASSES).select("arm", "seed", F.col("macro_f1_fixed").alias("f1"))
    return summary.best_with_ties(m, ["seed"], "f1", 2)


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || 's7'), doc_id) AS r FROM documents) WHERE r <= 5")
def stratified_sample(spark, sf_dir):
    return summary.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 5, "s7")


AB = PREDS + """, ab AS (SELECT a.seed, a.image_id, a.pred = a.target AS ok_a, b.pred = b.target AS ok_b, a.p_true AS pa, b.p_true AS pb FROM preds a JOIN preds b ON a.seed = b.seed AND a.image_id = b.image_id AND a.arm = 'A0' AND b.arm = 'A3'), t AS (SELECT seed, count(*) FILTER (ok_a AND ok_b) AS "both", count(*) FILTER (ok_a AND NOT ok_b) AS a_only, count(*) FILTER (NOT ok_a AND ok_b) AS b_only, count(*) FILTER (NOT ok_a AND NOT ok_b) AS neither FROM ab GROUP BY 1)"""


def _ab(spark, sf_dir):
    p = predictions(spark, sf_dir)
    one = lambda arm, s: p.filter(F.col("arm") == arm).select("seed", "image_id", (F.col("pred") == F.col("target")).alias(f"ok_{s}"), F.col("p_true").alias(f"p{s}"))
    return one("A0", "a").join(one("A3", "b"), ["seed", "image_id"])


@query(f"""WITH {AB} SELECT *, round((neither::DOUBLE * "both" - a_only::DOUBLE * b_only) / nullif(sqrt((neither + a_only)::DOUBLE * (b_only + "both") * (neither + b_only) * (a_only + "both")), 0), 6) AS phi,
 round(least(1.0, 2 * list_sum([exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2)) FOR i IN range(0, least(a_only, b_only) + 1)])), 6) AS p_value FROM t""")
def mcnemar_exact(spark, sf_dir):
    return inference.mcnemar(inference.contingency(_ab(spark, sf_dir), ["seed"]))


@query(f"WITH {AB}, r AS (SELECT seed, rank() OVER (PARTITION BY seed ORDER BY pa) + (count(*) OVER (PARTITION BY seed, pa) - 1) / 2.0 AS x, rank() OVER (PARTITION BY seed ORDER BY pb) + (count(*) OVER (PARTITION BY seed, pb) - 1) / 2.0 AS y FROM ab) SELECT seed, round(corr(x, y), 6) AS rho FROM r GROUP BY 1")
def spearman(spark, sf_dir):
    return inference.spearman(_ab(spark, sf_dir), ["seed"], "pa", "pb")


@query(f"""WITH {AB}, n AS (SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY image_id) - 1 AS k, ok_b::INT - ok_a::INT AS d FROM ab), s AS (SELECT seed, count(*) AS n, avg(d) AS observed FROM n GROUP BY 1),
 dr AS (SELECT s.seed, rep, {HASH.format("rep::VARCHAR || '|' || pos::VARCHAR", 4294967296)} % s.n AS k FROM s, (SELECT range AS rep FROM range(0, 200)), (SELECT range AS pos FROM range(0, (SELECT max(n) FROM s)))  WHERE pos < s.n),
 st AS (SELECT dr.seed, rep, avg(d) AS delta FROM dr JOIN n ON n.seed = dr.seed AND n.k = dr.k GROUP BY ALL)
 SELECT seed, round(any_value(observed), 6) AS observed, round(quantile_cont(delta, 0.025), 6) AS ci_low, round(quantile_cont(delta, 0.975), 6) AS ci_high, round(avg((delta > 0)::INT), 6) AS fraction_above, round(2.801585 * stddev_samp(delta), 6) AS mde80 FROM st JOIN s USING (seed) GROUP BY seed""")
def paired_bootstrap_ci(spark, sf_dir):
    rows = prefix.numbered(_ab(spark, sf_dir), ["seed"], ["image_id"], "k")
    return inference.bootstrap_accuracy(rows, ["seed"], "k", 200)


@query(f"""WITH {PREDS}, w AS (SELECT image_id, seed, pred, count(*) AS v FROM preds WHERE pred <> target GROUP BY ALL), t AS (SELECT image_id, seed, pred FROM w QUALIFY rank() OVER (PARTITION BY image_id, seed ORDER BY v DESC) = 1),
 m AS (SELECT image_id, seed, string_agg(pred::VARCHAR, ',' ORDER BY pred) AS modal_wrong, count(*) > 1 AS tie FROM t GROUP BY ALL),
 c AS (SELECT image_id, seed, min(target) AS target, count(*) FILTER (pred <> target) AS n_wrong, count(*) AS n_arms FROM preds GROUP BY ALL HAVING count(*) FILTER (pred <> target) >= 2)
 SELECT image_id, seed, target, n_wrong, n_arms, modal_wrong, tie FROM c JOIN m USING (image_id, seed)""")
def consensus_failures(spark, sf_dir):
    return consensus.consensus_failures(predictions(spark, sf_dir), ["image_id", "seed"], 2)


@query(f"WITH {PREDS}, o AS (SELECT seed, avg(ok) AS oracle FROM (SELECT seed, image_id, max((pred = target)::INT) AS ok FROM preds GROUP BY ALL) GROUP BY 1), s AS (SELECT seed, max(a) AS best_arm FROM (SELECT seed, arm, avg((pred = target)::INT) AS a FROM preds GROUP BY ALL) GROUP BY 1) SELECT seed, round(oracle, 6) AS oracle, round(best_arm, 6) AS best_arm FROM o JOIN s USING (seed)")
def oracle_ceiling(spark, sf_dir):
    return consensus.oracle_ceiling(predictions(spark, sf_dir), ["seed"], "image_id", "arm")


DECIDE = """d AS (SELECT vec_id, label, vec_id % 200 + 50.0 AS blur, vec_id % 250 + 0.0 AS brightness, abs(embedding[1])::DOUBLE * 4 AS confidence, abs(embedding[2])::DOUBLE * 4 AS agreement, vec_id % 11 = 0 AS flagged FROM embeddings),
s AS (SELECT *, CASE WHEN blur < 100 THEN 'blurry' WHEN brightness < 40 THEN 'dark' WHEN brightness > 220 THEN 'bright' END AS reason FROM d),
x AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN confidence < 0.7 THEN 'uncertain' WHEN agreement < 0.35 OR flagged THEN 'retake_required' ELSE 'accepted' END AS status FROM s)"""


def _decided(spark, sf_dir):
    size = lambda k: F.abs(F.col("embedding")[k].cast("double")) * 4
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 200 + 50.0).alias("blur"), (F.col("vec_id") % 250 + 0.0).alias("brightness"), size(0).alias("confidence"), size(1).alias("agreement"), (F.col("vec_id") % 11 == 0).alias("flagged"))
    return consensus.decide(e)


@query(f"WITH {DECIDE} SELECT vec_id, reason, status FROM x")
def decision_policy(spark, sf_dir):
    return _decided(spark, sf_dir).select("vec_id", "reason", "status")


@query(f"WITH {DECIDE} SELECT coalesce(label::VARCHAR, 'Overall') AS class_name, count(*) AS total, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'uncertain') AS uncertain, round(avg(confidence), 6) AS confidence_mean, round(max(confidence), 6) AS confidence_max FROM x GROUP BY ROLLUP (label)")
def class_statistics(spark, sf_dir):
    d = _decided(spark, sf_dir).rollup("label").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.count_if(F.col("status") == "uncertain").alias("uncertain"), F.avg("confidence").alias("confidence_mean"), F.max("confidence").alias("confidence_max"))
    return d.select(F.coalesce(F.col("label").cast("string"), F.lit("Overall")).alias("class_name"), "total", "rejected", "uncertain", "confidence_mean", "confidence_max")


EPOCHS = "e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value FROM events)"


def _epochs(spark, sf_dir):
    from pyspark.sql import Window

    return table(spark, sf_dir, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("epoch"), "value")


@query(f"""WITH {EPOCHS}, b AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e), i AS (SELECT user_id, epoch, value, before IS NULL OR value > before AS improved FROM b),
 s AS (SELECT *, max(value) OVER w AS best, epoch - max(CASE WHEN improved THEN epoch END) OVER w AS since FROM i WINDOW w AS (PARTITION BY user_id ORDER BY epoch))
 SELECT user_id, epoch, round(value, 6) AS value, improved, round(best, 6) AS best, since, since >= 25 AS stop FROM s""")
def running_best(spark, sf_dir):
    return training_log.running_best(_epochs(spark, sf_dir), "user_id", "epoch", "value", 25)


@query(f"WITH {EPOCHS} SELECT user_id, round(list_reduce(list(value ORDER BY epoch), lambda s, x: s * 0.9 + x * (1 - 0.9)), 4) AS ema FROM e GROUP BY 1")
def ema_fold(spark, sf_dir):
    return rounded(training_log.smoothed(_epochs(spark, sf_dir), "user_id", "epoch", "value", 0.9), 4)


@query(f"WITH {EPOCHS} SELECT user_id, epoch FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY epoch DESC) <= 3")
def keep_latest(spark, sf_dir):
    return training_log.latest(_epochs(spark, sf_dir), "user_id", "epoch", 3).select("user_id", "epoch")


@query("SELECT range AS epoch, round(CASE WHEN range <= 5 THEN 0.001 * range / 5.0 ELSE 0.5 * 0.001 * (1 + cos(pi() * (range - 5) / 95.0)) END, 9)::DOUBLE AS lr FROM range(1, 101)", 9)
def lr_schedule(spark, sf_dir):
    return spark.range(1, 101).select(F.col("id").alias("epoch"), V.warm_up_cosine(F.col("id"), 5, 100, 0.001).alias("lr"))


PIXELS = "p AS (SELECT vec_id, (vec_id % 7) / 7.0::DOUBLE AS r, (vec_id % 5) / 5.0::DOUBLE AS g, (vec_id % 3) / 3.0::DOUBLE AS b FROM embeddings), m AS (SELECT *, greatest(r, g, b) AS t, greatest(r, g, b) - least(r, g, b) AS d FROM p), h AS (SELECT *, CASE WHEN d < 1e-10 THEN 0 WHEN t = r THEN (g - b) / (d + 1e-10) WHEN t = g THEN (b - r) / (d + 1e-10) + 2 ELSE (r - g) / (d + 1e-10) + 4 END / 6 AS h0 FROM m)"


@query(f"WITH {PIXELS} SELECT vec_id, round(CASE WHEN h0 < 0 THEN h0 + 1 ELSE h0 END, 6) AS hue, round(CASE WHEN t > 0 THEN d / (t + 1e-10) ELSE 0 END, 6) AS saturation, round(t, 6) AS value, round(0.299 * r + 0.587 * g + 0.114 * b, 6)::DOUBLE AS luma FROM h")
def pixel_colours(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", *((F.col("vec_id") % n / float(n)).alias(c) for c, n in (("r", 7), ("g", 5), ("b", 3))))
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    h, s, v = V.hsv(r, g, b)
    return e.select("vec_id", h.alias("hue"), s.alias("saturation"), v.alias("value"), V.luma(r, g, b).alias("luma"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS gain, round(regr_intercept(l_extendedprice, l_quantity), 2) AS shift, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 5 AND 45 GROUP BY 1")
def photometric_fit(spark, sf_dir):
    """A linear fit with clipped ends left out, as gain and shift."""
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity").between(5, 45))
    return rows.groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("gain"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("shift"), F.count("*").alias("n"))
