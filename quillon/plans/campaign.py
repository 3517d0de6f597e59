"""Registered queries on partitions, campaign contracts, report inputs and scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import keys as K
from quillon.operators import audit, contracts, inference, pairs, partition, summary
from quillon.plans.catalog import ASSETS, PREDS, VECTORS, query
from quillon.sources import documents
from quillon.sources import sinks
from quillon.sources.tables import ARMS, SEEDS, assets, predictions, table, vectors

DEALT = f"""{ASSETS}, cl AS (SELECT class_name, canonical_id, count(*) AS n FROM assets WHERE NOT is_derived GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY n DESC, md5(canonical_id || '|42'), canonical_id) AS k, (sum(n) OVER (PARTITION BY class_name))::DOUBLE AS total FROM cl),
g AS (SELECT DISTINCT class_name, 0::BIGINT AS k, '' AS canonical_id, 0::BIGINT AS n, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, '' AS split FROM cl
 UNION ALL SELECT class_name, k, canonical_id, n, a + CASE pick WHEN 'train' THEN n ELSE 0 END, b + CASE pick WHEN 'val' THEN n ELSE 0 END, c + CASE pick WHEN 'test' THEN n ELSE 0 END, pick FROM (
  SELECT o.*, g.a, g.b, g.c, CASE WHEN 0.70::DOUBLE * total - g.a >= 0.15::DOUBLE * total - g.b AND 0.70::DOUBLE * total - g.a >= 0.15::DOUBLE * total - g.c THEN 'train'
   WHEN 0.15::DOUBLE * total - g.b >= 0.15::DOUBLE * total - g.c THEN 'val' ELSE 'test' END AS pick FROM g JOIN o ON o.class_name = g.class_name AND o.k = g.k + 1)),
dealt AS (SELECT class_name, canonical_id, n, split FROM g WHERE k > 0)"""
FAMILIES = "fam(arm, family, role, params) AS (VALUES ('A0', 'plain', 'baseline', 28), ('A1', 'plain', 'variant', 31), ('A2', 'token', 'baseline', 49), ('A3', 'token', 'variant', 52))"
FAMILY_ROWS = [("A0", "plain", "baseline", 28), ("A1", "plain", "variant", 31), ("A2", "token", "baseline", 49), ("A3", "token", "variant", 52)]


def _dealt(spark, sf_dir):
    return partition.balanced_split(assets(spark, sf_dir).filter("not is_derived"), "class_name", "canonical_id")


@query(f"WITH RECURSIVE {DEALT} SELECT * FROM dealt")
def balanced_split(spark, sf_dir):
    return _dealt(spark, sf_dir)


@query(f"WITH RECURSIVE {DEALT} SELECT a.class_name, coalesce(d.split, 'orphan') AS split, count(*) AS n FROM assets a LEFT JOIN dealt d USING (class_name, canonical_id) WHERE is_derived GROUP BY ALL")
def inherited_splits(spark, sf_dir):
    """Derived rows by their cluster's new split, orphans counted."""
    found = partition.inherited(assets(spark, sf_dir).filter("is_derived"), _dealt(spark, sf_dir), ["class_name", "canonical_id"])
    return found.groupBy("class_name", F.coalesce("split", F.lit("orphan")).alias("split")).agg(F.count("*").alias("n"))


@query(f"WITH {ASSETS}, s AS (SELECT class_name, canonical_id, count(*) AS size FROM assets GROUP BY ALL) SELECT size, count(*) AS n_clusters, size * count(*) AS n_rows, (SELECT max(size) FROM s) AS largest FROM s GROUP BY size")
def cluster_sizes(spark, sf_dir):
    s = assets(spark, sf_dir).groupBy("class_name", "canonical_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_clusters"))
    return s.select("size", "n_clusters", (F.col("size") * F.col("n_clusters")).alias("n_rows")).crossJoin(s.agg(F.max("size").alias("largest")))  # one row


@query(f"""WITH {ASSETS}, ev AS (SELECT * FROM assets WHERE split <> 'train'),
 ok AS (SELECT * FROM assets WHERE (split = 'train' AND md5 NOT IN (SELECT md5 FROM ev) AND (class_name, canonical_id) NOT IN (SELECT (class_name, canonical_id) FROM ev)) OR (split <> 'train' AND NOT is_derived)), ek AS (SELECT * FROM ok WHERE split <> 'train'),
 x AS (SELECT 'exact' AS "check", doc_id FROM ok WHERE split = 'train' AND md5 IN (SELECT md5 FROM ek) UNION ALL SELECT 'family', doc_id FROM ok WHERE split = 'train' AND (class_name, canonical_id) IN (SELECT (class_name, canonical_id) FROM ek) UNION ALL SELECT 'derivative_in_evaluation', doc_id FROM ek WHERE is_derived)
 SELECT c.name AS "check", count(x.doc_id) AS n_rows, (SELECT count(*) FROM ok) AS n_kept FROM (VALUES ('exact'), ('family'), ('derivative_in_evaluation')) c(name) LEFT JOIN x ON x."check" = c.name GROUP BY 1""")
def reaudit(spark, sf_dir):
    """The audit again, from the start, over what the cleaning kept."""
    kept = audit.without_leaks(assets(spark, sf_dir), ["md5"], ["class_name", "canonical_id"]).filter("split = 'train' or not is_derived")
    return audit.audit(kept).drop("n_groups").crossJoin(kept.agg(F.count("*").alias("n_kept")))  # one row


@query(f"""WITH {VECTORS} SELECT class_name, i, j, hamming, round(cosine, 6) AS cosine FROM pairs
 WHERE cosine >= 0.2 AND ((split_i = 'train' AND i % 7 IN (3, 5) AND split_j <> 'train') OR (split_j = 'train' AND j % 7 IN (3, 5) AND split_i <> 'train'))""")
def derivative_eval_screen(spark, sf_dir):
    """Training derivatives against evaluation rows of their class."""
    v = vectors(spark, sf_dir).filter("split != 'train' or id % 7 in (3, 5)")
    found = pairs.near_pairs(v, None, 0.2, "vector", carry=("split",))
    return found.filter("(split_i = 'train') != (split_j = 'train')").select("class_name", "i", "j", "hamming", "cosine")


@query(f"""WITH {VECTORS}, s AS (SELECT i, j, i * 1000000000 + j AS ord FROM pairs WHERE cosine >= 0.2 AND split_i = 'test' AND split_j = 'test'),
 b AS (SELECT i AS id, j AS partner, ord FROM s UNION ALL SELECT j, i, ord FROM s) SELECT id, arg_max(partner, ord) AS partner FROM b GROUP BY id""")
def partner_map(spark, sf_dir):
    """Near-duplicate partner of each test row, either way round; the last pair by (i, j) wins."""
    v = vectors(spark, sf_dir).filter("split = 'test'")
    s = pairs.near_pairs(v, None, 0.2, "vector").select("i", "j", F.struct("i", "j").alias("ord"))
    both = s.select(F.col("i").alias("id"), F.col("j").alias("partner"), "ord").unionByName(s.select(F.col("j").alias("id"), F.col("i").alias("partner"), "ord"))
    return both.groupBy("id").agg(F.max_by("partner", "ord").alias("partner"))


@query(f"""WITH {VECTORS}, g(max_hamming, min_cosine) AS (VALUES (25, 0.2), (30, 0.25)), ends AS (SELECT max_hamming, min_cosine, i AS id, split_i AS split FROM g JOIN pairs ON hamming <= max_hamming AND cosine >= min_cosine UNION SELECT max_hamming, min_cosine, j, split_j FROM g JOIN pairs ON hamming <= max_hamming AND cosine >= min_cosine)
 SELECT max_hamming, min_cosine::DOUBLE AS min_cosine, count(DISTINCT id) FILTER (split <> 'train') AS n_evaluation FROM ends GROUP BY 1, 2""")
def evaluation_touched(spark, sf_dir):
    """Distinct evaluation rows in a pair, by threshold."""
    v = vectors(spark, sf_dir)
    found = pairs.near_pairs(v, None, 0.2, "vector", carry=("split",))
    cells = spark.createDataFrame([(25, 0.2), (30, 0.25)], "max_hamming int, min_cosine double")
    met = found.join(F.broadcast(cells), (F.col("hamming") <= F.col("max_hamming")) & (F.col("cosine") >= F.col("min_cosine")))
    end = lambda s: F.struct(F.col(s).alias("id"), F.col(f"split_{s}").alias("split"))
    ends = met.select("max_hamming", "min_cosine", F.explode(F.array(end("i"), end("j"))).alias("e")).select("max_hamming", "min_cosine", "e.*").distinct()
    return ends.groupBy("max_hamming", "min_cosine").agg(F.count_if(F.col("split") != "train").alias("n_evaluation"))


@query(f"""WITH {PREDS}, {FAMILIES}, acc AS (SELECT arm, seed, avg((pred = target)::INT) AS accuracy FROM preds GROUP BY 1, 2), x AS (SELECT * FROM acc JOIN fam USING (arm))
 SELECT v.arm, v.seed, v.family, round(v.accuracy - b.accuracy, 6) AS delta, v.params - b.params AS added_params FROM x v JOIN x b ON b.family = v.family AND b.seed = v.seed AND b.role = 'baseline' WHERE v.role <> 'baseline'""")
def baseline_delta(spark, sf_dir):
    """Each variant against its family's baseline with the same seed."""
    fam = spark.createDataFrame(FAMILY_ROWS, "arm string, family string, role string, params int")
    acc = predictions(spark, sf_dir).groupBy("arm", "seed").agg(F.avg((F.col("pred") == F.col("target")).cast("int")).alias("accuracy")).join(F.broadcast(fam), "arm")
    base = acc.filter("role = 'baseline'").select("family", "seed", F.col("accuracy").alias("_a"), F.col("params").alias("_p"))
    return acc.filter("role != 'baseline'").join(base, ["family", "seed"]).select("arm", "seed", "family", (F.col("accuracy") - F.col("_a")).alias("delta"), (F.col("params") - F.col("_p")).alias("added_params"))


@query(f"""WITH a(arm) AS (VALUES {', '.join(f"('{x}')" for x in ARMS)}), said(x, y, purpose) AS (VALUES ('A0', 'A1', 'augmentation'), ('A3', 'A0', 'tokens'), ('A2', 'A3', 'matched size'))
 SELECT l.arm AS a, r.arm AS b, coalesce(f.purpose, g.purpose, '') AS purpose FROM a l JOIN a r ON l.arm < r.arm LEFT JOIN said f ON f.x = l.arm AND f.y = r.arm LEFT JOIN said g ON g.x = r.arm AND g.y = l.arm""")
def declared_purpose(spark, sf_dir):
    """A pair's declared purpose, named in either order; empty if undeclared."""
    arms = spark.createDataFrame([(x, y) for x in ARMS for y in ARMS if x < y], "a string, b string")
    said = spark.createDataFrame([("A0", "A1", "augmentation"), ("A3", "A0", "tokens"), ("A2", "A3", "matched size")], "x string, y string, p string")
    either = said.unionByName(said.selectExpr("y as x", "x as y", "p")).groupBy("x", "y").agg(F.min("p").alias("p"))
    return arms.join(F.broadcast(either), (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left").select("a", "b", F.coalesce("p", F.lit("")).alias("purpose"))


@query("SELECT event_type, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS share FROM events GROUP BY 1")
def value_shares(spark, sf_dir):
    return summary.value_shares(table(spark, sf_dir, "events"), "event_type")


@query(f"""WITH {ASSETS}, m AS (SELECT split, class_name, 'n_chars' AS metric, n_chars::DOUBLE AS value FROM assets UNION ALL SELECT split, class_name, 'log_chars', ln(1 + n_chars) FROM assets)
 SELECT split, class_name, metric, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75 FROM m GROUP BY 1, 2, 3""")
def distribution_summary(spark, sf_dir):
    a = assets(spark, sf_dir).select("split", "class_name", F.col("n_chars").cast("double").alias("n_chars"), F.log1p("n_chars").alias("log_chars"))
    return summary.distribution(a, ["split", "class_name"], ["n_chars", "log_chars"])


@query("""WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events), s AS (SELECT event_type AS stage, count(*) AS n, avg(value) AS mean_ms FROM e WHERE k > 50 GROUP BY 1)
 SELECT stage, n, round(mean_ms, 6) AS mean_ms, round(sum(mean_ms) OVER (), 6) AS total_ms, round(sum(mean_ms) OVER () + 95.0, 6)::DOUBLE AS end_to_end_ms FROM s""")
def stage_latency(spark, sf_dir):
    """Mean latencies after 50 warm-up rounds, their total, and that with 95 ms of network."""
    return summary.stage_latency(table(spark, sf_dir, "events"), "event_type", "value", ["ts", "event_id"], 50, 95.0)


@query("""WITH b(module, width, ratio, actual) AS (VALUES ('token', 96, 2, 56065), ('adapter', 96, 2, 37537), ('token', 768, 3, 3545089), ('adapter', 768, 3, 3545090), ('light', 768, 0, 5)),
 x AS (SELECT *, CASE module WHEN 'token' THEN 6 * width * width + 8 * width + 1 WHEN 'adapter' THEN 2 * ratio * width * width + (ratio + 5) * width + 1 END::BIGINT AS expected FROM b)
 SELECT module, width, actual, expected, abs(actual - expected)::BIGINT AS off, coalesce(abs(actual - expected) <= 0, true) AS ok FROM x""")
def parameter_budget(spark, sf_dir):
    """Counted parameters against their formulas; a module without a formula is not held."""
    rows = spark.createDataFrame([("token", 96, 2, 56065), ("adapter", 96, 2, 37537), ("token", 768, 3, 3545089), ("adapter", 768, 3, 3545090), ("light", 768, 0, 5)], "module string, width int, ratio int, actual int")
    token, adapter = contracts.token_parameters(F.col("width").cast("long"), F.col("ratio"))
    rows = rows.withColumn("expected", F.when(F.col("module") == "token", token).when(F.col("module") == "adapter", adapter))
    return contracts.within_budget(rows, "actual", "expected", 0).drop("ratio")


ARTIFACTS = ("config", "history", "marker", "metrics", "predictions")


@query(f"""WITH e AS (SELECT a.arm, s.seed, f.artifact FROM (VALUES {', '.join(f"('{x}')" for x in ARMS)}) a(arm), (VALUES (42), (1337), (2026)) s(seed), (VALUES {', '.join(f"('{x}')" for x in ARTIFACTS)}) f(artifact)),
 m AS (SELECT * FROM e WHERE ('0x' || substr(md5(arm || '|' || seed || '|' || artifact), 1, 8))::BIGINT % 9 = 0) SELECT arm, seed, count(*) AS n_missing, string_agg(artifact, ',' ORDER BY artifact) AS missing FROM m GROUP BY 1, 2""")
def completion_contract(spark, sf_dir):
    """Runs that lack some of their artifacts; the gaps are made by hashes."""
    grid = spark.createDataFrame([(a, s, f) for a in ARMS for s in SEEDS for f in ARTIFACTS], "arm string, seed int, artifact string")
    found = grid.filter(K.md5_mod(F.concat_ws("|", "arm", F.col("seed").cast("string"), "artifact"), 9) != 0)
    return contracts.incomplete(grid, found, ["arm", "seed", "artifact"], ["arm", "seed"])


@query(f"""WITH {ASSETS}, f AS (SELECT split, class_name, count(*) AS n FROM assets GROUP BY 1, 2), e AS (SELECT split, class_name FROM (SELECT DISTINCT class_name FROM assets WHERE class_name <> 'de' UNION SELECT 'absent'), (VALUES ('train'), ('val'), ('test')) s(split))
 SELECT coalesce(e.split, f.split) AS split, coalesce(e.class_name, f.class_name) AS class_name, coalesce(n, 0) AS n, CASE WHEN f.n IS NULL THEN 'missing' WHEN e.split IS NULL THEN 'extra' ELSE 'ok' END AS status FROM e FULL JOIN f ON e.split = f.split AND e.class_name = f.class_name""")
def source_layout(spark, sf_dir):
    """Folders found against those expected: one class is expected and absent, one is there and not expected."""
    a = assets(spark, sf_dir)
    names = a.select("class_name").distinct().filter("class_name != 'de'").unionByName(spark.createDataFrame([("absent",)], "class_name string"))
    return contracts.layout(names.select("class_name", F.explode(F.array(*map(F.lit, partition.SPLITS))).alias("split")), a, ["split", "class_name"])


@query(f"WITH {ASSETS}, p(split, published) AS (VALUES ('train', 700), ('val', 150), ('test', 150)) SELECT p.split, count(a.doc_id) AS n, p.published::BIGINT AS published, count(a.doc_id) = p.published AS ok FROM p LEFT JOIN assets a USING (split) GROUP BY p.split, p.published")
def published_counts(spark, sf_dir):
    return contracts.count_protocol(assets(spark, sf_dir), "split", {"train": 700, "val": 150, "test": 150})


@query("SELECT user_id, count(*) FILTER (event_type IS DISTINCT FROM 'click') AS n_foreign FROM events GROUP BY 1 HAVING count(*) FILTER (event_type IS DISTINCT FROM 'click') > 0")
def campaign_isolation(spark, sf_dir):
    return contracts.foreign(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type") == "click")


@query("SELECT event_type, min(event_id) AS first_seen, row_number() OVER (ORDER BY min(event_id)) AS k FROM events GROUP BY 1")
def first_seen(spark, sf_dir):
    """Distinct values in the order they came; the values are few."""
    seen = table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("event_id").alias("first_seen"))
    return seen.withColumn("k", F.row_number().over(Window.orderBy("first_seen")))


@query("WITH d(o_orderpriority, pos) AS (VALUES ('3-MEDIUM', 0), ('1-URGENT', 1), ('2-HIGH', 2)) SELECT o_orderpriority, count(*) AS n, coalesce(any_value(pos), 10000)::INTEGER AS pos, row_number() OVER (ORDER BY coalesce(any_value(pos), 10000), o_orderpriority) AS k FROM orders LEFT JOIN d USING (o_orderpriority) GROUP BY 1")
def declared_order(spark, sf_dir):
    """Groups in the order declared, unknown ones last."""
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return summary.in_declared_order(counts, "o_orderpriority", ["3-MEDIUM", "1-URGENT", "2-HIGH"])


def _metric_documents(spark, sf_dir):
    """(n_regionkey, text): a region's metrics as JSON, in one of three shapes."""
    n = table(spark, sf_dir, "nation").withColumn("k", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).withColumn("v", F.col("n_nationkey") / F.lit(25.0))
    g = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("e"))
    name = lambda e: F.concat(F.lit("c"), e["k"].cast("string"))
    flat = F.map_from_arrays(F.transform("e", name), F.transform("e", lambda e: e["v"]))
    shape = F.when(F.col("n_regionkey") % 3 == 0, F.to_json(F.map_from_arrays(F.transform("e", name), F.transform("e", lambda e: F.struct(e["v"].alias("f1"), F.lit(1.0).alias("recall"))))))
    shape = shape.when(F.col("n_regionkey") % 3 == 1, F.to_json(F.struct(flat.alias("f1"), F.lit(0.5).alias("macro")))).otherwise(F.to_json(F.struct(F.transform("e", lambda e: e["v"]).alias("f1"))))
    return g.select("n_regionkey", shape.alias("text"))


@query("""WITH n AS (SELECT n_regionkey, 'c' || (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::VARCHAR AS class, n_nationkey / 25.0::DOUBLE AS value FROM nation) SELECT n_regionkey, class, round(value, 6) AS value FROM n""")
def nested_metrics(spark, sf_dir):
    """Metric documents of three shapes (by region) as rows."""
    return contracts.metric_map(_metric_documents(spark, sf_dir), ["n_regionkey"], "text", "f1", [f"c{k}" for k in range(5)])


@query("""WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 'no' WHEN 2 THEN '1' END AS flag, CASE event_id % 5 WHEN 0 THEN -1.0::DOUBLE WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 'inf'::DOUBLE ELSE round(value, 2) END AS score, event_type || '_s_x_s' || (event_id % 3)::VARCHAR AS run, 'module.layer_' || (event_id % 10)::VARCHAR || '.module.w' AS weight FROM events)
 SELECT event_id, lower(trim(flag)) IN ('1', 'true', 't', 'yes', 'y') AS flag, CASE WHEN isnan(score) OR isinf(score) OR score = -1 THEN NULL ELSE score END AS score, regexp_extract(run, '^(.*)_s(.*)$', 1) AS experiment, regexp_extract(run, '^(.*)_s(.*)$', 2) AS seed,
 regexp_replace(weight, '^module\\.', '') AS weight, replace(weight, '_', '\\_') AS escaped FROM e""")
def run_scalars(spark, sf_dir):
    """Repairs of texts and numbers read from run files."""
    i = F.col("event_id")
    flag = F.when(i % 4 == 0, " TRUE ").when(i % 4 == 1, "no").when(i % 4 == 2, "1")
    score = F.when(i % 5 == 0, -1.0).when(i % 5 == 1, float("nan")).when(i % 5 == 2, float("inf")).otherwise(F.round("value", 2))
    experiment, seed = K.run_parts(F.concat("event_type", F.lit("_s_x_s"), (i % 3).cast("string")))
    weight = F.concat(F.lit("module.layer_"), (i % 10).cast("string"), F.lit(".module.w"))
    return table(spark, sf_dir, "events").select("event_id", K.as_flag(flag).alias("flag"), K.finite(score).alias("score"), experiment.alias("experiment"), seed.alias("seed"), K.bare_parameter(weight).alias("weight"), sinks.latex(weight).alias("escaped"))


@query("""WITH e AS (SELECT event_id, user_id, round(value * 100)::BIGINT AS cents FROM events) SELECT user_id, count(*) AS n, format('{:,}', (sum(cents) * 1000)::BIGINT) AS thousands, printf('%+.2f', (sum(cents) % 1000 - 500) / 100.0) AS points FROM e GROUP BY 1""")
def number_formats(spark, sf_dir):
    """Thousands separators and signed points, of whole numbers of hundredths."""
    c = table(spark, sf_dir, "events").select("user_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return c.groupBy("user_id").agg(F.count("*").alias("n"), F.format_number(F.sum("cents") * 1000, 0).alias("thousands"), F.format_string("%+.2f", (F.sum("cents") % 1000 - 500) / 100.0).alias("points"))


@query(f"WITH {ASSETS} SELECT class_name, count(*) FILTER (doc_id % 7 = 3) AS flip, count(*) FILTER (doc_id % 7 = 5) AS rot, count(*) FILTER (NOT is_derived) AS original FROM assets GROUP BY 1")
def augmentation_inventory(spark, sf_dir):
    a = assets(spark, sf_dir).withColumn("op", F.coalesce(K.operation(F.col("filename")), F.lit("original")))
    return a.groupBy("class_name").pivot("op", ["flip", "rot", "original"]).count().na.fill(0)


@query(f"""WITH {PREDS}, n AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT image_id FROM preds)), ok AS (SELECT arm, n.k, n.n, (pred = target)::INT AS hit FROM preds JOIN n USING (image_id) WHERE seed = 42),
 d AS (SELECT a.arm AS a, b.arm AS b, a.k, b.hit - a.hit AS d FROM ok a JOIN ok b ON a.k = b.k AND a.arm < b.arm), nn AS (SELECT max(n) AS n FROM n),
 w AS (SELECT rep, (('0x' || substr(md5(rep::VARCHAR || '|' || pos::VARCHAR), 1, 8))::BIGINT % 4294967296) % n AS k, count(*) AS w FROM nn, range(0, 100) r(rep), LATERAL (SELECT unnest(range(0, n)) AS pos) GROUP BY 1, 2),
 s AS (SELECT a, b, rep, sum(w * d) / sum(w)::DOUBLE AS delta FROM d JOIN w USING (k) GROUP BY 1, 2, 3), e AS (SELECT a, b, stddev_samp(delta) AS se FROM s GROUP BY 1, 2)
 SELECT a, b, round(se, 6) AS se, round(2.801585 * se, 6) AS mde80, round(quantile_cont(se, 0.5) OVER () * 2.801585, 6) AS median_mde80 FROM e""")
def power_analysis(spark, sf_dir):
    """Standard error and least detectable difference of every pair of arms from one set of resamples."""
    hits = predictions(spark, sf_dir).filter("seed = 42").select("arm", "image_id", (F.col("pred") == F.col("target")).cast("int").alias("hit"))
    return inference.power(hits, "arm", "image_id", "hit", 100)


@query("""WITH n AS (SELECT n_regionkey, 'c' || (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::VARCHAR AS class_name, n_nationkey / 25.0::DOUBLE AS v FROM nation),
 s AS (SELECT *, CASE n_regionkey % 3 WHEN 0 THEN 'by_class' WHEN 1 THEN 'by_metric' ELSE 'by_order' END AS shape FROM n)
 SELECT n_regionkey, shape, class_name, 'f1' AS metric, round(v, 6) AS value FROM s UNION ALL SELECT n_regionkey, shape, class_name, 'recall', 1.0 FROM s WHERE shape = 'by_class'
 UNION ALL SELECT DISTINCT n_regionkey, shape, NULL, 'macro', 0.5 FROM s WHERE shape = 'by_metric'""")
def metrics_of_any_name(spark, sf_dir):
    """The documents of ``nested_metrics`` without a schema: every metric, and what stands beside the classes."""
    return documents.class_metrics(_metric_documents(spark, sf_dir), ["n_regionkey"], "text", [f"c{k}" for k in range(5)]).drop("raw")
