"""Functions and table functions of a session against the operators they stand for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import keys, vectors
from quillon.operators import inference, sql
from quillon.sources import tables

SF = "/root/testdata/sf0.001"


def _own():
    def balanced(target, pred, weights, classes):
        """Mean recall of the classes that occur."""
        parts = []
        for c in range(classes):
            n = weights[:, target == c].sum(1)
            parts.append(np.divide(weights[:, (target == c) & (pred == c)].sum(1), n, out=np.full(len(weights), np.nan), where=n > 0))
        return np.nanmean(parts, axis=0)

    return balanced


balanced = _own()  # made in a function, so it travels to the tasks by value


@pytest.fixture(scope="module")
def session(spark):
    sql.register(spark, {"balanced": balanced})
    return spark


def test_functions_say_the_same(session):
    a = tables.assets(session, SF)
    told = a.select(F.expr("canonical_id(filename)"), F.expr("is_derived(filename)"), F.expr("split_of_key(cast(doc_id as string))"), keys.canonical_id(F.col("filename")), keys.is_derived(F.col("filename")), keys.split_of(F.col("doc_id"))).collect()
    assert len(told) == 200 and all(tuple(r)[:3] == tuple(r)[3:] for r in told)
    odd = session.createDataFrame([(".hidden",), ("a.b_AUG1.png",), ("x",), (None,), ("_aug",)], "filename string")
    assert all(r[0] == r[1] for r in odd.select(F.expr("canonical_id(filename)"), keys.canonical_id(F.col("filename"))).collect())
    v = tables.vectors(session, SF).selectExpr("word", "cast(vector as array<double>) v").limit(50)
    both = v.crossJoin(v.selectExpr("word w2", "v v2").limit(5))
    rows = both.select(F.expr("hamming(word, w2)"), vectors.hamming(F.col("word"), F.col("w2")), F.expr("inner_product(v, v2)"), vectors.dot(F.col("v"), F.col("v2")), F.expr("cosine(v, v2)")).collect()
    assert all(r[0] == r[1] and r[2] == r[3] and abs(r[4] - r[2]) < 1e-5 for r in rows)
    counts = session.createDataFrame([(5, 2, 1, 4), (0, 0, 0, 0)], "both long, a_only long, b_only long, neither long")
    phi = [r[0] for r in counts.select(F.expr("error_overlap(both, a_only, b_only, neither)")).collect()]
    assert phi[0] == pytest.approx((4 * 5 - 2) / np.sqrt(6 * 6 * 5 * 7)) and phi[1] is None


def test_leak_audit_from_sql(session):
    rows = [("k1", "train"), ("k1", "test"), ("k1", "train"), ("k2", "train"), ("k3", "val"), ("k3", "test"), (None, "train"), (None, "val"), ("k4", None), ("k4", "train")]
    session.createDataFrame(rows, "md5 string, split string").createOrReplaceTempView("some_assets")
    got = session.sql("SELECT * FROM leak_audit(TABLE(some_assets) PARTITION BY (md5), 'md5') ORDER BY leak_key").collect()
    assert [tuple(r) for r in got] == [(None, 1, 1, "train,val"), ("k1", 2, 1, "test,train")]
    assert session.sql("SELECT * FROM leak_audit(TABLE(SELECT * FROM some_assets WHERE split = 'x') PARTITION BY (md5), 'md5')").count() == 0
    tables.assets(session, SF).createOrReplaceTempView("assets_table")
    found = session.sql("SELECT sum(n_train) AS n FROM leak_audit(TABLE(assets_table) PARTITION BY (class_name, source), 'class_name,source')").first().n
    from quillon.operators import audit

    assert found == audit.leaking(tables.assets(session, SF), ["class_name", "source"]).count() > 0


def pairs(session):
    p = tables.predictions(session, SF)
    one = lambda arm, c: p.filter(F.col("arm") == arm).select("seed", "image_id", "target", F.col("pred").alias(c))
    return one("A0", "a").join(one("A3", "b"), ["seed", "image_id", "target"])


@pytest.mark.parametrize("metric", ["macro_f1", "balanced"])
def test_metric_of_ones_own_in_the_bootstrap(session, metric):
    rows = pairs(session)
    want = {str(r.seed): r for r in inference.paired_bootstrap(rows, "seed", 10, 2000, balanced if metric == "balanced" else metric).collect()}
    rows.createOrReplaceTempView("paired")
    got = session.sql(f"SELECT * FROM bootstrap(TABLE(paired) PARTITION BY (seed), 'seed', '{metric}', 10, 2000)").collect()
    assert len(got) == len(want) == 3
    for r in got:
        w = want[r.group_key]
        assert r.n == w.n == 500 and r.observed == pytest.approx(w.observed, abs=1e-12)
        assert abs(r.ci_low - w.ci_low) < 0.3 * w.delta_std and abs(r.ci_high - w.ci_high) < 0.3 * w.delta_std and abs(r.delta_std / w.delta_std - 1) < 0.1
    flat = rows.filter("seed = 42").toPandas()
    y, a, b = (flat[c].to_numpy() for c in ("target", "a", "b"))
    if metric == "balanced":
        recall = lambda p: np.mean([(p[y == c] == c).mean() for c in range(10) if (y == c).any()])
        assert want["42"].observed == pytest.approx(recall(b) - recall(a))
    with pytest.raises(Exception, match="unknown metric"):
        session.sql("SELECT * FROM bootstrap(TABLE(paired) PARTITION BY (seed), 'seed', 'none', 10, 20)").collect()
