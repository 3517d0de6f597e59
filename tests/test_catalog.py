"""Every registered query with a twin agrees with DuckDB on the smallest tables."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

from quillon.functions import keys as K
from quillon.operators import pairs as P
from quillon.plans import analyses, campaign, catalog, papers, rasters, reports  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name[:-8]} as select * from '{SF}/{name}'")
    return con


def told(frame):
    cols = sorted(frame.columns)
    rows = frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False)
    return cols, sorted(tuple(str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_twin(spark, duck, name):
    assert told(catalog.QUERIES[name](spark, SF).toPandas()) == told(duck.execute(catalog.ORACLE_SQL[name]).df())


def test_names(spark):
    names = ["a_01.jpg", "a_01_aug_rotation.jpg", "A_01_AUGflip.PNG", "b.c.jpeg", "noext", ".hidden"]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(n,) for n in names], "f string")
    got = df.select(K.canonical_id(F.col("f")), K.is_derived(F.col("f")), K.operation(F.col("f"))).collect()
    assert [tuple(r) for r in got] == [("a_01", False, None), ("a_01", True, "rotation"), ("A_01", True, "flip"), ("b.c", False, None), ("noext", False, None), (".hidden", False, None)]


def test_banded_pairs_equal_all_pairs(spark):
    import random

    rng = random.Random(5)
    words = [rng.getrandbits(63) for _ in range(40)]
    words += [w ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for w in words]
    rows = spark.createDataFrame([(i, 0, w, [1.0]) for i, w in enumerate(words)], "id long, class_name int, word long, vector array<double>")
    got = {(r.i, r.j) for r in P.near_pairs(rows, 8, None, "hash").collect()}
    assert got == {(i, j) for i in range(80) for j in range(i + 1, 80) if (words[i] ^ words[j]).bit_count() <= 8}


def test_entry(spark):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__

    assert __spark_entry__.queries()["leak_audit_summary"](spark, SF).count() == 3
