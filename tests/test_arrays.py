"""Array files through the data source: ranges, both orders, both layouts, failures."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.sources import arrays


def got(spark, path, range_mb=64):
    rows = arrays.read_arrays(spark, str(path), range_mb)
    return rows.rdd.getNumPartitions(), sorted(((os.path.basename(r.path), r.pos, r["values"]) for r in rows.collect()))


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("dtype", ["float32", "int16", "bool", ">f8"])
@pytest.mark.parametrize("shape", [(1000, 7), (50, 3, 4), (9,), (0, 4), (5, 0), ()])
def test_reads_like_numpy(spark, tmp_path, shape, dtype, order):
    a = (np.arange(int(np.prod(shape))) % 251).reshape(shape).astype(dtype)
    np.save(tmp_path / "a.npy", np.asarray(a, order=order))
    want = a.reshape(a.shape[0] if a.ndim else 1, -1 if a.size else int(np.prod(shape[1:]))).astype(float)
    tasks, rows = got(spark, tmp_path / "a.npy", 0.001)
    assert [r[1] for r in rows] == list(range(len(want))) and [r[2] for r in rows] == want.tolist()
    if shape == (1000, 7) and dtype == "float32":
        assert tasks > 20  # ranges of a kilobyte


def test_folder_pattern_and_refusals(spark, tmp_path):
    np.save(tmp_path / "b1.npy", np.ones((2, 2)))
    np.save(tmp_path / "b2.npy", np.zeros((3, 1)))
    (tmp_path / "note.txt").write_text("no array")
    assert [r[0] for r in got(spark, f"file://{tmp_path}")[1]] == ["b1.npy"] * 2 + ["b2.npy"] * 3
    assert len(got(spark, tmp_path / "b2*.npy")[1]) == 3
    some = arrays.read_arrays(spark, str(tmp_path / "b2.npy"), first=1, last=2).collect()
    assert [(r.pos, r["values"]) for r in some] == [(1, [0.0])] and arrays.read_arrays(spark, str(tmp_path / "b2.npy"), first=7).count() == 0
    np.save(tmp_path / "c.npy", np.array([{}], object), allow_pickle=True)
    for bad in (tmp_path / "c.npy", tmp_path / "none.npy"):
        with pytest.raises(Exception, match="numbers only|none.npy"):
            got(spark, bad)
    whole = (tmp_path / "b1.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(whole[:-5])
    with pytest.raises(Exception, match="ends too early"):
        got(spark, tmp_path / "cut.npy")


def test_one_file_filled_by_tasks(spark, tmp_path):
    rows = spark.range(5000).select("id", F.array(F.col("id") * 1.5, -F.col("id")).alias("v")).repartition(7)
    arrays.write_array(rows, str(tmp_path / "x" / "v.npy"), "v", ["id"])
    a = np.load(tmp_path / "x" / "v.npy")
    assert a.dtype == np.float32 and a.shape == (5000, 2) and (a[:, 0] == np.arange(5000) * np.float32(1.5)).all() and (a[:, 1] == -np.arange(5000)).all()
    assert os.listdir(tmp_path / "x") == ["v.npy"]
    with pytest.raises(Exception, match="v.npy"):
        arrays.write_array(rows, str(tmp_path / "x" / "v.npy"), "v", ["id"], overwrite=False)
    for bad in (rows.withColumn("v", F.when(F.col("id") != 77, F.col("v"))), rows.withColumn("v", F.when(F.col("id") == 77, F.array(F.lit(1.0))).otherwise(F.col("v")))):
        with pytest.raises(Exception, match="one length|doesn't fit"):
            arrays.write_array(bad, str(tmp_path / "x" / "v.npy"), "v", ["id"])
        assert os.listdir(tmp_path / "x") == ["v.npy"] and np.load(tmp_path / "x" / "v.npy").shape == (5000, 2)
    arrays.write_array(rows.limit(0), str(tmp_path / "none.npy"), "v", ["id"], "float64")
    assert np.load(tmp_path / "none.npy").shape == (0, 0)
    arrays.register(spark)
    with pytest.raises(Exception, match="rows came"):  # a row too few is no file
        rows.filter("id < 9").select(F.col("id").alias("pos"), F.col("v").alias("values")).write.format("npy").mode("overwrite").option("path", str(tmp_path / "y.npy")).option("rows", "10").option("width", "2").save()
    assert not [n for n in os.listdir(tmp_path) if n.startswith("y.npy")]


def test_parts_count_by_the_manifest(spark, tmp_path):
    rows = spark.range(100).select("id", F.array("id", F.lit(2)).alias("v")).repartition(4)
    to = str(tmp_path / "p")
    arrays.write_parts(rows, to, "v", "int32")
    (tmp_path / "p" / "part-00000-killed-99.npy").write_bytes(b"half of an array")  # what a killed task leaves
    tasks, back = got(spark, to)
    assert tasks == 4 and sorted(r[1] for r in back) == list(range(100)) and sorted(r[2][0] for r in back) == list(range(100))
    arrays.write_parts(rows.filter("id < 10"), to, "v", "int32", overwrite=False)
    assert len(got(spark, to)[1]) == 110
    arrays.write_parts(rows.filter("id < 10").coalesce(1), to, "v", "int32")
    parts = json.loads((tmp_path / "p" / "_manifest.json").read_text())["parts"]
    assert [p["rows"] for p in parts] == [10] and len(got(spark, to)[1]) == 10
    with pytest.raises(Exception, match="one length"):
        arrays.write_parts(rows.withColumn("v", F.when(F.col("id") % 2 == 0, F.array("id")).otherwise(F.col("v"))), to, "v", "int32")
    assert json.loads((tmp_path / "p" / "_manifest.json").read_text())["parts"] == parts
