"""Published trees: all at once, by the manifest, whatever killed tasks leave."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from quillon.sources import releases

SCHEMA = "split string, class_name string, filename string, content binary"


def rows(spark, ids, tag):
    return spark.createDataFrame([(("train", "test")[k % 2], f"c{k % 3}", f"{k}.jpg", bytearray(f"{tag}{k}".encode())) for k in ids], SCHEMA).repartition(3)


def held(spark, root):
    return {r.path: bytes(r.content).decode() for r in releases.contents(spark, root).collect()}


def test_releases(spark, tmp_path):
    root = str(tmp_path / "tree")
    assert releases.latest(spark, root) == (0, None) and held(spark, root) == {} and releases.strays(spark, root).count() == 0
    told = releases.publish(rows(spark, range(8), "a"), root)
    assert {r.status for r in told.collect()} == {"written"} and len(held(spark, root)) == 8
    again = {r.path: r.status for r in releases.publish(rows(spark, range(6, 10), "b"), root).collect()}
    assert sorted(again.values()) == ["kept", "kept", "written", "written"] and held(spark, root)["train/c0/6.jpg"] == "a6"
    over = {r.status for r in releases.publish(rows(spark, [6, 7], "c"), root, overwrite=True).collect()}
    assert over == {"replaced"} and held(spark, root)["train/c0/6.jpg"] == "c6" and len(held(spark, root)) == 10
    listed = {r.path: r for r in releases.files(spark, root).collect()}
    assert listed["train/c0/6.jpg"].sha256 == hashlib.sha256(b"c6").hexdigest() and listed["train/c0/6.jpg"].bytes == 2 and len(listed) == 10
    assert releases.latest(spark, root)[0] == 3
    releases.publish(rows(spark, [], "d"), root)
    assert len(held(spark, root)) == 10 and releases.latest(spark, root)[0] == 4


def test_what_failed_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "tree")
    releases.publish(rows(spark, range(4), "a"), root)
    for bad in (rows(spark, [5, 5], "x"), rows(spark, [6], "x").withColumn("filename", F.lit("../up")), rows(spark, [6], "x").withColumn("split", F.lit(None).cast("string"))):
        with pytest.raises(Exception, match="come twice|three parts"):
            releases.publish(bad, root, overwrite=True)
    os.makedirs(f"{root}/files/killed-00000-7/train/c1")
    open(f"{root}/files/killed-00000-7/train/c1/9.jpg", "wb").write(b"half")
    assert len(held(spark, root)) == 4 and releases.latest(spark, root)[0] == 1
    strays = {r.stored.rpartition("/")[2] for r in releases.strays(spark, root).collect()}
    assert "9.jpg" in strays and not strays & {f"{k}.jpg" for k in range(4)}
    nulls = rows(spark, [7], "x").withColumn("content", F.lit(None).cast("binary"))
    assert releases.publish(nulls, root).count() == 0 and len(held(spark, root)) == 4


def test_two_writers(spark, tmp_path, monkeypatch):
    """The second to take a number fails, and its files aren't seen."""
    root = str(tmp_path / "tree")
    releases.publish(rows(spark, [1], "a"), root)
    monkeypatch.setattr(releases, "latest", lambda *a: (0, None))
    with pytest.raises(Exception, match="(?i)exist"):
        releases.publish(rows(spark, [2], "b"), root)
    monkeypatch.undo()
    assert set(held(spark, root).values()) == {"a1"}
