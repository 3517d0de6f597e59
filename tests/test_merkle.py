"""Hash trees over ranges of sorted rows."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import merkle

SCHEMA = "g string, k long, v string, x double"


def rows_of(n, seed=1):
    rng = random.Random(seed)
    out = [(("a", "b", None)[k % 7 // 3], None if k == 9 else k // 2, rng.choice("uvwxyz") * 3, None if k % 11 == 0 else k / 4) for k in range(n)]
    return [*out, *out[:5], out[3]]


def frame(spark, rows, parts=3):
    random.Random(len(rows)).shuffle(rows := list(rows))
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def roots(tree):
    return {tuple(r)[:-2]: (r.digest, r.n) for r in tree.roots().collect()}


@pytest.fixture(scope="module")
def plain(spark):
    return merkle.tree(frame(spark, rows_of(1500)), ["g"], ["k"], 20, 4)


def test_roots_follow_from_the_rows_alone(spark, plain):
    again = merkle.tree(frame(spark, rows_of(1500), 8), ["g"], ["k"], 20, 4, few=0)  # sums over ranges
    assert roots(again) == roots(plain) and {g: n for (g,), (_, n) in roots(plain).items()} == {g: sum(r[0] == g for r in rows_of(1500)) for g in ("a", "b", None)}
    fewer = rows_of(1500)
    fewer.remove(fewer[-1])  # one of three equal rows
    assert roots(merkle.tree(frame(spark, fewer), ["g"], ["k"], 20, 4)) != roots(plain)
    assert merkle.tree(frame(spark, []), ["g"], ["k"]).roots().count() == 0
    assert merkle.tree(frame(spark, rows_of(30)), [], ["k", "v"], 4, 2).roots().count() == 1


def test_ranges_by_the_book(spark):
    rows = rows_of(200)
    tree = merkle.tree(frame(spark, rows), [], ["k"], 10, 4)
    told = {}
    for r in rows:
        text = json.dumps(dict(zip("gkvx", r)), separators=(",", ":"))
        sha = hashlib.sha256(text.encode()).hexdigest()
        key = (r[1] is not None, r[1] or 0, sha)
        told[key] = told.get(key, 0) + 1
    ranges, own = [], []
    for key in sorted(told):
        if int(key[2][:8], 16) % 10 == 0 and own:
            ranges.append(own)
            own = []
        own.append(f"{key[2]}:{told[key]}")
    ranges.append(own)
    want = [hashlib.sha256("\n".join(x).encode()).hexdigest() for x in ranges]
    assert sorted(r.digest for r in tree.leaves().collect()) == sorted(want)


@pytest.mark.parametrize("change", ["edit", "add", "drop", "group", "none"])
def test_one_change_is_located_and_rehashed_alone(spark, plain, change):
    rows = rows_of(1500)
    at = 700
    touched = [(rows[at][0], rows[at][1])]
    if change == "edit":
        rows[at] = (*rows[at][:2], "new", rows[at][3])
    elif change == "add":
        rows.append((rows[at][0], rows[at][1], "more", 1.0))
    elif change == "drop":
        rows.remove(rows[at])
    elif change == "group":
        rows.append(("new", 5, "q", None))
        touched = [("new", 5)]
    new = frame(spark, rows)
    tree = merkle.tree(new, ["g"], ["k"], 20, 4)
    ranges, seen = plain.differing(tree)
    found = ranges.collect()
    assert len(found) <= 6 and (change == "none") == (not found)
    assert seen < 120 < tree.nodes.count()  # some fan a level, of all nodes
    got = merkle.changed_rows(frame(spark, rows_of(1500)), new, ["g"], ["k"], 20, 4).collect()
    assert sorted(r.side for r in got) == {"edit": ["left", "right"], "add": ["right"], "drop": ["left"], "group": ["right"], "none": []}[change]
    assert all((r.g, r.k) == touched[0] and r.n == 1 for r in got)
    again, hashed = plain.rehashed(new, spark.createDataFrame(touched, "g string, k long"))
    assert roots(again) == roots(tree) and hashed < 250
    assert {(r.g, r.digest) for r in again.leaves().collect()} == {(r.g, r.digest) for r in tree.leaves().collect()}


def test_many_changes_are_rehashed(spark, plain):
    """First rows of ranges among them, so that ranges join; keys before all others; a whole group that goes."""
    rng = random.Random(5)
    starts = {(r.g, r["first"].k) for r in plain.leaves().collect()}
    rows, touched, out = rows_of(1500), {("a", -5), ("b", 10**6)}, [("a", -5, "low", None), ("b", 10**6, "high", 2.0)]
    for r in rows:
        if r[0] is None or ((r[0], r[1]) in starts and rng.random() < 0.5) or rng.random() < 0.02:
            touched.add((r[0], r[1]))
            if r[0] is not None and rng.random() < 0.5:
                out.append((r[0], r[1], "edited", r[3]))
        else:
            out.append(r)
    new = frame(spark, out)
    again, _ = plain.rehashed(new, spark.createDataFrame(sorted(touched, key=str), "g string, k long"))
    assert roots(again) == roots(merkle.tree(new, ["g"], ["k"], 20, 4)) and (None,) not in roots(again)
    few, hashed = plain.rehashed(frame(spark, rows_of(1500)), spark.createDataFrame([], "g string, k long"))
    assert roots(few) == roots(plain) and hashed == 0


def test_changed_rows_hash_each_table_once(spark, monkeypatch):
    seen = []
    told = merkle._told
    monkeypatch.setattr(merkle, "_told", lambda *a: seen.append(1) or told(*a))
    old = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"), F.lit("x").alias("v"))
    new = old.withColumn("v", F.when(F.col("k") == 77, "y").otherwise(F.col("v"))).filter("k != 5").unionByName(old.filter("k = 9"))
    got = {(r.side, r.g, r.k, r.n) for r in merkle.changed_rows(old, new, ["g"], ["k"], 20, 4).collect()}
    assert got == {("left", 2, 77, 1), ("right", 2, 77, 1), ("left", 2, 5, 1), ("right", 0, 9, 1)} and len(seen) == 2
