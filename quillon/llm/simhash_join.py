"""SimHash near-duplicates by covering locality-sensitive hashing: no pair within the radius is missed.

A text's fingerprint has bit k set if more than half of its three-word shingles (repeats included) have bit k set in
their XXH64. Equal fingerprints are one node. Two nodes link when at most ``radius`` bits differ.

Each of the 64 bit places gets a non-zero vector of ``radius + 1`` bits, in turn. Each non-zero vector v of that length
is a table, whose mask keeps the places with an odd product with v. At most ``radius`` differing places span less than
all vectors, so some v is orthogonal to them: its mask keeps none of them, and the pair has one key in that table. With
radius 2 these are 7 tables of 36 or 37 places.

A bucket of more than ``most`` nodes isn't compared all with all: it is covered again by the same rule over the places
that its mask left out, which are at most ``radius`` in the pair's difference as before. Left-out places go from 64 to
27, 11 and 5, so after three levels a bucket has at most 2**6 nodes, and a bucket of m nodes makes at most 343 m rows
and no m * m pairs. A pair is taken from the first table at each level that it meets in, so it is made once.

Cases: null and empty texts, and those without words, have the fingerprint zero and link like any other. Texts of fewer
than three words are one shingle of all their words. Rows are judged one by one: repeated rows or ids link by their
texts; a null id takes part but is no component's id unless the component has no other. An empty table gives an empty
result. Texts are read whole, as lists of words. Other columns are not read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, byte_words, map_batches, met_evenly, named
from .graph import components

SEED = 42
MOST = 64  # nodes of a bucket that are compared with one another


def fingerprint(text: str | None, size: int = 3) -> int:
    words = byte_words(text)
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)))) if len(words) >= size else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, max(1, len(words) - size + 1))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def covering(places: list[int], radius: int) -> list[int]:
    """Masks over ``places``: any ``radius`` of them are left out by at least one."""
    top = 1 << (radius + 1)
    return [sum(1 << p for k, p in enumerate(places) if ((1 + k % (top - 1)) & v).bit_count() % 2) for v in range(1, top)]


def tables(paths: list[tuple[int, int, list[int]]], radius: int) -> list[tuple[int, int, int, list[int]]]:
    """(parent, path, mask, masks of earlier tables on the way) below each (path, mask, earlier) of the level above."""
    out = []
    for path, mask, before in paths:
        own: list[int] = []
        for sub in covering([p for p in range(64) if not mask >> p & 1], radius):
            out.append((path, len(out), mask | sub, [*before, *own]))
            own.append(mask | sub)
    return out


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def linked(nodes: DataFrame, ws: Workspace, radius: int, most: int = MOST) -> DataFrame:
    """(a, b): each pair of distinct fingerprints ``fp`` of the written table ``nodes`` within the radius, once."""
    spark = nodes.sparkSession
    found, level, open_rows = spark.createDataFrame([], "a bigint, b bigint"), [(0, 0, [])], None
    for k in range(64):
        made = tables(level, radius)
        masks = spark.createDataFrame([(a, b, signed(m), [signed(x) for x in e]) for a, b, m, e in made], "parent int, path int, mask bigint, earlier array<bigint>")
        if open_rows is None:  # every node in each table
            first = F.array(*(F.struct(F.lit(path).alias("path"), F.lit(signed(m)).cast("long").alias("mask")) for _, path, m, _ in made))
            met = nodes.select("fp", F.explode(first).alias("t")).select("fp", "t.path", "t.mask")
        else:
            met = open_rows.join(F.broadcast(masks.drop("earlier")), "parent")
        keyed = ws.save(met.select("path", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"), f"keyed{k}")
        size = ws.save(keyed.groupBy("path", "key").agg(F.count("*").alias("size")).filter("size > 1"), f"size{k}")
        held = ws.save(met_evenly(keyed, size, ["path", "key"], "size"), f"held{k}")
        small, large = held.filter(F.col("size") <= most), held.filter(F.col("size") > most)
        pairs = small.select("path", "key", F.col("fp").alias("a")).join(small.select("path", "key", F.col("fp").alias("b")), ["path", "key"])
        differ = F.col("a").bitwiseXOR(F.col("b"))
        pairs = pairs.filter((F.col("a") < F.col("b")) & (F.bit_count(differ) <= radius)).join(F.broadcast(masks.select("path", "earlier")), "path")
        first = F.forall("earlier", lambda m: differ.bitwiseAND(m) != 0)
        found = found.unionByName(ws.save(pairs.filter(first).select("a", "b"), f"pairs{k}"))
        ws.drop(f"keyed{k}", f"size{k}", *([f"held{k - 1}"] if k else []))
        if large.isEmpty():
            break
        level, open_rows = [(path, mask, before) for _, path, mask, before in made], large.select("fp", F.col("path").alias("parent"))
    return found


def simhash_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 3, radius: int = 2, most: int = MOST) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (least id reachable by links), n_links (other
    fingerprints within the radius) and n_copies (rows of the same fingerprint)."""
    if not 0 <= radius <= 3:
        raise ValueError("radius: 0 to 3")
    ws = Workspace(docs.sparkSession, "simhash")
    id_type = docs.schema[id_column].dataType.simpleString()

    def make():
        return lambda cols: {"_id": cols["_id"], "fp": [fingerprint(t, size) for t in cols["text"]]}

    texts = docs.select(named(id_column).alias("_id"), named(text_column).alias("text"))
    rows = ws.save(map_batches(texts, make, f"_id {id_type}, fp bigint", rows=256), "rows")
    nodes = ws.save(rows.groupBy("fp").agg(F.min("_id").alias("min_id"), F.count("*").alias("n_copies")), "nodes")
    links = linked(nodes, ws, radius, max(most, 1 << 6)) if radius else docs.sparkSession.createDataFrame([], "a bigint, b bigint")
    comps = components(links, ws, "comp").withColumnRenamed("node", "fp")
    degree = links.select("a").unionAll(links.select("b")).groupBy(F.col("a").alias("fp")).agg(F.count("*").alias("n_links"))
    member = nodes.join(comps, "fp", "left").join(degree, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    member = ws.save(member, "member")
    least = member.groupBy("comp").agg(F.min("min_id").alias("component_id"))
    told = ws.save(member.join(least, "comp").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"), "told")
    out = met_evenly(rows, told, ["fp"], "n_copies")
    return out.select(F.col("_id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links", "n_copies")
