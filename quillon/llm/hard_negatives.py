"""Hard-negative mining by k-means inverted lists with stored radii; exact.

A vector's components become ``floor(scale * x)``; a score is the inner product of two such vectors, a whole number. An
anchor's positives are its best other rows of the same label; a positive's negatives are the best rows of other labels
whose score lies between ``least`` and ``most`` percent of the positive's. Equal scores go by ascending id.

The index deals every row into one of K lists by its nearest centre (K is the square root of the rows, ``MOST_LISTS`` at
most; the centres are fitted on ``SAMPLE`` rows of least hash at most, the only thing a sample decides: it changes how
much is skipped, never the result). A list stores its radius r, the largest distance of a row to the centre c. Scores of
its rows with an anchor a lie within ``a.c - |a| r`` and ``a.c + |a| r`` (Cauchy-Schwarz).

An anchor visits lists by descending upper bound, in waves of ``WAVES`` lists; between waves the k-th best score so far
is summed up, and a list whose upper bound falls strictly below it is not visited, nor are lists outside the window. In a
wave, a list's rows (in parts of some ``ROWS``) meet the anchors that visit it (in packs of some ``ANCHORS``) by a shuffle on
list, part and pack; each pair of them is one matrix product, and an anchor takes its k best from there. So no task
holds a whole list, and work is what the bounds leave: all rows for each anchor at worst.

Products whose size could pass 2**53 are taken in whole numbers of any length and clipped to 62 bits and a sign.

Cases: rows with a null id, label or vector, or with any null or non-finite component, take no part. Shorter vectors
count as padded with zeros; an empty vector scores 0 with all. Rows that share an id are rows of their own: each anchor
row has its results, and a row is never its own positive. An anchor without positives, and a positive without negatives,
give no rows. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, map_batches, named, on_workers

MOST_LISTS, SAMPLE, MOST_CENTRE_NUMBERS = 4096, 16_384, 1 << 22
WAVES = (4, 32)  # lists an anchor has visited after the first waves; the last wave takes what is left
ROWS, ANCHORS = 2048, 1024
FIT_ROUNDS = 6
EXACT = float(1 << 53)
TOP = (1 << 62) - 1


def centres_of(sample: np.ndarray, k: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Lloyd's rounds from ``k`` rows of the sample; a centre without rows stays where it is."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(np.int64)].copy()
    for _ in range(rounds):
        at = nearest(sample, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        n = np.bincount(at, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.empty(len(rows), np.int64)
    squares = (centres**2).sum(1)
    for k in range(0, len(rows), 1024):
        at[k : k + 1024] = (squares - 2 * rows[k : k + 1024] @ centres.T).argmin(1)
    return at, np.sqrt(((rows - centres[at]) ** 2).sum(1))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, clipped to 62 bits and a sign."""
    if np.sqrt((a**2).sum(1).max(initial=0) * (x**2).sum(1).max(initial=0)) < EXACT / 2:
        return (a @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(x).T, -TOP, TOP).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, use: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores among ``use``, equal ones by ascending id."""
    at = np.flatnonzero(use)
    if len(at) > k:
        s = score[at]
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return at[np.lexsort((ids[at], -score[at]))][:k]


class InvertedLists:
    """``rows``: (row, id, label, vec, cell), written; ``centres``, ``radius`` and ``count`` by list: bounded, on the driver."""

    def __init__(self, vectors: DataFrame, id_column: str, vector_column: str, label_column: str, scale: int = 256, lists: int | None = None) -> None:
        spark = vectors.sparkSession
        self.ws, self.compared = Workspace(spark, "negatives"), 0
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        rows = vectors.select(named(id_column).cast("long").alias("id"), named(label_column).cast("long").alias("label"), named(vector_column).cast("array<double>").alias("v"))
        rows = rows.filter("id is not null and label is not null and v is not null").filter(fine)
        rows = self.ws.save(rows.select("id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("vec")).withColumn("row", F.monotonically_increasing_id()), "read")
        size = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
        n, self.width = size["n"], max(1, size["width"] or 1)
        most = max(1, min(MOST_LISTS, MOST_CENTRE_NUMBERS // self.width))
        k = max(1, min(most, lists or round(n**0.5)))
        rows = rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(self.width) - F.size("vec"))))
        take = max(k, min(SAMPLE, 4 * MOST_CENTRE_NUMBERS // self.width))
        cut = int(min(1.0, take / max(n, 1)) * (1 << 32))
        drawn = rows.filter(F.shiftrightunsigned(F.xxhash64("id", "row"), 32) < cut) if n > take else rows
        sample = matrix(drawn.select("vec").limit(2 * take).toArrow()["vec"], self.width)
        self.centres = centres_of(sample, min(k, len(sample))) if len(sample) else np.zeros((1, self.width))
        sent, width = spark.sparkContext.broadcast(self.centres), self.width
        on_workers(spark)

        def dealt(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    cell, far = nearest(matrix(part.column("vec"), width), sent.value)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(far)], [*part.schema.names, "cell", "far"])

        rows = rows.select("row", "id", "label", "vec")
        self.rows = self.ws.save(rows.mapInArrow(dealt, "row bigint, id bigint, label bigint, vec array<double>, cell int, far double"), "lists")
        self.radius, self.count = np.zeros(len(self.centres)), np.zeros(len(self.centres), np.int64)
        for cell, far, m in self.rows.groupBy("cell").agg(F.max("far"), F.count("*")).collect():
            self.radius[cell], self.count[cell] = far, m
        self.ws.drop("read")

    def visits(self, anchors: DataFrame, first: int, last: int) -> DataFrame:
        """(cell, row, label, vec, slots): lists ``first`` to ``last`` of each anchor's order that its bounds leave. ``slots``: (slot,
        lo, hi, bar) of each search, bar being the k-th score so far."""
        sent, width = self.rows.sparkSession.sparkContext.broadcast((self.centres, self.radius, self.count)), self.width

        def run(batches):
            centres, radius, count = sent.value
            far = np.sqrt((centres**2).sum(1)) + radius
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    a = matrix(part.column("vec"), width)
                    norm, middle = np.sqrt((a**2).sum(1)), a @ centres.T
                    take, cells = [], []
                    for k, slots in enumerate(part.column("slots").to_pylist()):
                        spare = norm[k] * radius + 1e-9 * norm[k] * far + 1  # rounding
                        up, low = np.clip(middle[k] + spare, -TOP, TOP), np.clip(middle[k] - spare, -TOP, TOP)  # as scores are
                        lo = np.array([float(s["lo"]) for s in slots])
                        hi, bar = np.array([float(s["hi"]) for s in slots]), np.array([float(s["bar"]) for s in slots])
                        open_ = (count > 0) & (up >= lo.min()) & (low <= hi.max())
                        order = np.flatnonzero(open_)
                        order = order[np.argsort(-up[order], kind="stable")][first:last]
                        left = ((up[order, None] >= np.maximum(lo, bar)) & (low[order, None] <= hi)).any(1)
                        cells.append(order[left])
                        take.append(np.full(int(left.sum()), k))
                    take = np.concatenate(take)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells), pa.int32()), *(c.take(pa.array(take)) for c in part.columns)], ["cell", *part.schema.names])

        return anchors.select("row", "label", "vec", "slots").mapInArrow(run, "cell int, row bigint, label bigint, vec array<double>, slots array<struct<slot: int, lo: bigint, hi: bigint, bar: bigint>>")

    def search(self, anchors: DataFrame, slots: DataFrame, k: int, same: bool, tag: str) -> DataFrame:
        """(row, slot, rank, id, score): the ``k`` best rows of the same label, or of other ones, for each slot (row, slot, lo, hi)
        of an anchor, with scores from lo to hi."""
        width, found = self.width, None
        on_workers(self.rows.sparkSession)
        schema = "row bigint, slot int, score bigint, id bigint"
        ends = [0, *WAVES, len(self.centres)]
        for wave, (first, last) in enumerate(zip(ends, ends[1:])):
            if first >= last:
                continue
            if found is None:
                barred = slots.withColumn("bar", F.lit(-TOP))
            else:
                full = found.groupBy("row", "slot").agg(F.min("score").alias("bar"), F.count("*").alias("n")).filter(F.col("n") == k).drop("n")
                barred = slots.join(full, ["row", "slot"], "left").withColumn("bar", F.coalesce("bar", F.lit(-TOP)))
            by_anchor = barred.groupBy("row").agg(F.collect_list(F.struct("slot", "lo", "hi", "bar")).alias("slots"))
            visits = self.ws.save(self.visits(anchors.join(by_anchor, "row"), first, last), f"{tag}{wave}")
            sizes = visits.groupBy("cell").count().collect()  # MOST_LISTS rows at most
            if not sizes:
                continue
            self.compared += sum(n * int(self.count[cell]) for cell, n in sizes)
            places = self.rows.sparkSession.createDataFrame([(cell, -(-int(self.count[cell]) // ROWS), -(-n // ANCHORS)) for cell, n in sizes], "cell int, parts int, packs int")
            dealt = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
            every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
            left = self.rows.join(F.broadcast(places), "cell").select("cell", dealt("parts").alias("part"), every("packs").alias("pack"), "row", "id", "label", "vec")
            right = visits.join(F.broadcast(places), "cell").select("cell", every("parts").alias("part"), dealt("packs").alias("pack"), "row", "label", "vec", "slots")

            def met(rows: pa.Table, asking: pa.Table) -> pa.Table:
                out: list[list] = [[], [], [], []]
                if rows.num_rows and asking.num_rows:
                    ids, labels, own = (rows[c].to_numpy() for c in ("id", "label", "row"))
                    scores = products(matrix(asking["vec"], width), matrix(rows["vec"], width))
                    for score, row, label, wanted in zip(scores, asking["row"].to_pylist(), asking["label"].to_pylist(), asking["slots"].to_pylist()):
                        right_label = (labels == label) & (own != row) if same else labels != label
                        for s in wanted:
                            at = best(score, ids, right_label & (score >= max(s["lo"], s["bar"])) & (score <= s["hi"]), k)
                            for c, v in zip(out, (np.full(len(at), row), np.full(len(at), s["slot"]), score[at], ids[at])):
                                c.append(v)
                flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
                return pa.table({n: pa.array(c, t) for n, c, t in zip(("row", "slot", "score", "id"), flat, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))})

            keys = ["cell", "part", "pack"]
            new = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(met, schema)
            ranked = F.row_number().over(Window.partitionBy("row", "slot").orderBy(F.desc("score"), "id"))
            both = new if found is None else found.select("row", "slot", "score", "id").unionByName(new)
            found = self.ws.save(both.withColumn("rank", ranked).filter(F.col("rank") <= k), f"{tag}found{wave}")
        return found if found is not None else self.rows.sparkSession.createDataFrame([], schema + ", rank int")


def hard_negatives(vectors: DataFrame, anchor: Column, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, scale: int = 256, index: InvertedLists | None = None) -> DataFrame:
    """One row a negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``anchor``: a condition on
    ``id``, ``label`` or ``vec`` that tells the anchors."""
    index = index or InvertedLists(vectors, id_column, vector_column, label_column, scale)
    ws = index.ws
    anchors = ws.save(index.rows.filter(anchor).select("row", "id", "label", "vec"), "anchors")
    all_scores = anchors.select("row", F.lit(1).alias("slot"), F.lit(-TOP).alias("lo"), F.lit(TOP).alias("hi"))
    good = index.search(anchors, all_scores, positives, True, "positive")
    good = ws.save(good.select("row", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "good")
    # 100 * score lies between least * positive_score and most * positive_score, in whole numbers
    hundreds, rest = "((positive_score - pmod(positive_score, 100)) div 100)", "pmod(positive_score, 100)"
    hi = F.expr(f"{hundreds} * {most} + ({rest} * {most}) div 100")
    lo = F.expr(f"{hundreds} * {least} + ({rest} * {least} + 99) div 100")
    windows = good.select("row", "slot", lo.alias("lo"), hi.alias("hi")).filter("lo <= hi")
    bad = index.search(anchors, windows, negatives, False, "negative")
    out = bad.select("row", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(good, ["row", "slot"])
    return out.join(anchors.select("row", F.col("id").alias("anchor_id")), "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
