"""Near-duplicate pairs by two signals, pruning and threshold sweeps over pair tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.vectors import dot, hamming
from quillon.operators import graph, metric

SEVERITY = {("test", "train"): 0, ("train", "val"): 1, ("test", "val"): 2}


def _banded(rows: DataFrame, bands: int) -> DataFrame:
    """Rows once for each band of their 64-bit word; words within ``bands - 1`` bits share a band."""
    width = 64 // bands
    words = [F.struct(F.lit(k).alias("band"), F.expr(f"shiftrightunsigned(word, {k * width}) & {(1 << width) - 1}L").alias("piece")) for k in range(bands)]
    return rows.withColumn("_b", F.explode(F.array(*words))).select("*", F.col("_b.band").alias("band"), F.col("_b.piece").alias("piece")).drop("_b")


def _signs(word: Column) -> Column:
    """A word's bits as +1 and -1: the inner product of two such vectors is 64 less twice the differing bits."""
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when(F.bit_get(word, k) == 1, 1.0).otherwise(-1.0))


def near_pairs(rows: DataFrame, max_hamming: int | None, min_cosine: float | None, mode: str = "both", within_class: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs i < j of rows (id, class_name, word, vector) with hamming and cosine, and the columns of ``carry`` of both ends.

    mode: both, any, hash or vector. Where the hash must agree within 15 bits, candidates come from equal bands of the word
    (pigeon hole). Other bounds on hash or vector are inner products, and candidates come from a metric index
    (``metric.MetricIndex``), which gives each of them once. ``any`` is those of the hash and then those of the vector that
    the hash doesn't give. A bound that is None is met by all rows; where no other holds, every pair of a class is a
    candidate. Rows with a null or non-finite component have no near vector.
    """
    on, base = (["class_name"] if within_class else []), ["class_name", "id", "word", "vector", *carry]
    rows = rows.select(*base)
    near = F.col("hamming") <= max_hamming if max_hamming is not None else F.lit(True)
    like = F.col("cosine") >= min_cosine if min_cosine is not None else F.lit(True)
    keep: Column = {"both": near & like, "any": near | like, "hash": near, "vector": like}[mode]
    out = [*on, "i", "j", "hamming", "cosine", *(f"{c}_{s}" for c in carry for s in "ij")]
    kept = ["word", *carry, *([] if within_class else ["class_name"])]
    bits = hamming(F.col("word_i"), F.col("word_j"))

    def banded() -> DataFrame:
        parts, keys = _banded(rows, max_hamming + 1), [*on, "band", "piece"]
        side = lambda s: parts.select(*keys, F.col("id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("word", "vector", *carry)))
        met = side("i").join(side("j"), keys).filter("i < j").withColumns({"hamming": bits, "cosine": dot(F.col("vector_i"), F.col("vector_j"))})
        return met.filter(keep).select(*out).distinct()  # a pair may share several bands

    def by_vector(least: float) -> DataFrame:
        met = metric.MetricIndex(rows.select(*on, "id", "vector", *kept), least, on).pairs()
        return met.withColumns({"hamming": bits, "cosine": F.col("product")}).filter(keep).select(*out)

    def by_hash() -> DataFrame:
        if max_hamming is not None and max_hamming < 16:
            return banded()
        given = rows.select(*on, "id", _signs(F.col("word")).alias("vector"), *kept, F.col("vector").alias("whole"))
        least = 64 - 2 * (64 if max_hamming is None else max_hamming)
        met = metric.MetricIndex(given.filter("word is not null"), least, on).pairs("whole")
        return met.withColumns({"hamming": bits, "cosine": F.col("beside")}).filter(keep).select(*out)

    small = max_hamming is not None and max_hamming < 16
    if mode == "hash" or mode == "both" and (small or min_cosine is None):
        return by_hash()
    if mode == "any" and min_cosine is not None and max_hamming is not None:
        told = F.coalesce(near, F.lit(False))
        return by_hash().filter(told).unionByName(by_vector(min_cosine).filter(~told))
    if mode == "any" or min_cosine is None:
        return by_hash() if min_cosine is not None else by_vector(float("-inf"))
    return by_vector(min_cosine)


def prune(pairs: DataFrame, keep_val_test: bool = False) -> DataFrame:
    """(id, partner, severity) of evaluation rows to drop, from pairs (i, j, split_i, split_j, hamming).

    Closed form of the greedy rule: rows linked to training go; then val rows go that are linked to a test row that
    stays. The partner is that of the first pair by (severity, hamming, ids).
    """
    both = pairs.select("i", "j", "split_i", "split_j", "hamming").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("split_j").alias("split_i"), F.col("split_i").alias("split_j"), "hamming"))
    first = F.min(F.struct("severity", "hamming", "j")).alias("m")
    one = both.filter("split_i != 'train' and split_j = 'train'").withColumn("severity", F.when(F.col("split_i") == "test", 0).otherwise(1))
    gone = one.groupBy(F.col("i").alias("id")).agg(first)
    if not keep_val_test:
        ids = gone.select(F.col("id"))
        two = both.filter("split_i = 'val' and split_j = 'test'").withColumn("severity", F.lit(2))
        two = two.join(ids.withColumnRenamed("id", "i"), "i", "left_anti").join(ids.withColumnRenamed("id", "j"), "j", "left_anti")
        gone = gone.unionByName(two.groupBy(F.col("i").alias("id")).agg(first))
    return gone.select("id", F.col("m.j").alias("partner"), F.col("m.severity").alias("severity"))


def sweep(pairs: DataFrame, grid: list[tuple[int, float]]) -> DataFrame:
    """(max_hamming, min_cosine, n_pairs, n_cross) over a small grid of thresholds, in one pass over the pairs."""
    cells = pairs.sparkSession.createDataFrame(grid, "max_hamming int, min_cosine double")
    met = pairs.crossJoin(F.broadcast(cells)).filter("hamming <= max_hamming and cosine >= min_cosine")
    counts = met.groupBy("max_hamming", "min_cosine").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("split_i") != F.col("split_j")).alias("n_cross"))
    return cells.join(counts, ["max_hamming", "min_cosine"], "left").na.fill(0, ["n_pairs", "n_cross"])


def across_classes(rows: DataFrame, min_cosine: float, n: int, leads: tuple[int, ...] = (64, 4096)) -> DataFrame:
    """The first n pairs i < j of different classes by (i, j) with at least the cosine; the limit is the feature. The rows of
    least id meet all others first: if these give n pairs, no later row can. Else all pairs come from the metric index."""
    graph._checkpoints(rows.sparkSession)
    given = rows.select("id", "class_name", "vector")
    for lead in leads:
        met = metric.led(given, min_cosine, lead)
        if met is not None:
            found = met.filter("class_name_i != class_name_j").orderBy("i", "j").limit(n).checkpoint()
            if found.count() == n:
                break
    else:
        met = metric.MetricIndex(given, min_cosine, []).pairs().filter("class_name_i != class_name_j")
        found = met.orderBy("i", "j").limit(n)
    return found.orderBy("i", "j").selectExpr("i", "j", "class_name_i as class_i", "class_name_j as class_j", "product as cosine")


def bands(pairs: DataFrame, edges: list[int]) -> DataFrame:
    """(band, n_pairs, n_cross) of pairs by Hamming distance; bands are closed at their upper edge, an open one follows."""
    band = F.lit(f"over {edges[-1]}")
    for low, high in reversed(list(zip([-1, *edges], edges))):
        band = F.when(F.col("hamming") <= high, f"{low + 1}-{high}").otherwise(band)
    return pairs.groupBy(band.alias("band")).agg(F.count("*").alias("n_pairs"), F.count_if(F.col("split_i") != F.col("split_j")).alias("n_cross"))
