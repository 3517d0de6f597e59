"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its lower-cased letter runs and their first four and six letters, each hashed into 2**18
bins. A whole word counts by presence, a beginning by its density. The model is

    logit p = b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

so a pair of terms (an insult and a group mention) has a weight of its own through <v_i, v_j>, which an additive
model lacks. Bins that rarely occur in the training rows, or whose classes differ by less than three standard errors,
are left out; the number of updates has a floor, so small training sets are fitted as fully as large ones.

Training rows are at most ``max_training`` labelled ids (a documented bound: the ones with the smallest hash of
their id, below a cut-off that a count of the labels gives, so that no task and not the driver sees more); they reach
the driver as sparse counts, never as texts, in the order of that hash, so the fit doesn't depend on the partitioning.
Scoring is one pass without a shuffle; the broadcast model has at most ``max_terms`` bins.

Cases: null and empty texts have no terms and get the intercept's probability. Labels that are null are left out;
of several labels of an id the largest counts, of several texts of an id the one with the least counts is learned. A null id has crc32 of the empty text. Without labels of both
classes every score is the (smoothed) share of the label. Repeated rows are scored alike, each on its own row;
an empty table gives an empty result. Very long texts are read whole. Other columns are not read.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, bucket_of, map_batches, named

BINS = 1 << 18
CACHED_WORDS = 400_000


class WordBins(dict):
    """word -> row of ``table`` with the bins of its three terms; bounded, forgotten when full."""

    def __init__(self, wanted: np.ndarray | None = None) -> None:
        self.table, self.wanted = np.full((1024, 3), -1, np.int32), wanted

    def __missing__(self, word: str) -> int:
        row = len(self)
        if row >= len(self.table):
            self.table = np.vstack([self.table, np.full_like(self.table, -1)])
        raw = word.encode("utf-8", "surrogatepass")
        found = [zlib.crc32(raw) % BINS, zlib.crc32(b"4:" + word[:4].encode("utf-8", "surrogatepass")) % BINS, zlib.crc32(b"6:" + word[:6].encode("utf-8", "surrogatepass")) % BINS]
        if self.wanted is not None:
            found = self.wanted[found]
        self.table[row] = found
        self[word] = row
        return row


def term_counts(texts: list[str | None], bins: WordBins) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bin, value) of the texts' terms, each (row, bin) once. Bins that aren't wanted (-1) are left out."""
    if len(bins) > CACHED_WORDS:
        bins.clear()
    words = [LETTERS.findall(t.lower()) if t else [] for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter(map(bins.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
    found, row = bins.table[flat], np.repeat(np.arange(len(words)), n)
    keys = []
    for kind in range(3):
        use = found[:, kind] >= 0
        key, count = np.unique(row[use] * (2 * BINS) + (kind > 0) * BINS + found[use, kind], return_counts=True)
        at = key // (2 * BINS)
        keys.append((at, key % BINS, np.ones(len(at)) if kind == 0 else np.minimum(2.0, 100.0 * count / (n[at] + 20))))
    row, at, value = (np.concatenate(x) for x in zip(*keys, strict=True))
    order = np.argsort(row, kind="stable")
    return row[order], at[order], value[order].astype(np.float32)


class FactorizationMachine:
    """Weights of the wanted bins; ``index`` maps a bin to its weights or -1."""

    def __init__(self, index: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray) -> None:
        self.index, self.bias, self.w, self.v = index, bias, w, v

    def logits(self, row: np.ndarray, at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.bias, np.float64)
        out += np.bincount(row, self.w[at] * x, n)
        for f in range(self.v.shape[1]):
            vx = self.v[at, f] * x
            out += 0.5 * (np.bincount(row, vx, n) ** 2 - np.bincount(row, vx * vx, n))
        return out

    def score(self, texts: list[str | None], bins: WordBins) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*term_counts(texts, bins), len(texts)), -30, 30)))


def fit(row: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, factors: int = 4, epochs: int = 12, updates: int = 1200, rate: float = 0.05, l2: float = 2e-4, least_rows: int = 3, least_z: float = 3.0, max_terms: int = 4096, seed: int = 7) -> FactorizationMachine:
    """AdaGrad on the logistic loss over mini-batches, in ``epochs`` passes and more until ``updates`` are made. Terms need ``least_rows``
    rows and a difference between the classes of ``least_z`` standard errors. Rows are 0..len(y)-1; entries come sorted
    by row."""
    rng, n = np.random.default_rng(seed), len(y)
    share = (y.sum() + 0.5) / (n + 1) if n else 0.5
    bias = float(np.log(share / (1 - share)))
    index = np.full(BINS, -1, np.int32)
    if n == 0 or y.min() == y.max():
        return FactorizationMachine(index, bias, np.zeros(0), np.zeros((0, factors)))
    df = np.bincount(at, minlength=BINS)
    mean1 = np.bincount(at, x * y[row], BINS) / y.sum()
    mean0 = np.bincount(at, x * (1 - y[row]), BINS) / (1 - y).sum()
    square = np.bincount(at, x * x, BINS) / n
    z = np.abs(mean1 - mean0) / np.sqrt(square / y.sum() + 1e-12)
    z[(df < least_rows) | (z < least_z)] = 0
    chosen = np.sort(np.argsort(-z, kind="stable")[:max_terms])
    chosen = chosen[z[chosen] > 0]
    index[chosen] = np.arange(len(chosen))
    use = index[at] >= 0
    row, at, x = row[use], index[at[use]], x[use].astype(np.float64)
    start = np.searchsorted(row, np.arange(n + 1))
    w, v = np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), factors))
    gw, gv, gb = np.full(len(w), 1e-2), np.full(v.shape, 1e-2), 1e-2
    for _ in range(max(epochs, -(-updates // -(-n // 128)))):
        order = rng.permutation(n)
        for at_row in range(0, n, 128):
            docs = order[at_row : at_row + 128]
            lens = start[docs + 1] - start[docs]
            pick = np.repeat(start[docs] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
            r, i, xs = np.repeat(np.arange(len(docs)), lens), at[pick], x[pick]
            vx = v[i] * xs[:, None]
            sums = np.stack([np.bincount(r, vx[:, f], len(docs)) for f in range(factors)], 1)
            square = np.stack([np.bincount(r, vx[:, f] ** 2, len(docs)) for f in range(factors)], 1)
            logit = bias + np.bincount(r, w[i] * xs, len(docs)) + 0.5 * (sums**2 - square).sum(1)
            err = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[docs]
            uniq, inv = np.unique(i, return_inverse=True)
            g = np.bincount(inv, err[r] * xs, len(uniq)) / len(docs) + l2 * w[uniq]
            gw[uniq] += g * g
            w[uniq] -= rate * g / np.sqrt(gw[uniq])
            part = err[r, None] * xs[:, None] * (sums[r] - vx)
            g2 = np.stack([np.bincount(inv, part[:, f], len(uniq)) for f in range(factors)], 1) / len(docs) + l2 * v[uniq]
            gv[uniq] += g2 * g2
            v[uniq] -= 0.5 * rate * g2 / np.sqrt(gv[uniq])
            gb += err.mean() ** 2
            bias -= rate * err.mean() / np.sqrt(gb)
    return FactorizationMachine(index, bias, w, v)


def training_counts(rows: DataFrame, id_type: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse term values and labels of labelled rows (_id, text, label), one an id, in the order of the ids' hashes;
    the caller bounds the number of ids."""

    def make():
        bins = WordBins()

        def step(cols: dict) -> dict:
            row, at, value = term_counts(cols["text"], bins)
            cut = np.searchsorted(row, np.arange(len(cols["text"]) + 1))
            parts = [np.argsort(at[a:b], kind="stable") + a for a, b in zip(cut, cut[1:])]
            return {"_id": cols["_id"], "label": cols["label"], "bins": [at[p].astype(np.int32).tobytes() for p in parts], "vals": [value[p].astype(np.float16).tobytes() for p in parts]}

        return step

    found = map_batches(rows, make, f"_id {id_type}, label int, bins binary, vals binary", rows=128)
    one = found.groupBy("_id").agg(F.min(F.struct("label", "bins", "vals")).alias("x")).select(F.xxhash64("_id").alias("h"), F.col("_id").cast("string").alias("i"), "x.*")
    got = one.toArrow().sort_by([("h", "ascending"), ("i", "ascending")])
    bins, vals = got["bins"].to_pylist(), got["vals"].to_pylist()
    y = np.array(got["label"].to_pylist(), np.float64)
    row = np.repeat(np.arange(len(y)), [len(b) // 4 for b in bins])
    return row, np.frombuffer(b"".join(bins), np.int32).astype(np.int64), np.frombuffer(b"".join(vals), np.float16).astype(np.float64), y


def few_labels(known: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of known (_id, label; one an id): those with the least hashes. A cut-off from the count
    lets through few more than are taken, so what the tasks sort is bounded as well."""
    n = known.count()
    if n > most:
        part = (most + 6 * most**0.5 + 100) / n
        known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) < int(min(1.0, part) * (1 << 40)))
    return known.orderBy(F.pmod(F.xxhash64("_id"), F.lit(1 << 40)), "_id").limit(most)


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", modulus: int = 4, held: int = 2, threshold: float = 0.3, max_training: int = 12_000) -> DataFrame:
    """id, held_out, score, predicted for every row."""
    texts, kind = docs.select(named(id_column).alias("_id"), named(text_column).alias("text")), docs.schema[id_column].dataType.simpleString()
    known = labels.select(named(id_column).alias("_id"), named(label_column).cast("int").alias("label")).dropna().groupBy("_id").agg(F.max("label").alias("label"))
    known = few_labels(known.filter(bucket_of("_id", modulus) != held), max_training)
    model = fit(*training_counts(texts.join(F.broadcast(known), "_id"), kind))  # at most max_training short rows
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value
        bins = WordBins(model.index)

        def step(cols: dict) -> dict:
            score = model.score(cols["text"], bins)
            return {"_id": cols["_id"], "held_out": cols["held_out"], "score": score, "predicted": (score >= threshold).astype(np.int32)}

        return step

    out = map_batches(texts.withColumn("held_out", bucket_of("_id", modulus) == held), make, f"_id {kind}, held_out boolean, score double, predicted int", rows=256)
    return out.withColumnRenamed("_id", id_column)
