"""Quality by a regularised quadratic discriminant over transformed document statistics.

One pass turns each whole text into a short vector of transformed statistics (log lengths, log-odds of character
classes, repetition, entropy, compressibility). Class means and covariances come from sums over all training rows,
added up in the executors. Each class covariance is shrunk towards the pooled one and towards a multiple of the
identity,

    S_c = (1 - a - g) S_c + a S_pooled + g mean(diag S_pooled) I

and factored once (Cholesky). A score is the logistic of the difference of the two classes'

    log pi_c - heat * (sum log diag L_c + |L_c^-1 (x - m_c)|^2 / 2),

where ``L_c^-1 (x - m_c)`` is solved by forward substitution with the cached factor. The statistics depend on each
other in ways a covariance doesn't hold, which makes plain densities overconfident: ``heat`` tempers them.

Cases: null and empty texts have the statistics of an empty text. Null labels are left out; of several labels of an
id the largest counts. A null id has crc32 of the empty text. Without training rows of both classes every score is
the (smoothed) share of the label. Repeated rows are scored alike, each on its own row; an empty table gives an
empty result. Very long texts are read whole. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bucket_of, filter_rows, map_batches, named

#: Byte classes: lower, upper, digit, space, line end, sentence mark, other ASCII mark, above ASCII.
CLASSES = np.full(256, 7)
CLASSES[:128] = 6
CLASSES[ord("a") : ord("z") + 1], CLASSES[ord("A") : ord("Z") + 1], CLASSES[ord("0") : ord("9") + 1] = 0, 1, 2
CLASSES[[9, 11, 12, 13, 32]], CLASSES[10] = 3, 4
CLASSES[[ord(c) for c in ".,;:'\"?-"]] = 5
SIZE = 19


def _odds(part: float, whole: float) -> float:
    """Smoothed log-odds of a share."""
    return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a text; all of it is read."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(CLASSES, seen, 8)
    words, lines = raw.split(), raw.split(b"\n")
    counts, ends = Counter(words), Counter(w[-1:] for w in words)
    m = len(words)
    lens = np.fromiter(map(len, words), np.float64, m) if m else np.zeros(1)
    share = seen[seen > 0] / max(n, 1)
    entropy = float(-(share * np.log(share)).sum())
    repeated = sum(a == b for a, b in zip(words, words[1:]))
    dup_lines = len(lines) - len(set(lines))
    packed = len(zlib.compress(raw, 1)) if n else 0
    marks = sum(v for k, v in ends.items() if k in (b"!", b"$", b"%", b"&", b"#", b"*", b"|"))
    return [
        np.log1p(n), np.log1p(m), np.log1p(lens.mean()), np.log1p(lens.std()), np.log1p(lens.max()),
        _odds(kinds[1], kinds[0] + kinds[1]), _odds(kinds[2], n), _odds(kinds[4], n), _odds(kinds[5], n), _odds(kinds[6], n), _odds(kinds[7], n),
        _odds(len(counts), m), _odds(max(counts.values(), default=0), m), _odds(repeated, m), _odds(dup_lines, len(lines)),
        entropy, np.log((packed + 20) / (n + 20)), _odds(marks, m), np.log1p(n / len(lines)),
    ]


def solved(factor: np.ndarray, right: np.ndarray) -> np.ndarray:
    """z with ``factor @ z = right`` for a lower triangle, by forward substitution over all columns at once."""
    z = np.empty_like(right)
    for k in range(len(factor)):
        z[k] = (right[k] - factor[k, :k] @ z[:k]) / factor[k, k]
    return z


class Discriminant:
    """Means, Cholesky factors and log priors of the two classes; None where a class has no rows."""

    def __init__(self, n: np.ndarray, sums: np.ndarray, squares: np.ndarray, to_pooled: float = 0.15, to_identity: float = 0.02, heat: float = 0.5) -> None:
        self.share, self.parts, self.heat = (n[1] + 0.5) / (n.sum() + 1), None, heat
        if n.min() < 1:
            return
        means = sums / n[:, None]
        own = squares / n[:, None, None] - means[:, :, None] * means[:, None, :]
        pooled = (own * n[:, None, None]).sum(0) / n.sum()
        ridge = max(np.trace(pooled) / len(pooled), 1e-6) * np.eye(len(pooled))
        # Few rows shrink further: a covariance of d columns needs several times d rows.
        more = np.minimum(1 - to_pooled - to_identity, 2 * len(pooled) / (n + 2 * len(pooled)))
        self.parts = []
        for c in (0, 1):
            a = to_pooled + more[c]
            cov = (1 - a - to_identity) * own[c] + a * pooled + to_identity * ridge
            factor = np.linalg.cholesky((cov + cov.T) / 2 + 1e-9 * np.eye(len(cov)))
            self.parts.append((means[c], factor, np.log(np.diag(factor)).sum(), np.log(n[c] / n.sum())))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Of rows of statistics: the probability of class 1."""
        if self.parts is None:
            return np.full(len(x), self.share)
        logs = [prior - self.heat * (half_det + 0.5 * (solved(factor, (x - mean).T) ** 2).sum(0)) for mean, factor, half_det, prior in self.parts]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -30, 30)))


def class_moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of outer products by label of (label, x) rows, added up in the executors."""
    width = 1 + SIZE + SIZE * SIZE

    def make():
        def step(cols: dict) -> dict:
            y, x = np.array(cols["label"]), np.array(cols["x"], np.float64).reshape(-1, SIZE)
            labels = sorted(set(cols["label"]))
            parts = [np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()]) for z in (x[y == c] for c in labels)]
            return {"label": labels, "sums": [p.tolist() for p in parts]}

        return step

    parts = map_batches(rows, make, "label int, sums array<double>", rows=8192)
    total = parts.select("label", F.posexplode("sums").alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v"))
    out = np.zeros((2, width))
    for label, at, v in total.collect():  # two labels x 1 + d + d*d sums
        out[label, at] = v
    return out[:, 0], out[:, 1 : 1 + SIZE], out[:, 1 + SIZE :].reshape(2, SIZE, SIZE)


def vectors_of(texts: DataFrame, *others: str) -> DataFrame:
    """(_id, the other columns, x) of every row of texts (_id, text and the others)."""

    def make():
        return lambda cols: {**{c: cols[c] for c in ("_id", *others)}, "x": [statistics(t) for t in cols["text"]]}

    kinds = [f"{c} {texts.schema[c].dataType.simpleString()}" for c in ("_id", *others)]
    return map_batches(texts, make, ", ".join([*kinds, "x array<double>"]), rows=256)


def training_labels(labels: DataFrame, id_column: str, label_column: str, modulus: int, held: int) -> DataFrame:
    """(_id, label) of the ids that may be learned from."""
    known = labels.select(named(id_column).alias("_id"), named(label_column).cast("int").alias("label")).dropna().filter("label in (0, 1)").groupBy("_id").agg(F.max("label").alias("label"))
    return known.filter(bucket_of("_id", modulus) != held)


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(named(id_column).alias("_id"), named(text_column).alias("text"))


def quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", modulus: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """id, held_out, score, predicted for every row."""
    ws = Workspace(docs.sparkSession, "quality")
    vectors = ws.save(vectors_of(_texts(docs, id_column, text_column)), "vectors")
    known = training_labels(labels, id_column, label_column, modulus, held)
    sent = docs.sparkSession.sparkContext.broadcast(Discriminant(*class_moments(vectors.join(known, "_id").select("label", "x"))))

    def scored():
        def step(cols: dict) -> dict:
            score = sent.value.score(np.array(cols["x"], np.float64).reshape(-1, SIZE))
            return {"_id": cols["_id"], "held_out": cols["held_out"], "score": score, "predicted": (score >= threshold).astype(np.int32)}

        return step

    kind = docs.schema[id_column].dataType.simpleString()
    out = map_batches(vectors.withColumn("held_out", bucket_of("_id", modulus) == held), scored, f"_id {kind}, held_out boolean, score double, predicted int", rows=8192)
    return out.withColumnRenamed("_id", id_column)


def of_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", modulus: int = 5, held: int = 0, threshold: float = 0.3, most: int = 1_000_000) -> DataFrame:
    """The rows of docs that are predicted 1, with all their columns; without training rows of both classes, all rows.

    The fit reads the statistics of labelled texts only: they are picked by a broadcast of up to ``most`` labels
    (counted first); more meet the statistics of all texts in a shuffled join."""
    ws = Workspace(docs.sparkSession, "quality")
    known = ws.save(training_labels(labels, id_column, label_column, modulus, held), "known")
    texts = _texts(docs, id_column, text_column)
    if known.count() <= most:
        rows = ws.save(vectors_of(texts.join(F.broadcast(known), "_id"), "label"), "rows")  # one Python worker a task
    else:
        rows = ws.save(vectors_of(texts), "vectors").join(known, "_id")
    model = Discriminant(*class_moments(rows.select("label", "x")))
    if model.parts is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: (sent.value.score(np.array([statistics(t) for t in texts]).reshape(-1, SIZE)) >= threshold).tolist()

    return filter_rows(docs, make, text_column)
