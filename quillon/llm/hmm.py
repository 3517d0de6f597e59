"""Language-model scores by a hidden Markov model.

Tokens are the words of the lower-cased text and one end. The emissions of the ``head`` most frequent training words
are learned state by state. All other words are emitted in two steps: the state emits one of a few tail classes (a
function of the word's form), the class emits the word with ``(c + 1) / (N_class + V_class + 1)``, where unknown words
are one event of their class. So every text has a proper probability,

    log10 P(text) = scaled forward recursion over heads and classes + sum over tail words of log10 P(word | class).

Word counts cover all rows; Baum-Welch runs over all training rows: tasks return expected counts, which are added up
in two levels by stretch of the vocabulary, and the driver re-estimates. Rounds over all rows go on until the gain in
log10 likelihood a token falls below ``gain``, ``rounds`` at most; the likelihoods are logged. Only the starting point
comes from a bounded sample (``start_rows`` ids, those with the least hash, and ``start_tokens`` tokens; a cut-off from
the row count keeps all others in the executors). The model that is broadcast has ``head`` words at most. Counts of tail words reach their documents through a shard-wise join of packed arrays; words that are frequent
anywhere are looked up in the broadcast table instead, so no shard holds a hot word.

The unigram base is the sum of log10((c + 1) / (N + V + 1)) over the same tokens.

Words are told apart by 59 bits of a hash and their class: of a billion distinct words less than one pair is expected
to be taken for one word.

Cases: null and empty texts are one end token. A null id has crc32 of the empty text. Without training rows c, N and
V are 0 and the model is uniform over the classes. Repeated rows and ids are scored row by row; an empty table gives
an empty result. Very long texts are read whole. Other columns are not read.
"""

from __future__ import annotations

import logging
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bucket_of, byte_words, map_batches, named, on_workers, shard_bits

LOG = logging.getLogger(__name__)
HEAD = 40_000
HELD_WORDS = 200_000  # distinct words that a task counts before it sends them
CLASSES = 32
LOW = np.uint64(CLASSES - 1)
STATES = 8
STRETCH = 512  # emission rows a packed part


def class_of(word: bytes) -> int:
    """Of 32: the last byte's kind (letter, sentence mark, digit, other), length and whether it is ASCII."""
    last = word[-1]
    kind = 0 if 97 <= last <= 122 or last >= 128 else 1 if last in b".,;:!?" else 2 if 48 <= last <= 57 else 3
    return kind * 8 + min(3, len(word) // 5) * 2 + (not word.isascii())


def key_of(word: bytes) -> int:
    return (xxhash.xxh3_64_intdigest(word) & ~(CLASSES - 1)) | class_of(word)


def _shards(keys: np.ndarray, bits: int) -> list[slice]:
    """Where each shard's stretch of sorted keys lies."""
    cut = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    return [slice(a, b) for a, b in zip(cut, np.r_[cut[1:], len(keys)])]


def word_counts(texts: DataFrame, bits: int, ws: Workspace) -> DataFrame:
    """(shard, keys, train, total): packed, sorted by key; counts in training rows and in all rows."""

    on_workers(texts.sparkSession)

    def packed(train: Counter, held: Counter) -> pa.RecordBatch:
        total = Counter(train)
        total.update(held)
        keys = np.fromiter(map(key_of, total), np.uint64, len(total))
        order = np.argsort(keys)
        all_n = np.fromiter(total.values(), np.int64, len(total))[order]
        train_n = np.fromiter(map(train.__getitem__, total), np.int64, len(total))[order]
        keys = keys[order]
        parts = [(k, s) for k, s in enumerate(_shards(keys, bits)) if s.stop > s.start]
        columns = [pa.array([k for k, _ in parts], pa.int32()), *(pa.array([x[s].tobytes() for _, s in parts], pa.binary()) for x in (keys, train_n, all_n))]
        return pa.RecordBatch.from_arrays(columns, ["shard", "keys", "train", "total"])

    def run(batches):
        """A task adds its words up and sends them when there are many, so a word comes a few times from each task."""
        train, held = Counter(), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for text, out in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    (held if out else train).update(byte_words(text))
                if len(train) + len(held) >= HELD_WORDS:
                    yield packed(train, held)
                    train, held = Counter(), Counter()
        if train or held:
            yield packed(train, held)

    schema = "shard int, keys binary, train binary, total binary"

    def add(key: tuple, table: pa.Table) -> pa.Table:
        keys, train, total = (np.concatenate([np.frombuffer(v, kind) for v in table[c].to_pylist()]) for c, kind in (("keys", np.uint64), ("train", np.int64), ("total", np.int64)))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        made = [keys[start].tobytes(), np.add.reduceat(train[order], start).tobytes(), np.add.reduceat(total[order], start).tobytes()]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in made)], names=["shard", "keys", "train", "total"])

    return ws.save(texts.mapInArrow(run, schema).groupBy("shard").applyInArrow(add, schema), "counts")


class Words:
    """What the driver knows of the counts: totals, classes' totals and the frequent words."""

    def __init__(self, counts: DataFrame, n_train: int, head: int) -> None:
        def summary():
            def step(cols: dict) -> dict:
                rows = []
                for keys, train, total in zip(cols["keys"], cols["train"], cols["total"]):
                    keys, train, total = np.frombuffer(keys, np.uint64), np.frombuffer(train, np.int64), np.frombuffer(total, np.int64)
                    value, freq = np.unique(total, return_counts=True)
                    rows += [("n", int(v), int(f)) for v, f in zip(value, freq)]
                    kind = (keys & LOW).astype(np.int64)
                    rows += [("N", c, int(x)) for c, x in enumerate(np.bincount(kind, train, CLASSES))]
                    rows += [("V", c, int(x)) for c, x in enumerate(np.bincount(kind, train > 0, CLASSES))]
                return {"what": [r[0] for r in rows], "at": [r[1] for r in rows], "n": [r[2] for r in rows]}

            return step

        found = map_batches(counts, summary, "what string, at bigint, n bigint", rows=8).groupBy("what", "at").agg(F.sum("n").alias("n")).collect()
        sizes = sorted(((r["at"], r["n"]) for r in found if r["what"] == "n"), reverse=True)
        least, held = 1 << 62, 0
        for value, n in sizes:  # the least count whose words all fit the table
            if held + n > head:
                break
            least, held = value, held + n
        self.class_n, self.class_v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for r in found:
            if r["what"] in "NV":
                (self.class_n if r["what"] == "N" else self.class_v)[r["at"]] = r["n"]
        self.tokens, self.types = int(self.class_n.sum()) + n_train, int(self.class_v.sum()) + (n_train > 0)

        def frequent():
            def step(cols: dict) -> dict:
                out: dict = {"key": [], "n": []}
                for keys, train, total in zip(cols["keys"], cols["train"], cols["total"]):
                    use = np.frombuffer(total, np.int64) >= least
                    out["key"] += np.frombuffer(keys, np.int64)[use].tolist()
                    out["n"] += np.frombuffer(train, np.int64)[use].tolist()
                return out

            return step

        table = map_batches(counts, frequent, "key bigint, n bigint", rows=8).toPandas()  # at most ``head`` rows
        keys, n = table["key"].to_numpy(np.int64).view(np.uint64), table["n"].to_numpy(np.int64)
        order = np.argsort(keys)
        self.keys, self.n = keys[order], n[order]
        #: ids: 0 the end, then the classes, then the frequent words of the training rows.
        known = self.n > 0
        kind = (self.keys & LOW).astype(np.int64)
        self.ids = np.where(known, CLASSES + np.cumsum(known), 1 + kind)
        self.size = 1 + CLASSES + int(known.sum())
        self.tail_n = self.class_n - np.bincount(kind[known], self.n[known], CLASSES).astype(np.int64)
        self.tail_v = self.class_v - np.bincount(kind[known], minlength=CLASSES)
        self.start = np.concatenate([[n_train], self.tail_n, self.n[known]]) + 1.0  # add-one unigram over ids


class Lookup(dict):
    """word -> row of a table of (id, training count, key); -1 as count means: ask the shards."""

    def __init__(self, words: Words) -> None:
        self.words = words
        self.known = {int(k): (int(i), int(n)) for k, i, n in zip(words.keys, words.ids, words.n)}
        self.ids, self.counts, self.keys = (np.zeros(1 << 16, t) for t in (np.uint16, np.int64, np.uint64))

    def __missing__(self, word: bytes) -> int:
        row = len(self)
        if row >= len(self.ids):
            self.ids, self.counts, self.keys = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ids, self.counts, self.keys))
        key = key_of(word)
        self.ids[row], self.counts[row] = self.known.get(key, (1 + (key & (CLASSES - 1)), -1))
        self.keys[row] = key
        self[word] = row
        return row


def sequences(texts: DataFrame, words, bits: int, ws: Workspace, id_type: str) -> DataFrame:
    """Rows of documents (row_id, _id, held_out, ids, n_tokens and what the frequent words give) and, with row_id
    null, packed tail words by shard: key, row offset from ``base``, count."""

    def make():
        table = words.value
        lookup = Lookup(table)

        def step(cols: dict) -> dict:
            if len(lookup) > 300_000:
                lookup.clear()
            split = [byte_words(t) for t in cols["text"]]
            lens = np.fromiter(map(len, split), np.int64, len(split))
            flat = np.fromiter(map(lookup.__getitem__, chain.from_iterable(split)), np.int64, int(lens.sum()))
            row = np.repeat(np.arange(len(split)), lens)
            ids, n = lookup.ids[flat], lookup.counts[flat]
            cut = np.r_[0, np.cumsum(lens)]
            here = n >= 0
            logs = np.bincount(row[here], np.log10(n[here] + 1.0), len(split))
            known = np.bincount(row[here], n[here] > 0, len(split)).astype(np.int64)
            unseen = here & (n == 0)  # frequent outside training only: an unknown word of its class
            kind = (lookup.keys[flat] & LOW).astype(np.int64)
            tails = np.bincount(row[unseen], -np.log10(table.tail_n[kind[unseen]] + table.tail_v[kind[unseen]] + 1.0), len(split))
            ends = np.zeros(1, np.uint16).tobytes()
            base = cols["row_id"][0] if len(split) else 0
            offset = np.array(cols["row_id"], np.int64) - base
            packed = np.stack([lookup.keys[flat[~here]], offset[row[~here]].astype(np.uint64)])
            packed = packed[:, np.lexsort((packed[1], packed[0]))]
            m = packed.shape[1]
            first = np.flatnonzero(np.r_[True, (packed[:, 1:] != packed[:, :-1]).any(0)]) if m else np.zeros(0, np.int64)
            count, packed = np.diff(np.r_[first, m]).astype(np.uint32), packed[:, first]
            parts = [(k, s) for k, s in enumerate(_shards(packed[0], bits)) if s.stop > s.start]
            none, p = [None] * len(parts), len(split)
            return {
                "row_id": cols["row_id"] + none, "_id": cols["_id"] + none, "held_out": cols["held_out"] + none, "n_tokens": (lens + 1).tolist() + none,
                "ids": [ids[a:b].tobytes() + ends for a, b in zip(cut, cut[1:])] + none, "logs": logs.tolist() + none, "known": known.tolist() + none, "tails": tails.tolist() + none,
                "shard": [None] * p + [k for k, _ in parts], "base": [None] * p + [base] * len(parts), "keys": [None] * p + [packed[0, s].tobytes() for _, s in parts],
                "offsets": [None] * p + [packed[1, s].astype(np.uint32).tobytes() for _, s in parts], "times": [None] * p + [count[s].tobytes() for _, s in parts],
            }

        return step

    schema = f"row_id bigint, _id {id_type}, held_out boolean, n_tokens bigint, ids binary, logs double, known bigint, tails double, shard int, base bigint, keys binary, offsets binary, times binary"
    return ws.save(map_batches(texts, make, schema, rows=1024), "sequences")


def tail_sums(found: DataFrame, counts: DataFrame, words) -> DataFrame:
    """(row_id, logs, known, tails) that the tail words add to their rows."""
    left = found.filter("row_id is null").select("shard", "base", "keys", "offsets", "times")

    def meet(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        table = words.value
        keys = np.frombuffer(held["keys"][0].as_py(), np.uint64) if held.num_rows else np.zeros(0, np.uint64)
        n = np.frombuffer(held["train"][0].as_py(), np.int64) if held.num_rows else np.zeros(0, np.int64)
        names, row_id, logs, known, tails = ["row_id", "logs", "known", "tails"], [], [], [], []
        for base, ask, offset, times in zip(*(asked[c].to_pylist() for c in ("base", "keys", "offsets", "times"))):
            ask, offset, times = np.frombuffer(ask, np.uint64), np.frombuffer(offset, np.uint32).astype(np.int64), np.frombuffer(times, np.uint32)
            at = np.minimum(np.searchsorted(keys, ask), max(len(keys) - 1, 0))
            c = np.where(keys[at] == ask, n[at], 0) if len(keys) else np.zeros(len(ask), np.int64)
            kind = (ask & LOW).astype(np.int64)
            rows, inverse = np.unique(offset, return_inverse=True)
            row_id.append(rows + base)
            logs.append(np.bincount(inverse, times * np.log10(c + 1.0)))
            known.append(np.bincount(inverse, times * (c > 0)).astype(np.int64))
            tails.append(np.bincount(inverse, times * (np.log10(c + 1.0) - np.log10(table.tail_n[kind] + table.tail_v[kind] + 1.0))))
        if not row_id:
            return pa.table({k: pa.array([], t) for k, t in zip(names, (pa.int64(), pa.float64(), pa.int64(), pa.float64()))})
        row_id, logs, known, tails = map(np.concatenate, (row_id, logs, known, tails))
        rows, inverse = np.unique(row_id, return_inverse=True)  # one row a document and shard
        return pa.table({"row_id": rows, "logs": np.bincount(inverse, logs), "known": np.bincount(inverse, known).astype(np.int64), "tails": np.bincount(inverse, tails)})

    met = left.groupBy("shard").cogroup(counts.select("shard", "keys", "train").groupBy("shard")).applyInArrow(meet, "row_id bigint, logs double, known bigint, tails double")
    return met.groupBy("row_id").agg(*(F.sum(c).alias(f"tail_{c}") for c in ("logs", "known", "tails")))


class Model:
    """Start, transition and emission probabilities; emissions by id first."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit

    def batches(self, ids: list[np.ndarray], most: int = 250_000):
        """Rows by length, longest first: (row numbers, time-major padded ids, rows still running at each time)."""
        order = sorted(range(len(ids)), key=lambda k: -len(ids[k]))
        at = 0
        while at < len(order):
            width = len(ids[order[at]])
            rows = order[at : at + max(1, min(1024, most // width))]
            lens = np.array([len(ids[k]) for k in rows])
            grid = np.zeros((width, len(rows)), np.int64)
            for c, k in enumerate(rows):
                grid[: lens[c], c] = ids[k]
            yield rows, grid, np.searchsorted(-lens, -np.arange(width))
            at += len(rows)

    def _forward(self, grid: np.ndarray, alive: np.ndarray, keep: bool):
        a, scales, kept = None, np.ones(grid.shape, self.emit.dtype), [] if keep else None
        for t, n in enumerate(alive):
            a = (self.start if t == 0 else a[:n] @ self.move) * self.emit[grid[t, :n]]
            s = a.sum(1)
            a /= s[:, None]
            scales[t, :n] = s
            if keep:
                kept.append(a)
        return scales, kept

    def log10(self, ids: list[np.ndarray]) -> np.ndarray:
        """Exact log10 probabilities of id sequences by the scaled forward recursion."""
        out = np.zeros(len(ids))
        for rows, grid, alive in self.batches(ids):
            out[rows] = np.log10(self._forward(grid, alive, False)[0]).sum(0)
        return out

    def expect(self, ids: list[np.ndarray], into: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
        """Adds expected start, transition and emission counts; returns the log10 likelihood."""
        start, move, emit = into
        total = 0.0
        for _, grid, alive in self.batches(ids):
            scales, kept = self._forward(grid, alive, True)
            total += float(np.log10(scales).sum(dtype=np.float64))
            b = np.ones((grid.shape[1], len(self.start)), self.emit.dtype)
            gammas, moved = [None] * len(alive), np.zeros_like(self.move)
            for t in range(len(alive) - 1, -1, -1):
                n = alive[t]
                gammas[t] = kept[t] * b[:n]
                if t:
                    x = self.emit[grid[t, :n]] * b[:n] / scales[t, :n, None]
                    moved += kept[t - 1][:n].T @ x
                    b[:n] = x @ self.move.T
            start += gammas[0].sum(0)
            move += moved * self.move
            flat = np.concatenate([grid[t, :n] for t, n in enumerate(alive)])
            gamma = np.concatenate(gammas)
            for k in range(emit.shape[1]):
                emit[:, k] += np.bincount(flat, gamma[:, k], len(emit))
        return total

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray, prior: float = 200.0) -> Model:
        """Re-estimates; each state's emissions are smoothed by ``prior`` draws from the unigram distribution."""
        prior_draws = prior * unigram / unigram.sum()
        emit = (emit + prior_draws[:, None]) / (emit.sum(0) + prior)
        return Model((start + 0.1) / (start.sum() + 0.1 * len(start)), (move + 0.1) / (move.sum(1, keepdims=True) + 0.1 * len(start)), emit)


def _zeros(size: int, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(states), np.zeros((states, states)), np.zeros((size, states))


def started(ids: list[np.ndarray], words: Words, states: int, rounds: int = 10, seed: int = 11) -> Model:
    """A starting point from few sequences: states leave seldom at first, each begins with random whole sequences."""
    rng = np.random.default_rng(seed)
    start, move, emit = _zeros(words.size, states)
    start += 1
    move += np.eye(states) * 20 + 1
    for x in ids:
        emit[:, rng.integers(states)] += np.bincount(x, minlength=words.size)
    for _ in range(rounds):
        model = Model.from_counts(start, move, emit, words.start)
        start, move, emit = counts = _zeros(words.size, states)
        model.expect(ids, counts)
    return Model.from_counts(start, move, emit, words.start)


def baum_welch(training: DataFrame, model: Model, words: Words) -> tuple[Model, float]:
    """One round over all training sequences: the next model, and the log10 likelihood under the given one. Expected
    counts are added up by stretch of the emissions, in two levels."""
    states, size = len(model.start), words.size
    quick = Model(*(x.astype(np.float32) for x in (model.start, model.move, model.emit)))
    sent = training.sparkSession.sparkContext.broadcast(quick)

    def run(batches):
        counts, total = _zeros(size, states), 0.0
        for batch in batches:
            total += sent.value.expect([np.frombuffer(x, np.uint16) for x in batch.column(0).to_pylist()], counts)
        salt = TaskContext.get().partitionId() // 256
        start, move, emit = counts
        parts = [(-1, np.r_[total, start, move.ravel()])] + [(k, emit[k : k + STRETCH].ravel()) for k in range(0, size, STRETCH)]
        yield pa.RecordBatch.from_pydict({"part": [p for p, _ in parts], "salt": [salt] * len(parts), "sums": [x.astype(np.float32 if p >= 0 else np.float64).tobytes() for p, x in parts]}, pa.schema([("part", pa.int32()), ("salt", pa.int32()), ("sums", pa.binary())]))

    def add(key: tuple, table: pa.Table) -> pa.Table:
        kind = np.float32 if key[0].as_py() >= 0 else np.float64
        total = sum(np.frombuffer(x, kind).astype(np.float64) for x in table["sums"].to_pylist())
        return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([total.astype(kind).tobytes()], pa.binary())], names=["part", "salt", "sums"][: len(key)] + ["sums"])

    parts = training.select("ids").mapInArrow(run, "part int, salt int, sums binary")
    level = parts.groupBy("part", "salt").applyInArrow(add, "part int, salt int, sums binary")
    (start, move, emit), total = _zeros(size, states), 0.0
    for part, sums in level.select("part", "sums").groupBy("part").applyInArrow(add, "part int, sums binary").collect():  # the model's size
        if part < 0:
            x = np.frombuffer(sums, np.float64)
            total, start, move = float(x[0]), x[1 : states + 1], x[states + 1 :].reshape(states, states)
        else:
            x = np.frombuffer(sums, np.float32).reshape(-1, states)
            emit[part : part + len(x)] = x
    sent.destroy()
    return Model.from_counts(start, move, emit, words.start), total


def starting_rows(training: DataFrame, n: int, most: int, most_tokens: int) -> list[np.ndarray]:
    """Sequences of at most ``most`` ids and ``most_tokens`` tokens: those of the least hashes, one an id, the shortest
    of an id that repeats. A cut-off from the row count n leaves few more than are taken; rows of more than a twentieth
    of the tokens are passed over."""
    hashed = training.select("_id", "n_tokens", "ids", F.pmod(F.xxhash64("_id"), F.lit(1 << 40)).alias("h"))
    part = min(1.0, (most + 6 * most**0.5 + 100) / max(n, 1))
    few = hashed.filter((F.col("h") < int(part * (1 << 40))) & (F.col("n_tokens") <= most_tokens // 20))
    few = few.groupBy("h", "_id").agg(F.min(F.struct("n_tokens", F.xxhash64("ids").alias("x"))).alias("k")).select("h", "_id", "k.*")
    chosen, left = [], most_tokens
    for r in sorted(few.collect(), key=lambda r: (r["h"], str(r["_id"]))):  # a few numbers a row, some ``most`` rows
        if len(chosen) < most and r["n_tokens"] <= left:
            chosen.append((r["h"], r["n_tokens"], r["x"]))
            left -= r["n_tokens"]
    if not chosen:
        return []
    wanted = training.sparkSession.createDataFrame(chosen, "h bigint, n_tokens bigint, x bigint").distinct()
    met = hashed.withColumn("x", F.xxhash64("ids")).join(F.broadcast(wanted), ["h", "n_tokens", "x"], "left_semi")
    rows = met.groupBy("h", "n_tokens", "x").agg(F.min("ids").alias("ids")).collect()
    return [np.frombuffer(r["ids"], np.uint16) for r in sorted(rows, key=lambda r: (r["h"], r["n_tokens"], r["x"]))]


def hmm_scores(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", modulus: int = 7, held: int = 2, states: int = STATES, rounds: int = 4, gain: float = 0.01, head: int = HEAD, start_rows: int = 1500, start_tokens: int = 2_000_000) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    if head + CLASSES + 1 > 1 << 16:
        raise ValueError("head: ids of words are 16-bit numbers")
    spark = docs.sparkSession
    ws, bits = Workspace(spark, "hmm"), shard_bits(spark)
    id_type = docs.schema[id_column].dataType.simpleString()
    texts = docs.select(F.monotonically_increasing_id().alias("row_id"), named(id_column).alias("_id"), named(text_column).alias("text")).withColumn("held_out", bucket_of("_id", modulus) == held)
    counts = word_counts(texts.select("text", "held_out"), bits, ws)
    n_train = texts.filter("not held_out").count()
    words = Words(counts, n_train, head)
    sent = spark.sparkContext.broadcast(words)
    found = sequences(texts, sent, bits, ws, id_type)
    tails = ws.save(tail_sums(found, counts, sent), "tails")
    rows = found.filter("row_id is not null")
    training = rows.filter("not held_out")
    model, before = started(starting_rows(training, n_train, start_rows, start_tokens), words, states), None
    for k in range(rounds):
        model, found_log = baum_welch(training, model, words)
        per_token = found_log / max(words.tokens, 1)
        LOG.info("round %d over all rows: log10 likelihood a token %.5f before it", k + 1, per_token)
        if before is not None and per_token - before < gain:
            break
        before = per_token
    final = spark.sparkContext.broadcast(model)

    def make():
        def step(cols: dict) -> dict:
            ids = [np.frombuffer(x, np.uint16) for x in cols["ids"]]
            return {k: v for k, v in cols.items() if k != "ids"} | {"forward": final.value.log10(ids)}

        return step

    kept = ("row_id", "_id", "held_out", "n_tokens", "logs", "known", "tails")
    scored = map_batches(rows.select(*kept, "ids"), make, f"row_id bigint, _id {id_type}, held_out boolean, n_tokens bigint, logs double, known bigint, tails double, forward double", rows=2048)
    both = scored.join(tails, "row_id", "left").na.fill(0, ["tail_logs", "tail_known", "tail_tails"])
    end, scale = float(np.log10(n_train + 1.0)), float(np.log10(words.tokens + words.types + 1.0))
    return both.select(
        F.col("_id").alias(id_column), "held_out", "n_tokens", (F.col("known") + F.col("tail_known") + F.lit(int(n_train > 0))).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("tail_logs") + F.lit(end) - F.col("n_tokens") * F.lit(scale)).alias("base_score"), (F.col("forward") + F.col("tails") + F.col("tail_tails")).alias("score"),
    )
