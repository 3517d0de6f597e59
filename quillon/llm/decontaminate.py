"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of letters and digits. A document and a benchmark item that share a run of ``seed``
words become a pair. A count over all items at once tells how much of each the document's runs of ``least`` words cover,
which tiles can't exceed, so a phrase that thousands of items open with costs one count. The pairs left are tiled by
running Karp-Rabin matching: rolling hashes find the longest common run, tiles of its length are marked, marked words
take no further part, and the length falls until ``least``. As tiles may stand in any order, a passage whose sentences were moved is covered like an untouched one.
A document is contaminated by an item when the tiles cover at least ``threshold`` of its words, or when one tile has
``verbatim`` words or more, which shows a long item that is quoted in part.

The benchmark is a query set: it is sent to the executors in blocks of at most ``block_words`` words (a proven
bound, whatever its size), and each block reads the documents once. No pair leaves the task that found it and
nothing is shuffled.

Cases: null texts have no words. Items shorter than ``seed`` words are found by a run of all their words. Items
without words match nothing. Repeated rows and ids are judged row by row (``doc_id`` then repeats in the result);
a null id is kept as null. Very long texts are read whole. Empty tables give an empty result. Other columns are
not read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, map_batches, named

WORDS = re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


class Runs:
    """Karp-Rabin hashes of all runs of any length of an id array, modulo 2**64, from sums over its beginnings."""

    def __init__(self, ids: np.ndarray) -> None:
        x = ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        self.n, powers = len(ids), np.cumprod(np.r_[np.uint64(1), np.full(len(ids), BASE)], dtype=np.uint64)
        self.sums = np.cumsum(np.r_[np.uint64(0), x * powers[:-1]], dtype=np.uint64)
        self.back = np.cumprod(np.r_[np.uint64(1), np.full(len(ids), INVERSE)], dtype=np.uint64)

    def of(self, n: int) -> np.ndarray:
        if self.n < n:
            return np.zeros(0, np.uint64)
        return (self.sums[n:] - self.sums[: self.n - n + 1]) * self.back[: self.n - n + 1]


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n ids, modulo 2**64."""
    return Runs(ids).of(n)


def tiles(doc: np.ndarray, item: np.ndarray, least: int = 3) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two id arrays: non-overlapping (length, item start, doc start), longest first, of equal
    ones the first in the item and then in the document.

    The longest free run that both hold is found by bisection: runs of a length exist if longer ones do. All tiles of that
    length are marked at once, each item run with the first free document run of its hash, so repeated words cost no pair
    of places, and the next length is shorter. An item's words are marked once, so lengths and tiles are bounded by it.
    """
    out: list[tuple[int, int, int]] = []
    if min(len(doc), len(item)) < least:
        return out
    in_doc, in_item = Runs(doc), Runs(item)
    free_doc, free_item = doc > 0, np.ones(len(item), bool)

    def open_runs(runs: Runs, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        upto = np.r_[0, np.cumsum(free)]
        at = np.flatnonzero(upto[n:] - upto[:-n] == n)
        return at, runs.of(n)[at]

    def shared(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        p, hp = open_runs(in_item, free_item, n)
        t, ht = open_runs(in_doc, free_doc, n)
        if not len(p) or not len(t):
            return None
        keys = np.unique(hp)
        hit = keys[np.minimum(np.searchsorted(keys, ht), len(keys) - 1)] == ht
        return (p, hp, t[hit], ht[hit]) if hit.any() else None

    top = min(len(doc), len(item))
    while top >= least:
        low, found = least, shared(least)
        if found is None:
            break
        step = least
        while low < top:  # doubling, then halving
            n = min(top, low + step)
            more = shared(n)
            if more is None:
                top = n - 1
                break
            low, found, step = n, more, 2 * step
        while low < top:
            n = (low + top + 1) // 2
            more = shared(n)
            if more is None:
                top = n - 1
            else:
                low, found = n, more
        p, hp, t, ht = found
        order = np.argsort(ht, kind="stable")
        keys, spots = ht[order], t[order]
        first, last = np.searchsorted(keys, hp), np.searchsorted(keys, hp, "right")
        reached: dict[int, int] = {}  # by hash class: document runs before are no longer free
        for start, a, b in zip(p.tolist(), first.tolist(), last.tolist()):
            if a == b or not free_item[start : start + low].all():
                continue
            k = reached.get(a, a)
            while k < b and not free_doc[spots[k] : spots[k] + low].all():
                k += 1
            reached[a] = k
            if k < b and (item[start : start + low] == doc[spots[k] : spots[k] + low]).all():
                free_item[start : start + low] = False
                free_doc[spots[k] : spots[k] + low] = False
                out.append((low, start, int(spots[k])))
        top = low - 1
    return out


def around(doc: np.ndarray, hashes: np.ndarray, item_hashes: np.ndarray, least: int) -> np.ndarray:
    """The stretches of doc whose runs of ``least`` words the item holds too, with a 0 between them: all that tiles can be in."""
    hit = np.flatnonzero(np.isin(hashes, item_hashes))
    change = np.zeros(len(doc) + 1, np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + least, -1)
    inside = np.cumsum(change[:-1]) > 0
    edge = np.r_[False, ~inside[1:] & inside[:-1]]
    return np.where(inside, doc, 0)[inside | edge]


class Vocabulary(dict):
    """word -> id from 1 for the benchmark's words, 0 for all others."""

    def __missing__(self, word: str) -> int:
        return 0


class Benchmark:
    """One block of items: ids of words, hashes of seed runs and the items that hold each, and of all runs of ``least`` words
    with their places in the items laid end to end."""

    def __init__(self, items: list[tuple[object, str | None]], seed: int, least: int) -> None:
        self.seed, self.least, self.vocabulary = seed, least, Vocabulary()
        self.items = []
        for key, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int64)
            if len(ids):
                self.items.append((key, ids))
        self.lengths = np.array([len(ids) for _, ids in self.items], np.int64)
        self.by_length = {}
        for k, (_, ids) in enumerate(self.items):
            self.by_length.setdefault(min(seed, len(ids)), []).append(k)
        self.runs = []
        for n, members in sorted(self.by_length.items()):
            hashes = [np.unique(rolling(self.items[k][1], n)) for k in members]
            flat, owner = np.concatenate(hashes), np.repeat(members, list(map(len, hashes)))
            order = np.argsort(flat, kind="stable")
            self.runs.append((n, flat[order], owner[order]))
        starts = np.cumsum(self.lengths) - self.lengths
        self.short = [rolling(ids, least) for _, ids in self.items]
        flat = np.concatenate([*self.short, np.zeros(0, np.uint64)])
        place = np.concatenate([*(s + np.arange(len(h)) for s, h in zip(starts, self.short)), np.zeros(0, np.int64)])
        order = np.argsort(flat, kind="stable")
        self.keys, self.places = flat[order], place[order]
        self.owner = np.repeat(np.arange(len(self.items)), self.lengths)

    def reachable(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(most words that tiles can cover, longest tile there can be) of each item, from the hashes of a document's runs of
        ``least`` words: what the item's runs that the document holds cover, and the longest chain of them."""
        hit = np.unique(hashes)
        lows, highs = np.searchsorted(self.keys, hit), np.searchsorted(self.keys, hit, "right")
        times = highs - lows
        most, longest = np.zeros(len(self.items), np.int64), np.zeros(len(self.items), np.int64)
        if not times.sum():
            return most, longest
        at = np.sort(self.places[np.repeat(lows - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())])
        gap = np.r_[np.diff(at), self.least]
        np.add.at(most, self.owner[at], np.minimum(gap, self.least))
        first = np.flatnonzero(np.r_[True, (gap[:-1] != 1) | (self.owner[at[1:]] != self.owner[at[:-1]])])
        np.maximum.at(longest, self.owner[at[first]], np.diff(np.r_[first, len(at)]) + self.least - 1)
        return most, longest

    def leaks(self, text: str | None, threshold: float, verbatim: int = 50) -> list[tuple[object, int, int, int, int]]:
        """(item, its words, covered words, tiles, longest tile) of the items that the text holds. Of the items that share a
        seed run, those whose runs in the document can't cover enough are told by one count for all; the others are tiled,
        on the stretches that they share."""
        words, out, candidates = words_of(text), [], []
        ids = np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words))
        hashed = Runs(ids)
        for n, keys, owner in self.runs:
            hashes = hashed.of(n)
            if not len(hashes):
                continue
            at = np.searchsorted(keys, hashes)
            hit = np.unique(hashes[keys[np.minimum(at, len(keys) - 1)] == hashes])
            if len(hit):
                lows, highs = np.searchsorted(keys, hit), np.searchsorted(keys, hit, "right")
                candidates.append(np.unique(np.concatenate([owner[a:b] for a, b in zip(lows, highs)])))
        if not candidates:
            return out
        found, hashes = np.unique(np.concatenate(candidates)), hashed.of(self.least)
        most, longest = self.reachable(hashes)
        lengths = self.lengths[found]
        for k in found[(lengths < self.least) | (most[found] >= threshold * lengths) | (longest[found] >= verbatim)]:
            key, item = self.items[k]
            least = min(self.least, len(item))
            near = around(ids, hashes, self.short[k], least) if least == self.least else ids
            made = tiles(near, item, least)
            covered, top = sum(t[0] for t in made), max((t[0] for t in made), default=0)
            if covered >= threshold * len(item) or top >= verbatim:
                out.append((key, len(item), covered, len(made), top))
        return out


def blocks_of(items: DataFrame, block_words: int):
    """Blocks of (item, text) with at most block_words words (one item at least), read one partition at a time."""
    rows, block, size = items.toLocalIterator(), [], 0
    for key, text in rows:
        n = len(words_of(text))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((key, text))
        size += n
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", seed: int = 5, least: int = 3, threshold: float = 0.7, verbatim: int = 50, block_words: int = 1_000_000) -> DataFrame:
    """One row for each document row and item that it leaks: id, item, item_words, covered, coverage, n_tiles, longest_tile."""
    texts = docs.select(named(id_column).alias("_id"), named(text_column).alias("text"))
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, id_column), (benchmark, item_column)))
    schema = f"_id {kind}, _item {item_kind}, item_words int, covered int, n_tiles int, longest_tile int"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks_of(benchmark.select(named(item_column), named(item_text)), block_words):
        sent = docs.sparkSession.sparkContext.broadcast(Benchmark(block, seed, least))

        def make(sent=sent):
            def step(cols: dict) -> dict:
                rows = [(i, *leak) for i, t in zip(cols["_id"], cols["text"]) for leak in sent.value.leaks(t, threshold, verbatim)]
                names = ("_id", "_item", "item_words", "covered", "n_tiles", "longest_tile")
                return {n: [r[k] for r in rows] for k, n in enumerate(names)}

            return step

        out = out.unionByName(map_batches(texts, make, schema))
    return out.select(F.col("_id").alias(id_column), F.col("_item").alias(item_column), "item_words", "covered", (F.col("covered") / F.col("item_words")).alias("coverage"), "n_tiles", "longest_tile")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text: str = "text", seed: int = 5, least: int = 3, threshold: float = 0.7, verbatim: int = 50, block_words: int = 1_000_000) -> DataFrame:
    """The rows of docs that leak no benchmark item, with all their columns."""
    for block in blocks_of(benchmark.select(named(item_column), named(item_text)), block_words):
        sent = docs.sparkSession.sparkContext.broadcast(Benchmark(block, seed, least))
        docs = filter_rows(docs, lambda sent=sent: lambda texts: [not sent.value.leaks(t, threshold, verbatim) for t in texts], text_column)
    return docs
