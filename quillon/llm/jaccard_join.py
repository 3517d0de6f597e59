"""Exact Jaccard join of documents' word shingles by token-combination prefixes.

A document is the set of its distinct ``size``-word shingles, as 64-bit hashes (here: tokens). Two documents link
when ``100 * |x & y| >= percent * |x | y|``. Then at most ``slack(x) = |x| - ceil(percent * |x| / 100)`` tokens of x
are not in y, which prefix filtering uses:

* tokens are ordered rare ones first, frequent ones last, each by hash. A token is frequent when more than
  ``frequent`` distinct sets hold it; all tokens of all documents are counted. Where more than ``MOST_FREQUENT``
  tokens are, the bar rises until the list fits: the most frequent are always known exactly.
* the prefix of x runs through that order until it *covers* ``slack(x) + 1``. A rare token covers one and is indexed
  alone. Frequent tokens fall into G classes by hash; a class with n tokens in the prefix covers n - 1, and its
  pairs of tokens are indexed. If x and y link, the shorter of their two prefixes holds a common rare token or two
  common tokens of one class, and the longer holds them too - so they meet in an index bucket.
* sets with under 24 tokens index frequent tokens alone; G grows with the set's size to keep pairs few. Sets near
  a change of G index both ways, wide enough that no linked pair falls between.
* a set whose prefix reaches its frequent tokens has all its rare ones in the index. So two sets that share a rare token
  meet there as well, and those that meet by frequent tokens alone need compare only if these suffice for a link: if
  each holds at least ``percent * (|x| + |y|) / (100 + percent)`` of them. Pages that share a template and differ in
  their own words by too much for a link aren't compared, however many they are.

Rare tokens that only one set holds can't meet anything and aren't indexed; a bitmap with eight slots for each token
that several sets hold tells most of them (it has ``MOST_SLOT_BITS`` at most; where that is too few for the corpus,
more of them are indexed and dropped as buckets of one). Buckets are not expanded at once: each set is first compared
with its bucket's most central member and linked sets are contracted to components. This is repeated with members of
other components for buckets of more than ``HEAVY`` members; then the pairs of different components that share a bucket
are compared, large buckets in blocks, so no task holds a hot one. Parity bitmaps, a narrow one and one as wide as
the set is large, bound the symmetric difference from below and spare most comparisons; the rest compares full sets. So groups of near copies cost about one
comparison a member, and no link between different components is lost.

Sets that are equal are one node from the start, told apart by 128 bits.

Cases: null and empty texts have no shingles, link with nothing and are their own component. Texts with fewer words
than ``size`` are one shingle of all their words. Rows are judged one by one: repeated rows or ids link by their
texts; a null id takes part but is no component's id unless the component has no other. An empty table gives an
empty result. Very long texts are read whole. Other columns are not read.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, byte_words, map_batches, named, on_workers, shard_bits, without_ids
from .graph import components

MOST_SLOT_BITS, MOST_FREQUENT = 29, 1_000_000
HELD_TOKENS = 1_000_000  # that a task adds up before it sends them
PARITY_BITS = 1024
MOST_STARS, HEAVY = 4, 4096  # rounds that compare a bucket with one of its members; those after the first are for buckets of more members
BLOCK = 1024  # members of a large bucket that meet another block in one place
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
MASK, HALF = (1 << 64) - 1, 1 << 63
#: (least set size, classes of frequent tokens); 0 classes: alone.
MODES = ((0, 0), (24, 4), (64, 8), (128, 16), (256, 64), (2048, 512), (16384, 4096), (131072, 32768), (1 << 20, 1 << 18))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * ODD[1]
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = [byte_words(t) for t in texts]
    lens = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(lens.sum()))
    out, at = [], 0
    for w, n in zip(words, lens):
        h, at = flat[at : at + n], at + n
        if n == 0:
            out.append(np.zeros(0, np.uint64))
        elif n < size:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(w), 1)], np.uint64))
        else:
            x = np.zeros(n - size + 1, np.uint64)
            for k in range(size):
                part = h[k : n - size + 1 + k]
                x = x * ODD[0] + (part ^ (part >> np.uint64(31 - k % 8))) * ODD[k % 4]
            out.append(np.unique(mixed(x)))
    return out


def slack(n: int, percent: int) -> int:
    return n - -(-percent * n // 100)


def modes_of(n: int, percent: int) -> list[int]:
    """The class counts that a set of n tokens indexes its frequent tokens by."""
    tops = [(-(-100 * low // percent)) + 1 for low, _ in MODES[1:]] + [1 << 62]
    return [classes for (low, classes), top in zip(MODES, tops) if low <= n < top]


def signatures(tokens: np.ndarray, repeated: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Index keys of a set, even for rare tokens and odd for frequent ones; tokens are sorted, the flags say which are held by
    several sets and by many."""
    need = slack(len(tokens), percent) + 1
    rare = np.flatnonzero(~frequent)[:need]
    alone, keys, need = tokens[rare[repeated[rare]]] & ~np.uint64(1), [np.zeros(0, np.uint64)], need - len(rare)
    if need > 0:
        often = tokens[frequent]
        for classes in modes_of(len(tokens), percent):
            if not classes:
                keys.append(mixed(often[:need] + ODD[2]))
                continue
            kind = (mixed(often) >> np.uint64(8)) % np.uint64(classes)
            order = np.argsort(kind, kind="stable")
            first = np.r_[True, kind[order][1:] != kind[order][:-1]]
            adds = np.ones(len(often), np.int64)
            adds[order[first]] = 0  # the first of each class covers nothing yet
            end = int(np.searchsorted(np.cumsum(adds), need)) + 1
            kind, often_in = kind[:end], often[:end]
            order = np.argsort(kind, kind="stable")
            kind, member = kind[order], often_in[order]
            start = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
            size = np.diff(np.r_[start, len(kind)])
            place = np.arange(len(kind)) - np.repeat(start, size)
            left, right = [], []
            for back in range(1, int(size.max())):  # pairs of a class at distance back
                b = np.flatnonzero(place >= back)
                left.append(member[b - back])
                right.append(member[b])
            if left:
                keys.append(mixed(np.concatenate(left) * ODD[2] + np.concatenate(right) * ODD[3] + np.uint64(classes)))
    return np.unique(np.r_[alone, np.concatenate(keys) | np.uint64(1)])


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (x >> 64) - HALF, (x & MASK) - HALF


def parity(tokens: np.ndarray, width: int = PARITY_BITS) -> list[int]:
    """Which of ``width`` classes (low bits) hold an odd number of tokens; halves of a wide one fold by xor."""
    bits = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(bool)).view(np.int64).tolist()


class Tokens:
    """What the tasks know of all tokens: a bitmap by the top bits of those that two sets or more hold, and the sorted
    names (top bits) of the frequent ones."""

    def __init__(self, bits: np.ndarray, slot_bits: int, often: np.ndarray, name_bits: int) -> None:
        self.bits, self.slot_bits, self.often, self.name_bits = bits, slot_bits, often, name_bits

    def repeated(self, tokens: np.ndarray) -> np.ndarray:
        slot = (tokens >> np.uint64(64 - self.slot_bits)).astype(np.int64)
        return (self.bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1

    def frequent(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.often):
            return np.zeros(len(tokens), bool)
        names = tokens >> np.uint64(64 - self.name_bits)
        return self.often[np.minimum(np.searchsorted(self.often, names), len(self.often) - 1)] == names


def token_counts(texts: DataFrame, size: int, ws: Workspace) -> tuple[DataFrame, int]:
    """(shard, names, n): packed, the tokens that two sets or more hold, by their 32 bits after the shard's, and how
    many do; and the shard's bits. A task adds its tokens up before it sends them, so a hot token travels a few times
    a task, not once a document."""
    held = shard_bits(texts.sparkSession)
    shards = 1 << held
    on_workers(texts.sparkSession)

    def packed(sets: list) -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate(sets), return_counts=True)
        cut = np.searchsorted(tokens, np.arange(shards, dtype=np.uint64) << np.uint64(64 - held))
        names = ((tokens >> np.uint64(32 - held)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        rows = []
        for k, (a, b) in enumerate(zip(cut, np.r_[cut[1:], len(tokens)])):
            if b > a:
                once = n[a:b] == 1
                rows.append((k, names[a:b][once].tobytes(), names[a:b][~once].tobytes(), n[a:b][~once].astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[c] for r in rows], pa.binary()) for c in (1, 2, 3))], ["shard", "once", "names", "n"])

    def run(batches):
        seen, sets, total = set(), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for s in shingle_sets(batch.column(0).slice(at, 512).to_pylist(), size):
                    if len(s) and (key := fingerprint(s)) not in seen:
                        seen.add(key)
                        sets.append(s)
                        total += len(s)
                if len(seen) > 500_000:
                    seen.clear()
                if total >= HELD_TOKENS:
                    yield packed(sets)
                    sets, total = [], 0
        if sets:
            yield packed(sets)

    def count(key: tuple, table: pa.Table) -> pa.Table:
        # A shard comes as packed arrays; its size is the corpus' tokens over the number of shards.
        arrays = {c: [np.frombuffer(b.as_buffer(), np.uint32) for part in table[c].chunks for b in part] for c in ("once", "names", "n")}
        flat = np.concatenate(arrays["once"] + arrays["names"])
        times = np.concatenate([np.ones(sum(map(len, arrays["once"])), np.uint32)] + arrays["n"])
        order = np.argsort(flat, kind="stable")
        flat, times = flat[order], times[order]
        start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        n = np.add.reduceat(times, start, dtype=np.int64)
        use = n > 1
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "names": pa.array([flat[start][use].tobytes()], pa.binary()), "n": pa.array([n[use].tobytes()], pa.binary())})

    parts = texts.select("text").mapInArrow(run, "shard int, once binary, names binary, n binary")
    return ws.save(parts.groupBy("shard").applyInArrow(count, "shard int, names binary, n binary"), "tokens"), held


def _level(n: np.ndarray) -> np.ndarray:
    """Counts rounded down to their six leading bits: few distinct values whatever the corpus."""
    spare = np.maximum(np.frexp(n.astype(np.float64))[1] - 6, 0)
    return (n >> spare) << spare


def tokens_of(texts: DataFrame, size: int, frequent: int, ws: Workspace, most_frequent: int = MOST_FREQUENT, most_bits: int = MOST_SLOT_BITS) -> Tokens:
    """The driver gets 2**most_bits bits and most_frequent numbers at most."""
    counts, held = token_counts(texts, size, ws)

    def levels():
        def step(cols: dict) -> dict:
            level, n = np.unique(_level(np.concatenate([np.frombuffer(x, np.int64) for x in cols["n"]] or [np.zeros(0, np.int64)])), return_counts=True)
            return {"level": level, "n": n}

        return step

    sizes = sorted(((r["level"], r["n"]) for r in map_batches(counts.select("n"), levels, "level bigint, n bigint", rows=16).groupBy("level").agg(F.sum("n").alias("n")).collect()), reverse=True)
    bar, listed = 1 << 62, 0  # a token is frequent from this count on, a level's least
    for level, n in sizes:
        if level <= frequent or listed + n > most_frequent:
            break
        bar, listed = level, listed + n
    slot_bits = min(most_bits, max(held + 3, 3 + int(sum(n for _, n in sizes)).bit_length()))
    slots = slot_bits - held

    def told():
        def step(cols: dict) -> dict:
            out: dict = {"shard": cols["shard"], "bits": [], "often": []}
            for shard, names, n in zip(cols["shard"], cols["names"], cols["n"]):
                names, n = np.frombuffer(names, np.uint32), np.frombuffer(n, np.int64)
                bits = np.zeros(1 << slots, bool)
                bits[names >> np.uint32(32 - slots)] = True
                out["bits"].append(np.packbits(bits).tobytes())
                out["often"].append(((np.uint64(shard) << np.uint64(32)) | names[n >= bar].astype(np.uint64)).tobytes())
            return out

        return step

    bits, often = np.zeros((1 << held, (1 << slots) // 8), np.uint8), []
    for shard, b, o in map_batches(counts, told, "shard int, bits binary, often binary", rows=4).collect():
        bits[shard] = np.frombuffer(b, np.uint8)
        often.append(np.frombuffer(o, np.uint64))
    ws.drop("tokens")
    return Tokens(bits.ravel(), slot_bits, np.sort(np.concatenate(often or [np.zeros(0, np.uint64)])), held + 32)


def indexed(texts: DataFrame, maps, size: int, percent: int, id_type: str) -> DataFrame:
    """Per row: _id, n, hi, lo and, for the first row of a set in its task, index keys and parity words."""

    def make():
        tokens, seen = maps.value, set()

        def step(cols: dict) -> dict:
            out: dict = {k: [] for k in ("n", "hi", "lo", "keys", "parity", "fine", "central")}
            if len(seen) > 500_000:
                seen.clear()
            for s in shingle_sets(cols["text"], size):
                hi, lo = key = fingerprint(s)
                keys, bits, fine, central = None, None, None, None
                if len(s) and key not in seen:
                    seen.add(key)
                    often = tokens.frequent(s)
                    found = signatures(s, tokens.repeated(s), often, percent)
                    if len(found):
                        keys, bits, central = found.view(np.int64), parity(s), float(often.mean())
                        width = 1 << int(1.6 * len(s)).bit_length()
                        fine = parity(s, width) if width > PARITY_BITS else None
                for k, v in zip(out, (len(s), hi, lo, keys, bits, fine, central)):
                    out[k].append(v)
            return {"_id": cols["_id"], **out}

        return step

    return map_batches(texts, make, f"_id {id_type}, n bigint, hi bigint, lo bigint, keys array<bigint>, parity array<bigint>, fine array<bigint>, central double", rows=256)


PARTNERS = 256  # members that one copy of a head's set is compared with
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _wanted_sets(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(hi, lo, tokens) of the texts whose id may be among ``wanted`` (min_id): texts are read again and only those whose
    id falls in a slot of a wanted one are hashed, a few more than asked for; ids that repeat give each of their texts. A
    null id is the empty text. Of equal sets a task gives the first."""
    width = 1 << 22
    slot = lambda c: (F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % width).cast("int")
    slots = wanted.select(slot("min_id").alias("s")).distinct().toPandas()["s"]
    bits = np.zeros(width, bool)  # at most 2**22 bits whatever the nodes
    bits[slots.to_numpy(np.int64)] = True
    sent = texts.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def make():
        bits, seen = np.unpackbits(sent.value).astype(bool), set()

        def step(cols: dict) -> dict:
            if len(seen) > 500_000:
                seen.clear()
            hit = np.flatnonzero(bits[np.array(cols["slot"], np.int64)]) if cols["slot"] else []
            out: dict = {"hi": [], "lo": [], "tokens": []}
            for s in shingle_sets([cols["text"][k] for k in hit], size):
                key = fingerprint(s)
                if key not in seen:
                    seen.add(key)
                    for k, v in zip(out, (*key, s.tobytes())):
                        out[k].append(v)
            return out

        return step

    return map_batches(texts.select(slot("_id").alias("slot"), "text"), make, "hi bigint, lo bigint, tokens binary")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int, ws: Workspace, tag: str, most: int = 1_000_000) -> DataFrame:
    """The pairs (a, b) that link, by their full sets.

    Each set travels once for each pair: to its head a, whose own set comes first in the sorted stream. The members
    of a large head are split, each part with a copy of the head. Where sets are wanted is broadcast up to ``most``
    rows (counted first) and joined by a shuffle beyond.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    placed = ws.save(pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")), f"{tag}_placed")
    rows = placed.select(F.col("b").alias("sid"), "a", "part", F.lit(1).alias("late")).unionByName(placed.select(F.col("a").alias("sid"), "a", "part", F.lit(0).alias("late")).distinct())
    wanted = ws.save(rows.join(nodes.select("sid", "hi", "lo", "min_id"), "sid"), f"{tag}_wanted")
    sets = _wanted_sets(texts, wanted, size)
    to = wanted.drop("min_id")
    if to.count() <= most:
        to = F.broadcast(to)
    stream = sets.join(to, ["hi", "lo"]).select("a", "part", "late", "sid", "tokens").repartition("a", "part").sortWithinPartitions("a", "part", "late")

    def compare(batches):
        head, own = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, out = whole.slice(at, 256), []
                for a, part, late, sid, tokens in zip(*(batch.column(k).to_pylist() for k in range(5))):
                    tokens = np.frombuffer(tokens, np.uint64)
                    if not late:
                        head, own = (a, part), tokens
                    elif head == (a, part):
                        both = len(np.intersect1d(own, tokens, assume_unique=True))
                        if 100 * both >= percent * (len(own) + len(tokens) - both):
                            out.append((a, sid))
                yield pa.RecordBatch.from_pydict({"a": [x for x, _ in out], "b": [x for _, x in out]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    conf = texts.sparkSession.conf
    before = conf.get(BATCH_CONF)
    conf.set(BATCH_CONF, 512)  # whole sets are wide rows; what else starts meanwhile gets smaller batches, nothing more
    try:
        links = ws.save(stream.mapInArrow(compare, "a bigint, b bigint"), f"{tag}_links")
    finally:
        conf.set(BATCH_CONF, before)
    ws.drop(f"{tag}_placed", f"{tag}_wanted")
    return links


def _finely(pairs: DataFrame, keyed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that pass the bound by parities as wide as their sets are large; sets that the narrow ones suit
    have none and pass. Sizes of a pair are near, so the widths are equal or one is twice the other."""
    wide = keyed.filter("fine is not null")
    side = lambda c: wide.select(F.col("sid").alias(c), F.col("fine").alias(f"f{c}"), F.col("n").alias(f"n{c}"))
    met = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    m = F.least(F.size("fa"), F.size("fb"))
    fold = lambda c: F.when(F.size(c) == m, F.col(c)).otherwise(F.zip_with(F.slice(c, 1, m), F.slice(c, m + 1, m), lambda x, y: x.bitwiseXOR(y)))
    differ = F.aggregate(F.zip_with(fold("fa"), fold("fb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, v: t + v)
    none = F.col("fa").isNull() | F.col("fb").isNull()
    return met.filter(none | ((100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb")))).select("a", "b")


def _may_link(percent: int):
    """Condition on rows with n1, n2, p1, p2: size ratio, and the parity words' bound on the symmetric difference."""
    n1, n2 = F.col("n1"), F.col("n2")
    differ = F.aggregate(F.zip_with("p1", "p2", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & ((100 + percent) * differ <= (100 - percent) * (n1 + n2))


def jaccard_join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 4, percent: int = 85, frequent: int = 32, most_frequent: int = MOST_FREQUENT, most_bits: int = MOST_SLOT_BITS, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (least id reachable by links), n_copies of its set."""
    ws = Workspace(docs.sparkSession, "jaccard")
    id_type = docs.schema[id_column].dataType.simpleString()
    texts = docs.select(named(id_column).alias("_id"), named(text_column).alias("text"))
    maps = docs.sparkSession.sparkContext.broadcast(tokens_of(texts, size, frequent, ws, most_frequent, most_bits))
    rows = ws.save(indexed(texts, maps, size, percent, id_type), "rows")
    nodes = rows.groupBy("hi", "lo", "n").agg(F.min("_id").alias("min_id"), F.count("*").alias("copies"))
    nodes = ws.save(nodes.withColumn("sid", F.monotonically_increasing_id()), "nodes")
    keyed = rows.filter(F.size("keys") > 0).groupBy("hi", "lo").agg(F.first(F.struct("keys", "parity", "fine", "central")).alias("x"))
    keyed = ws.save(keyed.join(nodes.select("hi", "lo", "sid", "n"), ["hi", "lo"]).select("sid", "n", "x.*"), "keyed")
    parities = keyed.select("sid", "n", "parity")
    index = keyed.select(F.explode("keys").alias("key"), "sid", "central")
    shared = index.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key")
    left = ws.save(index.join(shared, "key").withColumn("comp", F.col("sid")), "shared")

    def side(k: int) -> DataFrame:
        return parities.select(F.col("sid").alias("ab"[k - 1]), F.col("n").alias(f"n{k}"), F.col("parity").alias(f"p{k}"))

    links = docs.sparkSession.createDataFrame([], "a bigint, b bigint")
    for k in range(MOST_STARS):
        rest = left
        if k:  # a heavy bucket's next head is from another component than its last
            heavy = left.groupBy("key").count().filter(F.col("count") > HEAVY).select("key")
            rest = ws.save(left.join(heavy, "key").join(last, "key").filter("comp != c0"), f"heavy{k}")
            if rest.isEmpty():
                break
        # Most central first: the text that the others of its bucket were copied from holds the fewest tokens of its own.
        heads = ws.save(rest.groupBy("key").agg(F.max(F.struct("central", (-F.col("sid")).alias("s"), "comp")).alias("h")).select("key", (-F.col("h.s")).alias("a"), F.col("h.comp").alias("c1")), f"heads{k}")
        pairs = left.join(heads, "key").filter("comp != c1").select(F.least("a", "sid").alias("a"), F.greatest("a", "sid").alias("b")).distinct()
        pairs = pairs.join(side(1), "a").join(side(2), "b").filter(_may_link(percent)).select("a", "b")
        pairs = ws.save(_finely(pairs, keyed, percent), f"pairs{k}")
        links = links.unionByName(_verified(pairs, nodes, texts, size, percent, ws, f"star{k}"))
        comps = components(links, ws, f"comp{k}")
        renamed = left.drop("comp").join(comps.withColumnRenamed("node", "sid"), "sid", "left").select("key", "sid", "central", F.coalesce("comp", "sid").alias("comp"))
        open_keys = renamed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("key")
        left = ws.save(renamed.join(open_keys, "key"), f"open{k}")
        last = ws.save(heads.select("key", F.col("a").alias("node")).join(comps, "node", "left").select("key", F.coalesce("comp", "node").alias("c0")), f"last{k}")
        ws.drop("shared", f"heads{k}", f"pairs{k}", *([f"open{k - 1}", f"last{k - 1}"] if k else []))
    # What is left: pairs of different components in a bucket, by pairs of blocks of its members, the smaller set first. In
    # buckets of frequent tokens these must suffice: most smaller sets of a template have too few and meet no one.
    sized = keyed.select("sid", "n", "parity", F.round(F.col("central") * F.col("n")).cast("long").alias("often"))
    blocks = left.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows_open = left.join(blocks, "key").join(sized, "sid").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    rows_open = ws.save(rows_open.select("key", "sid", "comp", "n", "often", "parity", "blocks", "own"), "open")
    rare = F.col("key").bitwiseAND(F.lit(1)) == 0
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    small = rows_open.filter(rare | (F.col("often") * (100 + percent) >= 2 * percent * F.col("n")))
    one = small.select("key", F.col("own").alias("i"), every.alias("j"), *(F.col(c).alias(f"{d}1") for c, d in (("comp", "c"), ("n", "n"), ("often", "f"), ("parity", "p"))), F.col("sid").alias("a"))
    two = rows_open.select("key", every.alias("i"), F.col("own").alias("j"), *(F.col(c).alias(f"{d}2") for c, d in (("comp", "c"), ("n", "n"), ("often", "f"), ("parity", "p"))), F.col("sid").alias("b"))
    suffice = rare | (F.least("f1", "f2") * (100 + percent) >= percent * (F.col("n1") + F.col("n2")))
    first = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("a") < F.col("b")))
    met = one.join(two, ["key", "i", "j"]).filter(first & (F.col("c1") != F.col("c2")) & suffice & _may_link(percent))
    second = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    second = ws.save(_finely(ws.save(second, "candidates"), keyed, percent), "pairs")
    links = links.unionByName(_verified(second, nodes, texts, size, percent, ws, "cross"))
    comps = components(links, ws, "comp")

    member = nodes.join(comps.withColumnRenamed("node", "sid"), "sid", "left").select("hi", "lo", "n", "copies", "min_id", F.coalesce("comp", "sid").alias("comp"))
    member = ws.save(member, "member")
    least = member.groupBy("comp").agg(F.min("min_id").alias("component_id"))
    told = ws.save(member.join(least, "comp").select("hi", "lo", "component_id", "copies"), "told")
    out = rows.select("_id", "n", "hi", "lo").join(told, ["hi", "lo"])
    alone = F.col("n") == 0
    return out.select(F.col("_id").alias(id_column), F.col("n").alias("n_shingles"), F.when(alone, F.col("_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, 1).otherwise(F.col("copies")).alias("n_copies"))


def one_of_each_group(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """The rows of docs whose id is its component's least, with all their columns. Rows that share an id share its
    fate: the id stays if any of its rows represents a group."""
    ids = jaccard_join(docs.select(named(id_column).alias("_id"), named(text_column).alias("text")), "_id", "text", **how)
    gone = ids.groupBy("_id").agg(F.bool_or(F.col("_id").eqNullSafe(F.col("component_id"))).alias("stays")).filter("not stays").select(F.col("_id").alias(id_column))
    return without_ids(docs, Workspace(docs.sparkSession, "gone").save(gone, "ids"), id_column)
