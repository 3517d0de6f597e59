"""Ranked lexical search: document-at-a-time merges over compressed postings, shard by shard.

Terms are maximal runs of ASCII letters, digits and code points from U+0080 on, with A-Z lower-cased. A document's score
for an item is a sum over the item's terms, repeats included, of a term's weight times a saturated count (see
``weight_of`` and ``gains``), in whole numbers.

``LexicalIndex.build`` deals documents into shards: a task sorts up to ``SHARD_DOCS`` documents or ``SHARD_POSTINGS``
postings by id and writes one row a term, with the places of its documents as differences and its counts, both in
variable-length bytes. No text and no posting is shuffled for that. ``search`` sums document frequencies over the
shards, joins the items' weighted terms to the postings, and merges each shard by itself: for each item a heap holds
one cursor a term, ordered by document; the first document is scored at once over all cursors that stand on it; a
heap of ``k`` results, ordered by score and then by id, gives the score to beat. Terms that could not lift a document
over that score even together leave the heap and are only looked up for documents that others bring in. The shards'
results meet in one ranking by item.

A shard's merge holds the postings of one shard for one block of ``BLOCK`` items, whatever the corpus.

Cases: null and empty texts, and those without terms, are in no shard and no result; items without terms have no rows.
Rows are judged one by one: rows that share a doc_id or item_id are each ranked; a null doc_id comes last among equal
scores, a null item_id is an item. Empty tables give an empty result. Very long texts and terms are read whole. Other
columns are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, map_batches, met_by, named, on_workers

SHARD_DOCS, SHARD_POSTINGS = 16_384, 1_000_000
BLOCK = 512  # items that are searched together
MOST_TERMS, MOST_BYTES = 1_000_000, 1 << 26  # of items, that are sent to the tasks as a filter
NO_ID = 1 << 63  # after every id

#: Bytes that belong to terms stay (A-Z as a-z), others become spaces.
_TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() if text else []


def packed(values: np.ndarray) -> bytes:
    """Numbers from 0 on, seven bits a byte, the lowest first; a byte's top bit says that more follow."""
    width = np.maximum(1, -(-np.frexp(values.astype(np.float64))[1] // 7))
    start = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    for k in range(int(width.max(initial=0))):
        more = np.flatnonzero(width > k)
        out[start[more] + k] = ((values[more] >> (7 * k)) & 127) | ((width[more] > k + 1) * 128)
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    start = np.flatnonzero(np.r_[True, raw[:-1] < 128]) if len(raw) else np.zeros(0, np.int64)
    place = np.arange(len(raw)) - np.repeat(start, np.diff(np.r_[start, len(raw)]))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), start) if len(raw) else np.zeros(0, np.int64)


def weight_of(n_docs: int, df: Column) -> Column:
    return F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * df + 1))).cast("long")


def gains(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - 25 + (25 * length * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def best_of_shard(lists: list[tuple[list[int], list[int], int]], ids: list[int], k: int) -> list[tuple[int, int]]:
    """The ``k`` documents of highest score above 0, as (score, place in the shard). ``lists``: a term's documents in
    ascending order, what each gains, and the largest gain. ``ids`` ascend with the places."""
    lists = sorted((x for x in lists if x[2] > 0), key=lambda x: x[2])
    reach = [0]  # what the first lists can add together
    for x in lists:
        reach.append(reach[-1] + x[2])
    n, shift = len(lists), max(1, len(lists).bit_length())
    mask, at, out = (1 << shift) - 1, [0] * n, []  # out: heap of (score, -place): the worst result first
    heap = [(x[0][0] << shift) | j for j, x in enumerate(lists)]
    heapq.heapify(heap)
    bar, idle = 0, 0  # lists before ``idle`` are only looked up
    while heap:
        place, score = heap[0] >> shift, 0
        while heap and heap[0] >> shift == place:
            j = heap[0] & mask
            docs, gain, _ = lists[j]
            p = at[j]
            score += gain[p]
            at[j] = p = p + 1
            if p < len(docs):
                heapq.heapreplace(heap, (docs[p] << shift) | j)
            else:
                heapq.heappop(heap)
        for j in range(idle - 1, -1, -1):
            if score + reach[j + 1] <= bar:
                break
            docs, gain, _ = lists[j]
            at[j] = p = bisect_left(docs, place, at[j])
            if p < len(docs) and docs[p] == place:
                score += gain[p]
        if score > bar:  # of equal scores the earlier place stays
            if len(out) < k:
                heapq.heappush(out, (score, -place))
            else:
                heapq.heapreplace(out, (score, -place))
            if len(out) == k:
                bar = out[0][0]
                now = idle
                while now < n and reach[now + 1] <= bar:
                    now += 1
                if now > idle:
                    idle = now
                    heap = [x for x in heap if x & mask >= idle]
                    heapq.heapify(heap)
    return [(score, -place) for score, place in out]


class LexicalIndex:
    """Shards of postings, written to the shared folder: (shard, term, df, postings), and one row a shard without a term
    that has the shard's ids and lengths in order."""

    SCHEMA = "shard string, term binary, df bigint, places binary, counts binary, ids array<bigint>, lengths binary"

    def __init__(self, shards: DataFrame, ws: Workspace) -> None:
        self.shards, self.ws = shards, ws
        head = shards.filter("term is null").agg(F.sum("df")).first()
        self.n_docs, self.n_terms = int(head[0] or 0), 0
        if self.n_docs:
            def total():
                return lambda cols: {"n": [int(unpacked(x).sum()) for x in cols["lengths"]]}

            self.n_terms = int(map_batches(shards.filter("term is null").select("lengths"), total, "n bigint").agg(F.sum("n")).first()[0])

    @classmethod
    def build(cls, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", only: set[bytes] | None = None, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> LexicalIndex:
        """``only``: terms that are indexed; lengths and totals count all terms of all documents all the same."""
        spark = docs.sparkSession
        ws = Workspace(spark, "lexical")
        on_workers(spark)
        kept = spark.sparkContext.broadcast(only)

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        kind = _parse_datatype_string(cls.SCHEMA)

        def run(batches):
            import uuid

            wanted, arrow = kept.value, to_arrow_schema(kind)

            def shard(held: list) -> pa.RecordBatch:
                name = uuid.uuid4().hex  # a task that runs again writes its own shards; only one attempt's are committed
                held.sort(key=lambda x: x[0])
                lists: dict[bytes, list[int]] = {}
                for place, (_, _, counts) in enumerate(held):
                    for term, n in counts:
                        lists.setdefault(term, []).extend((place, n))
                cols: list[list] = [[name], [None], [len(held)], [None], [None], [[None if x[0] == NO_ID else x[0] for x in held]], [packed(np.array([x[1] for x in held], np.int64))]]
                for term, flat in lists.items():
                    both = np.array(flat, np.int64).reshape(-1, 2)
                    for c, v in zip(cols, (name, term, len(both), packed(np.diff(both[:, 0], prepend=0)), packed(both[:, 1]), None, None)):
                        c.append(v)
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

            held, postings = [], 0
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        words = terms(text)
                        if not words:
                            continue
                        counts = Counter(words)
                        found = list(counts.items()) if wanted is None else [(t, counts[t]) for t in counts.keys() & wanted]
                        held.append((NO_ID if doc_id is None else doc_id, len(words), found))
                        postings += len(found)
                        if len(held) >= shard_docs or postings >= shard_postings:
                            yield shard(held)
                            held, postings = [], 0
            if held:
                yield shard(held)

        texts = docs.select(named(id_column).cast("long").alias("id"), named(text_column).alias("text"))
        return cls(ws.save(texts.mapInArrow(run, kind), "shards"), ws)

    def search(self, items: DataFrame, id_column: str = "item_id", text_column: str = "text", k: int = 20, block: int = BLOCK) -> DataFrame:
        """(item id, rank, doc_id, score): each item's ``k`` best documents."""
        ws = self.ws
        id_type = items.schema[id_column].dataType.simpleString()
        asked, entries = asked_terms(items, ws, id_column, text_column)
        n_docs, n_terms = self.n_docs, self.n_terms
        df = self.shards.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
        blocks = max(1, -(-asked.count() // block))
        entries = entries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
        weighted = entries.join(df, "term").withColumn("weight", weight_of(n_docs, F.col("df"))).filter("weight > 0")
        weighted = ws.save(weighted.groupBy("term", "block", "weight").agg(F.collect_list(F.struct("row", "n")).alias("of")), "weighted")  # of: a block's items at most
        heads = self.shards.filter("term is null").select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(None).cast("long").alias("weight"), F.expr("cast(null as array<struct<row: bigint, n: bigint>>)").alias("of"), "places", "counts", "ids", "lengths")
        lists = self.shards.filter("term is not null").join(met_by(weighted), "term").select(*heads.columns)
        on_workers(items.sparkSession)

        def merged(table: pa.Table) -> pa.Table:
            head = [x.as_py() is not None for x in table["lengths"]].index(True)
            ids = [NO_ID if x is None else x for x in table["ids"][head].as_py()]
            lengths = unpacked(table["lengths"][head].as_py())
            of_item: dict[int, list] = {}
            for weight, of, places, counts in zip(*(table[c].to_pylist() for c in ("weight", "of", "places", "counts"))):
                if of is None:
                    continue
                docs = np.cumsum(unpacked(places))
                gain = weight * gains(unpacked(counts), lengths[docs], n_docs, n_terms)
                docs_list, lists_by = docs.tolist(), {}
                for x in of:
                    n = x["n"]
                    if n not in lists_by:
                        lists_by[n] = ((gain * n).tolist(), int(gain.max()) * n)
                    of_item.setdefault(x["row"], []).append((docs_list, *lists_by[n]))
            out = [(row, ids[place], score) for row, lists in of_item.items() for score, place in best_of_shard(lists, ids, k)]
            return pa.table({"row": pa.array([x[0] for x in out], pa.int64()), "doc_id": pa.array([None if x[1] == NO_ID else x[1] for x in out], pa.int64()), "score": pa.array([x[2] for x in out], pa.int64())})

        # A shard's compressed postings for one block of items: bounded by the shard's size, not by the corpus.
        found = ws.save(lists.unionByName(heads).groupBy("shard", "block").applyInArrow(merged, "row bigint, doc_id bigint, score bigint"), "found") if n_docs else items.sparkSession.createDataFrame([], "row bigint, doc_id bigint, score bigint")
        best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        return ranked.join(met_by(asked.select("row", F.col("id").alias("_item"))), "row").select(F.col("_item").cast(id_type).alias(id_column), "rank", "doc_id", "score")


def asked_terms(items: DataFrame, ws: Workspace, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """(row, id) of the items and (row, term, n) of their terms, both written."""
    asked = ws.save(items.select(named(id_column).alias("id"), named(text_column).alias("text")).withColumn("row", F.monotonically_increasing_id()), "asked")

    def make():
        def step(cols: dict) -> dict:
            counts = [Counter(terms(t)) for t in cols["text"]]
            return {"row": cols["row"], "term": [list(c) for c in counts], "n": [list(c.values()) for c in counts]}

        return step

    lists = map_batches(asked.select("row", "text"), make, "row bigint, term array<binary>, n array<bigint>", rows=256)
    entries = lists.select("row", F.explode(F.arrays_zip("term", "n")).alias("x")).select("row", "x.term", "x.n")
    return asked, ws.save(entries, "entries")


def vocabulary(items: DataFrame, text_column: str = "text", most: int = MOST_TERMS, most_bytes: int = MOST_BYTES) -> set[bytes] | None:
    """The items' terms, if they are ``most`` at most and have ``most_bytes`` together (counted first); else None."""
    ws = Workspace(items.sparkSession, "vocabulary")
    found = ws.save(asked_terms(items.select(F.lit(0).alias("id"), named(text_column).alias("text")), ws, "id", "text")[1].select("term").distinct(), "terms")
    size = found.agg(F.count("*").alias("n"), F.sum(F.length("term")).alias("bytes")).first()
    if size["n"] > most or (size["bytes"] or 0) > most_bytes:
        return None
    return {bytes(x) for x in found.toArrow()["term"].to_pylist()}


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text", **how) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item. Only the items' terms are indexed, where
    they fit a task; otherwise all terms are. The rows are the same."""
    index = LexicalIndex.build(docs, id_column, text_column, only=vocabulary(items, item_text), **how)
    return index.search(items, item_id, item_text, k)
