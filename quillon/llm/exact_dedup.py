"""Exact deduplication by deterministic block naming (DataFrame operations only).

A text is its UTF-8 bytes cut into blocks of a fixed size. The distinct blocks are sorted and numbered:
their integer names. Adjacent names are then paired, the distinct pairs sorted and numbered again, and so on
until one name is left of each text. Two texts have the same (block count, name) exactly when they are equal:
a name stands for one content, never for a hash of it.

The block contents cross the network once, after map-side combining, to be named. On the way back to their
documents the names travel by the SHA-256 of the block, of which no two contents are known; that each digest met
exactly one content is checked over all names all the same, and the job stops rather than merge two texts.

Cases: null text is the empty text (one empty block). Rows are told apart by position, so repeated rows and
repeated or null ids are ordinary members of a group; the row with the largest id stays, among equal ids the
later row. An empty table gives an empty result. Other columns are not read by ``exact_dedup`` and pass through
``distinct_texts`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fresh, met_by, named, text_of

BLOCK_BYTES = 4096


def _blocks(text, size: int):
    raw = text.cast("binary")
    count = F.greatest(F.ceil(F.octet_length(raw) / size), F.lit(1)).cast("int")
    return count, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def _named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Integer names in sorted order within each partition of the distinct rows."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def block_identity(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES, ws: Workspace | None = None) -> DataFrame:
    """One row per input row: row_id, _id, text_sha256, n_blocks and the identity ``name``."""
    ws = ws or Workspace(docs.sparkSession, "blocks")
    texts = docs.select(named(id_column).alias("_id"), text_of(text_column).alias("_t"))
    count, blocks = _blocks(F.col("_t"), block_bytes)
    rows = ws.save(
        texts.select(F.monotonically_increasing_id().alias("row_id"), "_id", F.sha2("_t", 256).alias("text_sha256"), count.alias("n_blocks"), F.transform(blocks, lambda b: F.unhex(F.sha2(b, 256))).alias("digests")),
        "rows",
    )
    contents = texts.select(F.explode(blocks).alias("block")).select(F.unhex(F.sha2("block", 256)).alias("digest"), "block").distinct()
    names = ws.save(_named(contents, ["block"]).select("digest", "name"), "names")
    if not names.groupBy("digest").count().filter("count > 1").isEmpty():
        raise RuntimeError("two blocks share a SHA-256; the texts can't be told apart by it")
    level = rows.select("row_id", "n_blocks", F.posexplode("digests").alias("pos", "digest")).join(names, "digest").select("row_id", "n_blocks", "pos", "name")
    level = ws.save(level, "level0")
    found = level.filter("n_blocks = 1").select("row_id", "name")
    longest = rows.agg(F.max("n_blocks")).first()[0] or 1
    left, depth = longest, 0
    while left > 1:
        depth += 1
        still = level.filter(F.col("n_blocks") > 2 ** (depth - 1))
        pairs = still.groupBy("row_id", "n_blocks", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")
        )
        pairs = ws.save(pairs, f"pairs{depth}")
        paired = ws.save(_named(pairs.select("a", "b").distinct(), ["a", "b"]), f"names{depth}")
        level = ws.save(pairs.join(paired, ["a", "b"]).select("row_id", "n_blocks", "pos", "name"), f"level{depth}")
        found = found.unionByName(level.filter(F.col("n_blocks") <= 2**depth).select("row_id", "name"))
        ws.drop(f"pairs{depth}", f"names{depth}")
        left = -(-left // 2)
    return rows.drop("digests").join(found, "row_id")


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, row_id."""
    out = _judged(docs, id_column, text_column, block_bytes, Workspace(docs.sparkSession, "dedup"))
    (row,) = fresh([id_column, "keep_id", "group_size", "kept", "text_sha256"], "row_id")
    return out.select(F.col("_id").alias(id_column), "keep_id", "group_size", "kept", "text_sha256", F.col("row_id").alias(row))


def _judged(docs: DataFrame, id_column: str, text_column: str, block_bytes: int, ws: Workspace) -> DataFrame:
    identities = ws.save(block_identity(docs, id_column, text_column, block_bytes, ws), "identities")
    groups = ws.save(identities.groupBy("n_blocks", "name").agg(F.max(F.struct("_id", "row_id")).alias("keep"), F.count("*").alias("group_size")), "groups")
    ws.drop("rows", "names", "level0", *(f"level{k}" for k in range(1, 40)))  # identities are written
    out = identities.join(groups, ["n_blocks", "name"])
    return out.select("_id", F.col("keep._id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("keep.row_id")).alias("kept"), "text_sha256", "row_id")


def distinct_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows that stay, with all their columns: one row for each text, that of the largest id. Of rows that repeat
    both id and text one stays, which one isn't said.

    Rows are told by id and SHA-256 of the text. Those of texts that go are taken out by an anti join; only rows that
    repeat both id and text are grouped, so the texts that stay aren't shuffled while the list of those that go is
    short enough to be broadcast (``met_by``)."""
    ws = Workspace(docs.sparkSession, "distinct")
    judged = _judged(docs, id_column, text_column, block_bytes, ws)
    pairs = judged.groupBy("_id", "text_sha256").agg(F.bool_or("kept").alias("stays"), F.count("*").alias("times")).filter("not stays or times > 1")
    sha, gone_id, gone_sha = fresh(docs.columns, "_sha", "_id", "_of")
    pairs = ws.save(pairs.select(F.col("_id").alias(gone_id), F.unhex("text_sha256").alias(gone_sha), "stays"), "pairs")
    rows = docs.withColumn(sha, F.unhex(F.sha2(text_of(text_column), 256)))
    same = named(id_column).eqNullSafe(F.col(gone_id)) & (F.col(sha) == F.col(gone_sha))
    out = rows.join(met_by(pairs.select(gone_id, gone_sha)), same, "left_anti")
    again = pairs.filter("stays").select(gone_id, gone_sha)
    if not again.isEmpty():
        out = out.unionByName(rows.join(met_by(again), same, "left_semi").dropDuplicates([id_column, sha]))
    return out.select(*(named(c) for c in docs.columns))
