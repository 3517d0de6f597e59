"""Digests of whole tables that tell where two tables differ: a hash tree over ranges of the sorted rows.

Rows are told by the SHA-256 of all their columns, equal rows once with their number. In the order of (keys, row hash) a
range starts at each row whose hash ends a given way, about every ``about`` rows; a range's digest is that of its rows'
hashes. Ranges are grouped in the same way by their digests, about ``fan`` at a time, until a group of rows has one node,
its root. So the tree follows from the rows alone, not from partitions or history; a changed row changes its own range
and the few nodes above it, and other ranges keep their digests even if rows were added before them.

Numbers of ranges are prefix sums, so no group of rows is gathered: what a task holds together is one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import prefix
from quillon.operators.graph import _checkpoints, written

LISTED = 1000  # touched ranges that become a filter on the keys


def _same(names: list[str], a: str = "a", b: str = "b") -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return out


def _ends(digest: str, level: int, times: int) -> Column:
    """1 where the digest starts a range or node: a share of 1 / times, other digests on each level."""
    return (F.conv(F.substring(digest, 1 + 8 * (level % 8), 8), 16, 10).cast("long") % times == 0).cast("int")


def _told(rows: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """(group, keys, sha, n): each distinct row's hash."""
    sha = F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256)
    return rows.select(*group, *keys, sha.alias("sha")).groupBy(*group, *keys, "sha").agg(F.count("*").alias("n"))


def _placed(told: DataFrame, group: list[str], keys: list[str], about: int, few: int) -> DataFrame:
    """Told rows with their range's place."""
    marked = prefix.prefix_sums(told.withColumn("mark", _ends("sha", 0, about)), group, [*keys, "sha"], {"before": "mark"}, few)
    return marked.select(*group, *keys, "sha", "n", (F.col("before") + F.col("mark")).alias("place"))


def _leaves(placed: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """(group, place, first, digest, n) of the rows' ranges."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*keys, "sha", "n"))), lambda x: F.concat_ws(":", x["sha"], x["n"].cast("string")))
    return placed.groupBy(*group, "place").agg(F.min(F.struct(*keys, "sha")).alias("first"), F.sha2(F.array_join(lines, "\n"), 256).alias("digest"), F.sum("n").alias("n"))


def _ranges(told: DataFrame, group: list[str], keys: list[str], about: int, few: int) -> DataFrame:
    return _leaves(_placed(told, group, keys, about, few), group, keys)


class Tree:
    """``nodes``: (group, level, place, first, digest, n, parent), level 0 being the ranges; a root's parent is null."""

    def __init__(self, leaves: DataFrame, group: list[str], keys: list[str], about: int, fan: int, few: int) -> None:
        self.group, self.keys, self.about, self.fan, self.few = group, keys, about, fan, few
        level, now, done = 0, leaves.checkpoint(), None
        while True:
            sizes = now.groupBy(*group).agg(F.count("*").alias("size"))
            small = now.alias("a").join(sizes.alias("b"), _same(group)).select("a.*", "b.size")
            small = small.withColumn("mark", F.when(F.col("size") <= fan, 0).otherwise(_ends("digest", level + 1, fan)))
            numbered = prefix.prefix_sums(small, group, ["first"], {"before": "mark"}, few).withColumn("parent", F.when(F.col("size") > 1, F.col("before") + F.col("mark")))
            part = written(numbered.select(*group, F.lit(level).alias("level"), "place", "first", "digest", "n", "parent"))
            done = part if done is None else done.unionByName(part)
            up = part.filter("parent is not null")
            if up.isEmpty():
                break
            told = F.transform(F.array_sort(F.collect_list(F.struct("first", "digest"))), lambda x: x["digest"])
            now = up.groupBy(*group, F.col("parent").alias("place")).agg(F.min("first").alias("first"), F.sha2(F.array_join(told, "\n"), 256).alias("digest"), F.sum("n").alias("n")).checkpoint()
            level += 1
        self.nodes, self.height = done, level + 1

    def roots(self) -> DataFrame:
        """(group, digest, n) of each group of rows."""
        return self.nodes.filter("parent is null").select(*self.group, "digest", "n")

    def leaves(self) -> DataFrame:
        return self.nodes.filter("level = 0")

    def differing(self, other: Tree) -> tuple[DataFrame, int]:
        """((side, group, place, first, digest, n) of the ranges that only one of the trees has, nodes looked at). From the roots
        down, only nodes below differing ones are looked at: some ``fan`` a level for each changed row."""
        open_, seen = {"left": None, "right": None}, 0
        trees = {"left": self, "right": other}
        for level in reversed(range(max(self.height, other.height))):
            met = {}
            for side, tree in trees.items():
                here = tree.nodes.filter(F.col("level") == level)
                below = here.filter("parent is null")
                if open_[side] is not None:
                    above = open_[side].select(*self.group, F.col("place").alias("parent"), F.lit(True).alias("hit"))
                    below = here.alias("a").join(F.broadcast(above.alias("b")), _same([*self.group, "parent"]), "left").filter("b.hit or a.parent is null").select("a.*")
                met[side] = written(below)
                seen += met[side].count()
            for side, far in (("left", "right"), ("right", "left")):
                open_[side] = written(met[side].alias("a").join(met[far].alias("b"), _same([*self.group, "digest"]), "left_anti"))
        out = None
        for side in trees:
            part = open_[side].select(F.lit(side).alias("side"), *self.group, "place", "first", "digest", "n")
            out = part if out is None else out.unionByName(part)
        return out, seen

    def rehashed(self, rows: DataFrame, touched: DataFrame) -> tuple[Tree, int]:
        """(the tree of ``rows``, rows hashed again), where ``rows`` is this tree's table but for the groups and keys in ``touched``:
        those of rows that were added, removed or changed. Ranges that such keys fall into are read, by a filter on the first
        key, and hashed again, each with the one before it, which takes what a removed first row leaves. All others stay."""
        group, keys, few = self.group, self.keys, self.few
        starts = written(prefix.numbered(self.leaves().select(*group, "place", "first", "digest", "n"), group, ["first"], "k", few))
        key = F.struct(*(F.col("first")[k].alias(k) for k in keys))
        marks = starts.select(*group, key.alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("mark"))
        asked = touched.select(*group, F.struct(*keys).alias("at")).distinct()
        before, upto = (prefix.prefix_sums(marks.unionByName(asked.select("*", F.lit(k).alias("kind"), F.lit(0).alias("mark"))), group, ["at", "kind"], {"m": "mark"}, few).filter(F.col("kind") == k) for k in (0, 2))
        both = before.alias("a").join(upto.alias("b"), _same([*group, "at"])).select(*(F.col(f"a.{g}") for g in group), F.greatest(F.col("a.m") - 2, F.lit(0)).alias("low"), F.greatest(F.col("b.m") - 1, F.lit(0)).alias("high"))
        hit = written(both.select(*group, F.explode(F.sequence("low", "high")).alias("k")).distinct())
        told = _told(rows.filter(self._near(hit, starts)), group, keys)
        cuts = starts.select(*group, F.col("first").alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("mark"), F.lit(0).cast("long").alias("n"))
        own = told.select(*group, F.struct(*keys, "sha").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("mark"), "n")
        placed = prefix.prefix_sums(cuts.unionByName(own), group, ["at", "kind"], {"m": "mark"}, few).filter("kind = 1").withColumn("k", F.greatest(F.col("m") - 1, F.lit(0)))
        inside = placed.alias("a").join(hit.alias("b"), _same([*group, "k"]), "left_semi").select(*group, *(F.col("at")[k].alias(k) for k in keys), F.col("at.sha").alias("sha"), "n")
        inside = written(inside)
        kept = starts.alias("a").join(hit.alias("b"), _same([*group, "k"]), "left_anti").select(*group, "first", "digest", "n")
        leaves = kept.unionByName(_ranges(inside, group, keys, self.about, few).select(*group, "first", "digest", "n"))
        again = Tree(prefix.numbered(leaves, group, ["first"], "place", few), group, keys, self.about, self.fan, few)
        return again, int(inside.agg(F.sum("n")).first()[0] or 0)

    def _near(self, hit: DataFrame, starts: DataFrame) -> Column:
        """A filter on group and first key that all rows of the hit ranges pass; none if they are more than LISTED."""
        if hit.count() > LISTED:
            return F.lit(True)
        k = self.keys[0]
        after = starts.withColumn("k", F.col("k") - 1)
        found = hit.alias("h").join(starts.alias("a"), _same([*self.group, "k"], "h", "a"), "left").join(after.alias("b"), _same([*self.group, "k"], "h", "b"), "left")
        near = F.lit(False)
        for *own, n, low, high in found.select(*(F.col(f"h.{g}") for g in self.group), "h.k", F.col("a.first")[k], F.col("b.first")[k]).collect():
            one = F.lit(True)
            for g, v in zip(self.group, own):
                one = one & F.col(g).eqNullSafe(F.lit(v))
            if n > 0 and low is not None:
                one = one & (F.col(k) >= F.lit(low))
            if high is not None:  # nulls come first
                one = one & (F.col(k).isNull() | (F.col(k) <= F.lit(high)))
            near = near | one
        return near


def tree(rows: DataFrame, group: list[str], keys: list[str], about: int = 1024, fan: int = 16, few: int = prefix.FEW) -> Tree:
    """The tree of each group of rows. ``keys`` are columns in whose order ranges lie; all columns are hashed. An empty table
    has no root. Rows are bags: repeated rows count."""
    _checkpoints(rows.sparkSession)
    return Tree(_ranges(_told(rows, group, keys), group, keys, about, few), group, keys, about, fan, few)


def changed_rows(old: DataFrame, new: DataFrame, group: list[str], keys: list[str], about: int = 1024, fan: int = 16, few: int = prefix.FEW) -> DataFrame:
    """(side, group, keys, sha, n) of the rows that one table has more of than the other, from the ranges that differ alone. Rows
    are hashed and placed once a table, and kept for the ranges' rows."""
    placed = {side: written(_placed(_told(rows, group, keys), group, keys, about, few)) for side, rows in (("left", old), ("right", new))}
    a, b = (Tree(_leaves(rows, group, keys), group, keys, about, fan, few) for rows in placed.values())
    ranges, _ = a.differing(b)
    out = None
    for side, rows in placed.items():
        wanted = ranges.filter(F.col("side") == side).select(*group, "place")
        part = rows.alias("a").join(wanted.alias("b"), _same([*group, "place"]), "left_semi").select(*group, *keys, "sha", F.when(F.lit(side == "left"), -F.col("n")).otherwise(F.col("n")).alias("n"))
        out = part if out is None else out.unionByName(part)
    net = out.groupBy(*group, *keys, "sha").agg(F.sum("n").alias("n")).filter("n != 0")
    return net.select(F.when(F.col("n") < 0, "left").otherwise("right").alias("side"), *group, *keys, "sha", F.abs("n").alias("n"))
