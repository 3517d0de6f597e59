"""Pairs with an inner product from a bound on, by an exact metric index instead of all pairs.

``x.y >= t`` means ``|x - y|^2 <= |x|^2 + |y|^2 - 2 t``, a ball whose radius r each row knows from its own norm and the
largest one. Rows are dealt to cells by their nearest pivot, again and again until a cell has ``MOST`` rows at most. A
cell's pivots (four for each ``MOST`` rows, ``FAN`` at most) are taken from a sample of it, each the farthest from those
before, until all of the sample is near one. A row also visits each later cell that its ball may reach: if y is nearest
to pivot q and x to p, then y lies beyond the plane halfway between p and q, so x visits q's cell if it is within r of
that plane. So a pair in reach meets in one cell, once: that of the two rows' cells which comes later.

A cell whose rows would visit more than ``DENSE`` of the pivots gains nothing by that, nor does one of equal vectors: it
stays as it is. All rows of a cell meet by pairs of blocks of some ``BLOCK`` rows, each pair once: a matrix product of two
blocks, strip by strip, finds the candidates, and these are summed up again in the order of ``vectors.dot``. A task holds
two blocks and one strip, whatever the cell's size and however many pairs it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import workers
from quillon.functions.vectors import dot
from quillon.operators.graph import _checkpoints

FAN, MOST, BLOCK, PART = 1024, 256, 4096, 8192
DRAWN, JUDGED = 4, 64  # rows sampled for each pivot, and to judge the visits by
DENSE, LEVELS = 0.5, 12
SLACK = 1e-6  # of distances, for rounding
STRIP = 1 << 19  # products that a task holds
SMALL = 1_000_000  # rows of a table that is broadcast


def _met(small: DataFrame) -> DataFrame:
    """A checkpointed table as a join's small side: broadcast up to SMALL rows, counted first, else shuffled."""
    return F.broadcast(small) if small.count() <= SMALL else small


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _fold(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of columns i of x and j of y, summed up as ``vectors.dot`` does: the same to the bit."""
    out = np.zeros(len(i))
    for a, b in zip(x, y):
        out += a[i] * b[j]
    return out


def _second(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values by place, length) of vectors that may be null, have nulls or differ in length; nulls count as length -1."""
    rows = column.to_pylist()
    size = np.array([-1 if v is None or any(x is None for x in v) else len(v) for v in rows])
    out = np.zeros((max(size.max(initial=0), 0), len(rows)))
    for k, v in enumerate(rows):
        if size[k] > 0:
            out[: size[k], k] = v
    return out, size


def _meeting(least: float, on: list[str], carried: list[str], beside: str | None, forward: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs of one group of rows (left, right, second, id, vector and others): those of its first block with its second
    one, or within it where left is right; with ``forward`` only those whose first row has the lesser id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches)).combine_chunks()
        same = both["left"][0] == both["right"][0]
        one = both.filter(pc.invert(both["second"]))
        two = one if same else both.filter(both["second"])
        if not one.num_rows or not two.num_rows:
            return
        both = one if same else pa.concat_tables([one, two]).combine_chunks()
        shift = 0 if same else one.num_rows
        width = len(one["vector"][0])
        x, y = (_matrix(t["vector"], width) for t in (one, two))
        xs, ys = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
        ids = both["id"].to_numpy()
        extra, size = _second(both[beside]) if beside else (None, None)
        with np.errstate(over="ignore", invalid="ignore"):
            bound = least - 1e-9 * (1 + np.sqrt((x**2).sum(1).max(initial=0)) * np.sqrt((y**2).sum(1).max(initial=0)))  # the matrix product rounds otherwise
            step = max(1, STRIP // len(y))
            for at in range(0, len(x), step):
                low = at if same else 0
                i, j = np.nonzero(~(x[at : at + step] @ y[low:].T < bound))
                i, j = i + at, j + low
                if same:
                    i, j = i[j > i], j[j > i]
                product = _fold(xs, ys, i, j)
                a, b = ids[i], ids[j + shift]
                keep = ~(product < least) & ((a < b) if forward else (a != b))
                i, j, product, turn = i[keep], j[keep] + shift, product[keep], (a > b)[keep]
                if not len(i):
                    continue
                p, q = np.where(turn, j, i), np.where(turn, i, j)
                first, last = pa.array(p), pa.array(q)
                columns = {c: both[c].take(first) for c in on} | {"i": both["id"].take(first), "j": both["id"].take(last)}
                for c in carried:
                    columns |= {f"{c}_i": both[c].take(first), f"{c}_j": both[c].take(last)}
                columns["product"] = pa.array(product)
                if beside:
                    columns["beside"] = pa.array(_fold(extra, extra, p, q), mask=(size[p] != size[q]) | (size[p] < 0))
                made = pa.table(columns).combine_chunks()
                yield from made.to_batches()

    return run


def _meet(rows: DataFrame, least: float, on: list[str], keys: list[str], carried: list[str], beside: str | None = None, forward: bool = False) -> DataFrame:
    """(``on``, i, j, carried columns with these endings, product, beside) of rows dealt to groups by ``keys``, left and right."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = [*((c, kind[c]) for c in on), ("i", kind["id"]), ("j", kind["id"]), *((f"{c}_{s}", kind[c]) for c in carried for s in "ij"), ("product", "double"), *([("beside", "double")] if beside else [])]
    names = list(dict.fromkeys([*keys, "left", "right", "second", "id", "vector", *carried, *([beside] if beside else [])]))
    return rows.select(*names).groupBy(*keys, "left", "right").applyInArrow(_meeting(least, on, carried, beside, forward), ", ".join(f"`{c}` {t}" for c, t in schema))


def _whole(rows: DataFrame, on: list[str]) -> DataFrame:
    """Rows that can be in a pair, their vectors as doubles."""
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.withColumn("vector", F.col("vector").cast("array<double>")).dropna(subset=[*on, "id", "vector"])
    return rows.filter(fine)


def led(rows: DataFrame, min_dot: float, lead: int) -> DataFrame | None:
    """(i, j, other columns with these endings, product) of all pairs i < j whose i is among the ``lead`` least ids, or None if
    these have more than BLOCK rows: the leading rows meet every block of the others."""
    workers.ready(rows.sparkSession)
    rows = _whole(rows, [])
    last = rows.select("id").orderBy("id").limit(lead).agg(F.max("id")).first()[0]
    front = rows.filter(F.col("id") <= F.lit(last))
    if front.count() > BLOCK:
        return None
    parts = max(1, -(-rows.count() // BLOCK))
    left = front.withColumns({"left": F.lit(-1), "right": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "second": F.lit(False)})
    right = rows.withColumns({"left": F.lit(-1), "right": F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"), "second": F.lit(True)})
    width = F.size("vector")  # vectors of different lengths don't meet
    return _meet(left.unionByName(right).withColumn("width", width), float(min_dot), [], ["width"], [c for c in rows.columns if c not in ("id", "vector")], forward=True)


def _reach(x: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest pivot, distances to all, which cells each row's ball may reach)."""
    far = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T, 0))
    own = far.argmin(1)
    between = np.sqrt(np.maximum((pivots**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * pivots @ pivots.T, 0))
    apart = between[own]
    least = np.take_along_axis(far, own[:, None], 1)
    # far^2 - least^2 is twice the pivots' distance times the row's distance from the plane between them
    return own, far, far**2 - least**2 <= 2 * apart * (radius[:, None] + SLACK) + SLACK * (1 + least)


def _spread(x: np.ndarray, most: int, near: float) -> np.ndarray:
    """Up to ``most`` rows, each the farthest from those before; ends when all rows are within ``near`` of one."""
    taken = [0]
    far = ((x - x[0]) ** 2).sum(1)
    while len(taken) < most:
        k = int(far.argmax())
        if far[k] <= near * near:
            break
        taken.append(k)
        far = np.minimum(far, ((x - x[k]) ** 2).sum(1))
    return x[taken]


def _pivots(rows: DataFrame, most: int) -> DataFrame:
    """(cell, pivots, dense) of rows with their cell's size n, from its rows of least hash: some tell how many cells a row would
    visit, pivots are taken from the others."""
    first = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("id"), "id"))
    fan = F.least(F.lit(FAN), F.greatest(F.lit(16), F.ceil(4 * F.col("n") / most)))
    drawn = rows.filter("home").select("cell", "id", "vector", "radius", fan.alias("fan")).withColumn("k", first).filter(F.col("k") <= DRAWN * FAN + JUDGED).filter(F.col("k") <= DRAWN * F.col("fan") + JUDGED)
    packed = drawn.groupBy("cell").agg(F.max("fan").alias("fan"), F.sort_array(F.collect_list(F.struct("k", "vector", "radius"))).alias("drawn"))

    def judged(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for cell, fan, drawn in zip(*(batch.column(c).to_pylist() for c in ("cell", "fan", "drawn"))):
                x, radius = np.array([d["vector"] for d in drawn]), np.array([d["radius"] for d in drawn])
                pivots = _spread(x[JUDGED:] if len(x) > JUDGED else x, fan, float(np.median(radius)) / 2)
                seen = _reach(x[:JUDGED], pivots, radius[:JUDGED])[2].mean()
                alike = len(pivots) == 1
                for c, v in zip(out, (cell, pivots.ravel(), bool(alike or seen > DENSE))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.float64())), pa.array(out[2], pa.bool_())], ["cell", "pivots", "dense"])

    return packed.mapInArrow(judged, "cell bigint, pivots array<double>, dense boolean")


def _dealt(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """Rows of open cells in the cells of their pivots, as residents and as visitors."""
    names = rows.columns
    parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).checkpoint()
    left = rows.join(_met(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select(*names, "part")
    right = pivots.join(_met(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "part", "pivots")

    def split(own: pa.Table, told: pa.Table) -> pa.Table:
        if not own.num_rows or not told.num_rows:
            return own.slice(0, 0).select(names).append_column("child", pa.array([], pa.int32()))
        width = len(own["vector"][0])
        points = np.array(told["pivots"][0].as_py()).reshape(-1, width)
        x, home = _matrix(own["vector"], width), own["home"].to_numpy()
        at, far, reach = _reach(x, points, own["radius"].to_numpy())
        rows_at, cells = np.arange(len(x)), np.arange(len(points))
        visits = reach & np.where(home[:, None], cells > at[:, None], True)
        visits[rows_at[~home], at[~home]] = True
        who, where = np.nonzero(visits)
        take, child = np.r_[rows_at[home], who], np.r_[at[home], where]
        out = own.select(names).take(pa.array(take))
        for name, v in (("home", pa.array(np.r_[np.ones(int(home.sum()), bool), np.zeros(len(who), bool)])), ("far", pa.array(far[take, child]))):
            out = out.set_column(names.index(name), name, v)
        return out.append_column("child", pa.array(child, pa.int32()))

    keys = ["cell", "part"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", child int"
    moved = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(split, schema)
    moved = moved.withColumn("cell", F.xxhash64("cell", "child")).select(*names).checkpoint()
    edge = moved.filter("home").groupBy("cell").agg(F.max("far").alias("edge")).checkpoint()
    near = moved.join(_met(edge), "cell").filter(F.col("home") | (F.col("far") <= F.col("edge") + F.col("radius") + SLACK))  # cells without residents go
    return near.select(*names)


class MetricIndex:
    """Rows (``on``, id, vector and others) in cells. ``compared`` is how many pairs the cells hold, to be set against n(n - 1)/2.

    Rows with a null or non-finite component, or no vector, are in no pair; vectors of different lengths neither."""

    def __init__(self, rows: DataFrame, min_dot: float, on: list[str], most: int = MOST, levels: int = LEVELS) -> None:
        _checkpoints(rows.sparkSession)
        self.on, self.least = on, float(min_dot)
        self.carried = [c for c in rows.columns if c not in (*on, "id", "vector")]
        rows = _whole(rows, on).withColumn("square", dot(F.col("vector"), F.col("vector")))
        top = rows.agg(F.max("square")).first()[0] or 0.0
        ball = F.col("square") + top - 2 * self.least + SLACK
        rows = rows.filter(ball >= 0).withColumns({"radius": F.sqrt(ball), "cell": F.xxhash64(*(on or [F.lit(0)]), F.size("vector")), "home": F.lit(True), "far": F.lit(0.0)})
        done, level = [], 0
        rows = rows.checkpoint()
        while True:
            size = rows.groupBy("cell").agg(F.count_if("home").alias("n"))
            large = size.filter(F.col("n") > most).checkpoint()
            if level == levels or large.isEmpty():
                done.append(rows)
                break
            pivots = _pivots(rows.join(_met(large), "cell"), most).checkpoint()
            open_cells = pivots.filter("not dense").select("cell")
            done.append(rows.join(_met(open_cells), "cell", "left_anti").checkpoint())
            if open_cells.isEmpty():
                break
            rows = _dealt(rows.join(_met(open_cells), "cell"), pivots.filter("not dense").drop("dense")).checkpoint()
            level += 1
        self.rows, self.levels = done[0], level
        for part in done[1:]:
            self.rows = self.rows.unionByName(part)

    @property
    def compared(self) -> int:
        cells = self.rows.groupBy(*self.on, "cell").agg(F.count_if("home").alias("h"), F.count("*").alias("n"))
        return int(cells.agg(F.sum(F.expr("h * (h - 1) div 2 + (n - h) * h"))).first()[0] or 0)

    def pairs(self, beside: str | None = None) -> DataFrame:
        """(``on``, i, j, other columns of i and j with these endings, product): pairs i < j from the bound on, each once. ``beside``
        names a column of other vectors, whose inner product is given as well, null where one is null or lengths differ."""
        keys = [*self.on, "cell"]
        size = self.rows.groupBy(*keys).agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("v")).filter("h > 0")
        blocks = size.select(*keys, F.ceil(F.col("h") / BLOCK).cast("int").alias("own"), F.ceil(F.col("v") / BLOCK).cast("int").alias("guests")).checkpoint()
        part = lambda n: F.pmod(F.xxhash64("id"), F.greatest(F.col(n), F.lit(1))).cast("int")
        rows = self.rows.join(_met(blocks), keys).withColumn("at", F.when(F.col("home"), part("own")).otherwise(F.col("own") + part("guests")))
        # blocks of residents are 0..own - 1 and meet those from themselves on; blocks of visitors follow and meet all of these
        left = rows.withColumns({"left": F.col("at"), "right": F.explode(F.when(F.col("home"), F.sequence("at", F.col("own") - 1)).otherwise(F.sequence(F.lit(0), F.col("own") - 1))), "second": F.lit(False)})
        every = F.filter(F.sequence(F.lit(0), F.col("own") + F.col("guests") - 1), lambda k: (k < F.col("at")) | (k >= F.col("own")))
        right = rows.filter("home").withColumns({"left": F.explode(every), "right": F.col("at"), "second": F.lit(True)})
        return _meet(left.unionByName(right), self.least, self.on, keys, [c for c in self.carried if c != beside], beside)
