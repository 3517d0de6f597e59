"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. A cell's documents are kept with one probability, from 0 to
1, and these are raked so that the expected kept tokens meet the target marginals of the three within ``budget``
(a share of all tokens). Each round scales the cells to the targets of each dimension in turn and then takes back
what exceeds 1; the excess is remembered by cell and offered again in the next round (Dykstra's correction), so the
rounds approach the one solution that is closest to an even draw and meets the targets with no probability above 1.
Rounds go on until the largest relative miss of a marginal is below ``TOLERANCE``, ``ROUNDS`` times at most, and stop
where ``STALL`` rounds haven't lowered it by a hundredth: targets of different dimensions that contradict each other
have no solution. A fit that ends so is reported by a RuntimeWarning, and every row carries the largest relative miss
of its three marginals.

A target above the tokens that a value has can't be met by keeping all of it: it is lowered to that, and the rest is
shared out to the dimension's other values in proportion to their targets. Cells of values that are wanted whole are
kept whole, and only the others are scaled.

The draw is a hash of the id: the same documents are kept whatever the partitioning, and retries agree.

The documents are read once to count tokens and once to be judged; only cell totals are shuffled, pre-aggregated.
A cell table of at most ``driver_cells`` rows (counted first) is raked in memory; a larger one by grouped
aggregations, with the same steps, tolerance and round limit.

The default topic is a coarse one, told by a text's form (``topic_of``); a column of real topics is a parameter.

Cases: null text has no tokens; null sources, languages and topics are a cell of their own (the empty string).
Targets are shares over the values that occur; those without a target share get none and are dropped. Documents
without tokens weigh nothing and are drawn like their cell; a cell without tokens is drawn at the budget's share.
Repeated rows and ids are judged alike; a null id draws as the empty text. An empty table gives an empty result.
Very long texts are read whole. Other columns pass through ``mixed`` whatever their names.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fresh, named, text_of

DIMENSIONS = ("source", "lang", "topic")
ROUNDS, TOLERANCE, STALL = 500, 1e-6, 30
#: Shares wanted of languages; the others that occur share what is left by their tokens.
LANGUAGES = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


def words_in(text: Column) -> Column:
    """How many words a text has: starts of runs without white space."""
    flat = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(flat, " ", -1), lambda w: w != "")).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse form-based topic, the first that applies."""
    n = F.greatest(F.length(text), F.lit(1))
    often = lambda c, per: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) > n / per
    return F.when(often("|", 60), "table").when(F.upper(text) == text, "capitals").when(often("%%%", 30), "noise").when(F.contains(F.lower(text), F.lit("licens")), "licence").when(F.contains(text, F.lit("@")), "contact").otherwise("prose")


def rake(totals: np.ndarray, groups: list[np.ndarray], targets: list[np.ndarray], even: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """(probability, miss) of cells. groups[d] numbers each cell's value of dimension d, targets[d] has its kept tokens
    wanted; ``even`` is the probability to start from, 1 the most."""
    whole = np.zeros(len(totals), bool)  # of values that are wanted whole
    for group, target in zip(groups, targets):
        whole |= (target >= np.bincount(group, totals, len(target)) * (1 - 1e-12))[group]
    sure = [np.bincount(group, totals * whole, len(target)) for group, target in zip(groups, targets)]
    chance, excess = np.where(whole, 1.0, float(even)), np.ones(len(totals))
    miss, progress = np.zeros(len(totals)), Progress(tolerance)
    for _ in range(rounds):
        miss = np.zeros(len(totals))
        for group, target, held in zip(groups, targets, sure):
            now = np.bincount(group, totals * chance * ~whole, len(target))
            ratio = np.divide(np.maximum(target - held, 0), now, out=np.ones(len(target)), where=now > 0)
            off = np.abs(np.divide(target, now + held, out=np.ones(len(target)), where=now + held > 0) - 1)
            miss = np.maximum(miss, np.where(target > 0, off, 0)[group])
            chance *= np.where(whole, 1.0, ratio[group])
        wanted = chance * excess
        chance = np.minimum(1.0, wanted)
        excess = np.divide(wanted, chance, out=np.ones(len(totals)), where=chance > 0)
        if progress.done(miss.max(initial=0)):
            break
    _report(miss.max(initial=0), progress.rounds, tolerance)
    return chance, miss


class Progress:
    """When to stop: one rule for the fits in memory and spread."""

    def __init__(self, tolerance: float) -> None:
        self.tolerance, self.best, self.since, self.rounds = tolerance, float("inf"), 0, 0

    def done(self, worst: float) -> bool:
        self.rounds, self.since = self.rounds + 1, self.since + 1
        if worst < 0.99 * self.best:
            self.best, self.since = worst, 0
        return worst < self.tolerance or self.since >= STALL


def _report(worst: float, rounds: int, tolerance: float) -> None:
    if worst >= tolerance:
        warnings.warn(f"raking has not converged in {rounds} rounds: the largest relative miss is {worst:.3g}, wanted below {tolerance:.3g}", RuntimeWarning, stacklevel=3)


def target_shares(totals: dict[str, float], power: float, fixed: dict[str, float] | None = None) -> dict[str, float]:
    """Shares in proportion to tokens ** power; fixed ones first, then scaled to one."""
    raw = {k: v**power for k, v in totals.items() if v > 0}
    if fixed:
        rest = sum(v for k, v in raw.items() if k not in fixed)
        left = 0.05 if rest else 0.0
        raw = {k: fixed[k] * (1 - left) if k in fixed else left * v / rest for k, v in raw.items()}
    whole = sum(raw.values()) or 1.0
    return {k: v / whole for k, v in raw.items()}


def within(wanted: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Targets that no value lacks the tokens for: min(held, level * wanted) with the same sum, or all that is held."""
    open_, out = wanted > 0, np.zeros(len(wanted))
    left = wanted.sum()
    for _ in range(len(wanted)):  # each round fills a value at least, or ends
        level = left / wanted[open_].sum() if open_.any() else 0.0
        full = open_ & (level * wanted >= held)
        if not full.any():
            out[open_] = level * wanted[open_]
            return out
        out[full] = held[full]
        left, open_ = left - held[full].sum(), open_ & ~full
    return out


def _fit_local(cells: list, powers: dict[str, float], fixed: dict, share: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> list:
    """(source, lang, topic, probability, miss) of cells in memory."""
    tokens = np.array([c["tokens"] for c in cells], np.float64)
    groups, targets = [], []
    for d in DIMENSIONS:
        values = sorted({c[d] for c in cells})
        number = {v: k for k, v in enumerate(values)}
        group = np.array([number[c[d]] for c in cells], np.int64)
        sums = np.bincount(group, tokens, len(values))
        wanted = target_shares(dict(zip(values, sums)), powers.get(d, 1.0), fixed.get(d))
        groups.append(group)
        targets.append(within(np.array([wanted.get(v, 0.0) for v in values]) * tokens.sum() * share, sums))
    chance, miss = rake(tokens, groups, targets, share, rounds, tolerance)
    return [(*(c[d] for d in DIMENSIONS), float(p), float(m)) for c, p, m in zip(cells, chance, miss)]


def _targets(cells: DataFrame, d: str, total: float, power: float, fixed: dict | None, share: float, ws: Workspace) -> DataFrame:
    """(value of d, target, whether it is all that is held) as ``target_shares`` and ``within`` give them, by grouped
    aggregation."""
    sums = cells.groupBy(d).agg(F.sum("tokens").alias("held")).filter("held > 0").withColumn("raw", F.pow("held", F.lit(power)))
    if fixed:
        known = F.create_map(*(F.lit(x) for kv in fixed.items() for x in kv))[F.col(d)]
        rest = sums.filter(known.isNull()).agg(F.sum("raw")).first()[0]
        left = 0.05 if rest else 0.0
        sums = sums.withColumn("raw", F.coalesce(known * (1 - left), left * F.col("raw") / F.lit(rest or 1.0)))
    sums = ws.save(sums.select(d, "held", F.col("raw").cast("double").alias("raw")), f"raw_{d}")
    whole = sums.agg(F.sum("raw")).first()[0] or 1.0
    budget, level = total * share, total * share / whole
    while True:  # the level only rises, as values are found full
        full = F.lit(level) * F.col("raw") >= F.col("held")
        filled, still = sums.agg(F.sum(F.when(full, F.col("held")).otherwise(0)), F.sum(F.when(~full, F.col("raw")).otherwise(0.0))).first()
        higher = (budget - (filled or 0)) / still if still else level
        if higher <= level * (1 + 1e-15):
            break
        level = higher
    return ws.save(sums.select(d, F.least(F.lit(level) * F.col("raw"), F.col("held").cast("double")).alias(f"target_{d}"), (F.lit(level) * F.col("raw") >= F.col("held") * (1 - 1e-12)).alias(f"full_{d}")), f"target_{d}")


def _fit_spread(cells: DataFrame, powers: dict[str, float], fixed: dict, share: float, ws: Workspace, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The same steps as grouped aggregations over the cell table, written every round."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    wanted = {d: _targets(cells, d, total, powers.get(d, 1.0), fixed.get(d), share, ws) for d in DIMENSIONS}
    whole = F.lit(False)
    for d in DIMENSIONS:
        cells = cells.join(wanted[d], d, "left")
        whole = whole | F.coalesce(F.col(f"full_{d}"), F.lit(True))  # a value without tokens has no target
    cells = ws.save(cells.select(*DIMENSIONS, "tokens", *(F.coalesce(f"target_{d}", F.lit(0.0)).alias(f"target_{d}") for d in DIMENSIONS), whole.alias("whole")), "wanted")
    fitted, worst = cells.withColumns({"chance": F.when(F.col("whole"), 1.0).otherwise(float(share)), "excess": F.lit(1.0)}), 0.0
    progress = Progress(tolerance)
    for k in range(rounds):
        fitted = fitted.withColumn("miss", F.lit(0.0))
        for d in DIMENSIONS:
            part = F.col("tokens") * F.col("chance")
            now = fitted.groupBy(d).agg(F.sum(F.when(~F.col("whole"), part).otherwise(0.0)).alias("now"), F.sum(F.when(F.col("whole"), part).otherwise(0.0)).alias("sure"))
            target, both = F.col(f"target_{d}"), F.col("now") + F.col("sure")
            ratio = F.when(~F.col("whole") & (F.col("now") > 0), F.greatest(target - F.col("sure"), F.lit(0.0)) / F.col("now")).otherwise(1.0)
            off = F.when((both > 0) & (target > 0), F.abs(target / both - 1)).otherwise(0.0)
            fitted = fitted.join(now, d).withColumns({"chance": F.col("chance") * ratio, "miss": F.greatest("miss", off)}).drop("now", "sure")
        asked = F.col("chance") * F.col("excess")
        fitted = fitted.withColumns({"chance": F.least(F.lit(1.0), asked), "excess": F.when(asked > 0, asked / F.least(F.lit(1.0), asked)).otherwise(1.0)})
        fitted = ws.save(fitted, f"fitted{k}")
        worst = fitted.agg(F.max("miss")).first()[0] or 0.0
        if k:
            ws.drop(f"fitted{k - 1}")
        if progress.done(worst):
            break
    _report(worst, progress.rounds, tolerance)
    return fitted.select(*DIMENSIONS, F.col("chance").alias("probability"), "miss")


def _cell_of(text_column: str, topic: Column | None) -> Column:
    """The cell's values and the token count of a row."""
    text = text_of(text_column)
    plain = lambda d: F.coalesce(F.col(d).cast("string"), F.lit("")).alias(d)
    return F.struct(plain("source"), plain("lang"), F.coalesce(topic_of(text) if topic is None else topic, F.lit("")).alias("topic"), words_in(text).alias("tokens"))


def judged(rows: DataFrame, cell: str, id_column: str, powers: dict[str, float] | None, fixed: dict | None, share: float, seed: int, driver_cells: int, ws: Workspace) -> tuple[DataFrame, str]:
    """rows, whose column ``cell`` tells their cell, with one more struct column (probability, miss, kept), and its name.
    Rows aren't shuffled up to ``driver_cells`` cells; beyond, ids meet their cells' weights and rows are shuffled."""
    powers = {"source": 0.5, "lang": 1.0, "topic": 0.7} if powers is None else powers
    fixed = {"lang": LANGUAGES} if fixed is None else fixed
    cells = ws.save(rows.select(F.col(cell).alias("c")).groupBy(*(F.col(f"c.{d}").alias(d) for d in DIMENSIONS)).agg(F.sum("c.tokens").alias("tokens")), "cells")
    small = cells.count() <= driver_cells
    if small:
        made = _fit_local(cells.collect(), powers, fixed, share)
        fits = F.broadcast(rows.sparkSession.createDataFrame(made, "source string, lang string, topic string, probability double, miss double"))
    else:
        fits = ws.save(_fit_spread(cells, powers, fixed, share, ws), "fits")
    key, fit = fresh(rows.columns, "_key", "_fit")
    fits = fits.select(F.struct(*DIMENSIONS).alias(key), F.struct("probability", "miss").alias(fit))
    draw = F.pmod(F.xxhash64(F.coalesce(named(id_column).cast("string"), F.lit("")), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    out = rows.join(fits, F.struct(*(F.col(f"{cell}.{d}") for d in DIMENSIONS)) == F.col(key)).drop(key)
    return out.withColumn(fit, F.struct(F.col(f"{fit}.probability"), F.col(f"{fit}.miss"), (draw < F.col(f"{fit}.probability")).alias("kept"))), fit


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", topic: Column | None = None, powers: dict[str, float] | None = None, fixed: dict[str, dict[str, float]] | None = None, share: float = 0.5, seed: int = 1, driver_cells: int = 200_000) -> DataFrame:
    """One row per input row: id, source, lang, topic, n_tokens, probability, miss, kept."""
    ws = Workspace(docs.sparkSession, "mixing")
    rows = ws.save(docs.select(named(id_column).alias("_id"), _cell_of(text_column, topic).alias("cell")), "rows")
    out, fit = judged(rows, "cell", "_id", powers, fixed, share, seed, driver_cells, ws)
    return out.select(F.col("_id").alias(id_column), *(f"cell.{d}" for d in DIMENSIONS), F.col("cell.tokens").alias("n_tokens"), f"{fit}.probability", f"{fit}.miss", f"{fit}.kept")


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", topic: Column | None = None, powers: dict[str, float] | None = None, fixed: dict[str, dict[str, float]] | None = None, share: float = 0.5, seed: int = 1, driver_cells: int = 200_000) -> DataFrame:
    """The rows of docs that are drawn, with all their columns; a second read, no shuffle of texts while the cells are
    few enough to be broadcast."""
    ws = Workspace(docs.sparkSession, "mixing")
    (cell,) = fresh(docs.columns, "_cell")
    out, fit = judged(docs.withColumn(cell, _cell_of(text_column, topic)), cell, id_column, powers, fixed, share, seed, driver_cells, ws)
    return out.filter(F.col(f"{fit}.kept")).select(*(named(c) for c in docs.columns))
