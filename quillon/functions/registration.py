"""Which turn and zoom took one grey image to another: corners, binary descriptors, matches and a consensus, in NumPy.

Corners are local maxima of the smaller-eigenvalue measure on a pyramid of sizes, so a zoomed copy finds its corners on
another level. A corner's direction is that from its middle to the centroid of the grey values around it; its descriptor
compares pairs of smoothed values whose places turn with that direction. A match is kept if it is clearly nearer than the
second best. Each pair of matches fixes a similarity, written as one complex factor and offset; the one that most matches
agree with is fitted again to these by least squares.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from quillon.functions import rasters as R

REACH = 13  # of a descriptor's places, in pixels of its level
BITS = 256


@dataclass(frozen=True)
class Effort:
    """Fixed values of the estimate: sizes, bounds and draws. The same for every image."""

    most_side: int = 512
    corners: int = 2000
    levels: int = 8
    step: float = 1.2
    ratio: float = 0.75
    least_matches: int = 12
    least_inliers: int = 10
    reach: float = 3.0
    draws: int = 2000
    seed: int = 0


def shrunken(a: np.ndarray, most: int) -> np.ndarray:
    """The image with its longer side at most ``most`` pixels."""
    part = most / max(a.shape)
    return a if part >= 1 else R.resized(a, max(1, int(a.shape[0] * part)), max(1, int(a.shape[1] * part)), "area")


def smooth(a: np.ndarray, sigma: float) -> np.ndarray:
    n = math.ceil(3 * sigma)
    w = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    w /= w.sum()
    padded = np.pad(a, n, mode="edge")
    rows = sum(x * padded[k : k + a.shape[0]] for k, x in enumerate(w))
    return sum(x * rows[:, k : k + a.shape[1]] for k, x in enumerate(w))


def corners(a: np.ndarray, most: int, margin: int) -> np.ndarray:
    """(y, x) of the strongest local maxima of the smaller eigenvalue of the gradients' moments, to parts of a pixel."""
    if min(a.shape) <= 2 * margin + 2:
        return np.zeros((0, 2))
    gy, gx = np.gradient(smooth(a, 1.0))
    yy, xx, xy = smooth(gy * gy, 1.5), smooth(gx * gx, 1.5), smooth(gy * gx, 1.5)
    strength = (yy + xx) / 2 - np.sqrt(((yy - xx) / 2) ** 2 + xy**2)
    inner = strength[margin:-margin, margin:-margin]
    around = np.max([strength[margin + dy : strength.shape[0] - margin + dy, margin + dx : strength.shape[1] - margin + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx], axis=0)
    y, x = np.nonzero((inner > around) & (inner > 0.001 * max(strength.max(), 1e-9)) & (inner > 1e-3))
    order = np.argsort(-inner[y, x], kind="stable")[:most]
    y, x = y[order] + margin, x[order] + margin
    bend = lambda low, mid, high: np.clip(np.divide(low - high, 2 * (low - 2 * mid + high), out=np.zeros_like(mid), where=low - 2 * mid + high < 0), -0.5, 0.5)
    mid = strength[y, x]
    return np.stack([y + bend(strength[y - 1, x], mid, strength[y + 1, x]), x + bend(strength[y, x - 1], mid, strength[y, x + 1])], 1)


def pattern(seed: int = 7) -> np.ndarray:
    """BITS pairs of places within REACH, as complex offsets (x + iy): drawn once, the same everywhere."""
    rng = np.random.default_rng(seed)
    far = lambda: (REACH - 1) * np.sqrt(rng.random(BITS)) * np.exp(2j * math.pi * rng.random(BITS))
    return np.stack([far(), far()])


PATTERN = pattern()
DISC = np.array([complex(x, y) for y in range(-REACH, REACH + 1) for x in range(-REACH, REACH + 1) if x * x + y * y <= REACH * REACH])


def described(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each corner."""
    soft = smooth(a, 2.0)
    value = lambda places: soft[np.clip(np.rint(places.imag).astype(int), 0, a.shape[0] - 1), np.clip(np.rint(places.real).astype(int), 0, a.shape[1] - 1)]
    middle = at[:, 1] + 1j * at[:, 0]
    weight = value(middle[:, None] + DISC)
    centroid = (weight * DISC).sum(1)
    turn = centroid / np.where(np.abs(centroid) > 0, np.abs(centroid), 1)
    one, two = (value(middle[:, None] + turn[:, None] * p) for p in PATTERN)
    return np.where(one < two, 1, -1).astype(np.float32)


def features(a: np.ndarray, effort: Effort) -> tuple[np.ndarray, np.ndarray]:
    """Places (complex, x + iy in pixels of the image) and descriptors over all levels."""
    places, rows = [np.zeros(0, complex)], [np.zeros((0, BITS), np.float32)]
    share = (1 - effort.step**-2) / (1 - effort.step ** (-2 * effort.levels))  # corners go by a level's area
    for k in range(effort.levels):
        h, w = (max(1, round(n / effort.step**k)) for n in a.shape)
        if min(h, w) <= 2 * (REACH + 2):
            break
        level = R.resized(a, h, w, "area").astype(float)
        at = corners(level, max(1, round(effort.corners * share * effort.step ** (-2 * k))), REACH + 1)
        if len(at):
            places.append((at[:, 1] + 0.5) * a.shape[1] / w - 0.5 + 1j * ((at[:, 0] + 0.5) * a.shape[0] / h - 0.5))
            rows.append(described(level, at))
    return np.concatenate(places), np.concatenate(rows)


def matches(one: np.ndarray, two: np.ndarray, ratio: float) -> np.ndarray:
    """(row of one, row of two) where the nearest differs in fewer than ``ratio`` of the bits of the second nearest."""
    out = []
    for at in range(0, len(one), 512):  # bounds the table of distances
        far = (BITS - one[at : at + 512] @ two.T) / 2
        near = np.argpartition(far, 1, axis=1)[:, :2]
        d = np.take_along_axis(far, near, 1)
        near, d = np.take_along_axis(near, np.argsort(d, 1), 1), np.sort(d, 1)
        good = np.flatnonzero(d[:, 0] < ratio * d[:, 1])
        out.append(np.stack([good + at, near[good, 0]], 1))
    return np.concatenate(out)


def consensus(p: np.ndarray, q: np.ndarray, effort: Effort) -> tuple[complex, complex, int]:
    """(factor, offset, inliers) of q = factor * p + offset that most matches agree with to ``reach`` pixels."""
    rng = np.random.default_rng(effort.seed)
    i, j = rng.integers(len(p), size=(2, effort.draws))
    apart = np.abs(p[i] - p[j]) > effort.reach
    i, j = i[apart], j[apart]
    if not len(i):
        return 0, 0, 0
    factor = (q[i] - q[j]) / (p[i] - p[j])
    offset = q[i] - factor * p[i]
    votes = np.concatenate([(np.abs(f[:, None] * p + o[:, None] - q) <= effort.reach).sum(1) for f, o in zip(np.array_split(factor, -(-len(i) // 256)), np.array_split(offset, -(-len(i) // 256)))])
    k = int(votes.argmax())
    f, o = factor[k], offset[k]
    for _ in range(5):
        inside = np.abs(f * p + o - q) <= effort.reach
        if inside.sum() < 2:
            break
        pm, qm = p[inside].mean(), q[inside].mean()
        spread = (np.abs(p[inside] - pm) ** 2).sum()
        if spread == 0:
            break
        f = (np.conj(p[inside] - pm) * (q[inside] - qm)).sum() / spread
        o = qm - f * pm
    return f, o, int((np.abs(f * p + o - q) <= effort.reach).sum())


def similarity(source: np.ndarray, target: np.ndarray, effort: Effort = Effort()) -> tuple[float, float, int] | None:
    """(angle in degrees, zoom, matches that agree) of the similarity from source to target, or None if too few corners,
    matches or agreeing matches are found. Angles go from the x axis to the y axis, which points down."""
    source, target = shrunken(source, effort.most_side), shrunken(target, effort.most_side)
    (p, one), (q, two) = features(source, effort), features(target, effort)
    if min(len(p), len(q)) < effort.least_matches:
        return None
    met = matches(one, two, effort.ratio)
    if len(met) < effort.least_matches:
        return None
    factor, _, agree = consensus(p[met[:, 0]], q[met[:, 1]], effort)
    if agree < effort.least_inliers or factor == 0:
        return None
    return math.degrees(math.atan2(factor.imag, factor.real)), abs(factor), agree


def transformed(a: np.ndarray, angle: float, zoom: float, fill: float = 128.0) -> np.ndarray:
    """The grey image turned and zoomed about its middle, read between pixels; ``fill`` enters from outside."""
    h, w = a.shape
    y, x = np.mgrid[:h, :w]
    middle = complex((w - 1) / 2, (h - 1) / 2)
    at = (x + 1j * y - middle) / (zoom * np.exp(1j * math.radians(angle))) + middle
    x0, y0 = np.floor(at.real).astype(int), np.floor(at.imag).astype(int)
    fx, fy = at.real - x0, at.imag - y0
    padded = np.pad(a.astype(float), 1, constant_values=fill)
    read = lambda yy, xx: padded[np.clip(yy + 1, 0, h + 1), np.clip(xx + 1, 0, w + 1)]
    mixed = (1 - fy) * ((1 - fx) * read(y0, x0) + fx * read(y0, x0 + 1)) + fy * ((1 - fx) * read(y0 + 1, x0) + fx * read(y0 + 1, x0 + 1))
    return np.clip(np.floor(mixed + 0.5), 0, 255).astype(np.uint8)
