"""NumPy kernels over one image: height x width, or height x width x 3 in the order red, green, blue; 8-bit unless said."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np


def grey(rgb: np.ndarray) -> np.ndarray:
    """BT.601 luma in 16-bit fixed point, rounded to 8 bits."""
    return ((rgb.astype(np.int64) @ np.array([19595, 38470, 7471]) + (1 << 15)) >> 16).astype(np.uint8)


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue in degrees, saturation and value in 0..1; grey has hue and saturation 0."""
    c = rgb.astype(float) / 255
    top, low = c.max(-1), c.min(-1)
    span = top - low
    safe = np.where(span > 0, span, 1)
    r, g, b = np.moveaxis(c, -1, 0)
    turn = np.select([top == r, top == g], [(g - b) / safe, 2 + (b - r) / safe], 4 + (r - g) / safe)
    hue = np.where(span > 0, turn * 60 % 360, 0)
    return np.stack([hue, np.divide(span, top, out=np.zeros_like(span), where=top > 0), top], -1)


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0))


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)


#: Filters of ``resized``: kernel and half width.
FILTERS: dict[str, tuple[Callable[[np.ndarray], np.ndarray], float]] = {"bicubic": (_cubic, 2), "lanczos": (_lanczos, 3)}


def _taps(size: int, wanted: int, name: str) -> np.ndarray:
    """Weights (wanted x size) of one axis. Shrinking widens the kernel; "area" averages by overlap."""
    step = size / wanted
    if name == "area":
        left, cells = np.arange(wanted)[:, None] * step, np.arange(size)[None]
        w = np.clip(np.minimum(left + step, cells + 1) - np.maximum(left, cells), 0, None)
    else:
        kernel, reach = FILTERS[name]
        wide = max(step, 1.0)
        off = np.arange(size)[None] + 0.5 - (np.arange(wanted)[:, None] + 0.5) * step
        w = np.where(np.abs(off) < reach * wide, kernel(off / wide), 0)
    return w / w.sum(1, keepdims=True)


def _byte(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def resized(a: np.ndarray, height: int, width: int, name: str = "bicubic") -> np.ndarray:
    """Resampled along x and then along y, rounded to 8 bits after each."""
    if a.shape[1] != width:
        a = _byte(np.moveaxis(np.tensordot(_taps(a.shape[1], width, name), a, (1, 1)), 0, 1))
    if a.shape[0] != height:
        a = _byte(np.tensordot(_taps(a.shape[0], height, name), a, (1, 0)))
    return a


def centred(a: np.ndarray, shorter: int = 255, crop: int = 224) -> np.ndarray:
    """The shorter side brought to ``shorter`` by bicubic resampling, then the middle square of side ``crop``."""
    h, w = a.shape[:2]
    h, w = (shorter, shorter * w // h) if h <= w else (shorter * h // w, shorter)
    a = resized(a, h, w)
    top, left = round((h - crop) / 2), round((w - crop) / 2)
    return a[top : top + crop, left : left + crop]


def cosine_basis(n: int) -> np.ndarray:
    """Rows are the cosines of the discrete transform (type 2), not normalised."""
    return np.cos(math.pi * (np.arange(n)[None] + 0.5) * np.arange(n)[:, None] / n)


def perceptual_hash(rgb: np.ndarray, side: int = 8, times: int = 4) -> int:
    """``side``² bits, the first one highest: which low frequencies of the shrunken grey image exceed their median."""
    n = side * times
    basis = cosine_basis(n)[:side]
    low = 4 * basis @ resized(grey(rgb), n, n, "lanczos").astype(float) @ basis.T
    bits = low > np.median(low)
    return int("".join("01"[int(b)] for b in bits.ravel()), 2)


def moved(mask: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The mask shifted; nothing enters from outside."""
    out = np.zeros_like(mask)
    h, w = mask.shape
    out[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = mask[max(-dy, 0) : h - max(dy, 0), max(-dx, 0) : w - max(dx, 0)]
    return out


CROSS = ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))


def eroded(mask: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        mask = np.logical_and.reduce([moved(mask, *s) for s in CROSS])
    return mask


def dilated(mask: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        mask = np.logical_or.reduce([moved(mask, *s) for s in CROSS])
    return mask


def labelled(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """(labels, count): 4-connected parts, numbered from 1 by their first pixel; 0 is outside. Parts are joined by
    hooking roots to the least root beside them until no edge joins two, so long parts need few rounds."""
    at = np.arange(mask.size).reshape(mask.shape)
    beside, below = mask[:, :-1] & mask[:, 1:], mask[:-1] & mask[1:]
    a = np.concatenate([at[:, :-1][beside], at[:-1][below]])
    b = np.concatenate([at[:, 1:][beside], at[1:][below]])
    root = at.ravel().copy()
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    inside = mask.ravel()
    firsts, numbers = np.unique(root[inside], return_inverse=True)
    out = np.zeros(mask.size, dtype=np.int64)
    out[inside] = numbers + 1
    return out.reshape(mask.shape), len(firsts)


def filled(mask: np.ndarray) -> np.ndarray:
    """Outside parts that don't reach the edge become inside."""
    parts, n = labelled(~mask)
    edge = np.concatenate([parts[0], parts[-1], parts[:, 0], parts[:, -1]])
    open_ = np.zeros(n + 1, dtype=bool)
    open_[edge] = True
    open_[0] = False
    return ~open_[parts]


def largest(mask: np.ndarray) -> np.ndarray:
    """The part with the most pixels, of equal ones the first; an empty mask stays empty."""
    parts, n = labelled(mask)
    return parts == np.bincount(parts.ravel())[1:].argmax() + 1 if n else mask


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Blurred as float, cut at about three deviations, mirrored at the edges without repeating the edge itself."""
    reach = round(3 * sigma)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    w /= w.sum()
    out = a.astype(float)
    for axis in (1, 0):
        pad = [(0, 0)] * out.ndim
        pad[axis] = (reach, reach)
        out = np.lib.stride_tricks.sliding_window_view(np.pad(out, pad, mode="reflect"), len(w), axis) @ w
    return out


@lru_cache(maxsize=64)
def blurs(n: int, sigmas: tuple[float, ...]) -> np.ndarray:
    """``gaussian`` along an axis of n pixels as a matrix for each sigma."""
    out = np.zeros((len(sigmas), n, n))
    for k, sigma in enumerate(sigmas):
        reach = round(3 * sigma)
        w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        at = np.lib.stride_tricks.sliding_window_view(np.pad(np.arange(n), reach, mode="reflect"), len(w))
        np.add.at(out[k], (np.arange(n)[:, None], at), w / w.sum())
    return out


def upright(a: np.ndarray, orientation: int) -> np.ndarray:
    """The image turned as its orientation tag (1 to 8) asks; other tags leave it."""
    if orientation in (5, 6, 7, 8):
        a = np.swapaxes(a, 0, 1)
    if orientation in (3, 4, 7, 8):
        a = a[::-1]
    if orientation in (2, 3, 6, 7):
        a = a[:, ::-1]
    return a


def orientation(content: bytes) -> int:
    """The orientation tag of a JPEG file's Exif part; 1 if there is none or it can't be read."""
    at = 2
    if content[:2] != b"\xff\xd8":
        return 1
    while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] not in (0xDA, 0xD9):
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            tiff = content[at + 10 : at + 2 + size]
            order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
            if order is None:
                return 1
            first = int.from_bytes(tiff[4:8], order)
            for k in range(int.from_bytes(tiff[first : first + 2], order)):
                entry = tiff[first + 2 + 12 * k : first + 14 + 12 * k]
                if len(entry) == 12 and int.from_bytes(entry[:2], order) == 0x0112:
                    found = int.from_bytes(entry[8:10], order)
                    return found if 1 <= found <= 8 else 1
            return 1
        at += 2 + size
    return 1
