"""Pixel operations on numpy arrays."""

from __future__ import annotations

import numpy as np


def luminance(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Gray values of an image in blue, green, red (alpha) order."""
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.int64)
    if channels == 1:
        return raw[:, :, 0].astype(np.uint8)
    return ((raw[:, :, 2] * 299 + raw[:, :, 1] * 587 + raw[:, :, 0] * 114) // 1000).astype(np.uint8)


def otsu(gray: np.ndarray) -> int:
    """The threshold that separates two classes of gray values best."""
    count = np.bincount(gray.ravel(), minlength=256).astype(np.float64)
    below, total = np.cumsum(count), count.sum()
    mass = np.cumsum(count * np.arange(256))
    above = total - below
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nanargmax(np.where((below > 0) & (above > 0), apart, 0)))


def ink_otsu(gray: np.ndarray) -> np.ndarray:
    """1 for ink, the rarer class."""
    dark = gray <= otsu(gray)
    return (dark if dark.sum() * 2 <= dark.size else ~dark).astype(np.uint8)


def box_sums(values: np.ndarray, half: int) -> np.ndarray:
    """Sums over squares of side ``2 * half + 1``, cut at the edges, from one table of prefix sums."""
    h, w = values.shape
    table = np.zeros((h + 1, w + 1))
    table[1:, 1:] = values.cumsum(axis=0).cumsum(axis=1)
    y0, y1 = np.maximum(np.arange(h) - half, 0), np.minimum(np.arange(h) + half + 1, h)
    x0, x1 = np.maximum(np.arange(w) - half, 0), np.minimum(np.arange(w) + half + 1, w)
    return table[np.ix_(y1, x1)] - table[np.ix_(y0, x1)] - table[np.ix_(y1, x0)] + table[np.ix_(y0, x0)]


def ink_sauvola(gray: np.ndarray, window: int = 15, k: float = 0.15, reach: float = 128.0) -> np.ndarray:
    """1 where a pixel is darker than its surroundings' mean, lowered where they vary little."""
    g = gray.astype(np.float64)
    n = box_sums(np.ones_like(g), window // 2)
    mean = box_sums(g, window // 2) / n
    spread = np.sqrt(np.maximum(box_sums(g * g, window // 2) / n - mean**2, 0))
    return (g < mean * (1 + k * (spread / reach - 1))).astype(np.uint8)


def components(ink: np.ndarray, connectivity: int = 8) -> list[tuple[int, float, float, int, int, int, int]]:
    """(area, cx, cy, x0, y0, x1, y1) of the connected components, bounds inclusive, in raster order of their first pixels.

    Runs of ink in each row are united with those they touch in the row above.
    """
    parent: list[int] = []
    runs: list[tuple[int, int, int]] = []
    above: list[int] = []
    slack = 1 if connectivity == 8 else 0

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for y, row in enumerate(ink.astype(np.int8)):
        step = np.diff(np.concatenate([[0], (row > 0).astype(np.int8), [0]]))
        here, j = [], 0
        for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            me = len(runs)
            runs.append((y, a, b))
            parent.append(me)
            here.append(me)
            while j < len(above) and runs[above[j]][2] + slack <= a:
                j += 1
            k = j
            while k < len(above) and runs[above[k]][1] < b + slack:
                one, two = root(above[k]), root(me)
                parent[max(one, two)] = min(one, two)
                k += 1
        above = here
    found: dict[int, list[float]] = {}
    for i, (y, a, b) in enumerate(runs):
        n = b - a
        stats = found.setdefault(root(i), [0, 0.0, 0.0, a, y, b - 1, y])
        stats[0] += n
        stats[1] += n * (a + b - 1) / 2
        stats[2] += n * y
        stats[3], stats[5], stats[6] = min(stats[3], a), max(stats[5], b - 1), y
    return [(int(s[0]), s[1] / s[0], s[2] / s[0], int(s[3]), int(s[4]), int(s[5]), int(s[6])) for _, s in sorted(found.items())]


def row_runs(ink: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(y, x0, x1) of horizontal runs of ``least`` pixels or more, x1 exclusive."""
    out = []
    for y, row in enumerate(ink):
        step = np.diff(np.concatenate([[0], (row > 0).astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            if b - a >= least:
                out.append((y, a, b))
    return out


def erase_rows(ink: np.ndarray, rows: list[int], half: int = 1) -> np.ndarray:
    out = ink.copy()
    for y in rows:
        out[max(0, y - half) : y + half + 1] = 0
    return out
