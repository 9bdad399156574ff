"""Parity sketches, and exact classes of near-duplicate sets."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np

from .text import mix

_SALT = np.uint64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Bands:
    """Sizes cut into bands, so that two sets of Jaccard similarity ``num / den`` or more lie in one band or in neighbours.

    Pairs whose smaller set is in band k meet in scheme k. Such sets differ in at most ``differing(k)`` items; a sketch has so many words
    more that one word with items agrees, whatever items differ.
    """

    num: int
    den: int

    @property
    def _edges(self) -> list[int]:
        return _edges_of(self.num, self.den)

    def edges(self, upto: int) -> np.ndarray:
        """The first size of each band, beyond ``upto``."""
        edges = self._edges
        while edges[-1] <= upto:
            edges.append(max(edges[-1] + 1, (edges[-1] - 1) * self.den // self.num + 1))
        return np.array(edges)

    def differing(self, band: int) -> int:
        return (self.den - self.num) * (int(self._edges[band + 1]) - 1) // self.num

    def words(self, band: int) -> int:
        return _words_of(self.differing(band), int(self._edges[band]))


@cache
def _edges_of(num: int, den: int) -> list[int]:
    return [1]


@cache
def _words_of(differing: int, least: int) -> int:
    spare = 1
    while True:
        words = differing + spare
        empty = words * math.exp(-least / words)
        if spare >= 1 + math.floor(empty + 3 * math.sqrt(empty)) or spare > differing + 1:
            return words
        spare += 1


@dataclass
class Sketches:
    """Parity sketches of some sets, one behind the other, each in the scheme of its set's band or (``back``) of the band below.

    ``begin``: where the sketch of a set begins in ``bits``, -1 if it has none; ``words``: its words. ``row``/``key``: for each word by which
    a set may meet others the set and a hash of scheme, place and word.
    """

    begin: np.ndarray
    words: np.ndarray
    bits: np.ndarray
    row: np.ndarray
    key: np.ndarray

    def distances(self, mine: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The Hamming distances of the sketch ``mine`` from those of ``others``, worked through in slices of bounded size."""
        width, out = len(mine), []
        for some in np.array_split(others, max(1, len(others) * width >> 19)):
            out.append(np.bitwise_count(self.bits[self.begin[some][:, None] + np.arange(width)] ^ mine).sum(axis=1, dtype=np.int64))
        return np.concatenate(out)

    def of(self, row: int) -> np.ndarray:
        return self.bits[self.begin[row] : self.begin[row] + self.words[row]]


def bands_of(sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(the band of each size, the first size of each band)."""
    edges = bands.edges(int(sizes.max(initial=0)) + 1)
    return np.searchsorted(edges, sizes, side="right") - 1, edges


def sketched(sets: Sequence[np.ndarray], bands: Bands, back: int) -> Sketches:
    """The sketches of ``sets`` in the scheme of their band less ``back`` (0 or 1).

    Each item flips one bit of a sketch of 64-bit words, so that the Hamming distance of two sketches never exceeds the number of items in
    one set alone. With d items differing and w words, at least w - d words agree. A set with fewer empty words than that leaves them out:
    an agreeing word with items is left.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    begin, width = np.full(len(sets), -1, dtype=np.int64), np.zeros(len(sets), dtype=np.int64)
    none = np.zeros(0, dtype=np.uint64)
    band, edges = bands_of(sizes, bands)
    # as the larger of a pair (back 1): only if a smaller set of the band below is similar enough
    takes = (sizes > 0) & (band >= back)
    if back:
        takes &= (edges[np.maximum(band, 1)] - 1) * bands.den >= sizes * bands.num
    rows = np.flatnonzero(takes)
    if not len(rows):
        return Sketches(begin, width, none, np.zeros(0, dtype=np.int64), none)
    scheme = band[rows] - back
    kinds, which = np.unique(scheme, return_inverse=True)
    words = np.array([bands.words(int(k)) for k in kinds])[which]
    spare = words - np.array([bands.differing(int(k)) for k in kinds])[which]
    first = np.concatenate([[0], np.cumsum(words)])
    owner = np.repeat(np.arange(len(rows)), sizes[rows])
    hashed = mix(np.concatenate([sets[i] for i in rows.tolist()]) ^ mix(scheme.astype(np.uint64) + _SALT)[owner])
    slot = first[owner] + ((hashed >> np.uint64(6)) % words[owner].astype(np.uint64)).astype(np.int64)
    bits = np.zeros(first[-1], dtype=np.uint64)
    np.bitwise_xor.at(bits, slot, np.uint64(1) << (hashed & np.uint64(63)))
    used = np.bincount(slot, minlength=first[-1]) > 0
    place = np.repeat(np.arange(len(rows)), words)
    empty = words - np.add.reduceat(used.astype(np.int64), first[:-1])
    keep = used | (empty >= spare)[place]
    at = np.arange(first[-1]) - first[place]
    label = mix((scheme.astype(np.uint64) << np.uint64(32))[place] + at.astype(np.uint64) + _SALT)
    begin[rows], width[rows] = first[:-1], words
    return Sketches(begin, width, bits, rows[place[keep]], mix(bits ^ label)[keep])


def sketch_keys(sets: Sequence[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(position of the set, key) for the sketch words by which sets of one scheme meet."""
    own, below = (sketched(sets, bands, back) for back in (0, 1))
    return np.concatenate([own.row, below.row]), np.concatenate([own.key, below.key])


def similar(common: np.ndarray, a: np.ndarray | int, b: np.ndarray | int, num: int, den: int) -> np.ndarray:
    return den * common >= num * (a + b - common)


def exact_classes(sets: Sequence[np.ndarray], bands: Bands) -> np.ndarray:
    """For each set the position of the first set of its class: sets linked, directly or by others, at the similarity of ``bands``.

    Breadth-first: a set meets the unvisited ones that share a sketch word with it in the scheme of the smaller one's band. Those whose
    sketches differ in more bits than similar sets can differ in items go; of the others common items are counted in full. Visited sets
    leave the index, so a class of copies costs one visit each.
    """
    num, den = bands.num, bands.den
    count = len(sets)
    label = np.arange(count)
    if count < 2:
        return label
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    band, _ = bands_of(sizes, bands)
    own, below = (sketched(sets, bands, back) for back in (0, 1))
    row, key = np.concatenate([own.row, below.row]), np.concatenate([own.key, below.key])
    _, name, times = np.unique(key, return_inverse=True, return_counts=True)
    meets = times[name] > 1
    row, name = row[meets], name[meets]
    if not len(row):
        return label
    order = np.argsort(name, kind="stable")
    names, begin = np.unique(name[order], return_index=True)
    postings = dict(zip(names.tolist(), np.split(row[order], begin[1:]), strict=True))
    order = np.argsort(row, kind="stable")
    row, name = row[order], name[order]
    keys_from = np.searchsorted(row, np.arange(count + 1))
    first = np.concatenate([[0], np.cumsum(sizes)])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    unvisited, mark = np.ones(count, dtype=bool), np.zeros(len(token), dtype=bool)

    def candidates(at: int) -> np.ndarray:
        near = []
        for t in name[keys_from[at] : keys_from[at + 1]].tolist():
            if (posting := postings.get(t)) is not None:
                posting = posting[unvisited[posting]]
                if len(posting):
                    postings[t] = posting
                    near.append(posting)
                else:
                    del postings[t]
        others = np.unique(np.concatenate(near)) if near else np.zeros(0, dtype=np.int64)
        n = sizes[others]
        others = others[(n * den >= num * sizes[at]) & (sizes[at] * den >= num * n)]
        # sketches are compared in the scheme of the smaller set's band
        apart, step = np.zeros(len(others), dtype=np.int64), band[others] - band[at]
        for mine, theirs, which in ((own, own, step == 0), (own, below, step == 1), (below, own, step == -1)):
            if which.any():
                apart[which] = theirs.distances(mine.of(at), others[which])
        return others[apart * (den + num) <= (sizes[others] + sizes[at]) * (den - num)]

    for seed in range(count):
        if not unvisited[seed] or not sizes[seed]:
            continue
        unvisited[seed] = False
        queue = deque([seed])
        while queue:
            at = queue.popleft()
            others = candidates(at)
            if not len(others):
                continue
            items = token[first[at] : first[at + 1]]
            mark[items] = True
            for block in np.array_split(others, max(1, int(sizes[others].sum()) >> 22)):
                lengths = sizes[block]
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                gather = np.repeat(first[block] - starts, lengths) + np.arange(lengths.sum())
                common = np.add.reduceat(mark[token[gather]].astype(np.int64), starts)
                linked = block[similar(common, sizes[at], lengths, num, den)]
                unvisited[linked] = False
                label[linked] = label[seed]
                queue.extend(linked.tolist())
            mark[items] = False
    return label
