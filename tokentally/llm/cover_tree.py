"""Cover trees over norm-augmented vectors, and search for the largest inner products within windows.

Vectors of whole numbers get one more component that makes them equally long, so a vector is a direction
and the inner product with a query follows from an angle. A node of a tree has a centre and covers all
vectors within some angle of it; by the angle of the query to the centre, the inner products of all that
it covers lie between two bounds.

The centres of a tree are found by farthest-first steps. Every prefix of that order is a net: its members
are apart and all others are near one of them. The prefixes at falling distances are the levels, each
holds those before it, and a node's angle is measured on what it covers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np

#: Vectors for each leaf, about.
LEAF = 32
#: From one level to the next, distances fall by this factor.
BASE = 1.3
#: Added to angles, and, relative to the largest product, to bounds: more than rounding can take.
SLACK = 1e-6
#: Pairs of window and vector compared at once.
COMPARED = 1 << 20


def directions(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Unit vectors with one more component, for vectors not longer than `longest`."""
    unit = vectors / longest
    rest = np.sqrt(np.maximum(0, 1 - (unit**2).sum(axis=1)))
    return np.hstack([unit, rest[:, None]])


def norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def farthest_first(units: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to so many places, each the farthest from those before it; how far it was; and the cosines of all
    vectors to these. Ends when all are covered at no distance."""
    places, far = [0], [np.inf]
    cosines = np.empty((count, len(units)))
    cosines[0] = nearest = units @ units[0]
    while len(places) < count:
        place = int(nearest.argmin())
        distance = float(angles(nearest[place]))
        if distance <= SLACK:
            break
        cosines[len(places)] = own = units @ units[place]
        places.append(place)
        far.append(distance)
        nearest = np.maximum(nearest, own)
    return np.array(places), np.array(far), cosines[: len(places)]


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    largest = int(np.abs(queries).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * queries.shape[1]
    if largest < 1 << 53:
        return (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    return queries.astype(np.int64) @ vectors.T.astype(np.int64)


def bounds(scores: np.ndarray, lengths: np.ndarray, longest: float, angle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of queries (rows) with all within an angle of centres (columns), from
    the products with the centres."""
    scale = lengths[:, None] * longest
    to_centre = angles(scores / np.where(scale > 0, scale, 1))
    slack = 1 + SLACK * SLACK * scale
    low = scale * np.cos(np.minimum(np.pi, to_centre + angle + SLACK))
    high = scale * np.cos(np.maximum(0, to_centre - angle - SLACK))
    return low - slack, high + slack


@dataclass
class Windows:
    """What is searched for: window k wants the largest products from least[k] to most[k] of query
    query[k]. A query has a vector, a label and an id; rows with its id are not for it."""

    vectors: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    query: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def fits(self, window: np.ndarray, labels: np.ndarray, ids: np.ndarray, same: bool) -> np.ndarray:
        own = self.query[window]
        alike = self.labels[own][:, None] == labels
        return (alike if same else ~alike) & (self.ids[own][:, None] != ids)


@dataclass
class Found:
    """Windows with products and ids, best first: never more than `want` for a window."""

    want: int
    window: np.ndarray
    score: np.ndarray
    id: np.ndarray

    @classmethod
    def none(cls, want: int) -> Found:
        return cls(want, *(np.empty(0, np.int64) for _ in range(3)))

    def with_more(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Found:
        columns = [np.concatenate([old, *new]) for old, *new in zip((self.window, self.score, self.id), *parts)]
        window, score, ids = (c[np.lexsort((columns[2], -columns[1], columns[0]))] for c in columns)
        place = np.arange(len(window)) - np.searchsorted(window, window)
        top = place < self.want
        return Found(self.want, window[top], score[top], ids[top])

    def raised(self, least: np.ndarray) -> np.ndarray:
        """The bounds, raised to the last wanted product of each window that has found all it wants."""
        full = np.flatnonzero(np.arange(len(self.window)) - np.searchsorted(self.window, self.window) == self.want - 1)
        out = least.copy()
        out[self.window[full]] = np.maximum(out[self.window[full]], self.score[full])
        return out


def compared(windows: Windows, some: np.ndarray, least: np.ndarray, rows: tuple, same: bool) -> Iterator[tuple]:
    """(windows, products, ids) of the rows (vectors, labels, ids) that are within some windows, exactly."""
    vectors, labels, ids = rows
    step = max(1, COMPARED // max(len(ids), 1))
    for first in range(0, len(some), step):
        own = some[first : first + step]
        scores = products(windows.vectors[windows.query[own]], vectors)
        inside = (scores >= least[own][:, None]) & (scores <= windows.most[own][:, None])
        inside &= windows.fits(own, labels, ids, same)
        at, row = np.nonzero(inside)
        yield own[at], scores[at, row], ids[row]


@dataclass
class Tree:
    """Vectors in the order of leaves, and nodes level by level.

    Leaf k has the vectors leaves[k]..leaves[k+1]; node j covers the leaves first[j]..last[j], all within
    `angle` of its centre (a vector), with labels from `low` to `high`. Level l has the nodes
    levels[l]..levels[l+1]; the last level's are the leaves.
    """

    vectors: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    leaves: np.ndarray
    levels: np.ndarray
    centre: np.ndarray
    first: np.ndarray
    last: np.ndarray
    angle: np.ndarray
    low: np.ndarray
    high: np.ndarray
    longest: float

    @classmethod
    def of(cls, vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> Tree:
        longest = max(float(norms(vectors).max()), 1.0)
        units = directions(vectors, longest)
        places, far, cosines = farthest_first(units, -(-len(units) // LEAF))
        count = len(places)
        # How many centres each level has, the last one all of them.
        sizes, reach = [1], far[1] if count > 1 else 0.0
        while sizes[-1] < count:
            reach /= BASE
            size = int(np.searchsorted(-far, -reach))
            if size > sizes[-1]:
                sizes.append(size)
        # The centre above each centre, level by level from the last.
        above = [np.arange(count)]
        for size in reversed(sizes[:-1]):
            nearest = cosines[:size, places].argmax(axis=0)
            nearest[:size] = np.arange(size)
            above.append(nearest[above[-1]])
        paths = above[::-1]
        order = np.lexsort(above)
        leaf_of = np.empty(count, np.int64)
        leaf_of[order] = np.arange(count)
        own = leaf_of[cosines.argmax(axis=0)]
        rows = np.argsort(own, kind="stable")
        leaves = np.searchsorted(own[rows], np.arange(count + 1))
        row_of = np.empty(len(rows), np.int64)
        row_of[rows] = np.arange(len(rows))
        parts = []
        for path in paths:
            centres = path[order]
            first = np.flatnonzero(np.diff(centres, prepend=-1))
            last = np.append(first[1:], count)
            of_row = centres[own[rows]]
            starts = leaves[first]
            angle = np.maximum.reduceat(angles(cosines[of_row, rows]), starts)
            low, high = (f.reduceat(labels[rows], starts) for f in (np.minimum, np.maximum))
            parts.append((row_of[places[centres[first]]], first, last, angle, low, high))
        levels = np.cumsum([0, *(len(p[0]) for p in parts)])
        nodes = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return cls(vectors[rows], labels[rows], ids[rows], leaves, levels, *nodes, longest)

    def packed(self) -> dict[str, bytes | float]:
        """As binary values; `unpacked` reads them."""
        kinds = {"vectors": np.int32, "angle": np.float64}
        arrays = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "longest"}
        return {n: a.astype(kinds.get(n, np.int64)).tobytes() for n, a in arrays.items()} | {"longest": self.longest}

    @classmethod
    def unpacked(cls, row: dict, width: int) -> Tree:
        kinds = {"vectors": np.int32, "angle": np.float64}
        arrays = {n: np.frombuffer(row[n], kinds.get(n, np.int64)) for n in PACKED if n != "longest"}
        arrays["vectors"] = arrays["vectors"].reshape(-1, width)
        return cls(**arrays, longest=row["longest"])

    def _alive(self, windows: Windows, least: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Which leaves each window must look at, and the largest products that these may have. From the top
        level down; nodes below one that no window needs are not looked at."""
        lengths = norms(windows.vectors)
        alive = np.ones((len(windows.query), len(self.leaves) - 1), bool)
        upper = np.full(alive.shape, -np.inf)
        own = windows.query
        for a, b in zip(self.levels[:-1], self.levels[1:], strict=True):
            needed = np.logical_or.reduceat(alive.any(axis=0), self.first[a:b])
            nodes = np.flatnonzero(needed) + a
            scores = products(windows.vectors, self.vectors[self.centre[nodes]])
            low, high = bounds(scores, lengths, self.longest, self.angle[nodes])
            labels, lowest, highest = windows.labels[:, None], self.low[nodes], self.high[nodes]
            fits = (lowest <= labels) & (labels <= highest) if same else ~((lowest == labels) & (labels == highest))
            inside = fits[own] & (high[own] >= least[:, None]) & (low[own] <= windows.most[:, None])
            sizes = self.last[nodes] - self.first[nodes]
            at = np.repeat(self.first[nodes] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            alive[:, at] &= np.repeat(inside, sizes, axis=1)
            upper[:, at] = np.repeat(high[own], sizes, axis=1)
        return alive, upper

    def search(self, windows: Windows, want: int, same: bool) -> Found:
        """The `want` best vectors of each window, by product and then by id; with `same`, of the query's
        label, else of other ones.

        Leaves are looked at best first, in waves of doubling size: what a wave has found lifts the bounds
        of the windows, and leaves that cannot reach them any more are skipped.
        """
        found, least = Found.none(want), windows.least
        alive, upper = self._alive(windows, least, same)
        upper = np.where(alive, upper, -np.inf)
        order = np.argsort(-upper, axis=1, kind="stable")
        first, size = 0, 1
        while first < order.shape[1]:
            leaf = order[:, first : first + size]
            bound = np.take_along_axis(upper, leaf, axis=1)
            window, place = np.nonzero((bound > -np.inf) & (bound >= least[:, None]))
            if not len(window) and not (bound > -np.inf).any():
                break
            leaf = leaf[window, place]
            by_leaf = np.argsort(leaf, kind="stable")
            window, leaf = window[by_leaf], leaf[by_leaf]
            cuts = np.flatnonzero(np.diff(leaf)) + 1
            hits = []
            for some in np.split(np.arange(len(leaf)), cuts) if len(leaf) else []:
                part = slice(self.leaves[leaf[some[0]]], self.leaves[leaf[some[0]] + 1])
                rows = self.vectors[part], self.labels[part], self.ids[part]
                hits.extend(compared(windows, window[some], least, rows, same))
            if hits:
                found = found.with_more(hits)
                least = found.raised(least)
            first, size = first + size, 2 * size
        return found


PACKED = [f.name for f in fields(Tree)]
