"""Vantage-point trees in numpy, searched for many queries at once.

A node parts its points by their distance to a vantage point. A query must enter the other side only if it is nearer to
the parting radius than to its k-th best hit so far, by the triangle inequality; ``factor`` scales that distance down.
With factor one the search is exact; a smaller one skips sides that rarely hold a hit.
"""

from __future__ import annotations

import numpy as np

CANDIDATES = 8
EVALUATED = 512


def distances(a: np.ndarray, point: np.ndarray) -> np.ndarray:
    gap = a - point
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def choose(points: np.ndarray, margin: float, rng: np.random.Generator) -> tuple[np.ndarray, float] | None:
    """A vantage point and radius that part the points with few near the radius, for how evenly they part them.

    None if no candidate tells any two points apart.
    """
    some = points if len(points) <= EVALUATED else points[rng.choice(len(points), EVALUATED, replace=False)]
    best, chosen = np.inf, None
    for vantage in points[rng.choice(len(points), min(CANDIDATES, len(points)), replace=False)]:
        s = np.sort(distances(some, vantage))
        at = np.unique(np.clip(np.linspace(0.02, 0.98, 49) * len(s), 1, len(s) - 1).astype(int))
        at = at[s[at] > s[at - 1]]
        if not len(at):
            continue
        radius = (s[at] + s[at - 1]) / 2
        share = at / len(s)
        near = (np.searchsorted(s, radius + margin, "right") - np.searchsorted(s, radius - margin, "left")) / len(s)
        score = (near + 0.01) / -(share * np.log2(share) + (1 - share) * np.log2(1 - share))
        k = int(np.argmin(score))
        if score[k] < best:
            best, chosen = float(score[k]), (vantage, float(radius[k]))
    return chosen


class Tree:
    """``vantage[i], radius[i]`` and the two children of node i; a child below 0 is leaf ``-child - 1``."""

    def __init__(self, points: np.ndarray, leaf_size: int, margin: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vantage: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.leaves: list[np.ndarray] = []
        work = [(np.arange(len(points)), -1, 0)]
        while work:
            members, parent, side = work.pop()
            split = choose(points[members], margin, rng) if len(members) > leaf_size else None
            if split is not None:
                inside = distances(points[members], split[0]) < split[1]
                if not 0 < inside.sum() < len(members):
                    split = None
            if split is None:
                number = -len(self.leaves) - 1
                self.leaves.append(members)
            else:
                number = len(self.radius)
                self.vantage.append(split[0])
                self.radius.append(split[1])
                self.children.append([0, 0])
                work += [(members[inside], number, 0), (members[~inside], number, 1)]
            if parent >= 0:
                self.children[parent][side] = number
            else:
                self.root = number

    def route(self, queries: np.ndarray) -> np.ndarray:
        """The leaf each query falls in."""
        out = np.zeros(len(queries), dtype=np.int64)
        work = [(self.root, np.arange(len(queries)))]
        while work:
            node, rows = work.pop()
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                inside = distances(queries[rows], self.vantage[node]) < self.radius[node]
                work += [(self.children[node][0], rows[inside]), (self.children[node][1], rows[~inside])]
        return out

    def near(self, queries: np.ndarray, reach: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """All (query, leaf) that a query must enter to find what is within its reach; its own leaf is among them."""
        found_q, found_l = [], []
        work = [(self.root, np.arange(len(queries)))]
        while work:
            node, rows = work.pop()
            if node < 0:
                found_q.append(rows)
                found_l.append(np.full(len(rows), -node - 1))
            elif len(rows):
                off = distances(queries[rows], self.vantage[node]) - self.radius[node]
                wide = factor * reach[rows]
                work += [(self.children[node][0], rows[off - wide < 0]), (self.children[node][1], rows[off + wide >= 0])]
        return np.concatenate(found_q), np.concatenate(found_l)


class Hits:
    """The k best of each query so far, by squared distance and then number."""

    def __init__(self, queries: int, k: int, reach: np.ndarray | None = None):
        self.k = k
        self.square = np.full((queries, k), np.inf)
        self.number = np.full((queries, k), np.iinfo(np.int64).max)
        self.limit = np.full(queries, np.inf) if reach is None else reach.astype(float)

    def reach(self, rows: np.ndarray) -> np.ndarray:
        return np.minimum(self.limit[rows], np.sqrt(self.square[rows, -1]))

    def add(self, rows: np.ndarray, square: np.ndarray, number: np.ndarray) -> None:
        square = np.concatenate([self.square[rows], square], axis=1)
        number = np.concatenate([self.number[rows], number], axis=1)
        order = np.lexsort((number, square), axis=1)[:, : self.k]
        self.square[rows] = np.take_along_axis(square, order, 1)
        self.number[rows] = np.take_along_axis(number, order, 1)


def search(tree: Tree, points: np.ndarray, numbers: np.ndarray, queries: np.ndarray, own: np.ndarray, hits: Hits, factor: float) -> None:
    """Adds the best of ``points`` for each query to its hits. ``own`` is each query's number, which is no hit of itself."""
    work: list[tuple[int, np.ndarray, int, np.ndarray | None]] = [(tree.root, np.arange(len(queries)), 0, None)]
    while work:
        node, rows, stage, off = work.pop()
        if not len(rows):
            continue
        if node < 0:
            _scan(tree.leaves[-node - 1], points, numbers, queries, own, hits, rows)
        elif stage == 0:
            off = distances(queries[rows], tree.vantage[node]) - tree.radius[node]
            inside, (low, high) = off < 0, tree.children[node]
            work += [(node, rows, 1, off), (high, rows[~inside], 0, None), (low, rows[inside], 0, None)]
        else:
            cross, (low, high) = np.abs(off) <= factor * hits.reach(rows), tree.children[node]
            inside = off < 0
            work += [(high, rows[cross & inside], 0, None), (low, rows[cross & ~inside], 0, None)]


def _scan(leaf: np.ndarray, points: np.ndarray, numbers: np.ndarray, queries: np.ndarray, own: np.ndarray, hits: Hits, rows: np.ndarray) -> None:
    leaf = leaf[np.argsort(numbers[leaf], kind="stable")]
    block, number = points[leaf], numbers[leaf]
    norms = np.einsum("ij,ij->i", block, block)
    k = min(hits.k, len(leaf))
    for part in np.array_split(rows, max(1, len(rows) * len(leaf) // 2_000_000)):
        q = queries[part]
        rough = norms - 2.0 * (q @ block.T)
        rough[own[part][:, None] == number] = np.inf
        if len(leaf) > 4 * k:
            edge = np.partition(rough, k - 1, axis=1)[:, k - 1 : k]
            # Rounding may hide a tie at the edge: whatever is as near within it is measured again.
            tied = rough <= edge + 1e-9
            width = int(tied.sum(axis=1).max())
            pick = np.argsort(~tied, axis=1, kind="stable")[:, :width] if width <= 4 * k else np.broadcast_to(np.arange(len(leaf)), rough.shape)
        else:
            pick = np.broadcast_to(np.arange(len(leaf)), rough.shape)
        gap = block[pick] - q[:, None, :]
        square = np.einsum("ijk,ijk->ij", gap, gap)
        square[np.isinf(np.take_along_axis(rough, pick, 1))] = np.inf
        hits.add(part, square, number[pick])
