"""Extremely randomized trees (M7): random candidate features with random cut points, no bootstrap.

Every draw is a hash of (seed, tree, path), so a tree depends on its rows alone:
not on partitioning, on what else grows beside it or on how it is grown. A tree
limited in depth or split size is therefore the unlimited tree, read only so
far, and a forest of 100 trees is the first 100 of 500; one growth serves a
whole grid.

* ``grow_levels`` grows trees level by level over a table of any size, held as
  blocks of rows: one pass finds the ranges of each open node's candidate
  features, one the classes left of the drawn cuts. Both are map-side combined
  aggregates by (node, candidate). A node whose rows fit ``HAND_BYTES`` is
  handed over: its rows are shuffled to one task, which grows the rest below it.
  The driver holds the nodes above these, never rows and never whole trees.
* ``grow_whole`` deals trees, not rows, over tasks where the table is small: its
  vectors fit ``TABLE_BYTES``, or their places among the values ``PLACES_BYTES``.
  Both ways give the same trees.

Blocks have places instead of values, in 2 or 4 bytes each, as long as the
values of all features fit ``VALUES_BYTES``; else the values themselves.

A node is split by the best of its candidates (weighted Gini impurity, equal
scores: the first feature). Candidates are the first ``k`` features in the
node's random order; if all are constant in the node, the first later one that
isn't. Pure nodes, nodes of fewer than ``min_split`` rows and nodes at
``max_depth`` are leaves.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import materialize

PRIME = (1 << 31) - 1
CHILD = 1 << 20  # draws from here on make the keys of children
TABLE_BYTES = 64 << 20  # of vectors that go to every task
PLACES_BYTES = 384 << 20  # of places and their values, as a task holds them
VALUES_BYTES = 64 << 20  # of all features' values
BLOCK_BYTES = 16 << 20  # of one group's rows or nodes when voting
HAND_BYTES = 64 << 20  # of rows of a node that one task takes over
SHUFFLE_BYTES = 4 << 30  # of rows handed over at a time
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
CELLS = 1 << 18  # values that a task looks at together
LARGE = 1 << 14  # rows of a node that is split by itself; smaller ones are gathered
GATHERED = 1 << 17  # rows of gathered nodes
ROW_BLOCK = 1 << 14
HELD_BLOCKS = 32
SPARSE = 8  # rows of a table for each one of a node that gets a table of its own
ROWS = 1 << 17  # rows, at most, of small trees that a task grows together
SHALLOW = 8  # depth to which trees stay on the driver: at most 2^8 leaves each
NODES = ("forest int, tree int, node int, feature int, cut double, left_node int, right_node int, depth int, "
         "counts array<long>, gain double, path string")
_FIELDS = ["forest", "tree", "node", "feature", "cut", "left_node", "right_node", "depth", "counts", "gain", "path"]


def _fold(x):
    """A smaller number that is equal modulo PRIME = 2^31 - 1; takes the array over."""
    high = x >> 31
    x &= PRIME
    x += high
    return x


def draw(k1, k2, j):
    """Pseudo-random number below PRIME for draw ``j`` of a node with keys k1, k2 (arrays or ints)."""
    x = _fold(k1 + (j + 1) * k2)
    for _ in range(3):
        x *= 48271
        x += 11
        x = _fold(x)
        x *= x
        x += k1
        x = _fold(x)  # below 2^33, so that the next square fits 63 bits
    x = _fold(x)
    return x - PRIME * (x >= PRIME)


def root_keys(seed: int, tree):
    return (seed * 1000003 + tree * 7919 + 17) % PRIME, (seed * 69621 + tree * 16807 + 29) % (PRIME - 1) + 1


def child_keys(k1, k2, side: int):
    return draw(k1, k2, CHILD + side), draw(k1, k2, CHILD + 2 + side) % (PRIME - 1) + 1


@dataclass
class Forest:
    """A forest to grow: all folds but ``held_out`` are its rows, ``k`` its candidate features of a node."""

    trees: int
    k: int
    held_out: int | None = None
    seed: int = 42
    min_split: int = 2
    max_depth: int | None = None
    first: int = 0  # number of the first tree


@dataclass
class _Open:
    """Nodes of one level that may be split; all lists are parallel."""

    forest: np.ndarray
    tree: np.ndarray
    node: np.ndarray
    k1: np.ndarray
    k2: np.ndarray
    counts: np.ndarray
    path: list[str] = field(default_factory=list)


def candidates(k1: np.ndarray, k2: np.ndarray, d: int, skip: int, k: int) -> np.ndarray:
    """Features skip..skip+k-1 of each node's random order."""
    if skip == 0 and k >= d:
        return np.broadcast_to(np.arange(d), (len(k1), d))
    key = draw(k1[:, None], k2[:, None], 2 * np.arange(d)[None, :]) * d + np.arange(d)  # equal draws: the first feature
    key.sort(axis=1)
    return key[:, skip:skip + k] % d


def cut_points(k1: np.ndarray, k2: np.ndarray, features: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A random cut in [low, high) for each candidate."""
    share = draw(k1[:, None], k2[:, None], 2 * features + 1) / PRIME
    return _cuts(share, low, high)


def _cuts(share: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    cut = low + share * (high - low)
    return np.where(cut >= high, low, cut)


def split_scores(left: np.ndarray, total: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Score of splits (the larger, the lower the children's weighted Gini impurity) from class counts, last axis classes."""
    a = b = sa = sb = 0.0
    for c in range(total.shape[-1]):  # in class order, so that every engine adds alike
        l, r = left[..., c] * weights[c], (total[..., c] - left[..., c]) * weights[c]
        a, b, sa, sb = a + l, b + r, sa + l * l, sb + r * r
    with np.errstate(divide="ignore", invalid="ignore"):
        return sa / a + sb / b


def _gain(left: np.ndarray, total: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted impurity that a split takes away."""
    w = (total * weights).astype(np.float64)
    return split_scores(left, total, weights) - (w * w).sum(-1) / w.sum(-1)


def _splittable(counts: np.ndarray, min_split: int, depth: int, max_depth: int | None) -> np.ndarray:
    if max_depth is not None and depth >= max_depth:
        return np.zeros(len(counts), bool)
    return (counts.sum(axis=1) >= min_split) & ((counts > 0).sum(axis=1) > 1)


def _best(features: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Column of the highest score, equal ones by the first feature."""
    top = scores == scores.max(axis=1, keepdims=True)
    return np.where(top, features, np.iinfo(np.int64).max).argmin(axis=1)


# ---------------------------------------------------------------- whole trees in tasks

class Values:
    """Vectors row by row and feature by feature, compared as they are."""

    def __init__(self, at: np.ndarray | None = None, lines: np.ndarray | None = None) -> None:
        if at is not None:
            self.at = at
        if lines is not None:
            self.lines = lines

    @cached_property
    def at(self) -> np.ndarray:
        return np.ascontiguousarray(self.lines.T)

    @cached_property
    def lines(self) -> np.ndarray:
        return _by_feature(self.at)

    @cached_property
    def varies(self) -> np.ndarray:
        """Features that are not the same in all rows."""
        return np.flatnonzero([not line.min() == line.max() for line in self.lines]) if self.lines.size else np.empty(0, np.int64)

    def copied(self, at: np.ndarray | None = None, lines: np.ndarray | None = None) -> Values:
        """Other rows, in a table of their own."""
        own = copy.copy(self)
        for name in ("at", "lines", "varies"):
            own.__dict__.pop(name, None)
        Values.__init__(own, at, lines)
        return own

    def of_rows(self, feature: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Entries of the rows of nodes, one node's ``sizes`` rows after the other's, in the nodes' features (last axis); a feature's entries lie together."""
        place = np.repeat(feature * len(self.at), sizes, axis=-1)
        place += rows
        return self.lines.reshape(-1).take(place, mode="clip")

    def value(self, feature: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return entry

    def below(self, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Entries less than this have values of at most the cut (none, if the cut is no number)."""
        return np.nextafter(cut, np.inf)


def _kind(values: list[np.ndarray] | None) -> type:
    """Type of places among these values; without values, of the values."""
    return np.float64 if values is None else np.uint16 if max(map(len, values), default=0) < 1 << 16 else np.uint32


class Places(Values):
    """Vectors by each value's place among its feature's values in order, in 2 bytes where these are few enough; cuts fall between places.

    ``values`` are those of the whole table, so any of its rows can be taken.
    Not-a-number is the last place.
    """

    def __init__(self, at: np.ndarray | None, values: list[np.ndarray]) -> None:
        super().__init__(at)
        self.values, self.kind = values, _kind(values)
        known = [v[:np.searchsorted(v, np.nan)] for v in values]
        self.first = np.cumsum([0] + [len(v) for v in known])
        self.order = np.empty(self.first[-1], np.complex128)  # in order by feature, then value
        self.order.real, self.order.imag = np.repeat(np.arange(len(values)), np.diff(self.first)), np.concatenate(known)
        self.flat = np.concatenate(values)
        self.starts = np.cumsum([0] + [len(v) for v in values])

    @classmethod
    def of(cls, x: np.ndarray) -> Places:
        both = [np.unique(x[:, f], return_inverse=True) for f in range(x.shape[1])]
        at = np.empty(x.shape, _kind([v for v, _ in both]))
        for f, (_, place) in enumerate(both):
            at[:, f] = place
        return cls(at, [v for v, _ in both])

    def value(self, feature: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return self.flat.take(self.starts[feature] + entry)

    def below(self, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Number of places whose value is at most the cut (none, if the cut is no number)."""
        place = np.zeros(cut.shape, self.kind)
        if feature.shape != cut.shape:  # one feature for a line of cuts
            for i, f in enumerate(feature[:, 0].tolist()):
                place[i] = np.searchsorted(self.values[f], cut[i], "right")
        else:
            find = np.empty(cut.shape, np.complex128)
            find.real, find.imag = feature, cut
            place[...] = np.searchsorted(self.order, find, "right") - self.first[feature]
        place[np.isnan(cut)] = 0
        return place


def _left_counts(left: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Set entries of each row of ``left`` between consecutive bounds (last axis), by sums over whole bytes of bits."""
    bits = np.zeros((len(left), left.shape[1] // 8 + 1), np.uint8)
    packed = np.packbits(left, axis=1)
    bits[:, :packed.shape[1]] = packed
    before = np.zeros(bits.shape, np.int32)
    np.cumsum(np.bitwise_count(bits[:, :-1]), axis=1, dtype=np.int32, out=before[:, 1:])
    byte, some = bounds >> 3, (0xFF00 >> (bounds & 7) & 0xFF).astype(np.uint8)
    upto = before.take(byte, axis=1) + np.bitwise_count(bits.take(byte, axis=1) & some)
    return upto[..., 1:] - upto[..., :-1]


def _measure(p: Values, rows: np.ndarray, sizes: np.ndarray, bounds: np.ndarray, cand: np.ndarray, share: np.ndarray, same: bool) -> tuple[np.ndarray, ...]:
    """Whether candidates (first axis) vary in nodes (second axis) that hold ``sizes`` rows each, class by class; cuts and the class counts left of them.

    ``same``: all nodes have the same candidates, as a column.
    """
    first, width = bounds[:, 0], max(1, CELLS // len(rows))
    varies, cut = np.empty(share.shape, bool), np.empty(share.shape)
    left = np.empty((*share.shape, bounds.shape[1] - 1), np.int64)
    every = _by_feature(p.at, rows) if same else None
    if same and len(cand) < len(every):
        every = every[cand[:, 0]]
    for at in range(0, len(cand), width):
        own = slice(at, at + width)
        entries = every[own] if same else p.of_rows(cand[own], sizes, rows)
        low, high = np.minimum.reduceat(entries, first, axis=1), np.maximum.reduceat(entries, first, axis=1)
        low, high = p.value(cand[own], low), p.value(cand[own], high)
        varies[own], cut[own] = high > low, _cuts(share[own], low, high)
        left[own] = _left_counts(entries < np.repeat(p.below(cand[own], cut[own]), sizes, axis=1), bounds)
    return varies, cut, left


def _by_feature(at: np.ndarray, rows: np.ndarray | None = None, block: int = 512) -> np.ndarray:
    """The given rows (default: all), feature by feature."""
    n = len(at) if rows is None else len(rows)
    out = np.empty((at.shape[1], n), at.dtype)
    for i in range(0, n, block):
        out[:, i:i + block] = (at[i:i + block] if rows is None else at.take(rows[i:i + block], axis=0)).T
    return out


def _measure_one(p: Values, rows: np.ndarray, counts: np.ndarray, cand: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same for a single node of many rows (second axis dropped)."""
    low, high, left = [], [], np.zeros((len(cand), len(counts)), np.int64)
    ends = np.cumsum(counts).tolist()
    if len(cand) * 3 < len(p.lines):  # each candidate from its own line
        entries = [p.lines[f].take(rows, mode="clip") for f in cand.tolist()]
        low, high = (p.value(cand, np.array(list(map(side, entries)))) for side in (np.min, np.max))
        cut = _cuts(share, low, high)
        for i, (line, upto) in enumerate(zip(entries, p.below(cand, cut))):
            is_left = line < upto
            left[i] = [np.count_nonzero(is_left[a:b]) for a, b in zip([0, *ends], ends)]
        return high > low, cut, left
    # rows by blocks, of which few are held
    blocks = [(c, i, min(i + ROW_BLOCK, b)) for c, (a, b) in enumerate(zip([0, *ends], ends)) for i in range(a, b, ROW_BLOCK)]
    entries = {b: _by_feature(p.at, rows[b[1]:b[2]]) for b in blocks} if len(blocks) <= HELD_BLOCKS else {}
    for b in blocks:
        own = entries[b] if entries else _by_feature(p.at, rows[b[1]:b[2]])
        low.append(own.min(axis=1))
        high.append(own.max(axis=1))
    low, high = p.value(cand, np.min(low, axis=0)[cand]), p.value(cand, np.max(high, axis=0)[cand])
    cut = _cuts(share, low, high)
    upto = np.zeros(len(p.lines), p.at.dtype)
    upto[cand] = p.below(cand, cut)
    for b in blocks:
        own = entries[b] if entries else _by_feature(p.at, rows[b[1]:b[2]])
        left[:, b[0]] += np.array([np.count_nonzero(line < u) for line, u in zip(own, upto)])[cand]
    return high > low, cut, left


def grow_tree(x: np.ndarray | Values, y: np.ndarray, classes: int, weights: np.ndarray, forest: Forest, number: int,
              start: tuple[int, int, int, str] | None = None, use: np.ndarray | None = None) -> dict[str, np.ndarray | list]:
    """One tree over the rows x, y; columns by node, the root first, levels in turn.

    ``start``: keys, depth and path of a node to grow from instead of the root;
    ``use``: the rows to learn from (default: all).
    """
    *keys, depth, path = start or (*root_keys(forest.seed, number), 0, "")
    k1, k2 = (np.array([v], np.int64) for v in keys)
    return _grow(x if isinstance(x, Values) else Values(np.ascontiguousarray(x, np.float64)), y, classes, weights, forest, k1, k2, depth, [path], use)


class _Grown:
    """Columns of the nodes of growing trees; nodes have their number when they are opened."""

    def __init__(self, roots: int) -> None:
        self.made = roots
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, node, feature, cut, gain, depth, counts) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the left and right nodes below those that are split."""
        split = feature >= 0
        more = int(split.sum())
        left, right = np.full(len(node), -1), np.full(len(node), -1)
        left[split], right[split] = self.made + np.arange(more), self.made + more + np.arange(more)
        self.made += 2 * more
        self.parts.append((node, feature, cut, left, right, depth, counts, gain))
        return left[split], right[split]

    def columns(self, roots: int, names: list[str] | None) -> dict[str, np.ndarray | list]:
        """All nodes, the roots first, levels in turn."""
        node, *columns = (np.concatenate(c) for c in zip(*self.parts))
        back = np.empty(len(node), np.int64)
        back[node] = np.arange(len(node))
        feature, _, left, right, *_ = columns
        level, order, paths = back[np.arange(roots)], [], []
        while len(level):
            order.append(level)
            split = feature[level] >= 0
            if names is not None:
                paths += names
                names = [n + s for n, t in zip(names, split.tolist()) if t for s in "01"]
            level = back[np.stack([left[level[split]], right[level[split]]], axis=1).ravel()]
        order = np.concatenate(order)
        number = np.empty(len(node), np.int64)
        number[node[order]] = np.arange(len(node))
        out = dict(zip(("feature", "cut", "left_node", "right_node", "depth", "counts", "gain"), (c[order] for c in columns)))
        for side in ("left_node", "right_node"):
            out[side] = np.where(out[side] >= 0, number[out[side]], -1)
        return out | ({"path": paths} if names is not None else {})


def _grow(p: Values, y: np.ndarray, classes: int, weights: np.ndarray, forest: Forest, k1: np.ndarray, k2: np.ndarray, depth: int = 0,
          names: list[str] | None = None, use: np.ndarray | None = None) -> dict[str, np.ndarray | list]:
    """A tree for each pair of keys over the same rows: columns by node, the roots first, levels in turn; paths only if those of the roots are given.

    Nodes of many rows are split one by one. Those of fewer are gathered until
    they have ``GATHERED`` rows, which are copied next to each other, and grown
    to the end together. Rows are held class by class. ``use``: the rows to
    learn from (default: all).
    """
    use = np.arange(len(y)) if use is None else use
    rows = use[np.argsort(y[use], kind="stable")]
    counts = np.bincount(y[use], minlength=classes).astype(np.int64)
    varies = p.varies if forest.k >= len(p.lines) else None
    grown = _Grown(len(k1))
    large = [(p, i, rows, counts, k1[i:i + 1], k2[i:i + 1], depth) for i in range(len(k1))][::-1]
    small, held = [], 0
    while large:
        p, node, rows, *state = large.pop()
        if len(rows) <= LARGE:
            small.append((p.at.take(rows, axis=0), node, *state))
            held += len(rows)
        else:
            if varies is None and len(rows) * SPARSE < len(p.at):
                p, rows = p.copied(p.at.take(rows, axis=0)), np.arange(len(rows))
            large += _split_one(p, grown, node, rows, *state, weights, forest, varies)
        if held > GATHERED or not large and small:
            _grow_small(p, grown, small, weights, forest, varies)
            small, held = [], 0
    return grown.columns(len(k1), names)


def _tries(k1: np.ndarray, k2: np.ndarray, d: int, k: int) -> Iterator[np.ndarray]:
    """The candidates of one node; beyond the first k only the first feature that varies."""
    yield candidates(k1, k2, d, 0, k)[0]
    yield from candidates(k1, k2, d, k, d)[0][:, None]


def _split_one(p: Values, grown: _Grown, node: int, rows: np.ndarray, counts: np.ndarray, k1: np.ndarray, k2: np.ndarray, depth: int, weights: np.ndarray,
               forest: Forest, varies: np.ndarray | None) -> list[tuple]:
    """The open nodes below one node."""
    feature, cut, gain = np.full(1, -1), np.full(1, np.nan), np.zeros(1)
    if _splittable(counts[None, :], forest.min_split, depth, forest.max_depth)[0]:
        d = len(p.lines)
        for cand in [varies] if varies is not None else _tries(k1, k2, d, forest.k):
            if not len(cand):
                break
            share = draw(k1, k2, 2 * cand + 1) / PRIME
            found, cuts, left = _measure_one(p, rows, counts, cand, share)
            if found.any():
                scores = np.where(found, split_scores(left, counts, weights), -np.inf)
                pick = _best(cand[None, :], scores[None, :])
                feature, cut, gain = cand[pick], cuts[pick], _gain(left[pick], counts[None, :], weights)
                break
    below = grown.add(np.array([node]), feature, cut, gain, np.array([depth]), counts[None, :])
    if feature[0] < 0:
        return []
    is_left = p.lines[feature[0]].take(rows) < p.below(feature, cut)[0]
    sides = (rows[~is_left], counts - left[pick[0]]), (rows[is_left], left[pick[0]])
    return [(p, int(below[side][0]), *sides[1 - side], *child_keys(k1, k2, side), depth + 1) for side in (1, 0)]


def _grow_small(p: Values, grown: _Grown, nodes: list[tuple], weights: np.ndarray, forest: Forest, varies: np.ndarray | None) -> None:
    """Grow all trees below these nodes, level by level together, on a table of their rows. Rows are held node by node and, within a node, class by class."""
    at, node, counts, k1, k2, depth = zip(*nodes)
    node, counts, k1, k2, depth = np.array(node), np.stack(counts), np.concatenate(k1), np.concatenate(k2), np.array(depth)
    p = p.copied(np.concatenate(at))
    rows = np.arange(len(p.at))
    while len(node):
        ok = (counts.sum(axis=1) >= forest.min_split) & ((counts > 0).sum(axis=1) > 1)
        if forest.max_depth is not None:
            ok &= depth < forest.max_depth
        feature, cut, gain, left = np.full(len(node), -1), np.full(len(node), np.nan), np.zeros(len(node)), np.zeros_like(counts)
        rows = rows[np.repeat(ok, counts.sum(axis=1))]
        if ok.any():
            feature[ok], cut[ok], gain[ok], left[ok] = _split(p, rows, k1[ok], k2[ok], counts[ok], weights, forest.k, varies)
        split = feature >= 0
        below = grown.add(node, feature, cut, gain, depth, counts)
        rows = rows[np.repeat(split[ok], counts[ok].sum(axis=1))]
        sizes = counts[split].sum(axis=1)
        is_left = p.of_rows(feature[split], sizes, rows) < np.repeat(p.below(feature[split], cut[split]), sizes)
        rows = np.concatenate([rows[is_left], rows[~is_left]])  # the left nodes before the right ones
        node, counts = np.concatenate(below), np.concatenate([left[split], counts[split] - left[split]])
        k1, k2 = (np.concatenate(k) for k in zip(*(child_keys(k1[split], k2[split], side) for side in (0, 1))))
        depth = np.tile(depth[split] + 1, 2)


def _split(p: Values, rows: np.ndarray, k1: np.ndarray, k2: np.ndarray, counts: np.ndarray, weights: np.ndarray, k: int,
           varies: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1: nothing varies), cut, gain and class counts to the left of nodes with these keys and class counts, whose rows follow each other.

    ``varies``: the features that vary, if all of them are candidates.
    """
    d = len(p.lines)
    feature, cut, gain, to_left = np.full(len(counts), -1), np.full(len(counts), np.nan), np.zeros(len(counts)), np.zeros_like(counts)
    if varies is not None and not len(varies):
        return feature, cut, gain, to_left

    def choose(nodes: np.ndarray, rows: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Split ``nodes`` by their best candidate that varies; whether there is one."""
        total = counts[nodes]
        ends = np.cumsum(total.ravel()).reshape(total.shape)
        bounds = np.concatenate([ends[:, -1:] - total.sum(axis=1, keepdims=True), ends], axis=1)
        share = draw(k1[nodes], k2[nodes], 2 * cand + 1) / PRIME
        varies_in, cuts, left = _measure(p, rows, total.sum(axis=1), bounds, cand, share, varies is not None)
        scores = np.where(varies_in, split_scores(left, total, weights), -np.inf)
        features = np.broadcast_to(cand, scores.shape)
        pick = _best(features.T, scores.T), np.arange(len(nodes))
        found = varies_in.any(axis=0)
        here = nodes[found]
        feature[here], cut[here], to_left[here] = features[pick][found], cuts[pick][found], left[pick][found]
        gain[here] = _gain(left[pick], total, weights)[found]
        return found

    every = np.arange(len(counts))
    if varies is not None:
        choose(every, rows, varies[:, None])
        return feature, cut, gain, to_left
    found = choose(every, rows, np.ascontiguousarray(candidates(k1, k2, d, 0, k).T))
    if not found.all():  # beyond the first k only the first feature that varies
        sizes = counts.sum(axis=1)
        late, rows, sizes = every[~found], rows[np.repeat(~found, sizes)], sizes[~found]
        rest = candidates(k1[late], k2[late], d, k, d)
        some = np.empty(rest.shape, bool)
        first, width = np.cumsum(sizes) - sizes, max(1, CELLS // len(rows))
        for at in range(0, d - k, width):
            own = rest[:, at:at + width].T
            entries = p.of_rows(own, sizes, rows)
            some[:, at:at + width] = (p.value(own, np.maximum.reduceat(entries, first, axis=1)) > p.value(own, np.minimum.reduceat(entries, first, axis=1))).T
        got, place = some.any(axis=1), some.argmax(axis=1)
        if got.any():
            choose(late[got], rows[np.repeat(got, sizes)], rest[got, place[got]][None, :])
    return feature, cut, gain, to_left


def tree_leaves(x: np.ndarray, tree: dict[str, np.ndarray], min_split: int = 2, max_depth: int | None = None) -> np.ndarray:
    """Node at which each row ends when the tree is read with these limits."""
    stop = tree["feature"] < 0
    if min_split > 2:
        stop |= tree["counts"].sum(axis=1) < min_split
    if max_depth is not None:
        stop |= tree["depth"] >= max_depth
    node, active = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(active):
        at = node[active]
        go = ~stop[at]
        active, at = active[go], at[go]
        left = x[active, tree["feature"][at]] <= tree["cut"][at]
        node[active] = np.where(left, tree["left_node"][at], tree["right_node"][at])
    return node


def _leaves(p: Values, trees: dict[str, np.ndarray], roots: int, use: np.ndarray | None = None) -> np.ndarray:
    """Node at which each row (default: all) ends in each of several trees grown together (one tree's rows after the other's)."""
    use = np.arange(len(p.at)) if use is None else use
    inner = trees["feature"] >= 0
    upto = np.zeros(len(inner), p.at.dtype)
    upto[inner] = p.below(trees["feature"][inner], trees["cut"][inner])
    start, entries = trees["feature"] * len(p.at), p.lines.reshape(-1)
    out, node, active, rows = np.empty(roots * len(use), np.int64), np.repeat(np.arange(roots), len(use)), np.arange(roots * len(use)), np.tile(use, roots)
    while len(active):
        go = inner.take(node)
        out[active[~go]] = node[~go]
        active, node, rows = active[go], node[go], rows[go]
        right = entries.take(start.take(node) + rows, mode="clip") >= upto.take(node)
        node = np.where(right, trees["right_node"].take(node), trees["left_node"].take(node))
    return out


def _read_to(trees: dict[str, np.ndarray], min_split: int, max_depth: int | None) -> np.ndarray:
    """For each node the one at which a walk that reaches it ends under these limits; who is below a stop stops as well, so ends are doubled upwards."""
    split = np.flatnonzero(trees["feature"] >= 0)
    stop = trees["counts"].sum(axis=1) < min_split
    if max_depth is not None:
        stop |= trees["depth"] >= max_depth
    end = np.arange(len(stop))
    for side in ("left_node", "right_node"):
        end[trees[side][split]] = np.where(stop[split], split, trees[side][split])
    while not np.array_equal(end, up := end[end]):
        end = up
    return end


def _arrays(tree: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f: np.asarray(tree[f]) for f in ("feature", "cut", "left_node", "right_node", "depth", "counts")}


@dataclass
class Blocks:
    """A table as blocks of rows (y, fold, x: bytes), class by class, their vectors feature by feature; as places if ``values`` are given."""

    df: DataFrame
    rows: int
    width: int
    values: list[np.ndarray] | None

    def row_bytes(self) -> int:
        return self.width * np.dtype(_kind(self.values)).itemsize + 4

    def held_bytes(self) -> int:
        """Of the table in a task: both ways round, and the values in the forms that are looked up."""
        return 2 * self.rows * self.row_bytes() + 32 * sum(map(len, self.values or []))

    def table(self) -> Values:
        """Without rows, for those of a block to be put in."""
        return Values() if self.values is None else Places(None, self.values)

    def collected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Folds, labels, places and values."""
        kind, at = _kind(self.values), 0
        fold, y, x = np.empty(self.rows, np.int32), np.empty(self.rows, np.int64), np.empty((self.rows, self.width), kind)
        for batch in self.df.toArrow().to_batches(max_chunksize=1):
            for r in batch.to_pylist():
                own = slice(at, at := at + len(r["y"]) // 4)
                fold[own], y[own], x[own] = np.frombuffer(r["fold"], np.int32), np.frombuffer(r["y"], np.int32), np.frombuffer(r["x"], kind).reshape(self.width, -1).T
        return fold, y, x, self.values


def _gathered(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Vectors, folds and labels of many rows at a time."""
    held, most = [], max(1, min(1 << 16, HAND_BYTES // (8 * width)))
    for part in _blocks(batches, width):
        held.append(part)
        if sum(len(y) for _, _, y in held) >= most:
            yield tuple(map(np.concatenate, zip(*held)))
            held = []
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _distinct(df: DataFrame, width: int) -> list[np.ndarray] | None:
    """Each feature's values in order, unless they are over VALUES_BYTES."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _, _ in _gathered(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([np.unique(x[:, f]).tobytes() for f in range(width)], pa.binary())], names=["feature", "line"])

    def finish(lines: pa.Table) -> pa.Table:
        found = np.unique(np.frombuffer(b"".join(lines.column("line").to_pylist()), np.float64))
        return pa.table({"feature": lines.column("feature")[:1], "n": pa.array([len(found)], pa.int64()), "line": pa.array([found.tobytes()], pa.binary())})

    sent = df.mapInArrow(send, "feature int, line binary").repartition(width, "feature")
    found = materialize(sent.groupBy("feature").applyInArrow(finish, "feature int, n long, line binary"), "extra-trees-values")
    if 8 * found.agg(F.sum("n")).first()[0] > VALUES_BYTES:
        return None
    lines = {r["feature"]: np.frombuffer(r["line"], np.float64) for r in found.collect()}  # one row for each feature
    return [lines[f] for f in range(width)]


def pack(df: DataFrame, width: int) -> Blocks:
    """Blocks of a training table, written once."""
    n = df.count()
    values = _distinct(df, width) if 0 < 8 * n <= VALUES_BYTES and width else None
    held = df.sparkSession.sparkContext.broadcast(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, fold, y in _gathered(batches, width):
            order = np.argsort(y, kind="stable")
            lines = _by_feature(x, order)
            if held.value is not None:
                lines = np.stack([np.searchsorted(v, line).astype(_kind(held.value)) for v, line in zip(held.value, lines)])
            yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary()) for part in (y[order].astype(np.int32), fold[order].astype(np.int32), lines)], names=["y", "fold", "x"])

    blocks = df.mapInArrow(run, "y binary, fold binary, x binary")
    return Blocks(materialize(blocks, "extra-trees-blocks"), n, width, values)


def held_table(df: DataFrame, width: int, limit: int) -> tuple[tuple | None, Blocks | None]:
    """Folds, labels, places and values of a table that tasks can hold as a whole, or else its blocks.

    Tables whose vectors fit ``limit`` are read as they are; of larger ones
    tasks make the places, and these may fill ``PLACES_BYTES`` (limit 0: no table is held).
    """
    if df.count() * (width + 2) * 8 <= limit:
        t = df.select("row", "fold", "label", "x").toArrow().sort_by("row")
        p = Places.of(np.asarray(t.column("x").combine_chunks().flatten(), np.float64).reshape(-1, width))
        return (t.column("fold").to_numpy(), t.column("label").to_numpy().astype(np.int64), p.at, p.values), None
    blocks = pack(df, width)
    if limit and blocks.values is not None and blocks.held_bytes() <= PLACES_BYTES:
        return blocks.collected(), None
    return None, blocks


def _deal(spark: SparkSession, forests: Sequence[Forest]) -> DataFrame:
    """(forest, tree) rows in many small tasks."""
    every = [(i, f.first + t) for i, f in enumerate(forests) for t in range(f.trees)]
    tasks = max(1, min(len(every), 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(every, "forest int, tree int").repartition(tasks, "tree", "forest")


def grow_whole(spark: SparkSession, table: tuple, classes: int, forests: Sequence[Forest], weights: Sequence[Sequence[float]]) -> DataFrame:
    """Nodes of all trees; trees are dealt out and the (bounded) table, as ``held_table`` gives it, goes to every task."""
    held = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, y, at, values = held.value
        p = Places(at, values)
        for batch in batches:
            for i, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = forests[i]
                use = None if f.held_out is None else np.flatnonzero(fold != f.held_out)
                tree = grow_tree(p, y, classes, np.asarray(weights[i]), f, number, use=use)
                yield _node_batch({"forest": [i] * len(tree["cut"]), "tree": [number] * len(tree["cut"]), "node": list(range(len(tree["cut"]))), **tree})

    return _deal(spark, forests).mapInArrow(run, NODES)


_NODE_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.float64(), pa.string()]


def _node_batch(rows: dict[str, list]) -> pa.RecordBatch:
    counts = np.asarray(rows["counts"], np.int64)
    lists = pa.ListArray.from_arrays(np.arange(len(counts) + 1, dtype=np.int32) * counts.shape[1], counts.ravel())
    return pa.RecordBatch.from_arrays([lists if f == "counts" else pa.array(rows[f], t) for f, t in zip(_FIELDS, _NODE_TYPES)], names=_FIELDS)


# ---------------------------------------------------------------- level by level

class _Trees:
    """Growing trees as flat arrays; a row's way from a root ends at an open node or a leaf."""

    def __init__(self, n_roots: int) -> None:
        self.feature, self.cut = np.full(n_roots, -1), np.full(n_roots, np.nan)
        self.left = np.full(n_roots, -1)

    def extend(self, more: int) -> None:
        self.feature = np.append(self.feature, np.full(more, -1))
        self.cut = np.append(self.cut, np.full(more, np.nan))
        self.left = np.append(self.left, np.full(more, -1))


def _live(left: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Whether a node has a slot or one below it has."""
    live = slot >= 0
    for i in np.flatnonzero(left >= 0)[::-1].tolist():  # children come after their parents
        live[i] |= live[left[i]] or live[left[i] + 1]
    return live


def _open_rows(p: Values, fold: np.ndarray, state: tuple) -> Iterator[tuple[int, list[tuple[int, np.ndarray]]]]:
    """For every tree (slot, rows) of its open nodes that have rows in this block."""
    roots, feature, upto, left, live, slot = state
    for root, held_out in roots:
        held, found = [(root, np.arange(len(fold)) if held_out is None else np.flatnonzero(fold != held_out))], []
        while held:
            node, rows = held.pop()
            if not len(rows) or not live[node]:
                continue
            if slot[node] >= 0:
                found.append((int(slot[node]), rows))
                continue
            is_left = p.lines[feature[node]].take(rows, mode="clip") < upto[node]
            held += [(left[node] + 1, rows[~is_left]), (left[node], rows[is_left])]
        if found:
            yield found


def _packed(batches: Iterator[pa.RecordBatch], table: Values, kind: type, width: int) -> Iterator[tuple[Values, np.ndarray, np.ndarray]]:
    """Vectors, labels and folds of each block."""
    for batch in batches:
        for y, fold, x in zip(*(batch.column(c) for c in ("y", "fold", "x"))):
            y, fold = np.frombuffer(y.as_buffer(), np.int32), np.frombuffer(fold.as_buffer(), np.int32)
            yield table.copied(lines=np.frombuffer(x.as_buffer(), kind).reshape(width, -1)), y, fold


class _Passes:
    """Passes over the blocks of a table."""

    def __init__(self, blocks: Blocks, classes: int) -> None:
        self.blocks, self.classes, self.spark = blocks, classes, blocks.df.sparkSession
        self.table = self.spark.sparkContext.broadcast(blocks.values)

    def run(self, state: tuple, work: Callable, schema: str) -> DataFrame:
        """``work`` of (blocks' vectors, labels and folds, empty table, state with cuts as entries), whose ``state`` is as ``_grow_block`` has it."""
        roots, feature, cut, left, slot = state
        held, values = self.spark.sparkContext.broadcast((roots, feature, cut, left, _live(left, slot), slot)), self.table
        width = self.blocks.width

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            roots, feature, cut, left, live, slot = held.value
            table = Values() if values.value is None else Places(None, values.value)
            inner = feature >= 0
            upto = np.zeros(len(feature), _kind(values.value))
            upto[inner] = table.below(feature[inner], cut[inner])
            yield from work(_packed(batches, table, _kind(values.value), width), table, (roots, feature, upto, left, live, slot))

        return self.blocks.df.mapInArrow(task, schema)

    def ranges(self, state: tuple, cand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest value of every (open node, candidate)."""
        wanted = self.spark.sparkContext.broadcast(cand)

        def work(blocks, table, inner) -> Iterator[pa.RecordBatch]:
            features = wanted.value
            low, high = np.full(features.shape, np.inf), np.full(features.shape, -np.inf)
            for p, _, fold in blocks:
                for found in _open_rows(p, fold, inner):
                    for at, rows in found:
                        ends = np.array([(line.min(), line.max()) for line in (p.lines[f].take(rows, mode="clip") for f in features[at].tolist())])
                        low[at], high[at] = np.minimum(low[at], table.value(features[at], ends[:, 0])), np.maximum(high[at], table.value(features[at], ends[:, 1]))
            q, j = np.nonzero(~((low == np.inf) & (high == -np.inf)))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(j, pa.int32()), pa.array(low[q, j]), pa.array(high[q, j])], names=["q", "j", "low", "high"])

        got = self.run(state, work, "q int, j int, low double, high double").groupBy("q", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
        low, high = np.zeros(cand.shape), np.zeros(cand.shape)
        q, j = got.column("q").to_numpy(), got.column("j").to_numpy()
        low[q, j], high[q, j] = got.column("low").to_numpy(), got.column("high").to_numpy()
        return low, high

    def lefts(self, state: tuple, cand: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Class counts left of the cut of every (open node, candidate)."""
        wanted, classes = self.spark.sparkContext.broadcast((cand, cuts)), self.classes
        names = [f"c{c}" for c in range(classes)]

        def work(blocks, table, inner) -> Iterator[pa.RecordBatch]:
            features, cut = wanted.value
            upto, total = table.below(features, cut), np.zeros((*features.shape, classes), np.int64)
            for p, y, fold in blocks:
                first = np.searchsorted(y, np.arange(classes + 1))
                for found in _open_rows(p, fold, inner):
                    for at, rows in found:
                        bounds = np.searchsorted(rows, first).tolist()
                        for j, f in enumerate(features[at].tolist()):
                            is_left = p.lines[f].take(rows, mode="clip") < upto[at, j]
                            total[at, j] += [np.count_nonzero(is_left[a:b]) for a, b in zip(bounds, bounds[1:])]
            q, j = np.nonzero(total.any(axis=2))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(j, pa.int32()), *(pa.array(total[q, j, c]) for c in range(classes))], names=["q", "j", *names])

        sums = [F.sum(n).alias(n) for n in names]
        got = self.run(state, work, "q int, j int, " + ", ".join(f"{n} long" for n in names)).groupBy("q", "j").agg(*sums).toArrow()
        out = np.zeros((*cand.shape, classes), np.int64)
        q, j = got.column("q").to_numpy(), got.column("j").to_numpy()
        for c, n in enumerate(names):
            out[q, j, c] = got.column(n).to_numpy()
        return out


def _blocks(batches: Iterator[pa.RecordBatch], width: int, rows: int = 8192):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield (np.asarray(part.column("x").flatten(), np.float64).reshape(-1, width), part.column("fold").to_numpy(zero_copy_only=False),
                   part.column("label").to_numpy(zero_copy_only=False).astype(np.int64))


@dataclass
class _Handed:
    """A node whose subtree is grown by one task: its tree, number in the tree, place among the flat nodes, keys, depth and path."""

    tree: int
    node: int
    flat: int
    start: tuple[int, int, int, str]


def _grow_block(passes: _Passes, width: int, classes: int, forest: Forest, index: int, weights: np.ndarray, numbers: np.ndarray, counts: np.ndarray,
                hand_over: int = 0) -> tuple[dict[str, list], list[_Handed], _Trees, np.ndarray]:
    """Grow the trees ``numbers`` of one forest together, down to nodes of at most ``hand_over`` rows: nodes above, nodes handed over, flat trees, nodes by tree."""
    trees, handed = _Trees(len(numbers)), []
    roots = [(i, forest.held_out) for i in range(len(numbers))]
    out: dict[str, list] = {f: [] for f in _FIELDS}
    open_ = _Open(np.full(len(numbers), index), numbers, np.arange(len(numbers)), *root_keys(forest.seed, numbers), np.repeat(counts[None, :], len(numbers), axis=0), [""] * len(numbers))
    name = np.zeros(len(numbers), np.int64)  # flat place -> number within its tree
    made = np.ones(len(numbers), np.int64)
    tree_of = np.arange(len(numbers))
    depth = 0
    while len(open_.node):
        ok = _splittable(open_.counts, forest.min_split, depth, forest.max_depth)
        own = ~ok | (open_.counts.sum(axis=1) > hand_over)
        for i in np.flatnonzero(~own).tolist():
            at = int(open_.node[i])
            handed.append(_Handed(int(open_.tree[i]), int(name[at]), at, (int(open_.k1[i]), int(open_.k2[i]), depth, open_.path[i])))
        ok &= own
        n = len(open_.node)
        feature, cut, gain, left_counts = np.full(n, -1), np.full(n, np.nan), np.zeros(n), np.zeros((n, classes), np.int64)
        wanted, skip, k = np.flatnonzero(ok), 0, forest.k
        while len(wanted) and skip < width:
            cand = np.ascontiguousarray(candidates(open_.k1[wanted], open_.k2[wanted], width, skip, k))
            slot = np.full(len(trees.feature), -1)
            slot[open_.node[wanted]] = np.arange(len(wanted))
            state = [roots[t] for t in np.unique(tree_of[open_.node[wanted]])], trees.feature, trees.cut, trees.left, slot
            low, high = passes.ranges(state, cand)
            valid = high > low
            if skip:
                valid &= np.cumsum(valid, axis=1) == 1
            found = valid.any(axis=1)
            if found.any():
                cuts = cut_points(open_.k1[wanted], open_.k2[wanted], cand, low, high)
                by_class, total = passes.lefts(state, cand, cuts), open_.counts[wanted]
                scores = np.where(valid, split_scores(by_class, total[:, None, :], weights), -np.inf)
                pick = np.arange(len(wanted)), _best(cand, scores)
                here = wanted[found]
                feature[here], cut[here], left_counts[here] = cand[pick][found], cuts[pick][found], by_class[pick][found]
                gain[here] = _gain(by_class[pick], total, weights)[found]
            wanted, skip, k = wanted[~found], skip + cand.shape[1], width
        split = feature >= 0
        more = int(split.sum())
        flat = len(trees.feature) + 2 * np.arange(more)
        trees.extend(2 * more)
        trees.feature[open_.node], trees.cut[open_.node] = feature, cut
        trees.left[open_.node[split]] = flat
        # numbers within each tree, in the order of this level
        own_tree = tree_of[open_.node[split]]
        before = np.zeros(more, np.int64)
        for t in np.unique(own_tree):
            at = np.flatnonzero(own_tree == t)
            before[at] = made[t] + 2 * np.arange(len(at))
            made[t] += 2 * len(at)
        left_node = np.full(n, -1)
        left_node[split] = before
        out["forest"] += open_.forest[own].tolist()
        out["tree"] += open_.tree[own].tolist()
        out["node"] += name[open_.node[own]].tolist()
        out["feature"] += feature[own].tolist()
        out["cut"] += cut[own].tolist()
        out["left_node"] += left_node[own].tolist()
        out["right_node"] += np.where(split, left_node + 1, -1)[own].tolist()
        out["depth"] += [depth] * int(own.sum())
        out["counts"] += open_.counts[own].tolist()
        out["gain"] += gain[own].tolist()
        out["path"] += [p for p, o in zip(open_.path, own.tolist()) if o]
        name = np.append(name, np.stack([before, before + 1], axis=1).ravel())
        tree_of = np.append(tree_of, np.repeat(own_tree, 2))
        keys = [child_keys(open_.k1[split], open_.k2[split], side) for side in (0, 1)]
        both = np.stack([left_counts[split], open_.counts[split] - left_counts[split]], axis=1).reshape(-1, classes)
        open_ = _Open(np.repeat(open_.forest[split], 2), np.repeat(open_.tree[split], 2), np.stack([flat, flat + 1], axis=1).ravel(),
                      *(np.stack([keys[0][i], keys[1][i]], axis=1).ravel() for i in (0, 1)), both,
                      [p + s for p, t in zip(open_.path, split.tolist()) if t for s in "01"])
        depth += 1
    return out, handed, trees, made


def _subtrees(passes: _Passes, width: int, classes: int, forest: Forest, index: int, weights: np.ndarray, roots: list[tuple[int, int | None]], trees: _Trees,
              handed: list[_Handed], tasks: int) -> DataFrame:
    """NODES, numbered from 0 below each node handed over, and its ``slot``: the rows of a node are shuffled to one task as packed blocks."""
    slot = np.full(len(trees.feature), -1)
    slot[[h.flat for h in handed]] = np.arange(len(handed))
    starts = passes.spark.sparkContext.broadcast([(h.tree, h.start) for h in handed])
    values, tables = passes.table, []

    def send(blocks, _, inner) -> Iterator[pa.RecordBatch]:
        for p, y, fold in blocks:
            for found in _open_rows(p, fold, inner):
                at = pa.array([at for at, _ in found], pa.int32())
                yield pa.RecordBatch.from_arrays([at, *(pa.array([part.take(rows, axis=0).tobytes() for _, rows in found], pa.binary()) for part in (y, p.at))], names=["slot", "y", "x"])

    def finish(rows: pa.Table) -> pa.Table:
        if not tables:
            tables.append(Values() if values.value is None else Places(None, values.value))
        at = rows.column("slot")[0].as_py()
        y = np.frombuffer(b"".join(rows.column("y").to_pylist()), np.int32).astype(np.int64)
        x = np.frombuffer(b"".join(rows.column("x").to_pylist()), _kind(values.value)).reshape(len(y), width)
        number, start = starts.value[at]
        tree = grow_tree(tables[0].copied(x), y, classes, weights, forest, number, start)
        n = len(tree["cut"])
        batch = _node_batch({"forest": [index] * n, "tree": [number] * n, "node": list(range(n)), **tree})
        return pa.Table.from_batches([batch]).append_column("slot", pa.array([at] * n, pa.int32()))

    state = roots, trees.feature, trees.cut, trees.left, slot
    sent = passes.run(state, send, "slot int, y binary, x binary").repartition(tasks, "slot")
    return sent.groupBy("slot").applyInArrow(finish, NODES + ", slot int")


def grow_levels(df: DataFrame, width: int, classes: int, forests: Sequence[Forest], weights: Sequence[Sequence[float]], counts: Sequence[np.ndarray],
                at_once: int = 64, block_bytes: int = HAND_BYTES, blocks: Blocks | None = None) -> DataFrame:
    """Nodes of all trees, grown level by level over the distributed table, ``at_once`` trees in a pass.

    Nodes whose rows fit ``block_bytes`` are grown to the end by tasks, for as
    many trees at a time as ``SHUFFLE_BYTES`` allow; their nodes are written and
    not seen by the driver. Trees of at most ``SHALLOW`` levels are bounded and
    need no handing over.
    """
    spark = df.sparkSession
    parts = []
    blocks = blocks or pack(df, width)
    passes, row_bytes = _Passes(blocks, classes), blocks.row_bytes()
    for i, f in enumerate(forests):
        hand_over = 0 if f.max_depth is not None and f.max_depth <= SHALLOW else max(1, block_bytes // row_bytes)
        per_pass = max(1, int(SHUFFLE_BYTES // max(1, row_bytes * int(counts[i].sum()))))
        w = np.asarray(weights[i], np.float64)
        for at in range(0, f.trees, at_once):
            numbers = f.first + np.arange(at, min(f.trees, at + at_once))
            rows, handed, trees, made = _grow_block(passes, width, classes, f, i, w, numbers, counts[i], hand_over)
            if rows["node"]:
                parts.append(spark.createDataFrame(pa.Table.from_batches([_node_batch(rows)])))
            for lo in range(0, len(numbers), per_pass):
                own = [h for h in handed if lo <= h.tree - numbers[0] < lo + per_pass]
                if not own:
                    continue
                roots = [(t, f.held_out) for t in range(lo, min(len(numbers), lo + per_pass))]
                size = len(roots) * row_bytes * int(counts[i].sum())
                tasks = max(1, min(len(own), max(4 * spark.sparkContext.defaultParallelism, size // (4 * block_bytes))))
                kept = spark.conf.get(CLEANUP, "false")
                spark.conf.set(CLEANUP, "true")  # the rows handed over leave the disk when their nodes are written
                try:
                    below = materialize(_subtrees(passes, width, classes, f, i, w, roots, trees, own, tasks), "extra-trees-below")
                finally:
                    spark.conf.set(CLEANUP, kept)
                sizes = {r["slot"]: r["n"] for r in below.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).collect()}  # nodes handed over
                places = []
                for slot, h in enumerate(own):
                    places.append((slot, h.node, int(made[h.tree - numbers[0]]) - 1))
                    made[h.tree - numbers[0]] += sizes[slot] - 1
                # numbers within the whole tree: the node handed over keeps its own, those below come after all others so far
                place = spark.createDataFrame(places, "slot int, top int, base long")
                number = lambda c: F.when(F.col(c) < 0, F.col(c)).when(F.col(c) == 0, F.col("top")).otherwise(F.col("base") + F.col(c))
                parts.append(below.join(place, "slot").withColumns({c: number(c) for c in ("node", "left_node", "right_node")}).drop("slot", "top", "base"))
    parts = [p.select(*(F.col(n).cast(t) for n, t in (c.split(" ", 1) for c in NODES.split(", ")))) for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- use

def training_table(df: DataFrame, features: Sequence[str], label: str, fold: str | None = None) -> DataFrame:
    """row, fold, label and the vector x of each row, written once; ``label`` holds 0, 1, ...; nulls in features are an error."""
    x = F.array(*(F.col(c).cast("double") for c in features))
    fold_of = F.col(fold).cast("int") if fold else F.lit(-1)
    return materialize(df.select(F.monotonically_increasing_id().alias("row"), fold_of.alias("fold"), F.col(label).cast("int").alias("label"), x.alias("x")), "extra-trees")


def class_counts(table: DataFrame, classes: int, forests: Sequence[Forest]) -> list[np.ndarray]:
    """Rows by class that each forest learns from; one aggregate by (fold, class)."""
    cells = table.groupBy("fold", "label").count().collect()
    return [np.array([sum(r["count"] for r in cells if r["label"] == c and r["fold"] != f.held_out) for c in range(classes)], np.int64) for f in forests]


def balanced(counts: np.ndarray) -> list[float]:
    """N / (k n_c); classes without rows weigh nothing."""
    present = int((counts > 0).sum())
    return [float(counts.sum() / (present * c)) if c else 0.0 for c in counts.tolist()]


def grow(table: DataFrame, width: int, classes: int, forests: Sequence[Forest], limit: int | None = None) -> DataFrame:
    """Nodes of the forests, class-balanced, written once. ``limit`` (default: TABLE_BYTES) parts the two ways of growing, which give the same trees."""
    limit = TABLE_BYTES if limit is None else limit
    counts = class_counts(table, classes, forests)
    weights = [balanced(c) for c in counts]
    held, blocks = held_table(table, width, limit)
    if held is not None:
        return materialize(grow_whole(table.sparkSession, held, classes, forests, weights), "extra-trees-nodes")
    return materialize(grow_levels(table, width, classes, forests, weights, counts, blocks=blocks), "extra-trees-nodes")


def importances(nodes: DataFrame, features: Sequence[str], top_n: int | None = None) -> DataFrame:
    """M6 + K1: features by falling importance (ties by name): mean over trees of each feature's share of the tree's impurity decrease."""
    spark = nodes.sparkSession
    split = nodes.filter("feature >= 0").groupBy("forest", "tree", "feature").agg(F.sum("gain").alias("gain"))
    per_tree = nodes.groupBy("forest", "tree").agg(F.sum("gain").alias("total"))
    share = split.join(per_tree.filter("total > 0"), ["forest", "tree"]).groupBy("feature").agg((F.sum(F.col("gain") / F.col("total"))).alias("share"))
    found = {r["feature"]: r["share"] for r in share.collect()}  # one row for each feature
    total = math.fsum(found.values()) or 1.0
    rows = sorted(((f, found.get(i, 0.0) / total) for i, f in enumerate(features)), key=lambda r: (-round(r[1], 12), r[0]))
    return spark.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(rows)][:top_n], "feature string, importance double, rank int")


def _shares(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    share = counts * weights
    return share / np.maximum(share.sum(axis=1, keepdims=True), 1e-300)


def _votes(tree: dict[str, np.ndarray], weights: np.ndarray, x: np.ndarray, min_split: int, max_depth: int | None) -> np.ndarray:
    return _shares(tree["counts"], weights)[tree_leaves(x, tree, min_split, max_depth)]


def predict(df: DataFrame, nodes: DataFrame, features: Sequence[str], weights: Sequence[float], out: str = "prediction", probability: str = "probability",
            tree_block: int = 64, node_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` with the forest's class (equal probabilities: the lower) and class probabilities.

    Trees go to the tasks in blocks of ``tree_block``; each block's votes are
    added to the row's array. Forests whose nodes exceed ``node_bytes`` are not
    broadcast: blocks of trees meet blocks of rows in a shuffle.
    """
    spark = df.sparkSession
    w = np.asarray(weights, np.float64)
    sizes = {r["tree"]: r["n"] for r in nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each tree
    numbers = sorted(sizes)
    x = F.array(*(F.col(c).cast("double") for c in features))
    if sum(sizes.values()) * (len(w) + 6) * 8 > node_bytes:
        res = _shuffled_votes(df, nodes, x, len(features), w, sizes, probability)
        return res.withColumn(out, (F.array_position(probability, F.array_max(probability)) - 1).cast("double"))
    votes = F.array(*([F.lit(0.0)] * len(w)))
    for at in range(0, len(numbers), tree_block):
        own = nodes.filter(F.col("tree").isin(numbers[at:at + tree_block])).toArrow().sort_by([("tree", "ascending"), ("node", "ascending")])
        held = spark.sparkContext.broadcast(_split_trees(own))

        votes = _adder(held, w)(x, votes)
    share = F.transform(votes, lambda v: v / F.lit(float(max(1, len(numbers)))))
    res = df.withColumn(probability, share)
    return res.withColumn(out, (F.array_position(probability, F.array_max(probability)) - 1).cast("double"))


def _shuffled_votes(df: DataFrame, nodes: DataFrame, x, width: int, weights: np.ndarray, sizes: dict[int, int], probability: str,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` with the class probabilities; each block of trees and block of rows meet in one group, votes are added in the order of the trees' blocks."""
    spark = df.sparkSession
    most, blocks, filled = block_bytes // ((len(weights) + 6) * 8), {}, 0
    for tree in sorted(sizes):
        block = max(blocks.values(), default=0)
        if filled and filled + sizes[tree] > most:
            block, filled = block + 1, 0
        blocks[tree], filled = block, filled + sizes[tree]
    rows = materialize(df.withColumn("_forest_row", F.monotonically_increasing_id()), "forest-rows")
    row_blocks = max(1, math.ceil(rows.count() * (width + 1) * 8 / block_bytes))
    dealt = rows.select("_forest_row", x.alias("x"), F.pmod(F.xxhash64("_forest_row"), F.lit(row_blocks)).cast("int").alias("rows"),
                        F.explode(F.sequence(F.lit(0), F.lit(max(blocks.values())))).alias("trees"))
    block_of = spark.createDataFrame(list(blocks.items()), "tree int, trees int")
    kept = nodes.select("tree", "node", "feature", "cut", "left_node", "right_node", "depth", "counts").join(block_of, "tree")
    kept = kept.withColumn("rows", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))

    def vote(key: tuple, own: pa.Table, forest: pa.Table) -> pa.Table:
        n = own.num_rows
        total = np.zeros((n, len(weights)))
        if n:
            vectors = np.asarray(own.column("x").combine_chunks().flatten(), np.float64).reshape(n, -1)
            for tree in _split_trees(forest.combine_chunks().sort_by([("tree", "ascending"), ("node", "ascending")])):
                total += _votes(tree, weights, vectors, 2, None)
        votes = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(weights), pa.int32()), pa.array(total.ravel()))
        return pa.table({"_forest_row": own.column("_forest_row"), "trees": pa.array([key[1].as_py()] * n, pa.int32()), "votes": votes})

    by = ["rows", "trees"]
    got = dealt.groupBy(*by).cogroup(kept.groupBy(*by)).applyInArrow(vote, "_forest_row long, trees int, votes array<double>")
    zero = F.array(*([F.lit(0.0)] * len(weights)))
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("trees", "votes"))), zero, lambda a, b: F.zip_with(a, b["votes"], lambda p, q: p + q))
    share = F.transform(total, lambda v: v / F.lit(float(len(sizes)))).alias(probability)
    return rows.join(got.groupBy("_forest_row").agg(share).hint("merge"), "_forest_row").drop("_forest_row")


def _adder(held, weights: np.ndarray):
    """Function of (vector, votes so far) that adds the votes of a block of trees."""

    @F.arrow_udf("array<double>")
    def more(x: pa.Array, so_far: pa.Array) -> pa.Array:
        total = np.array(so_far.flatten(), np.float64).reshape(-1, len(weights))
        if len(x):
            rows = np.asarray(x.flatten(), np.float64).reshape(len(x), -1)
            for tree in held.value:
                total += _votes(tree, weights, rows, 2, None)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(weights), pa.int32()), pa.array(total.ravel()))

    return more


def _split_trees(table: pa.Table) -> list[dict[str, np.ndarray]]:
    """Arrays of each tree of a table sorted by tree and node."""
    if not table.num_rows:
        return []
    tree = table.column("tree").to_numpy()
    starts = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))
    cols = {f: table.column(f).to_numpy() for f in ("feature", "cut", "left_node", "right_node", "depth")}
    counts = np.asarray(table.column("counts").combine_chunks().flatten()).reshape(table.num_rows, -1)
    return [{**{f: c[a:b] for f, c in cols.items()}, "counts": counts[a:b]} for a, b in zip(starts, np.append(starts[1:], len(tree)))]


@dataclass
class Point:
    """A point of the forest grid; ``k`` is the number of candidate features, ``max_depth`` None for no limit."""

    trees: int
    max_depth: int | None
    min_split: int
    k: int


def grid_accuracy(table: DataFrame, width: int, classes: int, points: Sequence[Point], folds: Sequence[int], seed: int = 42) -> DataFrame:
    """Held-out rows and hits of every (point, fold): columns point, fold, n, hits.

    For each (fold, k) the largest forest is grown once without limits; smaller
    and limited points read the same trees. Tasks add the votes of their trees
    over the held-out rows, and only sums by (point, row) are shuffled.
    """
    spark = table.sparkSession
    table_held, blocks = held_table(table, width, TABLE_BYTES)
    if table_held is None:
        return _grid_by_fits(table, width, classes, points, folds, seed, blocks)
    plan = [(fold, k) for k in sorted({p.k for p in points}, reverse=True) for fold in folds]
    forests = [Forest(max(p.trees for p in points if p.k == k), k, fold, seed) for fold, k in plan]
    own_points = [[at for at, p in enumerate(points) if p.k == f.k] for f in forests]
    weights = [np.asarray(balanced(c)) for c in class_counts(table, classes, forests)]
    held = spark.sparkContext.broadcast(table_held)
    parts = math.ceil(4 * spark.sparkContext.defaultParallelism / len(forests))
    tasks = [(i, f.trees * j // parts, f.trees * (j + 1) // parts) for i, f in enumerate(forests) for j in range(parts)]
    slots = max(map(len, own_points))
    names = [f"p{s}_{c}" for s in range(slots) for c in range(classes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, y, at, values = held.value
        places = Places(at, values)
        for i, first, end in (tasks[t] for batch in batches for t in batch.column(0).to_pylist()):
            f, w, own = forests[i], weights[i], [points[s] for s in own_points[i]]
            out = np.flatnonzero(fold == f.held_out)
            learn = np.flatnonzero(fold != f.held_out)
            if not len(out) or not len(learn) or first == end:
                continue
            sums = np.zeros((len(out), slots, classes))
            together = max(1, ROWS // len(y))
            for lo in range(first, end, together):
                numbers = np.arange(lo, min(end, lo + together))
                trees = _grow(places, y, classes, w, f, *root_keys(seed, numbers), use=learn)
                leaf = _leaves(places, trees, len(numbers), out)
                share = _shares(trees["counts"], w)
                for read in {(p.min_split, p.max_depth) for p in own if p.trees > lo}:
                    votes = share[_read_to(trees, *read)[leaf]].reshape(len(numbers), len(out), classes)
                    for s, p in enumerate(own):
                        if (p.min_split, p.max_depth) == read:
                            sums[:, s] += votes[:max(0, p.trees - lo)].sum(axis=0)
            flat = sums.reshape(len(out), -1)
            for lo in range(0, len(out), ROW_BLOCK):
                own, votes = out[lo:lo + ROW_BLOCK], flat[lo:lo + ROW_BLOCK]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i, np.int32)), pa.array(own), pa.array(y[own], pa.int32()), *(pa.array(votes[:, c]) for c in range(votes.shape[1]))],
                                                 names=["forest", "at", "label", *names])

    spec = "forest int, at long, label int, " + ", ".join(f"{n} double" for n in names)
    votes = spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(run, spec).groupBy("forest", "at", "label").agg(*(F.sum(n).alias(n) for n in names))

    def hits(slot: int):
        share = [F.round(n, 9) for n in names[slot * classes:(slot + 1) * classes]]
        got = F.array_position(F.array(*share), F.greatest(*share) if classes > 1 else share[0]) - 1
        return F.sum((got == F.col("label")).cast("long"))

    by_forest = votes.groupBy("forest").agg(F.count(F.lit(1)).alias("n"), F.array(*map(hits, range(slots))).alias("hits"))
    place = spark.createDataFrame([(i, s, at, plan[i][0]) for i, own in enumerate(own_points) for s, at in enumerate(own)], "forest int, slot int, point int, fold int")
    return by_forest.join(F.broadcast(place), "forest").select("point", "fold", "n", F.get("hits", F.col("slot")).alias("hits"))


def _grid_by_fits(table: DataFrame, width: int, classes: int, points: Sequence[Point], folds: Sequence[int], seed: int, blocks: Blocks | None = None) -> DataFrame:
    """The same sums for tables of any size: one growth for each (fold, k), read once for each point."""
    out, blocks = None, blocks or pack(table, width)
    for fold in folds:
        for k in sorted({p.k for p in points}):
            own = [(i, p) for i, p in enumerate(points) if p.k == k]
            forest = Forest(max(p.trees for _, p in own), k, fold, seed)
            counts = class_counts(table, classes, [forest])
            nodes = materialize(grow_levels(table, width, classes, [forest], [balanced(counts[0])], counts, blocks=blocks), "extra-trees-nodes")
            cols = [F.col("x")[i].alias(f"x{i}") for i in range(width)]
            rows = table.filter(F.col("fold") == fold).select("fold", "label", *cols)
            for i, p in own:
                read = nodes.filter(F.col("tree") < p.trees)
                total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
                stop = total < p.min_split if p.max_depth is None else (total < p.min_split) | (F.col("depth") >= p.max_depth)
                read = read.withColumn("feature", F.when(stop, -1).otherwise(F.col("feature")))
                got = predict(rows, read, [f"x{i}" for i in range(width)], balanced(counts[0]))
                part = got.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("prediction") == F.col("label")).cast("long")).alias("hits"))
                part = part.select(F.lit(i).alias("point"), F.lit(fold).alias("fold"), "n", "hits")
                out = part if out is None else out.unionByName(part)
    return out


def grid_rows(accuracy: DataFrame, points: Sequence[Point], describe: Callable[[Point], str]) -> DataFrame:
    """K6: one row for each point with its mean accuracy over the folds and a flag at the best (equal ones: the first description)."""
    spark = accuracy.sparkSession
    mean = {r["point"]: r["a"] for r in accuracy.groupBy("point").agg(F.avg(F.col("hits") / F.col("n")).alias("a")).collect()}  # one row for each point
    rows = [(describe(p), mean.get(i, 0.0)) for i, p in enumerate(points)]
    best = min(rows, key=lambda r: (-round(r[1], 12), r[0]))[0]
    return spark.createDataFrame([(*r, r[0] == best) for r in rows], "params string, cv_accuracy double, best boolean")
