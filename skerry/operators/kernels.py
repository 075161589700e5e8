"""Sequential detectors and statistics as kernels: one object holds the parameters and the state of one stream; step(x, y) takes the next row in and returns its score;
score(x, y) scores a row against the state and leaves it as it is.

A kernel is a plain Python object, so its state is its pickle: runtime.run_batch streams sorted rows through one kernel per key, streaming.runner keeps it in the
state store, and both give the same scores.  All randomness comes from `seed` (and the key), never from global generators.
"""

from __future__ import annotations

import bisect
import copy
import math
from collections import deque

import numpy as np

from ..functions.numerics import average_path, esd, esd_critical, single_linkage, stl_residual
from ..functions.vectors import streamhash_matrix
from .columnar import Forest, HashParameters


class Kernel:
    """Subclasses define start(d), called at the first row with its number of features, and step(x, y), or learn(x, y) and score(x, y)."""

    seed = 0
    #: How many rows before a row its score depends on (None: all), and the windows whose edges they are counted from.
    memory: int | None = None
    window = 1

    def fresh(self, key_hash: int = 0) -> "Kernel":
        """A copy for one stream, with a generator of its own."""
        out = copy.deepcopy(self)
        out.rng = np.random.default_rng([out.seed, key_hash & 0xFFFFFFFF])
        out.started = False
        return out

    def next(self, x: np.ndarray, y=None) -> float | None:
        if not self.started:
            self.start(len(x))
            self.started = True
        return self.step(x, y)

    def start(self, d: int) -> None:
        pass

    def learn(self, x: np.ndarray, y=None) -> None:
        self.step(x, y)

    def step(self, x: np.ndarray, y=None) -> float | None:
        if type(self).learn is Kernel.learn:
            raise NotImplementedError
        self.learn(x, y)
        return self.score(x, y)

    def score(self, x: np.ndarray, y=None) -> float | None:
        """Where a detector has no score without taking the row in, a copy takes it in."""
        return copy.deepcopy(self).next(x, y)


class _Sorted:
    """Numbers in order, with their median."""

    def __init__(self):
        self.own: list[float] = []

    def add(self, x: float) -> None:
        bisect.insort(self.own, x)

    def remove(self, x: float) -> None:
        self.own.pop(bisect.bisect_left(self.own, x))

    def median(self) -> float | None:
        n = len(self.own)
        return (self.own[n // 2] + self.own[(n - 1) // 2]) / 2 if n else None


class PrefixMedian(Kernel):
    """The median of all values so far."""

    def start(self, d):
        self.held = _Sorted()

    def learn(self, x, y=None):
        if x[0] == x[0]:
            self.held.add(float(x[0]))

    def score(self, x, y=None):
        return self.held.median()


class PrefixRank(Kernel):
    """The share of all values so far, the own included, that are greater."""

    def start(self, d):
        self.held = _Sorted()

    def learn(self, x, y=None):
        if x[0] == x[0]:
            self.held.add(float(x[0]))

    def score(self, x, y=None):
        v, n = float(x[0]), len(self.held.own)
        return (n - bisect.bisect_right(self.held.own, v)) / n if v == v and n else None


class MedianAbsoluteDeviation(Kernel):
    """(x - median) / (b * MAD + 1e-10); each row's deviation is from the median as it was at that row."""

    def __init__(self, absolute: bool = True, b: float = 1.4826):
        self.absolute, self.b = absolute, b

    def start(self, d):
        self.values, self.deviations = _Sorted(), _Sorted()

    def learn(self, x, y=None):
        v = float(x[0])
        if v == v:
            self.values.add(v)
            self.deviations.add(abs(v - self.values.median()))

    def score(self, x, y=None):
        v = float(x[0])
        if v != v or not self.values.own:
            return None
        z = (v - self.values.median()) / (self.b * self.deviations.median() + 1e-10)
        return abs(z) if self.absolute else z


class HalfSpaceTrees(Kernel):
    """Half-space trees (Tan, Ting and Liu 2011): -sum over trees and path nodes of mass * 2**depth.  A node's mass is the number of rows of the last full window of `rows`
    rows that pass it, in the first window that of the rows so far.  Only visited nodes are kept.  initial: rows that are a first window before the stream's."""

    def __init__(self, forest: Forest, rows: int = 100, initial: np.ndarray | None = None):
        self.forest, self.rows, self.initial = forest, rows, initial
        if initial is None:
            self.memory, self.window = rows, rows

    def start(self, d):
        self.mass: dict = {}
        self.latest: dict = {}
        self.n = 0
        self.filled = self.initial is not None
        if self.filled:
            for x in np.asarray(self.initial, float):
                self._count(self.paths(x))
            self.mass, self.latest = self.latest, {}

    def paths(self, x: np.ndarray) -> list[list[int]]:
        """For each level, the trees' nodes as single numbers."""
        f, trees = self.forest, np.arange(self.forest.n_trees)
        low, high = np.tile(np.asarray(f.low, float), (f.n_trees, 1)), np.tile(np.asarray(f.high, float), (f.n_trees, 1))
        node, out = np.ones(f.n_trees, np.int64), [trees << 32 | 1]
        for _ in range(f.depth):
            q = f.attributes(trees, node)
            mid = (low[trees, q] + high[trees, q]) / 2
            right = x[q] > mid
            low[trees[right], q[right]] = mid[right]
            high[trees[~right], q[~right]] = mid[~right]
            node = 2 * node + right
            out.append(trees << 32 | node)
        return [level.tolist() for level in out]

    def _count(self, paths) -> None:
        held = self.latest
        for level in paths:
            for node in level:
                held[node] = held.get(node, 0) + 1

    def _total(self, paths) -> float:
        mass = self.mass if self.filled else self.latest
        return -sum(2.0**k * sum(mass.get(node, 0) for node in level) for k, level in enumerate(paths))

    def step(self, x, y=None):
        self.n += 1
        paths = self.paths(x)
        self._count(paths)
        if self.n % self.rows == 0:
            self.mass, self.latest, self.filled = self.latest, {}, True
        return self._total(paths)

    def score(self, x, y=None):
        return self._total(self.paths(x))


class RSHash(Kernel):
    """See columnar.rs_hash; cells that have faded below rounding are swept."""

    def __init__(self, parameters: HashParameters):
        self.p = parameters

    def start(self, d):
        self.cells: dict = {}
        self.n = 0
        self.faded = math.ceil(60 / self.p.decay)

    def _seen(self, x) -> list[tuple[tuple, float]]:
        """Cells of a row, and the faded numbers of rows in them."""
        out, p = [], self.p
        for r, (f, own, shift) in enumerate(zip(p.widths, p.features, p.shifts)):
            cell = (r, *(math.floor((x[i] + a) / f) for i, a in zip(own, shift)))
            at, c = self.cells.get(cell, (self.n, 0.0))
            out.append((cell, c * 2.0 ** (-p.decay * (self.n - at))))
        return out

    def step(self, x, y=None):
        seen = self._seen(x)
        for cell, c in seen:
            self.cells[cell] = (self.n, c + 1)
        self.n += 1
        if self.n % self.faded == 0:
            self.cells = {k: v for k, v in self.cells.items() if self.n - v[0] < self.faded}
        return sum(math.log1p(c) for _, c in seen) / len(seen)

    def score(self, x, y=None):
        return sum(math.log1p(c) for _, c in self._seen(x)) / len(self.p.widths)


class LODA(Kernel):
    """The published on-line detector (Pevny 2016): sparse random projections drawn once, and a histogram for each that grows with the stream.
    The score is the mean negative log density.  Cells are of fixed width, from the first `warm` projected values."""

    def __init__(self, n_bins: int = 10, n_cuts: int = 100, warm: int = 32, seed: int = 0):
        self.n_bins, self.n_cuts, self.warm, self.seed = n_bins, n_cuts, warm, seed

    def start(self, d):
        keep = max(1, round(math.sqrt(d)))
        self.w = np.zeros((self.n_cuts, d))
        for row in self.w:
            row[self.rng.choice(d, keep, replace=False)] = self.rng.normal(size=keep)
        self.first: list = []
        self.width = None
        self.counts: list[dict] = [{} for _ in range(self.n_cuts)]
        self.n = 0

    def _cells(self, z: np.ndarray) -> list:
        return np.floor(z / self.width).astype(np.int64).tolist()

    def _add(self, z: np.ndarray) -> None:
        for held, cell in zip(self.counts, self._cells(z)):
            held[cell] = held.get(cell, 0) + 1
        self.n += 1

    def step(self, x, y=None):
        z = self.w @ x
        if self.width is None:
            self.first.append(z)
            if len(self.first) < self.warm:
                return 0.0
            spread = np.ptp(np.array(self.first), axis=0)
            self.width = np.where(spread > 0, spread, 1.0) / self.n_bins
            for held in self.first:
                self._add(held)
            self.first = []
        else:
            self._add(z)
        return self._score(z)

    def _score(self, z: np.ndarray) -> float:
        counts = np.array([held.get(cell, 0.5) for held, cell in zip(self.counts, self._cells(z))])  # half a row where there was none
        return float(-np.mean(np.log(counts / (self.n * self.width))))

    def score(self, x, y=None):
        return 0.0 if self.width is None else self._score(self.w @ x)


class XStream(Kernel):
    """Half-space chains on stream-hash projections (Manzoor et al. 2018).  A window's rows are counted under the cell widths of the window before it and
    looked up under its own, as the reference does."""

    def __init__(self, n_components: int = 100, n_chains: int = 100, depth: int = 25, rows: int = 25, seed: int = 0):
        self.k, self.n_chains, self.depth, self.rows, self.seed = n_components, n_chains, depth, rows, seed
        self.memory, self.window = 2 * rows, rows
        rng = np.random.default_rng(seed)
        self.features, self.part = rng.integers(0, n_components, (n_chains, depth)), rng.random((n_chains, n_components))
        self.mix = rng.integers(1, 2**63, n_components, dtype=np.int64) | 1

        # How often a chain has cut a feature at each depth, and the depth where it did so before (-1: never).
        self.times, self.before = np.ones((n_chains, depth)), np.full((n_chains, depth), -1)
        for c, own in enumerate(self.features.tolist()):
            last: dict[int, int] = {}
            for j, f in enumerate(own):
                if f in last:
                    self.before[c, j], self.times[c, j] = last[f], self.times[c, last[f]] + 1
                last[f] = j

    def start(self, d):
        self.matrix = streamhash_matrix(self.k, d)
        self.width = np.full(self.k, 0.5)
        self.keys, self.numbers = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of the window closed last
        self.own: list = []
        self.cut: list = []
        self.n = 0

    def cells(self, z: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the cell vector for each chain and depth.  The m-th cut of a feature halves the cells of the one before and moves them by the chain's shift."""
        f, chains = self.features, np.arange(self.n_chains)[:, None]
        part, scale = self.part[chains, f], 2.0 ** (self.times - 1)
        bins = np.floor(scale * ((z[f] + part * self.width[f]) / self.width[f]) - (scale - 1) * part).astype(np.int64)
        old = np.where(self.before >= 0, bins[chains, self.before], 0)
        with np.errstate(over="ignore"):
            code = np.cumsum((bins - old) * self.mix[f], axis=1, dtype=np.int64)
            return ((code * self.depth + np.arange(self.depth)) * self.n_chains + chains) * np.int64(0x9E3779B97F4A7C15 - 2**64)

    def step(self, x, y=None):
        z = self.matrix @ x
        self.n += 1
        self.own.append(z)
        self.cut.append(self.cells(z).ravel())
        if self.n % self.rows == 0:
            self.keys, self.numbers = np.unique(np.concatenate(self.cut), return_counts=True)
            own = np.array(self.own)
            width = (own.max(0) - own.min(0)) / 2
            self.width = np.where(np.abs(width) <= 1e-4, 1.0, width)
            self.own, self.cut = [], []
        return self._score(z)

    def _score(self, z: np.ndarray) -> float:
        cells = self.cells(z)
        if self.n < self.rows:  # the first window counts as far as it is there
            counts = (np.array(self.cut) == cells.ravel()).sum(0)
        else:
            at = np.minimum(np.searchsorted(self.keys, cells.ravel()), len(self.keys) - 1)
            counts = np.where(self.keys[at] == cells.ravel(), self.numbers[at], 0)
        return -float((np.log2(1 + counts.reshape(cells.shape)) + np.arange(1, self.depth + 1)).min(1).mean())

    def score(self, x, y=None):
        return self._score(self.matrix @ x)


class KNNCAD(Kernel):
    """Conformal k-nearest-neighbour detector on lag embeddings (Burnaev and Ishimtsev 2016): 19 lags, 27 neighbours, a Mahalanobis-like metric renewed twice a
    period, and p-values against the scores of the last period.  After a hit (0.9965) the score is 0.5 for a fifth of a period."""

    LAGS, NEIGHBOURS, HIT = 19, 27, 0.9965

    def __init__(self, period: int):
        if period < self.LAGS + self.NEIGHBOURS + 2:
            raise ValueError("the period must leave more than 28 embedded rows")
        self.period = period

    def start(self, d):
        self.last: deque = deque(maxlen=self.LAGS)
        self.training = np.empty((0, self.LAGS))  # in no order; the oldest row is at `oldest`
        self.oldest = 0
        self.waiting: deque = deque()
        self.scores: deque = deque()
        self.metric = np.eye(self.LAGS)
        self._measured()
        self.n = self.quiet = 0

    def _measured(self) -> None:
        """What distances need of the training rows: their products with the metric and their own lengths."""
        self.products = self.training @ self.metric
        self.lengths = np.einsum("ij,ij->i", self.products, self.training)

    def distance(self, item: np.ndarray, itself: bool) -> float:
        k = self.NEIGHBOURS + itself
        # The metric is symmetric.
        return float(np.partition(self.lengths - 2 * (self.products @ item) + item @ self.metric @ item, k)[:k].sum())

    def _replaced(self, item: np.ndarray) -> None:
        at = self.oldest
        self.training[at], self.products[at] = item, item @ self.metric
        self.lengths[at] = self.products[at] @ item
        self.oldest = (at + 1) % len(self.training)

    def step(self, x, y=None):
        self.last.append(float(x[0]))
        self.n += 1
        if len(self.last) < self.LAGS:
            return 0.0
        item = np.array(self.last)
        if self.n < self.period:
            self.training = np.concatenate([self.training, item[None]])
            self._measured()
            return 0.0
        if self.n % self.period in (0, self.period // 2):
            try:
                metric = np.linalg.inv(self.training.T @ self.training)
                self.metric = (metric + metric.T) / 2
            except np.linalg.LinAlgError:
                pass  # the metric stays
            self._measured()
        if not self.scores:
            self.scores.extend(self.distance(t, True) for t in self.training)
        new = self.distance(item, False)
        if self.n >= 2 * self.period:
            self._replaced(self.waiting.popleft())
        self.scores.popleft()
        self.waiting.append(item)
        self.scores.append(new)
        # The row is scored against the training rows as they are now.
        share = float(np.mean(np.array(self.scores) < self.distance(item, False)))
        if self.quiet > 0:
            self.quiet -= 1
            return 0.5
        if share >= self.HIT:
            self.quiet = self.period // 5
        return share


class SeasonalESD(Kernel):
    """The statistic of the newest row of a window, if the generalised ESD test finds it among the STL residuals; else 0."""

    def __init__(self, period: int, rows: int, most: int, alpha: float = 0.05, robust: bool = True, hybrid: bool = False, **stl):
        if period < 2 or rows < 2 * period or not 0 < most < rows - 2 or not (isinstance(alpha, float) and 0 < alpha < 1):
            raise ValueError("period >= 2, rows >= 2 * period, 0 < most < rows - 2 and 0 < alpha < 1")
        self.period, self.rows, self.most, self.robust, self.hybrid, self.stl = period, rows, most, robust, hybrid, stl
        self.memory = rows - 1
        self.critical = [esd_critical(rows, i, alpha) for i in range(1, most + 1)]

    def start(self, d):
        if d != 1:
            raise ValueError("seasonal ESD takes one value")
        self.held: deque = deque(maxlen=self.rows)

    def step(self, x, y=None):
        self.held.append(float(x[0]))
        if len(self.held) < self.rows:
            return 0.0
        residual = stl_residual(np.array(self.held), self.period, self.robust, **self.stl)
        return next((s for i, s in esd(residual, self.most, self.critical, self.hybrid) if i == self.rows - 1), 0.0)


class STLResidual(Kernel):
    """The newest row's x - season - median over the last rows; 0 before two periods are there."""

    def __init__(self, period: int, rows: int, robust: bool = True, **stl):
        if period < 2 or rows < 2 * period:
            raise ValueError("period >= 2 and rows >= 2 * period")
        self.period, self.rows, self.robust, self.stl = period, rows, robust, stl
        self.memory = rows - 1

    def start(self, d):
        self.held: deque = deque(maxlen=self.rows)

    def step(self, x, y=None):
        self.held.append(float(x[0]))
        return 0.0 if len(self.held) < 2 * self.period else float(stl_residual(np.array(self.held), self.period, self.robust, **self.stl)[-1])


class InqMAD(Kernel):
    """Density from random Fourier features: the density matrix sums outer products of normalised feature maps, and a row's score is |rho psi|**2 over the squared
    number of rows; high for normal rows (Gallego-Mejia et al. 2022)."""

    def __init__(self, n_features: int = 64, gamma: float = 1.0, seed: int = 42):
        self.m, self.gamma, self.seed = n_features, gamma, seed

    def start(self, d):
        self.w = self.rng.normal(scale=math.sqrt(2 * self.gamma), size=(d, self.m))
        self.b = self.rng.uniform(0, 2 * math.pi, self.m)
        self.rho, self.n = np.zeros((self.m, self.m)), 0

    def psi(self, x: np.ndarray) -> np.ndarray:
        out = np.cos(x @ self.w + self.b)
        return out / (np.linalg.norm(out) or 1.0)

    def learn(self, x, y=None):
        psi = self.psi(x)
        self.rho += np.outer(psi, psi)
        self.n += 1

    def score(self, x, y=None):
        out = self.rho @ self.psi(x) / self.n
        return float(out @ out)


class _Cut:
    __slots__ = ("left", "right", "up", "low", "high", "n", "axis", "at", "point", "times")

    def __init__(self, point, n=1):
        self.left = self.right = self.up = None
        self.low, self.high, self.n, self.point = point.copy(), point.copy(), n, point
        self.axis = self.at = None


class CutTree:
    """A robust random cut tree (Guha et al. 2016); equal points share a leaf."""

    def __init__(self, rng: np.random.Generator):
        self.rng, self.root, self.leaves = rng, None, {}

    def insert(self, point: np.ndarray, name) -> _Cut:
        if self.root is None:
            self.root = self.leaves[name] = _Cut(point)
            return self.root
        node = self.root
        while True:
            low, high = np.minimum(node.low, point), np.maximum(node.high, point)
            if node.left is None and np.array_equal(node.point, point):
                self._count(node, 1)
                self.leaves[name] = node
                return node
            span = high - low
            r = self.rng.random() * span.sum()
            axis = int(min(np.searchsorted(np.cumsum(span), r, side="right"), len(span) - 1))
            at = low[axis] + r - (np.cumsum(span)[axis] - span[axis])
            if at < node.low[axis] or at >= node.high[axis]:
                break  # the cut parts the point from all of the node
            node = node.left if point[node.axis] <= node.at else node.right
        new, join = _Cut(point), _Cut(point)
        join.axis, join.at, join.n, join.up = axis, at, node.n, node.up
        join.left, join.right = (new, node) if point[axis] <= at else (node, new)
        if node.up is None:
            self.root = join
        elif node.up.left is node:
            node.up.left = join
        else:
            node.up.right = join
        node.up = new.up = join
        join.low, join.high = np.minimum(node.low, point), np.maximum(node.high, point)
        self._count(join, 1)
        while join.up is not None:
            join = join.up
            join.low, join.high = np.minimum(join.low, point), np.maximum(join.high, point)
        self.leaves[name] = new
        return new

    @staticmethod
    def _count(node: _Cut, by: int) -> None:
        while node is not None:
            node.n += by
            node = node.up

    def forget(self, name) -> None:
        leaf = self.leaves.pop(name)
        if leaf.n > 1:
            self._count(leaf, -1)
            return
        parent = leaf.up
        if parent is None:
            self.root = None
            return
        other = parent.right if parent.left is leaf else parent.left
        other.up = parent.up
        if parent.up is None:
            self.root = other
        elif parent.up.left is parent:
            parent.up.left = other
        else:
            parent.up.right = other
        node = parent.up
        self._count(node, -1)
        while node is not None:
            node.low, node.high = np.minimum(node.left.low, node.right.low), np.maximum(node.left.high, node.right.high)
            node = node.up

    def displacement(self, name) -> float:
        """Collusive displacement: the most that the removal of a subtree with the point would move others, for each of its points."""
        node, most = self.leaves[name], 0.0
        while node.up is not None:
            other = node.up.right if node.up.left is node else node.up.left
            most = max(most, other.n / node.n)
            node = node.up
        return most


class RobustRandomCutForest(Kernel):
    """Mean collusive displacement over trees that hold the last `size` rows; the oldest row is forgotten."""

    def __init__(self, n_trees: int = 4, size: int = 256, seed: int = 0):
        self.n_trees, self.size, self.seed = n_trees, size, seed

    def start(self, d):
        self.trees = [CutTree(self.rng) for _ in range(self.n_trees)]
        self.n = 0

    def step(self, x, y=None):
        self.n += 1
        total = 0.0
        for tree in self.trees:
            if len(tree.leaves) >= self.size:
                tree.forget(self.n - self.size)
            tree.insert(np.asarray(x, float), self.n)
            total += tree.displacement(self.n)
        return total / self.n_trees

    def __getstate__(self):
        # Trees are deep; their pickles are flat lists of nodes.
        out = dict(self.__dict__)
        if "trees" in out:
            out["trees"] = [_flat(t) for t in self.trees]
        return out

    def __setstate__(self, state):
        self.__dict__.update(state)
        if "trees" in state:
            self.trees = [_deep(t, self.rng) for t in state["trees"]]


def _flat(tree: CutTree) -> tuple:
    nodes, stack, place = [], [(tree.root, -1, 0)] if tree.root else [], {}
    while stack:
        node, up, side = stack.pop()
        place[id(node)] = len(nodes)
        nodes.append((up, side, node.low, node.high, node.n, node.axis, node.at, node.point))
        for side, child in ((1, node.left), (2, node.right)):
            if child is not None:
                stack.append((child, place[id(node)], side))
    return nodes, {k: place[id(v)] for k, v in tree.leaves.items()}


def _deep(flat: tuple, rng) -> CutTree:
    tree, made = CutTree(rng), []
    for up, side, low, high, n, axis, at, point in flat[0]:
        node = _Cut(point, n)
        node.low, node.high, node.axis, node.at = low, high, axis, at
        made.append(node)
        if up < 0:
            tree.root = node
        else:
            node.up = made[up]
            setattr(made[up], "left" if side == 1 else "right", node)
    tree.leaves = {k: made[i] for k, i in flat[1].items()}
    return tree


class AutoEncoder:
    """Tied weights, sigmoid units, 0-1 scaling by the extremes so far, one gradient step for each row.  Biases move by the mean over units."""

    def __init__(self, d: int, rate: float, hidden: float):
        self.rate = rate
        self.w = np.random.RandomState(1234).uniform(-1 / d, 1 / d, (d, math.ceil(d * hidden)))
        self.h, self.v = np.zeros(self.w.shape[1]), np.zeros(d)
        self.low, self.high = np.full(d, np.inf), np.full(d, -np.inf)

    def _rebuilt(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = (x - self.low) / (self.high - self.low + 1e-16)
        y = 1 / (1 + np.exp(-np.clip(s @ self.w + self.h, -500, 500)))
        z = 1 / (1 + np.exp(-np.clip(self.w @ y + self.v, -500, 500)))
        return s, y, s - z

    def train(self, x: np.ndarray) -> float:
        self.low, self.high = np.minimum(self.low, x), np.maximum(self.high, x)
        s, y, error = self._rebuilt(x)
        back = (error @ self.w) * y * (1 - y)
        self.w = self.w + self.rate * (np.outer(s, back) + np.outer(error, y))
        self.h, self.v = self.h + self.rate * back.mean(), self.v + self.rate * error.mean()
        return float(np.sqrt(np.mean(error**2)))

    def execute(self, x: np.ndarray) -> float:
        return float(np.sqrt(np.mean(self._rebuilt(x)[2] ** 2)))


class KitNet(Kernel):
    """An ensemble of autoencoders on groups of correlated features (Mirsky et al. 2018): features are grouped over the first rows, the autoencoders learn over
    the next, and later rows are scored; scores before that are 0."""

    def __init__(self, most: int = 10, mapping_rows: int | None = None, training_rows: int = 50_000, rate: float = 0.1, hidden: float = 0.75):
        self.most, self.training_rows, self.rate, self.hidden = max(1, most), training_rows, rate, hidden
        self.mapping_rows = training_rows if mapping_rows is None else mapping_rows

    def start(self, d):
        self.n, self.seen = 0, 0
        self.sum, self.rest, self.squares, self.products = np.zeros(d), np.zeros(d), np.zeros(d), np.zeros((d, d))
        self.groups: list = []

    def score(self, x, y=None):
        return self.output.execute(np.array([a.execute(x[g]) for a, g in zip(self.layer, self.groups)])) if self.n > self.mapping_rows + self.training_rows else 0.0

    def step(self, x, y=None):
        if self.n > self.mapping_rows + self.training_rows:
            return self.score(x)
        if not self.groups:
            self.seen += 1
            self.sum = self.sum + x
            away = x - self.sum / self.seen
            self.squares, self.products = self.squares + away**2, self.products + np.outer(away, away)
            if self.n == self.mapping_rows:
                norm = np.outer(np.sqrt(self.squares), np.sqrt(self.squares))
                distance = np.maximum(1 - self.products / np.where(norm == 0, 1e-100, norm), 0)
                self.groups = single_linkage(distance, min(self.most, len(x)))
                self.layer = [AutoEncoder(len(g), self.rate, self.hidden) for g in self.groups]
                self.output = AutoEncoder(len(self.groups), self.rate, self.hidden)
        else:
            self.output.train(np.array([a.train(x[g]) for a, g in zip(self.layer, self.groups)]))
        self.n += 1
        return 0.0


def fitted(detector, x: np.ndarray, rng: np.random.Generator, y: np.ndarray | None = None):
    """A batch detector's model; labels go to detectors that take them."""
    return detector.fit(x, rng) if y is None else detector.fit(x, rng, y)


class Monitor(Kernel):
    """A batch detector with a moving reference window; see reference_window.  labels: the detector learns from rows and their labels, those of an initial window included."""

    def __init__(self, detector, rows: int, slide: int, initial: np.ndarray | None = None, labels: bool = False, initial_labels: np.ndarray | None = None):
        if labels and initial is not None and (initial_labels is None or len(initial_labels) != len(initial)):
            raise ValueError("a label for each initial row")
        self.detector, self.rows, self.slide, self.initial, self.labels, self.initial_labels = detector, rows, slide, initial, labels, initial_labels

    def start(self, d):
        self.now: list = []
        first = [] if self.initial is None else zip(self.initial, self.initial_labels if self.labels else [None] * len(self.initial))
        self.reference = [(np.asarray(v, float), y) for v, y in first][-self.rows :]
        self.model = self._fitted() if self.reference else None
        self.filling = self.initial is None

    def _fitted(self):
        x, y = np.array([v for v, _ in self.reference]), np.array([y for _, y in self.reference])
        return fitted(self.detector, x, self.rng, y if self.labels else None)

    def score(self, x, y=None):
        return float(self.model.scores(np.asarray(x, float)[None])[0]) if self.model is not None else 0.0

    def step(self, x, y=None):
        self.now.append((np.asarray(x, float), y))
        if self.filling and len(self.now) < self.rows and len(self.reference) < self.rows:
            self.reference = list(self.now)
            self.model = self._fitted()
        elif len(self.now) % self.slide == 0:
            self.reference, self.now = (self.reference + self.now)[-self.rows :], []
            self.model = self._fitted()
        return self.score(x)


# --- batch detectors: fit(rows, rng) gives a model with scores(rows) -------------------------------------------------------------------------------------


class IsolationForest:
    """Liu et al. 2008; scores are 2 ** (-depth / c(sample)), high for anomalies."""

    def __init__(self, n_trees: int = 100, sample: int = 256):
        self.n_trees, self.sample = n_trees, sample

    def fit(self, x: np.ndarray, rng: np.random.Generator) -> "_Isolation":
        size = min(self.sample, len(x))
        limit = math.ceil(math.log2(max(size, 2)))

        def grow(rows: np.ndarray, depth: int):
            spread = rows.max(0) - rows.min(0) if len(rows) else np.zeros(1)
            axes = np.flatnonzero(spread > 0)
            if depth >= limit or len(rows) <= 1 or not len(axes):
                return depth + average_path(len(rows))
            axis = int(rng.choice(axes))
            at = rng.uniform(rows[:, axis].min(), rows[:, axis].max())
            left = rows[:, axis] < at
            return axis, at, grow(rows[left], depth + 1), grow(rows[~left], depth + 1)

        return _Isolation([grow(x[rng.choice(len(x), size, replace=False)], 0) for _ in range(self.n_trees)], average_path(size))


class _Isolation:
    def __init__(self, trees, norm):
        self.trees, self.norm = trees, norm or 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.trees:
            stack = [(tree, np.arange(len(x)))]
            while stack:
                node, rows = stack.pop()
                if not isinstance(node, tuple):
                    total[rows] += node
                elif len(rows):
                    left = x[rows, node[0]] < node[1]
                    stack += [(node[2], rows[left]), (node[3], rows[~left])]
        return 2 ** (-total / len(self.trees) / self.norm)


class LocalOutlierProbability:
    """LoOP (Kriegel et al. 2009) of rows against fixed training rows."""

    def __init__(self, n_neighbours: int = 10, extent: float = 3):
        self.k, self.extent = n_neighbours, extent

    def fit(self, x: np.ndarray, rng=None) -> "_Loop":
        return _Loop(np.asarray(x, float), min(self.k, len(x) - 1), self.extent)


class _Loop:
    def __init__(self, x, k, extent):
        if k < 1:
            raise ValueError("LoOP needs two training rows")
        self.x, self.k, self.extent = x, k, extent
        near, self.sigma = self._near(x, True)
        plof = self._plof(self.sigma, near)
        self.norm = extent * math.sqrt(np.mean(plof**2)) or 1.0

    def _near(self, rows, itself: bool):
        squares = np.maximum((rows**2).sum(1)[:, None] + (self.x**2).sum(1)[None] - 2 * rows @ self.x.T, 0)
        if itself:
            np.fill_diagonal(squares, np.inf)
        near = np.argpartition(squares, self.k - 1, axis=1)[:, : self.k]
        return near, np.sqrt(np.take_along_axis(squares, near, 1).mean(1))

    def _plof(self, sigma, near):
        around = self.sigma[near].mean(1)
        return np.where(around > 0, sigma / np.where(around > 0, around, 1) - 1, 0.0)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        near, sigma = self._near(np.asarray(rows, float), False)
        z = self._plof(sigma, near) / self.norm / math.sqrt(2)
        return np.maximum(0, np.array([math.erf(v) for v in z]))


class Fixed(Kernel):
    """One fit, on given rows and, for detectors that take them, labels; every row is scored by it."""

    def __init__(self, detector, initial: np.ndarray, labels: np.ndarray | None = None):
        self.detector, self.initial, self.labels = detector, np.asarray(initial, float), labels

    def start(self, d):
        self.model = fitted(self.detector, self.initial, self.rng, self.labels)

    def learn(self, x, y=None):
        pass

    def score(self, x, y=None):
        return float(self.model.scores(np.asarray(x, float)[None])[0])
