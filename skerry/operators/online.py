"""Kernels of the meters, post-processors, calibrators and column detectors: what plans compute by windows over tables, row by row, for streams.  Definitions are
those of functions.meters, functions.scores and operators.columnar; NaN counts as missing.

learn(x) takes a row in; score(x) looks at the state and leaves it as it is, so that a state can be frozen; the score of a row in a stream is learn, then score.
"""

from __future__ import annotations

import math

import numpy as np

from ..functions.numerics import chi2_quantile
from .kernels import Kernel, PrefixMedian, PrefixRank


class Ring:
    """The last rows of a stream, oldest first."""

    def __init__(self, rows: int, width: int = 1):
        self.rows, self.held, self.n = rows, np.empty((min(rows, 64), width)), 0

    def add(self, x: np.ndarray) -> None:
        if self.n < self.rows and self.n == len(self.held):
            self.held = np.concatenate([self.held, np.empty((min(self.rows, 2 * self.n) - self.n, self.held.shape[1]))])
        self.held[self.n % self.rows] = x
        self.n += 1

    def unordered(self) -> np.ndarray:
        return self.held[: min(self.n, self.rows)]

    def ordered(self) -> np.ndarray:
        return np.roll(self.held, -(self.n % self.rows), axis=0) if self.n >= self.rows else self.held[: self.n]


class Statistic(Kernel):
    """A meter's value over all rows (rows None) or the last `rows` rows."""

    def __init__(self, name: str, rows: int | None = None):
        if name not in ("count", "sum", "sum_squares", "average", "variance", "min", "max", "median"):
            raise ValueError(f"no meter {name!r}")
        self.name, self.rows = name, rows
        self.memory = None if rows is None else rows - 1

    def start(self, d):
        self.count = self.n = 0
        self.sum = self.squares = self.mean = self.m2 = 0.0
        self.low, self.high = math.inf, -math.inf
        self.ring = Ring(self.rows) if self.rows else None
        self.middle = PrefixMedian().fresh() if self.name == "median" and not self.rows else None

    def learn(self, x, y=None):
        v = float(x[0])
        self.count += 1
        if self.ring is not None:
            self.ring.add(x)
        elif v == v:
            self.n += 1
            self.sum += v
            self.squares += v * v
            away = v - self.mean
            self.mean += away / self.n
            self.m2 += away * (v - self.mean)
            self.low, self.high = min(self.low, v), max(self.high, v)
            if self.middle is not None:
                self.middle.next(x)

    def value(self) -> float | None:
        if self.ring is not None:
            own = self.ring.unordered()[:, 0]
            if self.name == "count":
                return float(len(own))
            own = own[own == own]
            if self.name in ("sum", "sum_squares"):
                return float((own if self.name == "sum" else own * own).sum())
            return float({"average": np.mean, "variance": np.var, "min": np.min, "max": np.max, "median": np.median}[self.name](own)) if len(own) else None
        if self.name in ("count", "sum", "sum_squares"):
            return float({"count": self.count, "sum": self.sum, "sum_squares": self.squares}[self.name])
        if not self.n:
            return None
        if self.name == "median":
            return self.middle.held.median()
        return {"average": self.sum / self.n, "variance": self.m2 / self.n, "min": self.low, "max": self.high}[self.name]

    def score(self, x, y=None):
        return self.value()


class Standardised(Kernel):
    """(x - mean) / deviation.  kind zscore: NULL while the deviation is zero; gauss: a deviation of zero counts as 1; tail: the normal distribution function of that;
    sad: (x - mean or median) / (deviation + 1e-10), absolute or not."""

    def __init__(self, kind: str = "zscore", rows: int | None = None, subtracted: str = "mean", absolute: bool = True):
        if kind not in ("zscore", "gauss", "tail", "sad") or subtracted not in ("mean", "median"):
            raise ValueError("kind is zscore, gauss, tail or sad; subtracted is mean or median")
        self.kind, self.absolute = kind, absolute
        self.parts = [Statistic("average" if subtracted == "mean" else "median", rows), Statistic("variance", rows)]
        self.memory = self.parts[0].memory

    def start(self, d):
        self.parts = [p.fresh() for p in self.parts]

    def learn(self, x, y=None):
        for p in self.parts:
            p.next(x)

    def score(self, x, y=None):
        v, (centre, variance) = float(x[0]), (p.value() if p.started else None for p in self.parts)
        if v != v or centre is None:
            return None
        if self.kind == "sad":
            z = (v - centre) / (math.sqrt(variance) + 1e-10)
            return abs(z) if self.absolute else z
        if self.kind == "zscore":
            return (v - centre) / math.sqrt(variance) if variance > 0 else None
        z = (v - centre) / (math.sqrt(variance) if variance > 0 else 1.0)
        return 0.5 * math.erfc(-z / math.sqrt(2)) if self.kind == "tail" else z


class Conformal(Kernel):
    """The share of the last `rows` scores (the own included) that are greater; rows None: PrefixRank."""

    def __new__(cls, rows: int | None = 300):
        return PrefixRank() if rows is None else super().__new__(cls)

    def __init__(self, rows: int | None = 300):
        self.rows, self.memory = rows, rows - 1

    def __reduce__(self):
        return object.__new__, (Conformal,), self.__dict__

    def start(self, d):
        self.ring = Ring(self.rows)

    def learn(self, x, y=None):
        self.ring.add(x)

    def score(self, x, y=None):
        own = self.ring.unordered()[:, 0]
        n = int((own == own).sum())
        return float((own > x[0]).sum()) / n if n and x[0] == x[0] else None


class ExactStorm(Kernel):
    """See columnar.exact_storm.  score() of a new row against a frozen state compares it with all rows that are held but the last one."""

    def __init__(self, rows: int = 10_000, radius: float = 0.1):
        self.rows, self.radius, self.memory = rows, radius, rows - 1

    def start(self, d):
        self.before = Ring(self.rows - 1, d) if self.rows > 1 else None
        self.last = None

    def learn(self, x, y=None):
        if self.last is not None and self.before is not None:
            self.before.add(self.last)
        self.last = np.asarray(x, float).copy()

    def score(self, x, y=None):
        if self.before is None or not self.before.n:
            return 0.0
        away = self.before.unordered() - x
        return float((np.einsum("ij,ij->i", away, away) < self.radius * self.radius).mean()) if self.radius > 0 else 0.0


class RelativeEntropy(Kernel):
    """See columnar.relative_entropy."""

    def __init__(self, low: float, high: float, n_bins: int = 5, rows: int = 52):
        self.low, self.high, self.n_bins, self.rows = low, high, n_bins, rows
        self.limit = chi2_quantile(0.99, n_bins - 1)

    def start(self, d):
        self.ring, self.first = Ring(self.rows), None

    def shares(self) -> np.ndarray:
        own = self.ring.unordered()[:, 0]
        b = np.ceil((own[own == own] - self.low) / ((self.high - self.low) / self.n_bins))
        counts = np.bincount(np.minimum(b[(b >= 0) & (b <= self.n_bins)].astype(int), self.n_bins - 1), minlength=self.n_bins)
        return counts / counts.sum() if counts.sum() else np.full(self.n_bins, np.nan)

    def learn(self, x, y=None):
        self.ring.add(x)
        if self.ring.n == self.rows:
            self.first = self.shares()

    def score(self, x, y=None):
        if self.ring.n < self.rows:
            return 0.0
        p, q, kl = self.shares(), self.first, 0.0
        for a, b in zip(p, q):
            if a != 0:
                kl += math.inf if b == 0 else a * math.log(a / b)
        return 0.0 if 2 * self.rows * kl < self.limit else -1.0


class SeasonalTrend(Kernel):
    """See columnar.seasonal_trend.  score() of a frozen state takes the phase of the next row and the trend of the rows that are held."""

    def __init__(self, season: int, trend: int | None = None):
        self.season, self.trend = season, season if trend is None else trend
        if self.season < 2 or self.trend < 1:
            raise ValueError("season must be 2 or more, trend 1 or more")

    def start(self, d):
        self.ring = Ring(self.trend)
        self.sums, self.counts = np.zeros(self.season), np.zeros(self.season)

    def _trend(self) -> float:
        own = self.ring.unordered()[:, 0]
        own = own[own == own]
        return float(own.mean()) if len(own) else math.nan

    def _season(self, phase: int) -> float:
        return self.sums[phase] / self.counts[phase] if self.counts[phase] else 0.0

    def learn(self, x, y=None):
        phase = self.ring.n % self.season
        self.ring.add(x)
        if self.ring.n >= self.trend and x[0] == x[0]:
            self.sums[phase] += x[0] - self._trend()
            self.counts[phase] += 1

    def _residual(self, x, phase: int) -> float | None:
        out = float(x[0]) - self._trend() - self._season(phase)
        return out if out == out else None

    def step(self, x, y=None):
        self.learn(x)
        return self._residual(x, (self.ring.n - 1) % self.season)

    def score(self, x, y=None):
        return self._residual(x, self.ring.n % self.season)
