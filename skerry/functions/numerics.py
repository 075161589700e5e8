"""Numerics that neither Spark nor NumPy has: quantiles, seasonal-trend decomposition, clustering, small distances."""

from __future__ import annotations

import functools
import math

import numpy as np


def _bisected(f, low: float, high: float) -> float:
    """The root of an increasing function."""
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series or its continued fraction."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * scale
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        n = -i * (i - a)
        b += 2
        d = 1 / (n * d + b or 1e-300)
        c = b + n / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - scale * h


def chi2_quantile(p: float, degrees: float) -> float:
    high = degrees + 10
    while gamma_p(degrees / 2, high / 2) < p:
        high *= 2
    return _bisected(lambda x: gamma_p(degrees / 2, x / 2) - p, 0.0, high)


def beta_i(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 1000):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + n * d) or tiny)
            c = (1 + n / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def t_quantile(p: float, degrees: float) -> float:
    """Of Student's t distribution."""
    if p < 0.5:
        return -t_quantile(1 - p, degrees)
    cdf = lambda t: 1 - beta_i(degrees / 2, 0.5, degrees / (degrees + t * t)) / 2
    high = 1.0
    while cdf(high) < p and high < 1e12:
        high *= 2
    return _bisected(lambda t: cdf(t) - p, 0.0, high)


def _odd(x: float) -> int:
    n = math.ceil(x)
    return n + (n % 2 == 0)


def loess(y: np.ndarray, span: int, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Local linear fits to y at places 0, 1, ..., with tricube weights of the `span` nearest places, evaluated at `at`."""
    n, near = len(y), min(span, len(y))
    # The nearest places are neighbours of each other.
    left = np.clip(np.floor(at - (near - 1) / 2), 0, n - near).astype(np.int64)
    place = left[:, None] + np.arange(near)
    x, value = place.astype(float), np.asarray(y, float)[place]
    far = np.abs(at[:, None] - x)
    width = np.maximum(far.max(1) + max(span - n, 0) // 2, 1e-12)[:, None]
    w = np.where(far <= 0.999 * width, np.where(far <= 0.001 * width, 1.0, (1 - np.minimum(far / width, 1) ** 3) ** 3), 0.0) * weights[place]
    total = w.sum(1, keepdims=True)
    ok = total[:, 0] > 0
    w = w / np.where(total > 0, total, 1)
    mean = (w * x).sum(1)
    spread = (w * (x - mean[:, None]) ** 2).sum(1)
    sloped = spread > (0.001 * max(n - 1, 1)) ** 2
    slope = np.where(sloped, (at - mean) / np.where(sloped, spread, 1), 0)
    fit = ((w * (1 + slope[:, None] * (x - mean[:, None]))) * value).sum(1)
    return np.where(ok, fit, np.interp(at, np.arange(n), y))


def _moving(x: np.ndarray, n: int) -> np.ndarray:
    return np.convolve(x, np.full(n, 1 / n), "valid")


@functools.lru_cache(maxsize=64)
def _stl_operator(n: int, period: int, options: tuple) -> np.ndarray:
    """Without robustness weights the seasonal part is linear in y; for the short windows that come again and again."""
    return np.column_stack([_stl(row, period, **dict(options)) for row in np.eye(n)])


def stl_seasonal(y: np.ndarray, period: int, robust: bool = True, **options) -> np.ndarray:
    """The seasonal part of STL (Cleveland et al. 1990): cycle-subseries smoothing, low-pass filtering and trend smoothing, repeated with bisquare weights."""
    if robust or options.get("outer") or len(y) > 48:
        return _stl(np.asarray(y, float), period, robust=robust, **options)
    return _stl_operator(len(y), period, tuple(sorted({**options, "robust": False}.items()))) @ y


def _stl(y: np.ndarray, period: int, seasonal: int = 7, trend: int | None = None, low_pass: int | None = None, robust: bool = True, inner: int | None = None, outer: int | None = None) -> np.ndarray:
    n = len(y)
    trend = trend or _odd(1.5 * period / (1 - 1.5 / seasonal))
    low_pass = low_pass or _odd(period + 1)
    inner, outer = inner or (2 if robust else 5), outer if outer is not None else (15 if robust else 0)
    weights, t, s = np.ones(n), np.zeros(n), np.zeros(n)
    every = np.arange(n, dtype=float)
    for k in range(outer + 1):
        for _ in range(inner):
            flat, cycle = y - t, np.zeros(n + 2 * period)
            for phase in range(period):
                sub = flat[phase::period]
                cycle[phase::period][: len(sub) + 2] = loess(sub, seasonal, np.arange(-1, len(sub) + 1, dtype=float), weights[phase::period])
            low = _moving(_moving(_moving(cycle, period), period), 3)
            low = loess(low, low_pass, every, np.ones(n))
            s = cycle[period : period + n] - low
            t = loess(y - s, trend, every, weights)
        if k < outer:
            rest = np.abs(y - s - t)
            h = 6 * np.median(rest)
            if h <= 1e-12:
                break
            u = rest / h
            weights = np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - np.minimum(u, 1) ** 2) ** 2, 0.0))
    return s


def stl_residual(y: np.ndarray, period: int, robust: bool = True, **options) -> np.ndarray:
    """y without its STL season and its median."""
    return y - stl_seasonal(y, period, robust=robust, **options) - np.median(y)


def esd_critical(n: int, i: int, alpha: float) -> float:
    """The critical value of the i-th step of the generalised ESD test (Rosner 1983)."""
    t = t_quantile(1 - alpha / (2 * (n - i + 1)), n - i - 1)
    return (n - i) * t / math.sqrt((n - i - 1 + t * t) * (n - i + 1))


def esd(values: np.ndarray, most: int, critical: list[float], hybrid: bool) -> list[tuple[int, float]]:
    """Places and statistics of the values that the test finds; hybrid: by median and MAD instead of mean and deviation."""
    left, found, selected = list(range(len(values))), [], 0
    for i in range(most):
        own = values[left]
        if hybrid:
            centre = np.median(own)
            scale = 1.4826 * np.median(np.abs(own - centre))
        else:
            centre, scale = own.mean(), own.std(ddof=1)
        if not scale > 1e-10:
            break
        away = np.abs(own - centre) / scale
        k = int(away.argmax())
        found.append((left.pop(k), float(away[k])))
        if away[k] > critical[i]:
            selected = i + 1
    return found[:selected]


def single_linkage(distance: np.ndarray, most: int) -> list[list[int]]:
    """Clusters of at most `most` members: the single-linkage dendrogram, split from its root until the parts are small enough."""
    n = len(distance)
    nodes: list = [([i], None) for i in range(n)]  # members, children
    own = list(range(n))
    pairs = sorted((distance[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    for _, i, j in pairs:
        a, b = own[i], own[j]
        if a != b:
            nodes.append((nodes[a][0] + nodes[b][0], (a, b)))
            for k in nodes[-1][0]:
                own[k] = len(nodes) - 1
    out, stack = [], [len(nodes) - 1]
    while stack:
        members, children = nodes[stack.pop()]
        if len(members) <= max(1, most):
            out.append(members)
        else:
            stack += [children[1], children[0]]
    return out


def average_path(n: float) -> float:
    """The mean depth of an unsuccessful search in a binary tree of n points (isolation forest's normalisation)."""
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)
