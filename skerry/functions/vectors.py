"""Vectors as arrays of doubles: scalers within a row, random projections drawn once per plan, extremes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def packed(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def let(x: Column, f) -> Column:
    """f of x, with x evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def identity(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def standardised(x: Column | str) -> Column:
    """(x - mean) / population deviation within the row; NULLs for a constant row."""

    def scaled(v: Column, mean: Column) -> Column:
        centred = F.transform(v, lambda y: y - mean)
        return let(centred, lambda c: let(F.sqrt(total(F.transform(c, lambda y: y * y)) / F.size(c)), lambda s: F.transform(c, lambda y: F.try_divide(y, s))))

    return let(doubles(x), lambda v: let(F.try_divide(total(v), F.size(v)), lambda mean: scaled(v, mean)))


def norm(v: Column, power: float = 2) -> Column:
    """The vector norm of an order: a number, 0 (entries that are not zero), inf or -inf."""
    sizes = F.transform(v, lambda y: F.abs(y))
    if power == math.inf:
        return F.array_max(sizes)
    if power == -math.inf:
        return F.array_min(sizes)
    if power == 0:
        return F.size(F.filter(v, lambda y: y != 0)).cast("double")
    if power == 1:
        return total(sizes)
    if power == 2:
        return F.sqrt(total(F.transform(v, lambda y: y * y)))
    return F.pow(total(F.transform(sizes, lambda y: F.pow(y, F.lit(float(power))))), F.lit(1.0 / power))


def unit(x: Column | str, power: float = 2) -> Column:
    """x over its norm; NULLs for a zero row."""
    return let(doubles(x), lambda v: let(norm(v, power), lambda n: F.transform(v, lambda y: F.try_divide(y, n))))


def dot(x: Column, weights: Sequence[float]) -> Column:
    """A product with fixed weights; zero weights cost nothing."""
    weights = [float(w) for w in weights]
    if sum(map(bool, weights)) > 8:  # long sums outgrow generated code
        return F.aggregate(F.zip_with(x, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    terms = [F.element_at(x, i + 1) * F.lit(w) for i, w in enumerate(weights) if w]
    return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


def projected(x: Column | str, matrix: np.ndarray) -> Column:
    """x times the transposed matrix, whose rows are the components; the matrix is part of the plan."""
    return F.array(*[dot(doubles(x), row) for row in np.asarray(matrix)])


def gaussian_matrix(n_components: int, n_features: int, seed: int = 0) -> np.ndarray:
    if not isinstance(n_components, int) or n_components < 1:
        raise ValueError("n_components must be a positive integer")
    return np.random.default_rng(seed).normal(scale=n_components**-0.5, size=(n_components, n_features))


def sparse_matrix(n_components: int, n_features: int, density: float | None = None, seed: int = 0) -> np.ndarray:
    """Entries 0 or +-sqrt(1 / (density * n_components)); density None: 1 / sqrt(n_features)."""
    if not isinstance(n_components, int) or n_components < 1:
        raise ValueError("n_components must be a positive integer")
    density = n_features**-0.5 if density is None else density
    if not 0 < density <= 1:
        raise ValueError("density must be in (0, 1]")
    rng = np.random.default_rng(seed)
    signs = rng.choice([-1.0, 0.0, 1.0], p=[density / 2, 1 - density, density / 2], size=(n_components, n_features))
    return signs * math.sqrt(1 / (density * n_components))


def murmur3(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 x86 32, unsigned (public domain, Appleby)."""
    mix = lambda k: (((k * 0xCC9E2D51 & 0xFFFFFFFF) << 15 | (k * 0xCC9E2D51 & 0xFFFFFFFF) >> 17) & 0xFFFFFFFF) * 0x1B873593 & 0xFFFFFFFF
    h, whole = seed, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h ^= mix(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
    if data[whole:]:
        h ^= mix(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for factor, shift in ((0x85EBCA6B, 16), (0xC2B2AE35, 13)):
        h = (h ^ h >> shift) * factor & 0xFFFFFFFF
    return h ^ h >> 16


def streamhash_matrix(n_components: int, n_features: int, density: float = 1 / 3) -> np.ndarray:
    """A sparse sign matrix from hashes of feature positions: it depends on no data, so new features get their columns at any time."""
    scale = math.sqrt(1 / density) / math.sqrt(n_components)
    out = np.zeros((n_components, n_features))
    for k in range(n_components):
        for f in range(n_features):
            h = murmur3(str(f).encode(), k) / (2**32 - 1)
            out[k, f] = -scale if h <= density / 2 else scale if h <= density else 0.0
    return out


class Projector(Protocol):
    """Anything that gives the matrix of a linear projection for vectors of n_features entries; project() applies it."""

    def matrix(self, n_features: int) -> np.ndarray: ...


@dataclass(frozen=True)
class Gaussian:
    n_components: int
    seed: int = 0

    def matrix(self, n_features: int) -> np.ndarray:
        return gaussian_matrix(self.n_components, n_features, self.seed)


@dataclass(frozen=True)
class Sparse:
    n_components: int
    density: float | None = None
    seed: int = 0

    def matrix(self, n_features: int) -> np.ndarray:
        return sparse_matrix(self.n_components, n_features, self.density, self.seed)


@dataclass(frozen=True)
class StreamHash:
    n_components: int
    density: float = 1 / 3

    def matrix(self, n_features: int) -> np.ndarray:
        return streamhash_matrix(self.n_components, n_features, self.density)


def project(df: DataFrame, features: str, projector: Projector, n_features: int | None = None, out: str | None = None) -> DataFrame:
    """df with the vectors projected; the number of features is looked up in one row where it is not given."""
    if n_features is None:
        first = df.where(F.col(features).isNotNull()).select(F.size(features).alias("n")).first()
        if first is None:
            return df if out is None else df.withColumn(out, doubles(features))
        n_features = first["n"]
    return df.withColumn(out or features, projected(features, projector.matrix(n_features)))


def feature_extremes(df: DataFrame, x: str = "features") -> DataFrame:
    """(pos, min, max) of each feature."""
    return df.select(F.posexplode(doubles(x)).alias("pos", "v")).groupBy("pos").agg(F.min("v").alias("min"), F.max("v").alias("max"))


def extremes(df: DataFrame, x: str = "features") -> DataFrame:
    """One row: the least and the greatest entry of all vectors."""
    return df.agg(F.min(F.array_min(doubles(x))).alias("min"), F.max(F.array_max(doubles(x))).alias("max"))
