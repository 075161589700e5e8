"""Detectors that are exact column plans.  `higher_is_anomalous` says which way a detector's raw score points; `oriented` turns it."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.meters import AVERAGE, VARIANCE, running, track
from ..functions.numerics import chi2_quantile
from ..functions.vectors import doubles, murmur3
from ..plans.stream import StreamSpec, number, numbered, over, repeated, sliding

#: Raw scores of these detectors are high for normal rows.
LOW_IS_ANOMALOUS = {"exact_storm", "rs_hash", "inqmad", "relative_entropy"}


def higher_is_anomalous(detector: str) -> bool:
    return detector not in LOW_IS_ANOMALOUS


def oriented(detector: str, score: str = "score") -> Column:
    return F.col(score) if higher_is_anomalous(detector) else -F.col(score)


def null_model(df: DataFrame, out: str = "score") -> DataFrame:
    return df.withColumn(out, F.lit(0.5))


def perfect_model(df: DataFrame, label: str = "label", out: str = "score") -> DataFrame:
    """The label; a missing one is an error."""
    y = F.col(label).cast("double")
    return df.withColumn(out, F.when(y.isNotNull(), y).otherwise(F.raise_error(F.lit("a perfect model needs labels")).cast("double")))


def random_model(df: DataFrame, spec: StreamSpec, seed: int = 0, out: str = "score") -> DataFrame:
    """Uniform on [0, 1), by a hash of the row's key and place: the same in every run and partitioning."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*spec.key, *spec.order)]))
    return df.withColumn(out, F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52)))


def standard_absolute_deviation(df: DataFrame, spec: StreamSpec, value: str, subtracted: str = "mean", absolute: bool = True, out: str = "score") -> DataFrame:
    """(x - mean or median) / (deviation + 1e-10) over all rows so far."""
    if subtracted not in ("mean", "median"):
        raise ValueError("subtracted must be mean or median")
    both = track(df, spec, value, {"__mean": AVERAGE, "__var": VARIANCE})
    if subtracted == "median":
        from .order import prefix_median

        both = prefix_median(both, spec, value, "__mean")
    z = (F.col(value).cast("double") - F.col("__mean")) / (F.sqrt("__var") + 1e-10)
    return both.withColumn(out, F.abs(z) if absolute else z).drop("__mean", "__var")


def exact_storm(df: DataFrame, spec: StreamSpec, features: Column | str, rows: int = 10_000, radius: float = 0.1, out: str = "score") -> DataFrame:
    """The share of the rows - 1 vectors before the own that are nearer than radius; 0 for the first row.  The kernel holds rows - 1 vectors; chunks of a stream run apart."""
    from .online import ExactStorm
    from .runtime import run_batch

    named = df.withColumn("__f", doubles(features))
    return run_batch(named, spec, ExactStorm(rows, radius), features="__f", out=out).drop("__f")


def relative_entropy(df: DataFrame, spec: StreamSpec, value: str, low: float, high: float, n_bins: int = 5, rows: int = 52, out: str = "score") -> DataFrame:
    """0.0 while the window fills and where the window's histogram agrees with that of the first full window (2 rows KL below the 0.99 quantile of chi-squared), else
    -1.0.  Values are binned by ceiling; the topmost bin takes what is n_bins."""
    limit = chi2_quantile(0.99, n_bins - 1)
    b = F.ceil((number(value) - low) / ((high - low) / n_bins))
    inside = lambda k: (b >= k) & ((b <= k + 1) if k == n_bins - 1 else (b < k + 1))
    placed = numbered(df, spec, "__rn").select("*", *[F.when(inside(k), 1).otherwise(0).alias(f"__in{k}") for k in range(n_bins)])
    counts = sliding(placed, StreamSpec(spec.key, spec.order, spec.block), rows, lambda w: [F.sum(f"__in{k}").over(w).alias(f"__c{k}") for k in range(n_bins)])
    counts = counts.withColumn("__total", sum((F.col(f"__c{k}") for k in range(1, n_bins)), F.col("__c0")))
    share = lambda k: F.try_divide(F.col(f"__c{k}").cast("double"), F.col("__total"))
    counts = counts.select("*", *[share(k).alias(f"__p{k}") for k in range(n_bins)])
    first = counts.where(F.col("__rn") == rows).select(F.struct(F.lit(0), *spec.key).alias("__first"), *[F.col(f"__p{k}").alias(f"__q{k}") for k in range(n_bins)])
    both = counts.join(first, F.struct(F.lit(0), *spec.key) == F.col("__first"), "left")  # a row for each stream
    term = lambda p, q: F.when(p == 0, 0.0).when(q == 0, F.lit(math.inf)).otherwise(p * F.log(p / q))
    kl = sum((term(F.col(f"__p{k}"), F.col(f"__q{k}")) for k in range(1, n_bins)), term(F.col("__p0"), F.col("__q0")))
    score = F.when(F.col("__rn") < rows, 0.0).when(2 * rows * kl < limit, 0.0).otherwise(-1.0)
    return both.withColumn(out, score).select(*df.columns, out)


def seasonal_trend(df: DataFrame, spec: StreamSpec, value: str, season: int, trend: int | None = None, out: str = "residual") -> DataFrame:
    """x - trend - season: the trend is the mean of the last `trend` rows; where that many are there, x - trend counts in the mean of its phase, the own included."""
    trend = season if trend is None else trend
    if season < 2 or trend < 1:
        raise ValueError("season must be 2 or more, trend 1 or more")
    x = number(value)
    rows = numbered(running(df, spec, value, {"__trend": AVERAGE}, trend), spec, "__rn")
    rows = rows.withColumn("__phase", (F.col("__rn") - 1) % season).withColumn("__flat", F.when(F.col("__rn") >= trend, x - F.col("__trend")))
    by_phase = StreamSpec((*spec.key, "__phase"), spec.order, spec.block)
    rows = track(rows, by_phase, "__flat", {"__season": AVERAGE})
    return rows.withColumn(out, x - F.col("__trend") - F.coalesce("__season", F.lit(0.0))).select(*df.columns, out)


def seasonal_trend_vectors(df: DataFrame, spec: StreamSpec, features: str, season: int, trend: int | None = None, out: str = "residual") -> DataFrame:
    """seasonal_trend() of each entry of the vectors, which are streams of their own."""
    each = df.select("*", F.posexplode(doubles(features)).alias("__pos", "__v"))
    flat = seasonal_trend(each, StreamSpec((*spec.key, "__pos"), spec.order, spec.block), "__v", season, trend, "__r")
    residual = F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__r"))), lambda x: x["__r"]).alias("__residual")
    rows = flat.groupBy(*spec.key, *spec.order).agg(residual).select(F.struct(F.lit(0), *spec.key, *spec.order).alias("__to"), F.col("__residual").alias(out))
    return df.join(rows, F.struct(F.lit(0), *spec.key, *spec.order) == F.col("__to"), "left").drop("__to")


#: The largest prime below 2**31.
PRIME = 2_147_483_647

# --- half-space trees -----------------------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Forest:
    """Half-space trees over a box: nodes are numbered from 1 as in a heap, and a node's split attribute is a hash of its number, so that nothing has to be stored
    to know a path."""

    low: tuple[float, ...]
    high: tuple[float, ...]
    n_trees: int = 25
    depth: int = 15
    seed: int = 0

    def attributes(self, tree, node):
        """Split attribute of nodes of a tree, numbers or arrays: multiplicative hashing modulo a prime, which SQL can do as well."""
        a, b = self.factors(tree)
        return (node * a + b) % PRIME % len(self.low)

    def factors(self, tree):
        return (tree * 7919 + self.seed * 104_729 + 1) * 48_271 % PRIME, (tree * 15_485_863 + self.seed * 32_452_843 + 11) % PRIME

    def splits(self, tree: int) -> tuple[list[int], list[float]]:
        """Split attribute and value of every inner node, from node 1."""
        boxes = {1: (list(self.low), list(self.high))}
        attributes, values = [], []
        for node in range(1, 1 << self.depth):
            low, high = boxes.pop(node)
            q = self.attributes(tree, node)
            mid = (low[q] + high[q]) / 2
            attributes.append(q)
            values.append(mid)
            left, right = list(high), list(low)
            left[q] = right[q] = mid
            boxes[2 * node], boxes[2 * node + 1] = (low, left), (right, high)
        return attributes, values


def _deeper(attributes: Column, values: Column):
    """A path with one node more; its last node decides by its split."""

    def step(path: Column, _: Column) -> Column:
        node = F.element_at(path, -1)
        right = F.element_at(F.col("__x"), F.element_at(attributes, node)) > F.element_at(values, node)
        return F.concat(path, F.array(2 * node + F.when(right, 1).otherwise(0)))

    return step


def _named(tree: int):
    return lambda n, k: F.struct(F.lit(tree).alias("t"), n.alias("n"), k.alias("k"))


def half_space_trees(df: DataFrame, spec: StreamSpec, features: Column | str, forest: Forest, rows: int = 100, out: str = "score") -> DataFrame:
    """-sum over trees and path nodes of mass * 2**depth.  A node's mass is the number of rows of the last full window of `rows` rows that pass it, in the first
    window that of the rows so far.  Windows are counted apart from each other, so the plan is as parallel as there are windows.  The plan holds the trees; those
    deeper than 8 are walked by the kernel, over chunks of windows that have the window before them."""
    if forest.depth > 8:
        from .kernels import HalfSpaceTrees
        from .runtime import run_batch

        return run_batch(df, spec, HalfSpaceTrees(forest, rows), features=features, out=out)
    x, paths = doubles(features), []
    for tree in range(forest.n_trees):
        attributes, values = forest.splits(tree)
        a, v = F.array(*[F.lit(q + 1) for q in attributes]), F.array(*[F.lit(float(p)) for p in values])
        path = F.aggregate(F.sequence(F.lit(1), F.lit(forest.depth)), F.array(F.lit(1)), _deeper(a, v))
        paths.append(F.transform(path, _named(tree)))
    placed = numbered(df.withColumn("__x", x), spec, "__rn").withColumn("__r", F.floor(F.col("__rn") / rows))
    key = list(spec.key)
    each = placed.select(*key, "__rn", "__r", F.explode(F.concat(*paths)).alias("p")).select(*key, "__rn", "__r", "p.t", "p.n", "p.k")
    mass = each.withColumn("__r", F.floor((F.col("__rn") - 1) / rows) + 1).groupBy(*key, "__r", "t", "n").agg(F.count("*").alias("m"))
    weight = F.pow(F.lit(2.0), F.col("k"))
    later = each.where("__r > 0").join(mass, [*key, "__r", "t", "n"], "left").groupBy(*key, "__rn").agg(F.sum(F.coalesce("m", F.lit(0)) * weight).alias("__s"))
    w = Window.partitionBy(*key, "t", "n").orderBy("__rn").rowsBetween(Window.unboundedPreceding, 0)
    first = each.where("__r = 0").withColumn("m", F.count("*").over(w)).groupBy(*key, "__rn").agg(F.sum(F.col("m") * weight).alias("__s"))
    scored = later.unionByName(first)
    return placed.join(scored, [*key, "__rn"]).select(*df.columns, (-F.col("__s")).alias(out))


# --- RS-Hash --------------------------------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class HashParameters:
    """Of each component: the width of its cells, its features, and their shifts."""

    widths: tuple[float, ...]
    features: tuple[tuple[int, ...], ...]
    shifts: tuple[tuple[float, ...], ...]
    decay: float = 0.015

    @staticmethod
    def drawn(low: list[float], high: list[float], n: int = 100, decay: float = 0.015, seed: int = 0) -> "HashParameters":
        """After Sathe and Aggarwal (2016), for an effective sample of s rows: a component's width is uniform between 1/sqrt(s) and 1 - 1/sqrt(s); its number of features is
        a uniform integer between 1 + t/2 and t, with t = log(s) to the base max(2, 1/width); its features are any of those whose range is not empty; shifts are uniform
        below the width.  Features without a range tell no rows apart and are in no component."""
        rng = np.random.default_rng(seed)
        s = max(1000.0, 1 / -math.expm1(-decay * math.log(2)))
        widths = rng.uniform(s**-0.5, 1 - s**-0.5, n)
        usable = np.flatnonzero(np.asarray(high, float) > np.asarray(low, float))
        t = math.log(s) / np.log(np.clip(1 / widths, 2, None))
        sizes = np.minimum(rng.integers(np.ceil(1 + t / 2).astype(int), np.maximum(np.floor(t), np.ceil(1 + t / 2)).astype(int) + 1), len(usable))
        order = rng.random((n, len(usable))).argsort(axis=1)
        shifts = rng.random((n, len(usable))) * widths[:, None]
        return HashParameters(tuple(widths.tolist()), tuple(tuple(sorted(usable[o[:k]].tolist())) for o, k in zip(order, sizes)), tuple(tuple(x[:k].tolist()) for x, k in zip(shifts, sizes)), decay)

    def cells(self, x: Column) -> Column:
        """The names of a row's cells.  The parameters are one literal, which keeps the plan's code short."""
        own = [{"r": str(r), "w": w, "f": [i + 1 for i in f], "a": list(a)} for r, (w, f, a) in enumerate(zip(self.widths, self.features, self.shifts))]
        every = F.from_json(F.lit(json.dumps(own)), "array<struct<r:string,w:double,f:array<int>,a:array<double>>>")
        place = lambda p: F.zip_with(p["f"], p["a"], lambda i, a: F.floor((F.element_at(x, i) + a) / p["w"]).cast("string"))
        return F.transform(every, lambda p: F.concat_ws(",", p["r"], place(p)))


def rs_hash(df: DataFrame, spec: StreamSpec, features: Column | str, parameters: HashParameters, block: int = 20_000, out: str = "score") -> DataFrame:
    """Mean over components of ln(1 + c), c the decayed number of earlier rows in the same cell: sum of 2**(-decay * age).  Weights count from the start of a block of
    rows, which keeps them finite; rows older than 60 halvings before a block add less than rounding and stay out of it.
    Cells are told apart exactly, so that several hash functions for them would count the same."""
    n, halo = len(parameters.widths), math.ceil(60 / parameters.decay)
    rows = repeated(df.withColumn("__x", doubles(features)), spec, max(block, halo), halo)
    age = F.col("__place") - F.col("__to") * max(block, halo)
    each = rows.select(*spec.key, "__place", "__chunk", "__to", age.alias("__age"), F.explode(parameters.cells(F.col("__x"))).alias("__cell"))
    w = Window.partitionBy(*spec.key, "__to", "__cell").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    c = F.coalesce(F.sum(F.pow(F.lit(2.0), parameters.decay * F.col("__age"))).over(w), F.lit(0.0)) * F.pow(F.lit(2.0), -parameters.decay * F.col("__age"))
    scored = each.withColumn("__c", c).where("__to = __chunk").groupBy(*spec.key, "__place").agg((F.sum(F.log1p("__c")) / n).alias(out))
    return rows.where("__to = __chunk").join(scored, [*spec.key, "__place"]).select(*df.columns, out)
