"""Operators on scores: post-processors, probability calibrators and score ensemblers."""

from __future__ import annotations

import random
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stream import StreamSpec, number, numbered, over
from .meters import AVERAGE, MAX, MEDIAN, VARIANCE, running, track

# --- post-processors ------------------------------------------------------------------------------------------------------------------------------------


def average(df: DataFrame, spec: StreamSpec, score: str, out: str = "post") -> DataFrame:
    return track(df, spec, score, {out: AVERAGE})


def maximum(df: DataFrame, spec: StreamSpec, score: str, out: str = "post") -> DataFrame:
    return track(df, spec, score, {out: MAX})


def _z(df: DataFrame, score: str, out: str) -> DataFrame:
    z = over(F.col(score).cast("double") - F.col("__mean"), F.sqrt("__var"))
    return df.withColumn(out, z).drop("__mean", "__var")


def zscore(df: DataFrame, spec: StreamSpec, score: str, out: str = "post") -> DataFrame:
    """(s - mean) / deviation over all rows so far; NULL while the deviation is zero."""
    return _z(track(df, spec, score, {"__mean": AVERAGE, "__var": VARIANCE}), score, out)


def running_average(df: DataFrame, spec: StreamSpec, score: str, rows: int, out: str = "post") -> DataFrame:
    return running(df, spec, score, {out: AVERAGE}, rows)


def running_maximum(df: DataFrame, spec: StreamSpec, score: str, rows: int, out: str = "post") -> DataFrame:
    return running(df, spec, score, {out: MAX}, rows)


def running_median(df: DataFrame, spec: StreamSpec, score: str, rows: int, out: str = "post") -> DataFrame:
    return running(df, spec, score, {out: MEDIAN}, rows)


def running_zscore(df: DataFrame, spec: StreamSpec, score: str, rows: int, out: str = "post") -> DataFrame:
    return _z(running(df, spec, score, {"__mean": AVERAGE, "__var": VARIANCE}, rows), score, out)


def frozen_zscore(fitted: DataFrame, df: DataFrame, spec: StreamSpec, score: str, out: str = "post") -> DataFrame:
    """Fit on one set of rows, transform another: z-scores with the fitted mean and deviation of each stream."""
    x = number(score)
    stats = fitted.groupBy(*spec.key).agg(F.avg(x).alias("__mean"), F.var_pop(x).alias("__var"))
    return _z(_with_fitted(df, stats, spec), score, out)


def _with_fitted(df: DataFrame, stats: DataFrame, spec: StreamSpec) -> DataFrame:
    """Rows with what was fitted on their stream, a row for each; NULLs where nothing was."""
    return df.join(stats, list(spec.key), "left") if spec.key else df.join(F.broadcast(stats), F.lit(True), "left")  # one row without keys


def last_rows(fitted: DataFrame, spec: StreamSpec, rows: int) -> DataFrame:
    """The last `rows` rows of each stream: those that have fewer than that many behind them."""
    total = fitted.groupBy(*spec.key).agg(F.count(F.lit(1)).alias("__n"))
    return _with_fitted(numbered(fitted, spec, "__rn"), total, spec).where(F.col("__rn") > F.col("__n") - rows).drop("__rn", "__n")


def frozen(fitted: DataFrame, df: DataFrame, spec: StreamSpec, score: str, method: str, rows: int | None = None, out: str = "post") -> DataFrame:
    """Fit on one set of rows, transform another, whose rows change nothing.  method: average, max or median (the fitted value itself), zscore, gauss or gauss_tail (against the
    fitted mean and deviation), conformal (the share of fitted scores that are greater).  rows: fitted are the last `rows` scores of each stream (None: all)."""
    x, own = number(score), fitted if rows is None else last_rows(fitted, spec, rows)
    values = {"average": F.avg(x), "max": F.max(x), "median": F.percentile(x, F.lit(0.5))}
    if method in values:
        return _with_fitted(df, own.groupBy(*spec.key).agg(values[method].alias(out)), spec)
    if method == "conformal":
        return _frozen_conformal(own, df, spec, score, out)
    both = _with_fitted(df, own.groupBy(*spec.key).agg(F.avg(x).alias("__mean"), F.var_pop(x).alias("__var")), spec)
    if method == "zscore":
        return _z(both, score, out)
    z = (F.col(score).cast("double") - F.col("__mean")) / F.when(F.col("__var") > 0, F.sqrt("__var")).otherwise(F.lit(1.0))
    return both.withColumn(out, {"gauss": z, "gauss_tail": normal_cdf(z)}[method]).drop("__mean", "__var")


def _frozen_conformal(fitted: DataFrame, df: DataFrame, spec: StreamSpec, score: str, out: str) -> DataFrame:
    """Fitted and new scores in one order per stream: a new one's rank is the number of fitted ones above it.  Distinct scores are counted first."""
    keys = list(spec.key)
    counts = fitted.where(number(score).isNotNull()).groupBy(*keys, number(score).alias("__s")).agg(F.count(F.lit(1)).alias("__m"))
    both = df.withColumn("__s", number(score)).withColumn("__m", F.lit(0).cast("long")).withColumn("__new", F.lit(True)).unionByName(counts.withColumn("__new", F.lit(False)), allowMissingColumns=True)
    above = Window.partitionBy(*keys).orderBy(F.desc("__s")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ties = Window.partitionBy(*keys, "__s")
    ranked = both.withColumn("__above", F.sum("__m").over(above) - F.sum("__m").over(ties)).withColumn("__all", F.sum("__m").over(Window.partitionBy(*keys)))
    p = F.when(F.col("__s").isNotNull(), over(F.col("__above").cast("double"), F.col("__all").cast("double")))
    return ranked.where("__new").withColumn(out, p).select(*df.columns, out)

# --- calibrators ----------------------------------------------------------------------------------------------------------------------------------------


def conformal(df: DataFrame, spec: StreamSpec, score: str, rows: int | None = 300, out: str = "p") -> DataFrame:
    """The share of the last `rows` scores (the own included) that are greater: a p-value, small for anomalies.  rows None: of all scores so far."""
    from ..operators.online import Conformal
    from ..operators.order import prefix_rank
    from ..operators.runtime import run_batch

    if rows is None:
        return prefix_rank(df, spec, score, out)
    return run_batch(df, spec, Conformal(rows), value=score, out=out)


def gaussian_z(df: DataFrame, spec: StreamSpec, score: str, rows: int | None = 6400, out: str = "z") -> DataFrame:
    """(s - mean) / deviation over the last `rows` scores (None: all so far); the deviation is 1 where the variance is not positive."""
    meters = {"__mean": AVERAGE, "__var": VARIANCE}
    both = track(df, spec, score, meters) if rows is None else running(df, spec, score, meters, rows)
    deviation = F.when(F.col("__var") > 0, F.sqrt("__var")).otherwise(F.lit(1.0))
    return both.withColumn(out, (F.col(score).cast("double") - F.col("__mean")) / deviation).drop("__mean", "__var")


#: The rational approximation of the normal distribution function by Hart (1968), numerator and denominator from the highest power, as given by West (2005).
ABOVE = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
NEAR, FAR, ROOT = 7.07106781186547, 37.0, 2.506628274631


def normal_cdf(z: Column | str) -> Column:
    """Of a standard normal variable, to about 15 digits; Spark has no error function."""
    z = F.col(z) if isinstance(z, str) else z
    x = F.abs(z)
    horner = lambda c: reduce(lambda acc, k: acc * x + k, c[1:], F.lit(c[0]))
    fraction = reduce(lambda acc, k: x + F.lit(float(k)) / acc, (4, 3, 2, 1), x + 0.65)
    tail = F.exp(-x * x / 2) * F.when(x < NEAR, horner(ABOVE) / horner(BELOW)).otherwise(1 / (fraction * ROOT))
    tail = F.when(x > FAR, 0.0).otherwise(tail)
    return F.when(z.isNull() | F.isnan(z), None).when(z > 0, 1 - tail).otherwise(tail)


def normal_cdf_sql(z: str) -> str:
    """normal_cdf() in SQL."""
    horner = lambda c: reduce(lambda acc, k: f"({acc} * abs({z}) + {k!r}::DOUBLE)", c[1:], f"{c[0]!r}::DOUBLE")
    fraction = reduce(lambda acc, k: f"(abs({z}) + {float(k)} / {acc})", (4, 3, 2, 1), f"(abs({z}) + 0.65)")
    tail = f"CASE WHEN abs({z}) > {FAR} THEN 0 ELSE exp(-{z} * {z} / 2) * CASE WHEN abs({z}) < {NEAR!r} THEN {horner(ABOVE)} / {horner(BELOW)} ELSE 1 / ({fraction} * {ROOT!r}) END END"
    return f"CASE WHEN {z} > 0 THEN 1 - ({tail}) ELSE {tail} END"


def gaussian_tail(df: DataFrame, spec: StreamSpec, score: str, rows: int | None = 6400, out: str = "p") -> DataFrame:
    """One minus the tail probability of gaussian_z: near 1 for anomalies."""
    return gaussian_z(df, spec, score, rows, "__z").withColumn(out, normal_cdf("__z")).drop("__z")


def alerts(df: DataFrame, score: str, threshold: float) -> DataFrame:
    return df.where(F.col(score) > threshold)


# --- ensemblers -----------------------------------------------------------------------------------------------------------------------------------------


def _mean(items: Sequence[Column]) -> Column:
    return sum(items[1:], items[0]) / len(items)


def mean_of(scores: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    """The (weighted) mean of a row's scores."""
    weights = weights or [1.0] * len(scores)
    if len(weights) != len(scores) or not sum(weights):
        raise ValueError("a weight for each score, with a sum that is not zero")
    parts = [s * F.lit(float(w)) for s, w in zip(scores, weights)]
    return sum(parts[1:], parts[0]) / F.lit(float(sum(weights)))


def max_of(scores: Sequence[Column]) -> Column:
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def median_of(scores: Sequence[Column]) -> Column:
    own, n = F.array_sort(F.array(*scores)), len(scores)
    return (F.element_at(own, (n + 1) // 2) + F.element_at(own, n // 2 + 1)) / 2


def buckets(n: int, n_buckets: int = 5, method: str = "static", bootstrap: bool = False, seed: int = 0) -> list[list[int]]:
    """Detectors dealt into buckets, drawn once when the plan is built.  static: shuffled, of equal size, which must come out even; dynamic: of random sizes;
    bootstrap: with replacement."""
    rng = random.Random(seed)
    if method == "static":
        if n % n_buckets:
            raise ValueError(f"{n} detectors do not fill {n_buckets} equal buckets")
        sizes = [n // n_buckets] * n_buckets
    elif method == "dynamic":
        if n_buckets > n:
            raise ValueError("more buckets than detectors")
        ends = [0, *sorted(rng.sample(range(1, n), n_buckets - 1)), n]
        sizes = [b - a for a, b in zip(ends, ends[1:])]
    else:
        raise ValueError(f"method {method!r} is neither static nor dynamic")
    if bootstrap:
        return [[rng.randrange(n) for _ in range(s)] for s in sizes]
    dealt = rng.sample(range(n), n)
    return [[dealt.pop() for _ in range(s)] for s in sizes]


def average_of_maximum(scores: Sequence[Column], dealt: Sequence[Sequence[int]]) -> Column:
    return _mean([max_of([scores[i] for i in b]) for b in dealt])


def maximum_of_average(scores: Sequence[Column], dealt: Sequence[Sequence[int]]) -> Column:
    return max_of([_mean([scores[i] for i in b]) for b in dealt])


def zipped(frames: Sequence[DataFrame], spec: StreamSpec, score: str = "score") -> DataFrame:
    """Score streams of several detectors over the same rows, as columns s0, s1, ...: an equi-join on key and order."""
    on = [*spec.key, *spec.order]
    out = None
    for i, f in enumerate(frames):
        own = f.select(*on, F.col(score).alias(f"s{i}"))
        out = own if out is None else out.join(own, on)
    return out
