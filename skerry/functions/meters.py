"""Univariate statistics along a stream: prefix values by scans, values of the last rows by sliding windows, final values by groupBy.

NaN counts as missing.  Of no values, sums and counts are 0 and the others NULL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stream import StreamSpec, number, over, scan, sliding


@dataclass(frozen=True)
class Meter:
    """parts: the decomposable aggregates that it needs; final: its value from them; direct: its value as one aggregate."""

    name: str
    parts: tuple[str, ...]
    final: Callable[[dict[str, Column]], Column]
    direct: Callable[[Column], Column]


COUNT = Meter("count", ("rows",), lambda p: p["rows"], lambda x: F.count(F.lit(1)))
SUM = Meter("sum", ("sum",), lambda p: F.coalesce(p["sum"], F.lit(0.0)), lambda x: F.coalesce(F.sum(x), F.lit(0.0)))
SUM_SQUARES = Meter("sum_squares", ("squares",), lambda p: F.coalesce(p["squares"], F.lit(0.0)), lambda x: F.coalesce(F.sum(x * x), F.lit(0.0)))
AVERAGE = Meter("average", ("sum", "n"), lambda p: over(p["sum"], p["n"]), F.avg)
#: Population variance, from means and squared deviations.
VARIANCE = Meter("variance", ("moments",), lambda p: over(p["moments"]["m2"], p["moments"]["n"]), F.var_pop)
MIN = Meter("min", ("min",), lambda p: p["min"], F.min)
MAX = Meter("max", ("max",), lambda p: p["max"], F.max)
#: Has no parts: its prefix values are computed by operators.kernels.PrefixMedian.
MEDIAN = Meter("median", (), lambda p: F.lit(None), lambda x: F.percentile(x, F.lit(0.5)))
METERS = {m.name: m for m in (COUNT, SUM, SUM_SQUARES, AVERAGE, VARIANCE, MIN, MAX, MEDIAN)}


def absolute(meter: Meter) -> Meter:
    """The absolute value of another meter."""
    return Meter(f"abs_{meter.name}", meter.parts, lambda p: F.abs(meter.final(p)), lambda x: _abs_over(meter.direct(x)))


class _abs_over:  # noqa: N801
    """|aggregate|, also over a window: over() belongs to the aggregate."""

    def __init__(self, inner: Column):
        self.inner = inner

    def over(self, w) -> Column:
        return F.abs(self.inner.over(w))

    def alias(self, name: str) -> Column:
        return F.abs(self.inner).alias(name)


def _direct_over(meter: Meter, x: Column, w) -> Column:
    if meter.name in ("sum", "sum_squares"):
        return F.coalesce(F.sum(x if meter.name == "sum" else x * x).over(w), F.lit(0.0))
    return meter.direct(x).over(w)


def track(df: DataFrame, spec: StreamSpec, value: str | Column, meters: dict[str, Meter]) -> DataFrame:
    """df with each meter's value over all rows so far, by output name."""
    if any(not m.parts for m in meters.values()):
        raise ValueError("a prefix median is sequential: use the PrefixMedian kernel")
    x, needed = number(value), sorted({p for m in meters.values() for p in m.parts})
    rows = scan(df, spec, {f"__p_{p}": (p, x) for p in needed})
    parts = {p: F.col(f"__p_{p}") for p in needed}
    return rows.select(*df.columns, *[m.final(parts).alias(out) for out, m in meters.items()])


def running(df: DataFrame, spec: StreamSpec, value: str | Column, meters: dict[str, Meter], rows: int) -> DataFrame:
    """df with each meter's value over the last `rows` rows, by output name."""
    x = number(value)
    return sliding(df, spec, rows, lambda w: [_direct_over(m, x, w).alias(out) for out, m in meters.items()])


def final(df: DataFrame, spec: StreamSpec, value: str | Column, meters: dict[str, Meter]) -> DataFrame:
    """One row for each stream: each meter over all its rows."""
    x = number(value)
    return df.groupBy(*spec.key).agg(*[m.direct(x).alias(out) for out, m in meters.items()])


def retracted(df: DataFrame, spec: StreamSpec, value: str, op: str, out: str = "n") -> DataFrame:
    """Multisets with removals: op is 1 where a value comes and -1 where it goes; sums, counts and averages follow from signed sums, the others from the values that are
    left.  Variances are about the mean of the values that are left."""
    left = df.groupBy(*spec.key, number(value).alias("__x")).agg(F.sum(op).alias("__m")).where("__m > 0")
    x, m = F.col("__x"), F.col("__m")
    means = left.groupBy(*spec.key).agg(over(F.sum(x * m), F.sum(m)).alias("__mean")).select(F.struct(F.lit(0), *spec.key).alias("__to"), "__mean")  # a row for each stream
    away = left.join(means, F.struct(F.lit(0), *spec.key) == F.col("__to")).withColumn("__away", x - F.col("__mean"))
    return away.groupBy(*spec.key).agg(
        F.sum(m).alias(out), F.sum(x * m).alias("sum"), F.sum(x * x * m).alias("sum_squares"), over(F.sum(x * m), F.sum(m)).alias("average"), over(F.sum(F.col("__away") * F.col("__away") * m), F.sum(m)).alias("variance"), F.min(x).alias("min"), F.max(x).alias("max"), F.percentile(x, F.lit(0.5), m).alias("median")
    )
