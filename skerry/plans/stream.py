"""An ordered stream as a DataFrame, and the two ways to look back along it.

`scan` gives prefix aggregates and `sliding` gives windows over the last rows.  Both split a key's rows, so that a key with most of the rows is not one task:
scan adds the totals of earlier blocks (a coarse, order-preserving expression such as a day) to prefixes within a block; sliding cuts numbered rows
into chunks and repeats the last rows of a chunk in the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key that one task of a sliding window gets at least.
CHUNK = 50_000


@dataclass(frozen=True)
class StreamSpec:
    """key: columns whose values are independent streams (none: one stream); order: columns that order a stream totally; block: a SQL expression that never falls
    along the order, whose values cut a stream into parts of a bounded number of rows (None: a stream is one part)."""

    key: tuple[str, ...] = ()
    order: tuple[str, ...] = ("seq",)
    block: str | None = None

    def window(self, *more: str):
        return Window.partitionBy(*self.key, *more).orderBy(*self.order)

    def prefix(self, *more: str):
        return self.window(*more).rowsBetween(Window.unboundedPreceding, 0)

    def last(self, rows: int, *more: str):
        return self.window(*more).rowsBetween(-(rows - 1), 0)


def number(x: Column | str) -> Column:
    """A value as double; NaN counts as missing, in every aggregate alike."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    return F.when(~F.isnan(x), x)


def over(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(a, b)


#: A stream over an input of at most this many bytes, by Catalyst's estimate, is windowed whole; beyond it, in parts.
SMALL = 64 << 20


def small(df: DataFrame) -> bool:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one where df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


Over = Callable[[Column], Column]


@dataclass(frozen=True)
class Part:
    """A decomposable aggregate: of rows (over() puts each aggregate over a window or leaves it), of parts, and of two values."""

    of_rows: Callable[[Column, Over], Column]
    of_parts: Callable[[Column, Column | None, Over], Column]
    joined: Callable[[Column, Column], Column]
    #: What of a part is subtracted, from the first one on, before parts are added up.
    centre: str | None = None


def _simple(of_rows: Callable[[Column], Column], of_parts: Callable[[Column], Column], joined: Callable[[Column, Column], Column]) -> Part:
    return Part(lambda x, over: over(of_rows(x)), lambda c, _, over: over(of_parts(c)), joined)


def _added(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


def _moments(n: Column, mean: Column, m2: Column) -> Column:
    return F.struct(n.alias("n"), mean.alias("mean"), F.greatest(m2, F.lit(0.0)).alias("m2"))


def _moments_of_parts(c: Column, centre: Column, over: Over) -> Column:
    """Sums of parts about the mean of the first part, which keeps large means from cancelling small deviations."""
    d = c["mean"] - centre
    n, first, second = over(F.sum(c["n"])), over(F.sum(c["n"] * d)), over(F.sum(F.coalesce(c["m2"] + c["n"] * d * d, F.lit(0.0))))
    return _moments(n, centre + F.try_divide(first, n), second - F.try_divide(first * first, n))


def _moments_joined(a: Column, b: Column) -> Column:
    n, d = a["n"] + b["n"], b["mean"] - a["mean"]
    both = _moments(n, a["mean"] + d * F.try_divide(b["n"], n), a["m2"] + b["m2"] + d * d * F.try_divide(a["n"] * b["n"], n))
    return F.when(F.coalesce(b["n"], F.lit(0.0)) == 0, a).when(a["n"] == 0, b).otherwise(both)


PARTS = {
    "rows": _simple(lambda x: F.count(F.lit(1)), F.sum, _added),
    "n": _simple(F.count, F.sum, _added),
    "sum": _simple(F.sum, F.sum, _added),
    "squares": _simple(lambda x: F.sum(x * x), F.sum, _added),
    "min": _simple(F.min, F.min, F.least),
    "max": _simple(F.max, F.max, F.greatest),
    "moments": Part(lambda x, over: _moments(over(F.count(x)).cast("double"), over(F.avg(x)), over(F.var_pop(x)) * over(F.count(x))), _moments_of_parts, _moments_joined, "mean"),
}


def scan(df: DataFrame, spec: StreamSpec, values: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with prefix aggregates (the current row included): values has, by output name, a part's name and its input."""

    def within(w) -> list[Column]:
        return [PARTS[p].of_rows(x, lambda a: a.over(w)).alias(out) for out, (p, x) in values.items()]

    if spec.block is None or small(df):
        return df.select("*", *within(spec.prefix()))
    # Keys are structs, which are equal where their nulls are: rows stay as the window dealt them when they meet their offsets.
    key = F.struct(*spec.key) if spec.key else F.lit(0)
    at, to = unused(df, "__at"), unused(df, "__to")
    rows = df.withColumn(at, F.struct(key.alias("key"), F.expr(spec.block).alias("block")))
    totals = rows.groupBy(at).agg(*[PARTS[p].of_rows(x, lambda a: a).alias(f"__{out}") for out, (p, x) in values.items()])
    blocks = Window.partitionBy(f"{at}.key").orderBy(f"{at}.block")  # a row for each block
    upto, earlier = blocks.rowsBetween(Window.unboundedPreceding, 0), blocks.rowsBetween(Window.unboundedPreceding, -1)
    centred = [out for out, (p, _) in values.items() if PARTS[p].centre]
    totals = totals.select("*", *[F.first(F.col(f"__{out}")[PARTS[values[out][0]].centre], ignorenulls=True).over(upto).alias(f"__centre_{out}") for out in centred])
    offsets = [PARTS[p].of_parts(F.col(f"__{out}"), F.col(f"__centre_{out}") if out in centred else None, lambda a: a.over(earlier)).alias(f"__{out}") for out, (p, _) in values.items()]
    local = rows.select("*", *within(Window.partitionBy(at).orderBy(*spec.order).rowsBetween(Window.unboundedPreceding, 0)))
    both = local.join(totals.select(F.col(at).alias(to), *offsets), F.col(at) == F.col(to))
    return both.select(*df.columns, *[PARTS[p].joined(F.col(out), F.col(f"__{out}")).alias(out) for out, (p, _) in values.items()])


def numbered(df: DataFrame, spec: StreamSpec, out: str = "rn") -> DataFrame:
    """df with each row's place in its stream, from 1."""
    return scan(df, spec, {out: ("rows", F.lit(1))})


def sliding(df: DataFrame, spec: StreamSpec, rows: int, columns: Callable[[object], Sequence[Column]], chunk: int | None = None) -> DataFrame:
    """df with columns(window) of the last `rows` rows; window is to be used by over()."""
    if spec.block is None or (chunk is None and small(df)):
        return df.select("*", *columns(spec.last(rows)))
    spread = repeated(df, spec, max(chunk or CHUNK, rows), rows - 1)
    w = Window.partitionBy(*spec.key, "__to").orderBy("__place").rowsBetween(-(rows - 1), 0)
    return spread.select("*", *columns(w)).where("__to = __chunk").drop("__place", "__chunk", "__to")


def repeated(df: DataFrame, spec: StreamSpec, rows: int, halo: int) -> DataFrame:
    """Rows with their __place from 1, in chunks of `rows`; the last `halo` rows of a chunk come again in the next one: __chunk is a row's own, __to the one it is in."""
    if halo > rows:
        raise ValueError("a chunk has to hold the rows that are repeated")
    placed = numbered(df, spec, "__place").withColumn("__chunk", F.floor((F.col("__place") - 1) / rows))
    again = (F.col("__place") - 1) % rows >= rows - halo
    return placed.withColumn("__to", F.explode(F.when(again, F.array("__chunk", F.col("__chunk") + 1)).otherwise(F.array("__chunk"))))
