"""Batch detectors on streams: one fit on given rows, or refits on a moving reference window.

When a reference window is refitted depends on row numbers only, so the versions of a stream's model are known when the plan is built: a row number says which version
scores it and which rows that version learns from.  Versions train apart from each other; a version gets its own rows and those that it scores, and no more.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import ship
from ..plans.stream import StreamSpec, numbered
from .kernels import Fixed, IsolationForest, LocalOutlierProbability, Monitor, fitted
from .runtime import run_batch, vectors


def first_slide(rows: int, slide: int) -> int:
    """The row at which a window is full for the first time and a slide ends."""
    return -(-max(rows, slide) // slide) * slide


def schedule(rows: int, slide: int, n: int) -> list[tuple[int, int, int]]:
    """(row at which the model is fitted, first and last row that it learns from), without an initial window: at every row while fewer than `rows` are there, then
    every `slide` rows from the first slide of a full window on.  Row numbers start from 1."""
    warm = [(t, 1, t) for t in range(1, min(rows, n + 1))]
    start = first_slide(rows, slide)
    return warm + [(t, max(1, t - rows + 1), t) for t in range(start, n + 1, slide)]


def versions(df: DataFrame, spec: StreamSpec, rows: int, slide: int) -> DataFrame:
    """Numbered rows, once for the version that scores them and once for each version that learns from them.  From row `start` on, where windows are
    full, version t is fitted every `slide` rows on rows t - rows + 1 to t and scores rows t to t + slide - 1; the rows before are one version, fitted again and again."""
    start = first_slide(rows, slide)
    rn = F.col("__rn")
    own = F.when(rn < start, F.lit(0)).otherwise(rn - (rn - start) % slide)
    placed = numbered(df, spec, "__rn").withColumn("__version", own)
    # Versions that learn from a row: the multiples of slide from the row's own on, while it is among the last `rows`.
    first = F.greatest(F.lit(start), F.ceil(rn / slide) * slide)
    last = rn + rows - 1
    learns = F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"), F.lit(slide).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    every = F.array_distinct(F.concat(F.array(own.cast("long")), learns))
    return placed.select("*", F.explode(every).alias("__to"))


def monitor(df: DataFrame, spec: StreamSpec, features: str, detector, rows: int, slide: int, initial: np.ndarray | None = None, seed: int = 0, out: str = "score", label: str | None = None, initial_labels: np.ndarray | None = None) -> DataFrame:
    """Scores of a detector with a moving reference window; label: a column for detectors that learn from labels.  With an initial window the versions depend on it, and the
    stream runs through one kernel."""
    if initial is not None:
        kernel = Monitor(detector, rows, slide, initial, label is not None, initial_labels)
        kernel.seed = seed
        return run_batch(df, spec, kernel, features=features, label=label, out=out)
    ship(df.sparkSession)
    keys = list(spec.key)
    each = versions(df, spec, rows, slide).withColumn("__x", F.col(features).cast("array<double>")).withColumn("__y", F.col(label).cast("double") if label else F.lit(None).cast("double"))
    by = [*keys, "__to"]
    ordered = each.repartition(*by).sortWithinPartitions(*by, "__rn")
    names = ordered.columns
    at = {c: i for i, c in enumerate(names)}

    def generator(key: tuple) -> np.random.Generator:
        return np.random.default_rng([seed, zlib.crc32(repr(key).encode())])

    def finished(key: tuple, n: np.ndarray, v: np.ndarray, x: np.ndarray, y: np.ndarray | None):
        """n: row numbers, v: the versions that score them; scores of the rows that this version scores, in order."""
        version = key[-1]
        if version == 0:
            kernel = Monitor(detector, rows, slide, labels=y is not None).fresh()
            kernel.rng = generator(key)
            return [kernel.next(own, None if y is None else y[i]) for i, own in enumerate(x)]
        return fitted(detector, x[n <= version], generator(key), None if y is None else y[n <= version]).scores(x[v == version])

    def run(batches):
        key, group = None, []

        def flush():
            whole = pa.Table.from_batches(group)
            n, v = (whole.column(c).to_numpy() for c in ("__rn", "__version"))
            x = np.concatenate([vectors(b.column(at["__x"])) for b in group])
            y = whole.column("__y").to_numpy() if label else None
            mine = whole.select(df_columns).filter(pa.array(v == key[-1])).combine_chunks()
            for part in mine.append_column(out, pa.array(finished(key, n, v, x, y), pa.float64())).to_batches():
                yield part

        for batch in batches:
            keys_of = list(zip(*(batch.column(at[c]).to_pylist() for c in by)))
            start = 0
            for i, k in enumerate(keys_of):
                if k != key:
                    if i > start:
                        group.append(batch.slice(start, i - start))
                    if group:
                        yield from flush()
                    key, group, start = k, [], i
            if len(keys_of) > start:
                group.append(batch.slice(start))
        if group:
            yield from flush()

    df_columns = df.columns
    return ordered.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def iforest_asd(df: DataFrame, spec: StreamSpec, features: str, rows: int = 2048, detector: IsolationForest | None = None, seed: int = 0, out: str = "score", initial: np.ndarray | None = None) -> DataFrame:
    """Isolation forests on windows that slide by their own length; initial: rows of a first window."""
    return monitor(df, spec, features, detector or IsolationForest(), rows, rows, initial, seed, out)


def one_fit(df: DataFrame, features: str, detector, initial: np.ndarray, seed: int = 0, out: str = "score", labels: np.ndarray | None = None) -> DataFrame:
    """One fit on the driver, on rows (and labels) that were handed over; the model is broadcast and rows are scored where they are."""
    ship(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(fitted(detector, np.asarray(initial, float), np.random.default_rng(seed), labels))
    columns = df.columns

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array(vectors(batch.column(len(columns))))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.value.scores(x), pa.float64())], [*columns, out])

    return df.withColumn("__x", F.col(features).cast("array<double>")).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def local_outlier_probability(df: DataFrame, features: str, initial: np.ndarray, n_neighbours: int = 10, extent: float = 3, out: str = "score") -> DataFrame:
    return one_fit(df, features, LocalOutlierProbability(n_neighbours, extent), initial, out=out)


__all__ = ["Fixed", "iforest_asd", "local_outlier_probability", "monitor", "one_fit", "schedule", "versions"]
