"""Kernels over whole tables.  Rows of a key come sorted to one task, which streams them through one kernel; a batch of rows is all that is held beside its state.  Where a
kernel's scores depend on a bounded number of rows before (its `memory`), a stream is cut into chunks that begin with those rows, and each chunk is a task of its own."""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import ship
from ..plans import stream
from ..plans.stream import StreamSpec
from .kernels import Kernel


def key_hash(key: tuple) -> int:
    return zlib.crc32(repr(key).encode())


def vectors(column) -> list[np.ndarray] | np.ndarray:
    """Rows of a column of doubles or of arrays; missing numbers are NaN."""
    if not (pa.types.is_list(column.type) or pa.types.is_large_list(column.type)):
        return column.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, 1)
    sizes = column.value_lengths()
    if len(column) and not column.null_count and not (flat := column.flatten()).null_count and len(set(sizes.to_pylist())) == 1:
        return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    return [np.array([np.nan if v is None else v for v in x or []], float) for x in column.to_pylist()]


def _keys(batch: pa.RecordBatch, at: list[int]) -> list[tuple]:
    return list(zip(*(batch.column(i).to_pylist() for i in at))) if at else [()] * batch.num_rows


def _chunk(kernel: Kernel, rows: int) -> tuple[int, int]:
    """(rows of a chunk, rows before it that come again): whole windows."""
    halo = -(-kernel.memory // kernel.window) * kernel.window
    return max(-(-rows // kernel.window) * kernel.window, halo), halo


def run_batch(df: DataFrame, spec: StreamSpec, kernel: Kernel, value: str | None = None, features: str | None = None, label: str | None = None, out: str = "score", chunk: int | None = None) -> DataFrame:
    """df with the kernel's score of each row in the order of its stream.  A column named out is replaced."""
    ship(df.sparkSession)
    source = value or features
    kept = [c for c in df.columns if c != out]
    number = F.col(source).cast("double" if value else "array<double>")
    cut = kernel.memory is not None and spec.block is not None and (chunk is not None or not stream.small(df))
    if cut:
        rows_of_chunk, halo = _chunk(kernel, chunk or stream.CHUNK)
        df_placed = stream.repeated(df, spec, rows_of_chunk, halo)
        by, order, own = [*spec.key, "__to"], ["__place"], F.col("__to") == F.col("__chunk")
    else:
        # One stream needs one task: its scores depend on all rows before.
        df_placed, by, order, own = df, list(spec.key), list(spec.order), F.lit(True)
    extra = [F.col("__to"), F.col("__place")] if cut else []
    rows = df_placed.select(*kept, number.alias("__x"), (F.col(label).cast("double") if label else F.lit(None).cast("double")).alias("__y"), own.alias("__own"), *extra)
    rows = (rows.repartition(*by) if by else rows.repartition(1)).sortWithinPartitions(*by, *order)
    at = [kept.index(k) for k in spec.key]
    n = len(kept)

    def run(batches):
        now, held = None, None
        for batch in batches:
            parts = [*at, n + 3] if cut else at
            scores = []
            for key, x, y in zip(_keys(batch, parts), vectors(batch.column(n)), batch.column(n + 1).to_pylist()):
                if held is None or key != now:
                    now, held = key, kernel.fresh(key_hash(key[: len(at)]))
                scores.append(held.next(x, y))
            done = pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(scores, pa.float64())], [*kept, out])
            yield done.filter(batch.column(n + 2)) if cut else done

    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField(out, T.DoubleType())])
    return rows.mapInArrow(run, schema)


def fitted_states(fitted: DataFrame, spec: StreamSpec, kernel: Kernel, source: str, kind: str) -> DataFrame:
    """(key, __state): the pickled kernel of each stream after all its rows."""
    keys = list(spec.key)
    rows = fitted.select(*keys, F.col(source).cast(kind).alias("__x"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(spec.order)])
    rows = (rows.repartition(*keys) if keys else rows.repartition(1)).sortWithinPartitions(*keys, *[f"__o{i}" for i in range(len(spec.order))])

    def learn(batches):
        now, own = None, None

        def done():
            return pa.RecordBatch.from_arrays([*[pa.array([k]) for k in now], pa.array([pickle.dumps(own)], pa.binary())], [*keys, "__state"])

        for batch in batches:
            for key, x in zip(_keys(batch, list(range(len(keys)))), vectors(batch.column(len(keys)))):
                if own is None or key != now:
                    if own is not None:
                        yield done()
                    now, own = key, kernel.fresh(key_hash(key))
                own.next(x)
        if own is not None:
            yield done()

    return rows.mapInArrow(learn, T.StructType([*[fitted.schema[k] for k in keys], T.StructField("__state", T.BinaryType())]))


def fit_then_score(fitted: DataFrame, df: DataFrame, spec: StreamSpec, kernel: Kernel, value: str | None = None, features: str | None = None, out: str = "score") -> DataFrame:
    """Every row of df against the state after all rows of `fitted`, which it leaves as it is; NULL where a stream was not fitted.  A stream's state is one row, which
    comes to a task before the stream's rows."""
    ship(df.sparkSession)
    keys, columns = list(spec.key), df.columns
    source, kind = value or features, "double" if value else "array<double>"
    states = fitted_states(fitted, spec, kernel, source, kind)
    rows = df.withColumn("__x", F.col(source).cast(kind))
    fields = [f for f in rows.schema.fields if f.name not in keys]
    first = states.select(*keys, *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields], "__state")
    both = first.unionByName(rows.withColumn("__state", F.lit(None).cast("binary")))
    both = (both.repartition(*keys) if keys else both.repartition(1)).sortWithinPartitions(*keys, F.col("__state").isNull())
    names = both.columns
    at = [names.index(k) for k in keys]

    def score(batches):
        now, own = None, None
        for batch in batches:
            raw = batch.column(names.index("__state"))
            scores = []
            for key, x, state in zip(_keys(batch, at), vectors(batch.column(names.index("__x"))), raw.to_pylist()):
                if state is not None:
                    now, own = key, pickle.loads(state)
                    scores.append(None)
                else:
                    scores.append(own.score(x) if own is not None and key == now else None)
            done = pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in columns], pa.array(scores, pa.float64())], [*columns, out])
            yield done.filter(raw.is_null())

    return both.mapInArrow(score, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))
