"""Kernels on Structured Streaming: the state store holds one pickled kernel for each key, and a micro-batch's rows go through it in their order.

Rows of a later micro-batch follow those of an earlier one.  Where rows may come late, `release` first holds them back until the watermark has passed, and then hands
them on in order.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..cluster import ship
from ..operators.kernels import Kernel
from ..operators.runtime import key_hash
from ..plans.stream import StreamSpec


def _vector(x) -> np.ndarray:
    return np.atleast_1d(np.asarray(x, float))


def run_stream(df: DataFrame, spec: StreamSpec, kernel: Kernel, value: str | None = None, features: str | None = None, out: str = "score", event_time: str | None = None) -> DataFrame:
    """A streaming df with the kernel's score of each row.  event_time: a column of df with a watermark; rows are then held back until the watermark has passed them, so
    that scores do not depend on the order of arrival, and rows later than the watermark are dropped by Spark."""
    ship(df.sparkSession)
    keys, source = list(spec.key), value or features
    columns = df.columns
    held = df.withColumn("__x", F.col(source).cast("double" if value else "array<double>"))
    if not keys:
        held, keys = held.withColumn("__one", F.lit(0)), ["__one"]
    order = list(spec.order)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own, waiting = pickle.loads(state.get[0]) if state.exists else (kernel.fresh(key_hash(key if spec.key else ())), None)
        parts = [f for f in ([waiting] if waiting is not None else []) + ([] if state.hasTimedOut else list(frames)) if len(f)]
        rows = pd.concat(parts, ignore_index=True).sort_values(order, kind="stable") if parts else None
        waiting = None
        if rows is not None and event_time is not None:
            passed = rows[event_time] <= pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
            rows, waiting = rows[passed], rows[~passed]
        result = None
        if rows is not None and len(rows):
            result = rows[columns].copy()
            result[out] = [own.next(_vector(x)) for x in rows["__x"]]
        state.update((pickle.dumps((own, waiting)),))
        if waiting is not None and len(waiting):
            last = int(waiting[event_time].max().value // 1_000_000)
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)
        if result is not None:
            yield result

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    timeout = GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.NoTimeout
    return held.groupBy(*keys).applyInPandasWithState(step, schema, "state binary", "append", timeout)


def read_events(spark, path: str, schema, timestamp: str | None, late: str = "0 seconds", files_per_batch: int = 1) -> DataFrame:
    """A stream of Parquet files, with a watermark on a timestamp where one is named; timestamps without a zone are taken as the session's."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    if timestamp is None:
        return df
    return df.withColumn(timestamp, F.col(timestamp).cast("timestamp")).withWatermark(timestamp, late)


def totals(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Running totals of a stream (complete or update mode): the meters' final values."""
    x = F.col(value).cast("double")
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("count"), F.sum(x).alias("sum"), F.sum(x * x).alias("sum_squares"), F.avg(x).alias("average"), F.var_pop(x).alias("variance"), F.min(x).alias("min"), F.max(x).alias("max"))
