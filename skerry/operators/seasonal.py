"""STL residuals of whole series: x - season - median over all rows of a stream, which meet in one task, as the definition asks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..cluster import ship
from ..functions.numerics import stl_residual
from ..plans.stream import StreamSpec


def series_residual(df: DataFrame, spec: StreamSpec, value: str, period: int, robust: bool = True, out: str = "residual", **stl) -> DataFrame:
    """NULL for streams of fewer than two periods."""
    if period < 2:
        raise ValueError("period must be 2 or more")
    ship(df.sparkSession)
    order = list(spec.order)

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        y = rows[value].to_numpy(float)
        rows[out] = stl_residual(y, period, robust, **stl) if len(y) >= 2 * period else np.nan
        return rows

    return df.groupBy(*spec.key).applyInPandas(work, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))
