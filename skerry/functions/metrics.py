"""Detection metrics as aggregates: precision and recall at a threshold, areas under the ROC and precision-recall curves, and tumbling count windows."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stream import StreamSpec, numbered


class Metric(Protocol):
    """What windowed() takes: one value for each group of rows."""

    def __call__(self, df: DataFrame, by: list[str]) -> DataFrame: ...


def _counts(df: DataFrame, by: list[str], label: str, predicted: Column) -> DataFrame:
    y, p = F.col(label).cast("double"), predicted.cast("double")
    return df.groupBy(*by).agg(F.sum(y * p).alias("__tp"), F.sum(p).alias("__p"), F.sum(y).alias("__y"))


def precision(df: DataFrame, label: str, predicted: Column, by: list[str] = (), out: str = "value") -> DataFrame:
    """TP / (TP + FP); 0 where nothing is predicted."""
    return _counts(df, list(by), label, predicted).select(*by, F.coalesce(F.try_divide("__tp", "__p"), F.lit(0.0)).alias(out))


def recall(df: DataFrame, label: str, predicted: Column, by: list[str] = (), out: str = "value") -> DataFrame:
    """TP / (TP + FN); 0 where nothing is to be found."""
    return _counts(df, list(by), label, predicted).select(*by, F.coalesce(F.try_divide("__tp", "__y"), F.lit(0.0)).alias(out))


def _by_score(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """A row for each distinct score, with its positives and negatives."""
    y = F.col(label).cast("double")
    return df.groupBy(*by, F.col(score).cast("double").alias("__s")).agg(F.sum(y).alias("__tp"), F.sum(1 - y).alias("__fp"))


def auroc(df: DataFrame, label: str, score: str, by: list[str] = (), out: str = "value") -> DataFrame:
    """The area under the ROC curve, ties counting half; NULL where only one class is seen.

    Ranks are summed over distinct scores; a score's rank needs the number of positives above it only, which is gathered in two levels, so no task holds all scores."""
    by = list(by)
    ranked = _cumulated(_by_score(df, label, score, by), by)
    area = F.sum(F.col("__fp") * (F.col("__ctp") - F.col("__tp") / 2))
    return ranked.groupBy(*by).agg(F.try_divide(area, F.sum("__tp") * F.sum("__fp")).alias(out))


def aupr(df: DataFrame, label: str, score: str, by: list[str] = (), out: str = "value") -> DataFrame:
    """Average precision: sum of precision times recall gained, over distinct scores."""
    by = list(by)
    ranked = _cumulated(_by_score(df, label, score, by), by)
    gained = F.sum(F.col("__tp") * F.col("__ctp") / (F.col("__ctp") + F.col("__cfp")))
    return ranked.groupBy(*by).agg(F.coalesce(F.try_divide(gained, F.sum("__tp")), F.lit(0.0)).alias(out))


def _bucket(score: Column) -> Column:
    """A logarithmic bucket, of which there are some thousands at most; never falls as the score grows."""
    size = F.log2(F.abs(score) + 1) * 16
    return F.floor(F.when(score >= 0, size).otherwise(-size))


def _cumulated(points: DataFrame, by: list[str]) -> DataFrame:
    """points with __ctp and __cfp, sums over all scores at or above the own: within a bucket of scores, plus the totals of higher buckets."""
    rows = points.withColumn("__b", _bucket(F.col("__s")))
    totals = rows.groupBy(*by, "__b").agg(F.sum("__tp").alias("__btp"), F.sum("__fp").alias("__bfp"))
    above = Window.partitionBy(*by).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    offsets = totals.select(F.struct(*by, "__b").alias("__to"), F.coalesce(F.sum("__btp").over(above), F.lit(0.0)).alias("__atp"), F.coalesce(F.sum("__bfp").over(above), F.lit(0.0)).alias("__afp"))
    # A struct is equal where its nulls are; rows meet their offsets as the window dealt them.
    rows = rows.withColumn("__at", F.struct(*by, "__b"))
    local = Window.partitionBy("__at").orderBy(F.desc("__s")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__ltp", F.sum("__tp").over(local)).withColumn("__lfp", F.sum("__fp").over(local))
    return rows.join(offsets, F.col("__at") == F.col("__to")).withColumn("__ctp", F.col("__ltp") + F.col("__atp")).withColumn("__cfp", F.col("__lfp") + F.col("__afp"))


def windowed(df: DataFrame, spec: StreamSpec, metric: Metric, rows: int, ignore_nonempty_last: bool = True, out: str = "value") -> DataFrame:
    """The mean of a metric over tumbling windows of `rows` rows, for each stream.  A last window that is not full counts only if it is the only one or if
    ignore_nonempty_last is false.  metric(df, by) gives a column `value`."""
    placed = numbered(df, spec, "__rn").withColumn("__w", F.floor((F.col("__rn") - 1) / rows))
    key = list(spec.key)
    full = placed.groupBy(*key, "__w").agg(F.count("*").alias("__n")).select(F.struct(*key, "__w").alias("__to"), "__n")
    both = metric(placed, [*key, "__w"]).join(full, F.struct(*key, "__w") == F.col("__to"))
    if ignore_nonempty_last:
        both = both.where((F.col("__n") == rows) | (F.col("__w") == 0))
    return both.groupBy(*key).agg(F.avg("value").alias(out))
