"""Prefix medians, ranks and median deviations of streams of any length, in parts that fit a task.

A long stream is cut twice: by place into chunks of PART rows, and by value into buckets.  Boundaries are approximate quantiles; a boundary's own value is a bucket of its
own, so that ties crowd no bucket that has to be searched, and between two boundaries lie about PART values.  Four passes, each with a chunk or a bucket in a task:

1. each chunk counts its values by bucket; 2. running sums of these counts give each chunk the counts before it (a row for each chunk); 3. a chunk goes through its rows
with the counts so far, which tells for each row how many values lie in higher buckets, and in which bucket and at which rank the median lies; 4. within a bucket the rest is
sorted: greater values for ranks, values at ranks for medians.

Streams of at most PART rows go through the kernels whole.  NaN counts as missing, as in the kernels.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import shared_path, ship
from ..plans import stream
from ..plans.stream import StreamSpec, number
from .kernels import PrefixMedian, PrefixRank
from .runtime import run_batch

PART = 1 << 17


class Counts:
    """Numbers of values by bucket that grow one by one (Fenwick's tree)."""

    def __init__(self, start: np.ndarray):
        self.n = len(start)
        self.total = int(start.sum())
        sums = np.concatenate([[0], np.cumsum(start)])
        at = np.arange(1, self.n + 1)
        self.tree = [0, *(sums[at] - sums[at - (at & -at)]).tolist()]
        self.top = 1 << self.n.bit_length() - 1 if self.n else 0

    def add(self, bucket: int) -> None:
        self.total += 1
        at = bucket + 1
        while at <= self.n:
            self.tree[at] += 1
            at += at & -at

    def upto(self, bucket: int) -> int:
        out, at = 0, bucket + 1
        while at:
            out += self.tree[at]
            at &= at - 1
        return out

    def find(self, k: int) -> tuple[int, int]:
        """(bucket, rank within it) of the k-th value, from 0."""
        at, step = 0, self.top
        while step:
            if at + step <= self.n and self.tree[at + step] <= k:
                at += step
                k -= self.tree[at]
            step >>= 1
        return at, k


def buckets(bounds: np.ndarray, x: np.ndarray) -> np.ndarray:
    """2 i + 1 for the i-th boundary, 2 i for values between it and the one before."""
    at = np.searchsorted(bounds, x)
    return 2 * at + (bounds[np.minimum(at, len(bounds) - 1)] == x) if len(bounds) else np.zeros(len(x), np.int64)


def _grouped(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Neighbouring rows that are equal in the columns, as tables."""
    now, held = None, []
    for batch in batches:
        keys, start = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns))), 0
        for i, k in enumerate(keys):
            if k != now:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield now, pa.Table.from_batches(held)
                now, held, start = k, [], i
        if len(keys) > start:
            held.append(batch.slice(start))
    if held:
        yield now, pa.Table.from_batches(held)


def _table(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Long:
    """What medians and ranks of the long streams share: passes 1 and 2."""

    def __init__(self, rows: DataFrame, counts: DataFrame, part: int, base: str):
        """rows: (stream, place, x) of long streams, x not missing; counts: (stream, n)."""
        spark = rows.sparkSession
        self.rows, self.part, self.base = rows.withColumn("chunk", F.floor((F.col("place") - 1) / part)), part, base
        most = counts.agg(F.max("n")).first()[0] or 0
        q = max(2, -(-most // part))
        found = rows.groupBy("stream").agg(F.percentile_approx("x", [i / q for i in range(1, q)], 10 * q).alias("q"), F.count("*").alias("n"))
        # A stream of n rows keeps n / part of the quantiles: 8 bytes for PART rows meet at the driver.
        bounds = {r["stream"]: np.unique(np.array(r["q"])[:: max(1, q * part // max(r["n"], 1))]) for r in found.collect()}
        self.bounds = spark.sparkContext.broadcast(bounds)
        self.starts = _table(self._starts(), f"{base}/starts")

    def _starts(self) -> DataFrame:
        """(stream, chunk, before): how many values of each bucket come before a chunk."""
        bounds = self.bounds

        def counted(batches):
            for (name, chunk), t in _grouped(batches, ["stream", "chunk"]):
                own = bounds.value[name]
                n = np.bincount(buckets(own, t.column("x").to_numpy()), minlength=2 * len(own) + 1)
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([chunk], pa.int64()), pa.array([n], pa.list_(pa.int64()))], ["stream", "chunk", "n"])

        def added(batches):
            now, sums = None, None
            for batch in batches:
                out = []
                for name, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                    if name != now:
                        now, sums = name, np.zeros(len(n), np.int64)
                    out.append(sums.copy())
                    sums += n
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["stream", "chunk", "before"])

        n = self.rows.select("stream", "chunk", "x").repartition("stream", "chunk").sortWithinPartitions("stream", "chunk").mapInArrow(counted, "stream string, chunk long, n array<long>")
        return n.repartition("stream").sortWithinPartitions("stream", "chunk").mapInArrow(added, "stream string, chunk long, before array<long>")

    def walked(self, work: Callable, schema: str) -> DataFrame:
        """Pass 3: work(stream, counts so far, places, values, buckets) of each chunk gives a batch."""
        bounds = self.bounds
        first = self.starts.select("stream", "chunk", F.lit(0).cast("long").alias("place"), F.lit(None).cast("double").alias("x"), "before")
        both = first.unionByName(self.rows.select("stream", "chunk", "place", "x", F.lit(None).cast("array<bigint>").alias("before")))

        def run(batches):
            for (name, chunk), t in _grouped(batches, ["stream", "chunk"]):
                x = t.column("x").to_numpy()[1:]
                yield work(name, chunk, Counts(np.array(t.column("before")[0].as_py(), np.int64)), t.column("place").to_numpy()[1:], x, buckets(bounds.value[name], x))

        return both.repartition("stream", "chunk").sortWithinPartitions("stream", "chunk", "place").mapInArrow(run, schema)

    def ranks(self) -> DataFrame:
        """(stream, place, above, n): values so far that are greater, and all."""

        def higher(name, chunk, counts, places, x, own):
            above = []
            for b in own.tolist():
                counts.add(b)
                above.append(counts.total - counts.upto(b))
            n = counts.total - np.arange(len(x))[::-1]
            return pa.RecordBatch.from_arrays([pa.array([name] * len(x), pa.string()), pa.array(places), pa.array(x), pa.array(own.astype(np.int64)), pa.array(above, pa.int64()), pa.array(n)], ["stream", "place", "x", "bucket", "above", "n"])

        def within(batches):
            for (name, bucket), t in _grouped(batches, ["stream", "bucket"]):
                above = t.column("above").to_numpy().copy()
                if bucket % 2 == 0:
                    held: list[float] = []
                    for i, v in enumerate(t.column("x").to_pylist()):
                        above[i] += len(held) - bisect.bisect_right(held, v)
                        bisect.insort(held, v)
                yield from t.select(["stream", "place"]).append_column("above", pa.array(above)).append_column("n", t.column("n")).combine_chunks().to_batches()

        walked = self.walked(higher, "stream string, place long, x double, bucket long, above long, n long")
        # A boundary's own values need no order among them: they may be many, and are dealt by chunk.
        deal = F.when(F.col("bucket") % 2 == 0, F.lit(-1)).otherwise(F.floor(F.col("place") / self.part))
        return walked.withColumn("deal", deal).repartition("stream", "bucket", "deal").sortWithinPartitions("stream", "bucket", "deal", "place").drop("deal").mapInArrow(within, "stream string, place long, above long, n long")

    def medians(self) -> DataFrame:
        """(stream, place, median) for each row."""
        bounds = self.bounds

        def asked(name, chunk, counts, places, x, own):
            out = []
            for b, place in zip(own.tolist(), places.tolist()):
                counts.add(b)
                for k in {(counts.total - 1) // 2, counts.total // 2}:
                    out.append((place, *counts.find(k)))
            values = bounds.value[name]
            # The median of an even number of values is the mean of two; those at boundaries are known.
            known = [float(values[b // 2]) if b % 2 else None for _, b, _ in out]
            return pa.RecordBatch.from_arrays([pa.array([name] * len(out), pa.string()), pa.array([chunk] * len(out), pa.int64()), *[pa.array([r[i] for r in out], pa.int64()) for i in range(3)], pa.array(known, pa.float64())], ["stream", "chunk", "place", "bucket", "rank", "value"])

        queries = _table(self.walked(asked, "stream string, chunk long, place long, bucket long, rank long, value double"), f"{self.base}/queries")
        open_ones = queries.where("value IS NULL").select("stream", "chunk", "bucket", "place", "rank", F.lit(None).cast("double").alias("x"))
        needed = open_ones.select("stream", "chunk", "bucket").distinct()

        def placed(batches):
            for (name,), t in _grouped(batches, ["stream"]):
                own = buckets(bounds.value[name], t.column("x").to_numpy())
                yield from t.append_column("bucket", pa.array(own.astype(np.int64))).combine_chunks().to_batches()

        members = self.rows.select("stream", "place", "x", F.col("chunk").alias("own")).mapInArrow(placed, "stream string, place long, x double, own long, bucket long")
        members = members.join(needed, ["stream", "bucket"]).where("own <= chunk").select("stream", "chunk", "bucket", "place", F.lit(None).cast("long").alias("rank"), "x")

        def answered(batches):
            for (name, _, _), t in _grouped(batches, ["stream", "chunk", "bucket"]):
                held: list[float] = []
                places, values = [], []
                for place, rank, v in zip(t.column("place").to_pylist(), t.column("rank").to_pylist(), t.column("x").to_pylist()):
                    if rank is None:
                        bisect.insort(held, v)
                    else:
                        places.append(place)
                        values.append(held[rank])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(values, pa.float64())], ["stream", "place", "value"])

        # A row is in its bucket before it is asked for.
        sorted_rows = members.unionByName(open_ones).repartition("stream", "chunk", "bucket").sortWithinPartitions("stream", "chunk", "bucket", "place", F.col("rank").isNotNull())
        found = sorted_rows.mapInArrow(answered, "stream string, place long, value double")
        return found.unionByName(queries.where("value IS NOT NULL").select("stream", "place", "value")).groupBy("stream", "place").agg(F.avg("value").alias("median"))


def _parts(df: DataFrame, spec: StreamSpec, value: str, kernel, out: str, part: int | None, joined: Callable[[_Long, DataFrame], DataFrame]) -> DataFrame:
    if part is None and (spec.block is None or stream.small(df)):
        return run_batch(df, spec, kernel, value=value, out=out)
    ship(df.sparkSession)
    part, base = part or PART, shared_path(df.sparkSession, "order")
    kept = [c for c in df.columns if c != out]
    name = F.to_json(F.struct(F.lit(0).alias("_"), *spec.key))
    rows = _table(stream.numbered(df, spec, "__place").select(*kept, F.col("__place"), number(value).alias("__x"), name.alias("__stream")), f"{base}/rows")
    sizes = _table(rows.groupBy("__stream").agg(F.count(F.lit(1)).alias("__n")), f"{base}/sizes")
    long_ones = sizes.where(F.col("__n") > part)  # one for `part` rows at most
    short = run_batch(rows.join(F.broadcast(long_ones), "__stream", "left_anti").select(*kept, "__place"), StreamSpec(spec.key, ("__place",)), kernel, value=value, out=out).select(*kept, out)
    own = rows.join(F.broadcast(long_ones.drop("__n")), "__stream", "left_semi")
    plain = own.where("__x IS NOT NULL").select(F.col("__stream").alias("stream"), F.col("__place").alias("place"), F.col("__x").alias("x"))
    work = _Long(plain, long_ones.select(F.col("__stream").alias("stream"), F.col("__n").alias("n")), part, base)
    return short.unionByName(joined(work, own).select(*kept, out))


def prefix_rank(df: DataFrame, spec: StreamSpec, value: str, out: str = "p", part: int | None = None) -> DataFrame:
    """The share of all values so far, the own included, that are greater; NULL for missing values.  part: rows of a task, where all long streams are to be cut."""

    def joined(work: _Long, own: DataFrame) -> DataFrame:
        found = work.ranks().select(F.col("stream").alias("__stream"), F.col("place").alias("__place"), (F.col("above") / F.col("n")).alias(out))
        return own.join(found, ["__stream", "__place"], "left")

    return _parts(df, spec, value, PrefixRank(), out, part, joined)


def prefix_median(df: DataFrame, spec: StreamSpec, value: str, out: str = "median", part: int | None = None) -> DataFrame:
    """The median of all values so far; a missing value has that of the rows before it.  part: see prefix_rank."""

    def joined(work: _Long, own: DataFrame) -> DataFrame:
        found = work.medians().select(F.col("stream").alias("__stream"), F.col("place").alias("__place"), F.col("median").alias(out))
        rows = own.join(found, ["__stream", "__place"], "left")
        # Missing values take the last median of their chunk, or the last one of the chunks before (a row for each chunk).
        rows = rows.withColumn("__chunk", F.floor((F.col("__place") - 1) / work.part))
        local = Window.partitionBy("__stream", "__chunk").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("__local", F.last(out, ignorenulls=True).over(local))
        ends = rows.groupBy("__stream", "__chunk").agg(F.max_by(out, F.when(F.col(out).isNotNull(), F.col("__place"))).alias("__end"))
        before = Window.partitionBy("__stream").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select("__stream", "__chunk", F.last("__end", ignorenulls=True).over(before).alias("__before"))
        return rows.join(ends, ["__stream", "__chunk"]).withColumn(out, F.coalesce("__local", "__before"))

    return _parts(df, spec, value, PrefixMedian(), out, part, joined)


def median_absolute_deviation(df: DataFrame, spec: StreamSpec, value: str, absolute: bool = True, b: float = 1.4826, out: str = "score", part: int | None = None) -> DataFrame:
    """(x - median) / (b * MAD + 1e-10) over all rows so far; each row's deviation is from the median as it was at that row."""
    rows = prefix_median(df, spec, value, "__m", part).withColumn("__d", F.abs(number(value) - F.col("__m")))
    rows = prefix_median(rows, spec, "__d", "__mad", part)
    z = (number(value) - F.col("__m")) / (b * F.col("__mad") + 1e-10)
    return rows.withColumn(out, F.abs(z) if absolute else z).drop("__m", "__d", "__mad")
