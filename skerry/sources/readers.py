"""Readers: headerless numeric CSV and MAT-5 files with the label last or in `y`, plain tables, and a deterministic shuffle.

A dataset is a DataFrame (seq, features, label).  Files are read by Spark, so they can lie in any store that it reaches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stream import StreamSpec, numbered

#: The dataset files that can be asked for by name.
KNOWN = [
    "arrhythmia.mat",
    "cardio.mat",
    "glass.mat",
    "ionosphere.mat",
    "letter.mat",
    "lympho.mat",
    "mnist.mat",
    "musk.mat",
    "optdigits.mat",
    "pendigits.mat",
    "pima.mat",
    "satellite.mat",
    "satimage-2.mat",
    "shuttle.mat",
    "vertebral.mat",
    "vowels.mat",
    "wbc.mat",
    "gisette_sampled.txt",
    "isolet_sampled.txt",
    "madelon_sampled.txt",
    "pima-indians_sampled.txt",
    "magic-telescope_sampled.txt",
]


class Source(Protocol):
    """Anything that gives a dataset: from_arrays, read_dataset and dataset are such functions with their arguments bound."""

    def __call__(self, spark: SparkSession) -> DataFrame: ...


def ordered(df: DataFrame, order: Sequence[str], out: str = "seq") -> DataFrame:
    """df with a place in its total order, from 1, without bringing all rows into one task: rows are dealt in ranges, and a range's places follow from the sizes of
    the ranges before it.  `order` must tell all rows apart."""
    # Ranges by the first column of the order; rows that share its value share a range.
    levels = df.select(F.col(order[0]).alias("__v"))
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = df.schema[order[0]].dataType
    as_number = F.col("__v").cast("timestamp").cast("double") if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)) else F.col("__v").cast("double")
    if not isinstance(kind, (T.NumericType, T.TimestampNTZType, T.TimestampType, T.DateType)):
        return numbered(df, StreamSpec((), tuple(order)), out)
    ends = sorted({x for x in levels.select(F.percentile_approx(as_number, [i / n for i in range(1, n)]).alias("q")).first()["q"] or [] if x is not None})  # n values
    value = f"cast(cast(`{order[0]}` AS timestamp) AS double)" if not isinstance(kind, T.NumericType) else f"cast(`{order[0]}` AS double)"
    block = " + ".join(["0", *[f"CASE WHEN {value} > {e!r}D THEN 1 ELSE 0 END" for e in ends]])
    return numbered(df, StreamSpec((), tuple(order), block), out)


def shuffled(df: DataFrame, seed: int, row: Column | str = "seq") -> DataFrame:
    """seq is replaced by a place in a random order that depends on seed and row only."""
    row = F.col(row) if isinstance(row, str) else row
    placed = df.withColumn("__h", F.xxhash64(F.lit(seed), row)).withColumn("__row", row)
    out = ordered(placed.drop("seq"), ["__h", "__row"], "seq")
    return out.drop("__h", "__row")


def read_csv(spark: SparkSession, path: str, n_features: int) -> DataFrame:
    """Headerless numbers, the label in the last column; rows are in the order of the file, those of a folder in the order of its files' names.  Spark deals large files
    before small ones, so a row's place is that of its file, of its split of the file, and its own within the split."""
    schema = T.StructType([T.StructField(f"c{i}", T.DoubleType()) for i in range(n_features + 1)])
    file, split = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")
    rows = spark.read.schema(schema).csv(path).select("*", file, split, F.monotonically_increasing_id().alias("line"))
    vector = F.array(*[F.col(f"c{i}") for i in range(n_features)])
    placed = numbered(rows, StreamSpec((), ("file", "split", "line"), "struct(file, split)"), "seq")
    return placed.select("seq", vector.alias("features"), F.col(f"c{n_features}").cast("int").alias("label"))


def csv_width(spark: SparkSession, path: str) -> int:
    """Number of features of a CSV file, from its first line."""
    first = spark.read.text(path).first()
    return len(first["value"].split(",")) - 1 if first else 0


_NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}


def parse_mat(raw: bytes) -> dict[str, np.ndarray]:
    """Numeric matrices of a MAT-5 file (the published level 5 format): elements are tags of type and size, small ones packed into the tag."""
    end = "<" if raw[126:128] == b"IM" else ">"

    def elements(data: bytes):
        at = 0
        while at + 8 <= len(data):
            kind, size = struct.unpack_from(end + "II", data, at)
            if kind >> 16:
                size, kind = kind >> 16, kind & 0xFFFF
                yield kind, data[at + 4 : at + 4 + size]
                at += 8
            else:
                yield kind, data[at + 8 : at + 8 + size]
                at += 8 + size + (-size % 8 if kind != 15 else 0)

    out = {}
    for kind, body in elements(raw[128:]):
        if kind == 15:  # compressed
            kind, body = next(elements(zlib.decompress(body)))
        if kind != 14:
            continue
        parts = list(elements(body))
        if len(parts) < 4 or parts[3][0] not in _NUMBERS:
            continue
        shape = np.frombuffer(parts[1][1], end + "i4")
        data = np.frombuffer(parts[3][1], end + _NUMBERS[parts[3][0]]).astype(float)
        out[parts[2][1].decode()] = data.reshape(shape, order="F")
    return out


def read_mat(spark: SparkSession, path: str) -> DataFrame:
    """Matrices X and y of a MAT-5 file, which is read as one binary file."""
    content = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    found = parse_mat(bytes(content))
    pdf = pd.DataFrame({"seq": np.arange(1, len(found["X"]) + 1), "features": found["X"].tolist(), "label": found["y"].ravel().astype(int)})
    return spark.createDataFrame(pdf, "seq long, features array<double>, label int")


def read_dataset(spark: SparkSession, path: str, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """(seq, features, label) of a .mat file or, for any other name, of CSV."""
    df = read_mat(spark, path) if ".mat" in path.rsplit("/", 1)[-1] else read_csv(spark, path, csv_width(spark, path))
    return shuffled(df, seed) if shuffle else df


def dataset(spark: SparkSession, base: str, name: str, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """One of the KNOWN files in a base folder."""
    if name not in KNOWN:
        raise ValueError(f"no dataset {name!r}; there are {', '.join(KNOWN)}")
    return read_dataset(spark, f"{base.rstrip('/')}/{name}", shuffle, seed)


def from_arrays(spark: SparkSession, x, y=None, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """(seq, features, label) of an array or a pandas frame and its labels, which must be as many."""
    x = np.asarray(x.to_numpy() if hasattr(x, "to_numpy") else x, float)
    if y is not None and len(x) != len(y):
        raise AssertionError("as many labels as rows")
    labels = [None] * len(x) if y is None else [int(v) for v in (y.to_numpy() if hasattr(y, "to_numpy") else y)]
    rows = [(i + 1, v.tolist(), label) for i, (v, label) in enumerate(zip(x, labels))]
    df = spark.createDataFrame(rows, "seq long, features array<double>, label int")
    return shuffled(df, seed) if shuffle else df
