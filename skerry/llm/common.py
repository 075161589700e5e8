"""What the operators of this subpackage share: tables, the shared folder, Arrow batches of whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import removed, shared_path, ship  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; see cluster.shared_path."""
    return shared_path(spark, name)


def written(df: DataFrame, path: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, read again with its own schema."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined_apart(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """left.join(right, key, how), "left" or "inner", where right has a row for each key at most and left is a table.  Keys of more than one in 1,000 of left's rows, of
    which there are 1,000 at most, meet their rows in a broadcast join; so no key crowds a task of the shuffled one."""
    often = left.groupBy(key).agg(F.count("*").alias("__n")).where(F.col(key).isNotNull() & (F.col("__n") > left.count() / 1000)).select(F.col(key).alias("__key"))
    often = written(often, scratch(left.sparkSession, "often"))
    hot = right.join(F.broadcast(often), F.col(key) == F.col("__key"), "left_semi")
    others = left.join(F.broadcast(often), F.col(key) == F.col("__key"), "left_anti")
    return left.join(F.broadcast(often), F.col(key) == F.col("__key"), "left_semi").join(F.broadcast(hot), key, how).unionByName(others.join(right, key, how))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Whole texts as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `most` bytes of text (or one row), which bounds a worker's memory."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
        held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += size
        yield batch.slice(at, n - at)
        pa.default_memory_pool().release_unused()


class PieceCache(dict):
    """Encodings of text pieces, by the piece's bytes; a missing piece is encoded by `encode`.  When `most` pieces are held they become the old ones, of which
    those that are met again are kept: at most 2 * most pieces are held."""

    def __init__(self, encode: Callable[[bytes], bytes], most: int = 150_000):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, piece: bytes) -> bytes:
        out = self.old.get(piece)
        if out is None:
            out = self.encode(piece)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = out
        return out
