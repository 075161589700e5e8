"""Token-ID output: a content-addressed store of token ids.

Texts are encoded with a public tokenizer, each document's id stream is cut into chunks where a rolling hash of the last WINDOW ids
meets a mask, equal chunks are stored once under their digest, recipes list the chunks of each document, and Merkle manifests bind the
recipes of each segment.  Reading back recomputes every digest from the stored bytes.

The store is a folder of Parquet tables, so that any file system that Spark reaches can hold it:

* chunks   (digest binary, ids binary)  unique chunks; ids are little-endian, ID_BYTES wide;
* recipes  (segment int, doc_id long, n_tokens long, leaf binary, chunks array<binary>)  sorted by doc_id within and across segments;
* manifest (segment int, n_docs long, n_tokens long, start long, root binary)  one row per segment; start counts the ids before it.

Defined cases: a null text counts as empty and holds the end id alone; a null doc_id sorts first; rows that repeat a doc_id are kept, ordered by
leaf, and identical rows get successive starts; an empty table gives an empty store.  Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import joined_apart, removed, scratch, slices, utf8, written
from .pieces import encoder, powers

WINDOW, AVERAGE, LEAST, MOST = 16, 256, 64, 1024
DIGEST = 16

def encode_text(text: bytes, path: str, end: int | None = None) -> np.ndarray:
    """The ids of a whole text, as the tokenizer's encode without special tokens gives them, then the end id."""
    ids = encoder(path).encode([text])[0]
    return ids if end is None else np.append(ids, np.uint16(end))


def rolling(ids: np.ndarray) -> np.ndarray:
    """At each position the polynomial hash of the last WINDOW ids (fewer at the start), from prefix sums modulo 2**64."""
    up, down = powers(len(ids))
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    sums = np.cumsum(mixed * down, dtype=np.uint64)
    sums[WINDOW:] -= sums[:-WINDOW].copy()
    return sums * up


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of chunks: where the rolling hash's top bits are zero, at least LEAST and at most MOST ids apart.  A cut depends on the WINDOW ids before it
    and on the last cut only, so that equal passages fall into step again."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    ends, last = [], 0
    for at in (np.flatnonzero(rolling(ids) >> np.uint64(64 - AVERAGE.bit_length() + 1) == 0) + 1).tolist():
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            ends.append(at)
            last = at
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return ends + [n] * (last < n)


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=DIGEST).digest()


def leaf(n_tokens: int, chunks: list[bytes]) -> bytes:
    """A document's Merkle leaf: its length and its chunks' digests."""
    return digest(b"\0" + n_tokens.to_bytes(8, "little") + b"".join(chunks))


class Peaks:
    """A Merkle tree over leaves as they come; holds one hash for each set bit of their number."""

    def __init__(self):
        self.peaks: list[tuple[int, bytes]] = []

    def add(self, x: bytes) -> None:
        size = 1
        while self.peaks and self.peaks[-1][0] == size:
            x, size = digest(b"\1" + self.peaks.pop()[1] + x), size * 2
        self.peaks.append((size, x))

    def root(self) -> bytes:
        out = b""
        for _, x in reversed(self.peaks):
            out = digest(b"\1" + x + out) if out else x
        return out


def staged(docs: DataFrame, path: str, end: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_tokens, leaf, chunks, payload): the documents' ids, cut; equal chunks are not yet met across documents."""

    def run(batches):
        for part in slices(batches, "text", 2 << 20):
            n_tokens, leaves, names, payload = [], [], [], []
            every, sizes = encoder(path).encode(utf8(part.column(1)))
            ends = np.cumsum(sizes)
            every = np.insert(every, ends, np.uint16(end))
            for ids in np.split(every, (ends + np.arange(1, len(ends) + 1))[:-1]):
                raw, at, own = ids.tobytes(), 0, []
                for to in cuts(ids):
                    own.append(raw[2 * at : 2 * to])
                    at = to
                n_tokens.append(len(ids))
                names.append([digest(x) for x in own])
                leaves.append(leaf(len(ids), names[-1]))
                payload.append(own)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_tokens, pa.int64()), pa.array(leaves, pa.binary()), pa.array(names, pa.list_(pa.binary())), pa.array(payload, pa.list_(pa.binary()))], ["doc_id", "n_tokens", "leaf", "chunks", "payload"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, leaf binary, chunks array<binary>, payload array<binary>")


def segments(recipes: DataFrame) -> DataFrame:
    """(segment, n_docs, n_tokens, root) of recipes.  A segment's rows come in order to one task; the root takes a constant amount of memory."""

    def roots(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for segment, n, x in zip(*(c.to_pylist() for c in batch.columns)):
                row = held.setdefault(segment, [0, 0, Peaks()])
                row[0] += 1
                row[1] += n
                row[2].add(x)
        rows = [(k, a, b, p.root()) for k, (a, b, p) in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["segment", "n_docs", "n_tokens", "root"])

    ordered = recipes.select("segment", "doc_id", "leaf", "n_tokens").repartition("segment").sortWithinPartitions("segment", "doc_id", "leaf")
    return ordered.select("segment", "n_tokens", "leaf").mapInArrow(roots, "segment int, n_docs long, n_tokens long, root binary")


def compared(recipes: DataFrame, manifest: DataFrame) -> DataFrame:
    """(segment, start, sound_segment) of each segment of recipes: whether its root, counts and start, computed anew, are those of its one row of the manifest, and no
    segment of the manifest is without recipes.  Both tables have a row per file of recipes."""
    listed = manifest.groupBy("segment").agg(F.count("*").alias("entries"), *[F.first(c).alias(f"m_{c}") for c in ("n_docs", "n_tokens", "start", "root")])
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    both = segments(recipes).join(listed, "segment", "full").withColumn("start", before)
    equal = (F.col("entries") == 1) & F.col("n_docs").eqNullSafe(F.col("m_n_docs")) & F.col("n_tokens").eqNullSafe(F.col("m_n_tokens")) & F.col("start").eqNullSafe(F.col("m_start")) & F.col("root").eqNullSafe(F.col("m_root"))
    none_lost = F.min(F.col("n_docs").isNotNull()).over(Window.partitionBy())
    both = both.withColumn("sound_segment", F.coalesce(equal, F.lit(False)) & none_lost)
    return both.where("n_docs is not null").select("segment", F.coalesce("m_start", "start").alias("start"), "sound_segment")


def write_store(docs: DataFrame, store: str, path: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes the documents into a new store at `store`."""
    spark = docs.sparkSession
    stage = f"{store.rstrip('/')}.staging"
    staged(docs, path, end, id_col, text_col).write.mode("overwrite").option("compression", "zstd").parquet(stage)
    own = spark.read.parquet(stage)

    pieces = own.select(F.explode(F.arrays_zip("chunks", "payload")).alias("x")).select(F.col("x.chunks").alias("digest"), F.col("x.payload").alias("ids"))
    pieces.groupBy("digest").agg(F.first("ids").alias("ids")).write.mode("overwrite").option("compression", "zstd").parquet(f"{store}/chunks")

    recipes = own.select("doc_id", "n_tokens", "leaf", "chunks").repartitionByRange("doc_id", "leaf").sortWithinPartitions("doc_id", "leaf")
    recipes.select(F.spark_partition_id().alias("segment"), "*").write.mode("overwrite").option("compression", "zstd").parquet(f"{store}/recipes")
    removed(spark, stage)

    per_segment = segments(spark.read.parquet(f"{store}/recipes"))
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per segment
    per_segment.select("segment", "n_docs", "n_tokens", before.cast("long").alias("start"), "root").coalesce(1).write.mode("overwrite").parquet(f"{store}/manifest")


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products in GF(2)[x] modulo CRC-32's polynomial, bits reversed as CRC-32 has them."""
    a, out = a.copy(), np.zeros_like(b)
    for k in range(31, -1, -1):
        out ^= np.where(b >> np.uint32(k) & np.uint32(1), a, np.uint32(0))
        a = np.where(a & np.uint32(1), a >> np.uint32(1) ^ np.uint32(0xEDB88320), a >> np.uint32(1))
    return out


def shifted_crc(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A chunk's part in the CRC-32 of a text that has `after` more bytes behind it.  The parts of a text's chunks, combined by exclusive or, are its CRC-32."""
    crc, after = crc.astype(np.uint32), after.astype(np.uint64).copy()
    square = np.full(1, 1 << 23, np.uint32)  # x**8
    while after.any():
        odd = (after & np.uint64(1)).astype(bool)
        crc[odd] = _times(np.broadcast_to(square, odd.sum()), crc[odd])
        after >>= np.uint64(1)
        square = _times(square, square)
    return crc


def read_back(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, verified) from the store's files alone.  Every stored chunk's digest is computed from its bytes, its CRC-32 is
    taken over its ids as unsigned 32-bit integers, and recipes put the chunks' values together: a chunk crosses no shuffle.  verified: all chunks
    are there, match their digests and add up to the recipe's length, leaves match, and the segment's root, numbers of documents and ids, and start are those of the
    manifest.  Where all recipes of a segment are lost, no document is verified."""

    def checked(batches):
        for batch in batches:
            names, raws = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([digest(r) == d for d, r in zip(names, raws)], pa.bool_()), pa.array([len(r) // 2 for r in raws], pa.int64()), pa.array([zlib.crc32(np.frombuffer(r, "<u2").astype("<u4").tobytes()) for r in raws], pa.int64())],
                ["digest", "sound", "n", "crc"],
            )

    def leaves(batches):
        for batch in batches:
            n, names, own = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n_tokens", "chunks", "leaf"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(4), pa.array([leaf(a, b) == c for a, b, c in zip(n, names, own)], pa.bool_())], ["segment", "doc_id", "n_tokens", "leaf", "chunks", "sound_leaf"])

    def terms(batches):
        for batch in batches:
            crc, after = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("crc", "after"))
            at = batch.schema.get_field_index("crc")
            yield batch.set_column(at, "crc", pa.array(shifted_crc(crc, after).astype(np.int64)))

    chunks = spark.read.parquet(f"{store}/chunks").select("digest", "ids").mapInArrow(checked, "digest binary, sound boolean, n long, crc long")
    recipes = spark.read.parquet(f"{store}/recipes").select("segment", "doc_id", "n_tokens", "leaf", "chunks")
    recipes = recipes.mapInArrow(leaves, "segment int, doc_id long, n_tokens long, leaf binary, chunks array<binary>, sound_leaf boolean")

    # Documents with equal leaves have equal ids: each distinct leaf is put together once.
    base = scratch(spark, "token-store-read")
    distinct = written(recipes.groupBy("leaf").agg(F.first("chunks").alias("chunks"), F.first("n_tokens").alias("n_tokens"), F.min("sound_leaf").alias("sound_leaf")).select("leaf", "n_tokens", "sound_leaf", F.posexplode("chunks").alias("at", "digest")), f"{base}/placed")
    placed = joined_apart(distinct, chunks, "digest")
    # Bytes behind a chunk follow from the lengths before it, by order of position.
    w = Window.partitionBy("leaf").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("leaf", "n_tokens", F.coalesce("sound", F.lit(False)).alias("sound"), "sound_leaf", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("crc", F.lit(0)).alias("crc"), (4 * F.coalesce(F.sum("n").over(w), F.lit(0))).cast("long").alias("after"))
    parts = placed.mapInArrow(terms, placed.schema)
    by_leaf = parts.groupBy("leaf").agg(F.bit_xor("crc").alias("ids_crc32"), (F.min("sound") & F.min("sound_leaf") & (F.sum("n") == F.max("n_tokens"))).alias("verified"))

    order = Window.partitionBy("segment").orderBy("doc_id", "leaf").rowsBetween(Window.unboundedPreceding, -1)
    plain = spark.read.parquet(f"{store}/recipes").select("segment", "doc_id", "n_tokens", "leaf")
    rows = plain.join(F.broadcast(compared(plain, spark.read.parquet(f"{store}/manifest"))), "segment")
    rows = written(rows.select("doc_id", "leaf", "n_tokens", "sound_segment", (F.col("start") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).cast("long").alias("start")), f"{base}/rows")
    rows = joined_apart(rows, written(by_leaf, f"{base}/leaves"), "leaf")
    return rows.select("doc_id", "start", "n_tokens", F.coalesce("ids_crc32", F.lit(0)).cast("long").alias("ids_crc32"), (F.coalesce("verified", F.lit(False)) & F.col("sound_segment")).alias("verified"))


def documents_of(spark: SparkSession, store: str, wanted: Column | None = None) -> DataFrame:
    """(doc_id, ids array<int>): the documents' ids, put together from their chunks; wanted picks documents by a condition on doc_id."""

    def joined(batches):
        for batch in batches:
            rows = [b"".join(x["ids"] for x in sorted(own, key=lambda x: x["at"])) for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(r, "<u2").astype(np.int32) for r in rows], pa.list_(pa.int32()))], ["doc_id", "ids"])

    recipes = spark.read.parquet(f"{store}/recipes")
    recipes = (recipes if wanted is None else recipes.where(wanted)).select("doc_id", F.monotonically_increasing_id().alias("row"), "chunks")
    recipes = recipes.select("doc_id", "row", F.posexplode("chunks").alias("at", "digest"))
    whole = recipes.join(spark.read.parquet(f"{store}/chunks"), "digest").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("at", "ids")).alias("own"))
    return whole.select("doc_id", "own").mapInArrow(joined, "doc_id long, ids array<int>")


def store_ids(docs: DataFrame, path: str, end: int = 2) -> DataFrame:
    """Writes a store below the shared folder and reads it back."""
    store = scratch(docs.sparkSession, "token-store")
    write_store(docs, store, path, end)
    return read_back(docs.sparkSession, store)
