"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: texts lower-cased A-Z, words between ASCII white space, 3-word shingles with repeats (fewer words: the whole sequence), XXH64 of each with
seed 42; a bit is 1 if it is set in over half of the hashes; no words: zero.

Links: two fingerprints that differ in at most RADIUS bits.  Each bit i has a vector a(i) in {0,1}^(RADIUS+1), not zero; for every non-zero v the mask m_v holds
the bits with a(i).v = 1.  At most RADIUS differing bits leave a v that is orthogonal to all their vectors, so the two fingerprints agree under m_v:
every pair within the radius collides in one of the 2^(RADIUS+1)-1 tables.  Candidates are verified exactly.  A bucket of two is one comparison.
Fingerprints in larger buckets are grouped by the values within RADIUS / 2 bits of them instead of compared in pairs: for an even radius, two fingerprints are linked
exactly if they share such a value, and for radius 2 no value has more than 65 of them.  Where so many fingerprints are there that keys of some 36 bits meet by chance
(10^10 and more), all are grouped that way, with 65 rows for each.

Components: smallest doc_id reachable over links, by alternating large-star and small-star steps on the distinct linked fingerprints; lineage is cut by tables in the
shared folder.

Defined cases: null and wordless texts have fingerprint zero, linked like any other; a null doc_id is never the smallest unless the whole component has none;
repeated rows are kept one for one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_apart, removed, scratch, slices, utf8, written

SHINGLE, SEED, RADIUS = 3, 42, 2
UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The covering masks, as unsigned integers; the bits' vectors take turns, which spreads them evenly."""
    n = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(bits) if (1 + i % n & v).bit_count() & 1) for v in range(1, n + 1)]


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    words = text.translate(UPPER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(words, words[1:], words[2:])))
    seed = SEED
    hashes = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], "<u8")
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        total += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, fp), and row where row_col names it: the fingerprint as a signed long."""

    def run(batches):
        for part in slices(batches, "text"):
            values = np.array([fingerprint(t) for t in utf8(part.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values), *part.columns[2:]], ["doc_id", "fp", *part.schema.names[2:]])

    rows = [F.col(row_col).cast("long").alias("row")] if row_col else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *rows).mapInArrow(run, "doc_id long, fp long" + ", row long" * bool(row_col))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, base: str) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints whose transitive closure is that of all pairs within RADIUS bits.  fps: one row per fingerprint."""
    if RADIUS % 2:
        raise ValueError("crowded buckets are grouped exactly for an even radius only")
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for t, m in enumerate(masks())])).alias("x")
    placed = fps.select("fp", tables).select("x.table", "x.key", "fp")
    buckets = written(placed.groupBy("table", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), f"{base}/buckets")
    pairs = buckets.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")
    crowded = placed.join(buckets.where("n > 2").select("table", "key"), ["table", "key"], "left_semi").select("fp").distinct()
    flips = [sum(1 << i for i in own) for k in range(RADIUS // 2 + 1) for own in itertools.combinations(range(64), k)]
    near = F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(x)).cast("long")) for x in flips])).alias("value")
    stars = crowded.select("fp", near).groupBy("value").agg(F.sort_array(F.collect_list("fp")).alias("own")).where(F.size("own") > 1)  # at most len(flips) in each
    stars = stars.select(F.col("own")[0].alias("a"), F.explode(F.slice("own", 2, len(flips))).alias("b"))
    return pairs.union(stars).distinct()


def components(edges: DataFrame, base: str, most_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node of each component, for all nodes of edges (a, b).  Large-star and small-star (Kiveris et al. 2014): links of a node
    move to its smallest neighbour until each component is a star.  Rounds grow with the logarithm of the largest component."""
    spark = edges.sparkSession
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{base}/round0")
    for k in itertools.count(1):
        if k > most_rounds:
            raise RuntimeError("components did not settle")
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        after = written(small, f"{base}/round{k}")
        changed = after.join(now, ["u", "v"], "left_anti").limit(1).count() or now.join(after, ["u", "v"], "left_anti").limit(1).count()
        removed(spark, f"{base}/round{k - 1}")
        now = after
        if not changed:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def hexed(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, fp, component_id, root) for each row of docs, and row where row_col names it; root is the component's smallest fingerprint, which no other component has."""
    base = scratch(docs.sparkSession, "simhash")
    own = written(fingerprints(docs, id_col, text_col, row_col), f"{base}/fingerprints")
    fps = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{base}/distinct")
    roots = components(links(fps, base), base)
    roots = written(roots.union(roots.select("root", "root")).distinct().join(fps, F.col("node") == F.col("fp")).select("fp", "root", "least"), f"{base}/linked")
    moved = roots.join(roots.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    # A linked component's name is null where none of its rows has a doc_id, and then so is least.
    named = fps.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    # Copies share a fingerprint, and a third of all rows may be copies.
    return joined_apart(own, written(named, f"{base}/named"), "fp", "inner").select("doc_id", "fp", "component_id", "root", *["row"] * bool(row_col))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id)."""
    return groups(docs).select("doc_id", hexed("fp").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with exactly one row of each component: that of the smallest doc_id, of these that of the smallest fingerprint, and any one of equals.
    A row with a null doc_id stays only where its whole component has none."""
    columns = docs.columns
    base = scratch(docs.sparkSession, "simhash-rows")
    names = [f"c{i}" for i in range(len(columns))]
    rows = written(docs.toDF(*names).withColumn("__row", F.monotonically_increasing_id()), f"{base}/rows")
    own = groups(rows, names[columns.index(id_col)], names[columns.index(text_col)], "__row")
    kept = own.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "row")).alias("x")).select(F.col("x.row").alias("__row"))
    return rows.join(kept, "__row", "left_semi").select(names).toDF(*columns)
