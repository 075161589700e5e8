"""Benchmark decontamination: windows of test items, broadcast as a hash set, are looked for in every document.

Words are runs of ASCII letters and digits and of all non-ASCII characters, lower-cased A-Z.  A window is SIZE consecutive words of an item; an item of
fewer words, but not none, is one window.  Documents are scanned with numpy: words become the item vocabulary's numbers (0: in no item), runs of known
words are cut into windows, their polynomial hashes are looked up among the items' hashes, and each hit is verified word by word.

At most MOST_WORDS item words are sent to the executors at once, counted from above by bytes first (one item is never parted).  Larger item sets are dealt into blocks of that
size, each block is looked for in all documents, and a document's hits of all blocks are put together, so no item is left out at any size.

Defined cases: null texts have no words; the words of items without an id are hit like any other's, but such items are not counted or named; repeated items count once by id;
rows are told apart by their place and not by doc_id; empty tables give no hits; other columns are not read, and kept by `without_hits`.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, slices, utf8, written

SIZE = 10
#: At most this many item words are broadcast at once (about 100 bytes each in a worker).
MOST_WORDS = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Lower-cases A-Z and turns every byte that is in no word into a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Windows:
    """The items' windows: `vocabulary` numbers their words from 1; `by_size` has, for each window length, sorted hashes and what they stand for."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int = SIZE):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for name, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            n = min(size, len(own))
            for i in range(len(own) - n + 1 if n else 0):
                found[n][tuple(own[i : i + n])] |= {name} - {None}
        self.by_size = []
        for n, windows in sorted(found.items()):
            keys = np.array(list(windows), np.uint64).reshape(-1, n)
            hashes: dict[int, list] = defaultdict(list)
            for h, (window, names) in zip(self.hashed(keys).tolist(), windows.items()):
                hashes[h].append((window, names))
            self.by_size.append((n, np.array(sorted(hashes), np.uint64), hashes))

    @staticmethod
    def hashed(keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.uint64)
        for j in range(keys.shape[1]):
            out = out * BASE + keys[:, j]
            out ^= out >> np.uint64(29)
        return out

    def scan(self, text: bytes) -> tuple[int, np.ndarray | None, set[str]]:
        """Number of words, which of them are hit (None: none), and the items found."""
        own = words(text)
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in own], np.uint64)
        n_known = np.cumsum(np.concatenate([[0], ids != 0]))
        hit, names = None, set()
        for n, hashes, stands in self.by_size:
            if len(ids) < n:
                break
            starts = np.flatnonzero(n_known[n:] - n_known[:-n] == n)
            if not len(starts):
                continue
            keys = self.hashed(ids[starts[:, None] + np.arange(n)])
            at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
            for i, key in zip(starts[(same := hashes[at] == keys)].tolist(), keys[same].tolist()):
                window = tuple(ids[i : i + n].tolist())
                for known, items in stands[key]:
                    if known == window:  # verified
                        hit = np.zeros(len(ids), bool) if hit is None else hit
                        hit[i : i + n] = True
                        names |= items
        return len(own), hit, names


def _result(doc_ids: pa.Array, rows: list[tuple[int, int, set[str]]]) -> pa.RecordBatch:
    names = [sorted(r[2]) for r in rows]
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(map(len, names), pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]), pa.array([r[1] > 0 for r in rows], pa.bool_()), pa.array(names, pa.list_(pa.string()))],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
    )


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"


def item_blocks(benchmark: DataFrame, most_words: int = MOST_WORDS, id_col: str = "item_id", text_col: str = "text") -> list[DataFrame]:
    """(name, text) of the items, in blocks of at most most_words words, or one item.  A word and what parts it from the next take two bytes at least."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("text"))
    size = F.octet_length("text").cast("long")
    if (items.agg(F.sum(size)).first()[0] or 0) <= 2 * most_words:
        return [items]
    placed = items.withColumn("__size", size).withColumn("__row", F.monotonically_increasing_id())
    placed = written(placed, scratch(benchmark.sparkSession, "items"))
    until = F.sum("__size").over(Window.orderBy("__row").rowsBetween(Window.unboundedPreceding, 0))
    # An item that crosses the end of a block starts the next one: blocks hold at most half of the bytes each, or one item.
    block = F.floor(until / max(most_words, 1)).alias("__block")
    numbers = written(placed.select("__row", block), scratch(benchmark.sparkSession, "items"))
    every = [r["__block"] for r in numbers.select("__block").distinct().orderBy("__block").collect()]
    return [placed.join(numbers.where(F.col("__block") == k), "__row", "left_semi").select("name", "text") for k in every]


def _shared(docs: DataFrame, items: DataFrame, size: int):
    return docs.sparkSession.sparkContext.broadcast(Windows([(r["name"], r["text"].encode()) for r in items.collect()], size))


def scan(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, most_words: int = MOST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: n_words, n_hit, n_items, items_sha256, contaminated and the sorted item ids."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = item_blocks(benchmark, most_words)
    if len(blocks) > 1:
        own = written(own.withColumn("row", F.monotonically_increasing_id()), scratch(docs.sparkSession, "scan"))
        found = _found(own, blocks, size)
        counted = own.join(found, "row", "left").select("doc_id", "text", "places", "items")

        def put_together(batches):
            for part in slices(batches, "text"):
                rows = [(len(words(t)), len(places or ()), set(names or ())) for t, places, names in zip(utf8(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield _result(part.column(0), rows)

        return counted.mapInArrow(put_together, SCHEMA)
    shared = _shared(docs, blocks[0], size)

    def run(batches):
        windows = shared.value
        for part in slices(batches, "text"):
            rows = [(n, 0 if hit is None else int(hit.sum()), names) for n, hit, names in map(windows.scan, utf8(part.column(1)))]
            yield _result(part.column(0), rows)

    return own.mapInArrow(run, SCHEMA)


def _found(rows: DataFrame, blocks: list[DataFrame], size: int) -> DataFrame:
    """(row, places, items) of the rows (row, text) with hits: the places of all hit words and the names of all items.  A block has one row for each row with hits."""
    base, every = scratch(rows.sparkSession, "scan"), []
    for k, items in enumerate(blocks):
        shared = _shared(rows, items, size)

        def run(batches, shared=shared):
            for part in slices(batches, "text"):
                found = [(row, np.flatnonzero(hit).tolist(), sorted(names)) for row, (_, hit, names) in zip(part.column(0).to_pylist(), map(shared.value.scan, utf8(part.column(1)))) if hit is not None]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())))], ["row", "places", "items"])

        every.append(written(rows.select("row", "text").mapInArrow(run, "row long, places array<int>, items array<string>"), f"{base}/{k}"))
        shared.unpersist()
    together = reduce(DataFrame.unionAll, every)
    return together.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def cut(text: bytes, hit: set[int] | np.ndarray) -> str:
    """The text without the words at these places: runs of them go, with what lies between their words."""
    mapped, out, keep_from, end, last = text.translate(TABLE), [], 0, 0, False
    hit = set(np.asarray(hit).tolist()) if not isinstance(hit, set) else hit
    for k, w in enumerate(mapped.split()):
        start = mapped.index(w, end)
        end = start + len(w)
        if k in hit:
            if not last:
                out.append(text[keep_from:start])
            keep_from = end
        last = k in hit
    return b"".join([*out, text[keep_from:]]).decode()


def without_hits(docs: DataFrame, benchmark: DataFrame, whole: bool = True, size: int = SIZE, most_words: int = MOST_WORDS, text_col: str = "text") -> DataFrame:
    """docs with contaminated rows removed (whole), or with the hit words removed from their texts: runs of hit words and what lies between them go.
    Columns stay as they are."""
    columns, at = docs.columns, docs.columns.index(text_col)
    blocks = item_blocks(benchmark, most_words)
    names = [f"c{i}" for i in range(len(columns))]
    if len(blocks) == 1:
        shared = _shared(docs, blocks[0], size)

        def run(batches):
            for batch in batches:
                for part in slices(iter([batch]), names[at]):
                    texts = utf8(part.column(at))
                    hits = [shared.value.scan(t)[1] for t in texts]
                    if whole:
                        yield part.filter(pa.array([h is None for h in hits], pa.bool_()))
                    else:
                        yield part.set_column(at, names[at], pa.array([t if h is None else cut(b, np.flatnonzero(h)) for t, b, h in zip(part.column(at).to_pylist(), texts, hits)], part.schema.field(at).type))

        rows = docs.toDF(*names)
        return rows.mapInArrow(run, rows.schema).toDF(*columns)
    rows = written(docs.toDF(*names).withColumn("__row", F.monotonically_increasing_id()), scratch(docs.sparkSession, "scan-rows"))
    found = _found(rows.select(F.col("__row").alias("row"), F.col(names[at]).cast("string").alias("text")), blocks, size).withColumnRenamed("row", "__row")
    if whole:
        return rows.join(found, "__row", "left_anti").select(names).toDF(*columns)

    def rewritten(batches):
        for batch in batches:
            for part in slices(iter([batch]), names[at]):
                texts = [t if places is None else cut(b, set(places)) for t, b, places in zip(part.column(at).to_pylist(), utf8(part.column(at)), part.column(len(names)).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(texts, part.schema.field(at).type), *part.columns[at + 1 : len(names)]], names)

    both = rows.join(found, "__row", "left").select(*names, "places")
    return both.mapInArrow(rewritten, rows.select(names).schema).toDF(*columns)


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, n, w[i:i + n - 1] AS g FROM (SELECT item, w, least({SIZE}, len(w)) AS n, unnest(range(1, len(w) - least({SIZE}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, n, i, w[i:i + n - 1] AS g FROM (SELECT r, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, (SELECT DISTINCT n FROM iw))),
h AS (SELECT r, n, i, item FROM dw JOIN iw USING (n, g)),
p AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""
