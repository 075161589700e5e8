"""Language-model scores: a causal self-attention model in numpy on the subword ids of a public tokenizer, beside a unigram base score on words.

Tokens are words `[^\\x20\\x09-\\x0D]+` of texts lower-cased A-Z, and one end per text.  The attention reads the first and last subword ids of the words before a token, and the model gives

    P(token) = P(class | what comes before, by attention) * ((c - D) / N  +  D V / N * P(spelling | class)).

The class of a word is that of its first subword id: first ids are clustered by what comes before them; the end and all rare first ids have a class each.  c is the word's
count among the training tokens, N and V are the class's tokens and distinct words, and D is the discount of Kneser and Ney.  A spelling is a first id, ids that depend on
the id before them, a stop, and which of the words with these ids it is: the plain one, the one with a capital first letter beyond ASCII, or another, by its bytes.
So the probabilities of all tokens add up to one at most: what is missing are id sequences that the tokenizer never makes.

Learning covers all training documents.  Word counts are a distributed aggregate, subword counts follow from them exactly, and embeddings of subword ids and classes come
from counts of which ids follow which.  The attention is trained on every token of every training document: documents are dealt by a hash of id and text into rounds and
shards, whose number depends on the corpus and not on the cluster; a shard is trained by Adam in the order of the hash, and the shards of a round meet in their
average, weighted by tokens.  Only the model, whose size is fixed, meets at the driver.

Scoring cuts texts into blocks of STRIDE tokens; a block's tokens are scored once, and see those before them in their own and in the preceding block.

Word counts are joined to documents in two ways that together cover every word: the HEAD most frequent words at most are broadcast, and the others meet their
documents in a shuffled join, with the log probability of the spelling.

Defined cases: null counts as empty: one end; a null doc_id is never held out; rows and repeats are kept one for one; without training documents all counts are 0 and the
model knows classes and spellings by their floors alone; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, slices, utf8, written
from .pieces import MOST, Held, distinct_segments, distinct_words, encoder, forget, hashes, span
from .simhash import UPPER

STRIDE, WIDTH, CLASSES, TOP, HEAD = 16, 16, 32, 1024, 200_000
ROUNDS, BATCH, STEP = 2, 128, 0.02
#: Tokens of a shard, as far as there are at most MOST_SHARDS in a round.
SHARD, MOST_SHARDS = 1_000_000, 10_000
END, NONE, IDS = 49_407, 49_408, 49_409  # the end of a text; what stands for the ids of words without any
FOLDS, HELD_OUT = 7, 2
BETA, FLOOR = 2.0, 0.05
PLAIN, CAPITAL, BYTES = range(3)
#: Words of printable ASCII without A-Z and of small Latin-1 letters.
LOWER = re.compile(rb"(?:[!-@\[-~]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def variant(word: bytes) -> int:
    """Which of the words with the same ids this is."""
    s = word.decode()
    if not unicodedata.is_normalized("NFC", s) or s.split() != [s]:
        return BYTES
    if s == s.lower():
        return PLAIN
    first = s[0].lower()
    return CAPITAL if s[1:] == s[1:].lower() and len(first) == 1 and first.upper() == s[0] else BYTES


def variants(words: list[bytes]) -> np.ndarray:
    """PLAIN, CAPITAL, or BYTES and the number of bytes."""
    out = np.full(len(words), PLAIN, np.int64)
    for i in np.flatnonzero(~np.array(list(map(bytes.isascii, words)), bool)).tolist():
        if not LOWER(w := words[i]) and (k := variant(w)) != PLAIN:
            out[i] = k if k < BYTES else k + len(w)
    return out


def packed(x: np.ndarray, wide: str) -> bytes:
    """Numbers in a byte each where they fit, else in as many as `wide` has."""
    return x.astype(np.uint8).tobytes() if len(x) and x.max() < 256 else x.astype(wide).tobytes()


def unpacked(raw: list[bytes], n: np.ndarray, wide: str) -> np.ndarray:
    """packed() of arrays of n[0], n[1], ... numbers, one behind the other."""
    if all(len(r) == k for r, k in zip(raw, n.tolist())):
        return np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    return np.concatenate([np.frombuffer(r, np.uint8 if len(r) == k else wide).astype(np.int64) for r, k in zip(raw, n.tolist())])


def ids_of(words: list[bytes], path: str, distinct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words, one word behind the other, and their numbers; NONE for a word without ids (white space beyond ASCII).  distinct: no word comes twice."""
    ids, sizes = encoder(path).encode(words, distinct)
    if len(sizes) and not sizes.all():
        ids = np.insert(ids, (np.cumsum(sizes) - sizes)[sizes == 0], np.uint16(NONE))
    return ids, np.maximum(sizes, 1)


# --- counts over all training documents ---------------------------------------------------------------------------------------------------------------


def word_counts(own: DataFrame) -> DataFrame:
    """(word, c) of the training documents; the end is the empty word."""

    def run(batches):
        held: dict[bytes, int] = {}

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
            held.clear()

        for part in slices(batches, "text", 2 << 20):
            texts = [t.translate(UPPER) for key, t in zip(part.column(0).to_pylist(), utf8(part.column(1))) if not held_out(key)]
            words, at, _ = distinct_words(texts)
            for w, n in zip([*words, b""], [*np.bincount(at, minlength=len(words)).tolist(), len(texts)]):
                if n:
                    held[w] = held.get(w, 0) + n
            if len(held) > 400_000:
                yield from flush()
        if held:
            yield from flush()

    return own.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


#: What subword_counts() counts: tokens and distinct words by first id, distinct words and tokens by other ids, pairs of neighbours (first * 65536 + second), last ids,
#: variants, and how many words occur once and twice.
STARTS, TYPES, INNER, INNER_TOKENS, PAIRS, LAST, VARIANTS, TIMES = range(8)


def spelt(vocabulary: DataFrame, path: str) -> DataFrame:
    """(word, c, ids, kind) of the training words without the end: a word is encoded once."""

    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            if words:
                ids, sizes = ids_of(words, path, True)
                offsets = (2 * np.append(0, np.cumsum(sizes))).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u2").tobytes())])
                yield pa.RecordBatch.from_arrays([*batch.columns, raw, pa.array(variants(words))], ["word", "c", "ids", "kind"])

    return vocabulary.where("octet_length(word) > 0").select("word", "c").mapInArrow(run, "word binary, c long, ids binary, kind long")


def subword_counts(words: DataFrame) -> DataFrame:
    """(kind, key, n) over all training words, each of which comes once in spelt()."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            c, raw, kinds = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            ids, size = np.frombuffer(b"".join(raw), "<u2").astype(np.int64), np.array(list(map(len, raw))) // 2
            first = np.zeros(len(ids), bool)
            first[np.cumsum(size) - size] = True
            last = np.append(first[1:], True)
            weight = np.repeat(c, size)
            inner = ~first
            pairs = ids[:-1][inner[1:]] * 65536 + ids[1:][inner[1:]]
            parts = [(STARTS, ids[first], c), (TYPES, ids[first], None), (INNER, ids[inner], None), (INNER_TOKENS, ids[inner], weight[inner]), (PAIRS, pairs, None), (LAST, ids[last], None), (VARIANTS, np.minimum(kinds, BYTES), None), (TIMES, np.minimum(c, 3), None)]
            out = []
            for kind, keys, w in parts:
                keys, at = np.unique(keys, return_inverse=True)
                out.append((np.full(len(keys), kind, np.int32), keys, np.bincount(at, w, len(keys)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["kind", "key", "n"])

    return words.select("c", "ids", "kind").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


# --- documents as ids ---------------------------------------------------------------------------------------------------------------------------------


class Heads:
    """The most frequent words, by number in flat arrays: counts, ids and variants.  One number more stands for all other words."""

    def __init__(self, words: Sequence[bytes] = (), counts=(), ids: Sequence[bytes] = (), kinds=()):
        size = np.array(list(map(len, words)), np.int32)
        at = (np.cumsum(size + 1) - size - 1).astype(np.int32)
        data = np.frombuffer(b" ".join(words), np.uint8)
        keys = hashes(data, at, at + size) if words else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        alike = np.zeros(len(words) + 1, bool)
        alike[1:-1] = keys[order][1:] == keys[order][:-1]
        alike = alike[1:] | alike[:-1]
        #: Words whose hash another one has as well; they are not found.
        self.excluded = [words[i] for i in order[alike].tolist()]
        order = order[~alike]
        self.held = Held()
        self.held.keys, self.held.numbers, self.held.bytes, self.held.at, self.held.size = keys[order], order.astype(np.int32), data, at, size
        self.n = len(words)
        self.counts = np.append(np.asarray(counts, np.int64), 0)
        self.logs = np.log10(self.counts + 1.0)
        self.kinds = np.asarray(kinds, np.int64)
        self.ids, self.sizes = np.frombuffer(b"".join(ids), "<u2"), np.array(list(map(len, ids)), np.int64) // 2
        self.ids_at = np.cumsum(self.sizes) - self.sizes
        self.first, self.last = (np.append(self.ids[k], np.uint16(0)) for k in (self.ids_at, self.ids_at + self.sizes - 1))

    def find(self, joined: bytes, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Numbers of segments with these hashes."""
        out = np.full(len(keys), self.n, np.int64)
        here, numbers = self.held.find(keys, np.frombuffer(joined, np.uint8), starts, ends - starts)
        out[here] = numbers
        return out

    def numbers(self, words: list[bytes], most: int = 50_000) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        for k in range(0, len(words), most):
            part = words[k : k + most]
            ends = np.cumsum([len(w) + 1 for w in part]) - 1
            starts, joined = ends - np.array(list(map(len, part))), b" ".join(part)
            out.append(self.find(joined, starts, ends, hashes(np.frombuffer(joined, np.uint8), starts, ends)))
        return np.concatenate(out)


def prepared(own: DataFrame, path: str, shared: Broadcast, n_shards: int) -> DataFrame:
    """For each row: doc_id, held_out, n_tokens; n_known and sums (of log10(c + 1)) over the head's words; low and high: the number of each word in the head in 16 and 8 bits; of
    the other words in order ends (their first and last ids), ids, sizes (ids of each) and variants, packed; rest: these words, and how many there are of each; and the training
    shard (null: held out).  shared: Heads, or nothing."""

    def run(batches):
        heads = shared.value or Heads()
        for part in slices(batches, "text", 1 << 20):
            keys, texts = part.column(0).to_pylist(), [t.translate(UPPER) for t in utf8(part.column(1))]
            if sum(map(len, texts)) <= MOST:
                joined, starts, ends, hashed, at, n_words = distinct_segments(texts)
                number = heads.find(joined, starts, ends, hashed)
                free = np.flatnonzero(number == heads.n)
                words = [joined[a:b] for a, b in zip(starts[free].tolist(), ends[free].tolist())]
            else:
                words, at, n_words = distinct_words(texts)
                number = heads.numbers(words)
                free = np.flatnonzero(number == heads.n)
                words = list(map(words.__getitem__, free.tolist()))
            ids, sizes = ids_of(words, path, True)
            place = np.zeros(len(number), np.int64)
            place[free] = np.arange(len(free))
            number = number[at]
            to = np.cumsum(n_words)
            ahead = to - n_words
            known = number < heads.n
            logs = np.append(0, np.cumsum(heads.logs[number]))
            n_known = np.append(0, np.cumsum(known))
            others = np.flatnonzero(~known)  # the words that are not in the head
            at = place[at[others]]
            text = np.repeat(np.arange(len(texts)), n_words)[others]
            n_others = n_words - (n_known[to] - n_known[ahead])
            others_to = np.cumsum(n_others)
            own_size = sizes[at]
            begin, until = np.cumsum(sizes) - sizes, np.cumsum(own_size)
            every = ids[span(begin[at], own_size)]
            both = np.stack([ids[begin], ids[begin + sizes - 1]], 1)[at] if len(at) else np.zeros((0, 2))
            kind = variants(words)[at]
            pair, n = np.unique(text * (len(words) + 1) + at, return_counts=True)
            rest = pa.StructArray.from_arrays([pa.array(list(map(words.__getitem__, (pair % (len(words) + 1)).tolist())), pa.binary()), pa.array(n, pa.int64())], ["word", "n"])
            offsets = np.append(0, np.cumsum(np.bincount(pair // (len(words) + 1), minlength=len(texts))))

            def cut(x: np.ndarray, ends: np.ndarray) -> pa.Array:
                return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((np.append(0, ends) * x.itemsize).astype(np.int32)), pa.py_buffer(x.tobytes())])

            def packs(x: np.ndarray) -> pa.Array:
                if not len(x) or x.max() < 256:
                    return cut(x.astype(np.uint8), others_to)
                return pa.array([packed(x[a:b], "<u4") for a, b in zip((others_to - n_others).tolist(), others_to.tolist())], pa.binary())

            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(map(held_out, keys), pa.bool_()),
                    pa.array(n_words + 1, pa.int64()),
                    pa.array(n_known[to] - n_known[ahead], pa.int64()),
                    pa.array(logs[to] - logs[ahead], pa.float64()),
                    cut((number & 65535).astype("<u2"), to),
                    cut((number >> 16).astype(np.uint8), to),
                    cut(both.astype("<u2").ravel(), 2 * others_to),
                    cut(every.astype("<u2"), np.append(0, until)[others_to]),
                    packs(own_size),
                    packs(kind),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rest),
                    *part.columns[2:],
                ],
                NAMES,
            )

    h = F.xxhash64("doc_id", "text")
    rows = own.select("doc_id", "text", h.alias("h"))
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, sums double, low binary, high binary, ends binary, ids binary, sizes binary, variants binary, rest array<struct<word:binary,n:long>>, h long")
    return out.withColumn("row", F.monotonically_increasing_id()).withColumn("shard", F.when(~F.col("held_out"), F.pmod("h", F.lit(n_shards * ROUNDS)))).withColumn("round", F.coalesce(F.col("shard") % ROUNDS, F.lit(-1)).cast("int"))


NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "sums", "low", "high", "ends", "ids", "sizes", "variants", "rest", "h"]


def numbered(low: list[bytes], high: list[bytes]) -> np.ndarray:
    """Numbers of words in the head, from prepared()."""
    return np.frombuffer(b"".join(low), "<u2") + (np.frombuffer(b"".join(high), np.uint8).astype(np.int64) << 16)


def whole(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """Rows of prepared() with ids, sizes, counts (0: not in the head) and variants of all words."""

    def run(batches):
        heads = shared.value
        at = NAMES.index
        for batch in batches:
            low, high, ids, sizes, kinds = (batch.column(at(n)).to_pylist() for n in ("low", "high", "ids", "sizes", "variants"))
            out = []
            for x in zip(low, high, ids, sizes, kinds):
                number = numbered(x[:1], x[1:2])
                known = number < heads.n
                n = np.array([len(number) - known.sum()])
                size, kind = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
                own = number[known]
                size[known], kind[known] = heads.sizes[own], heads.kinds[own]
                size[~known], kind[~known] = unpacked([x[3]], n, "<u4"), unpacked([x[4]], n, "<u4")
                every, inside = np.empty(int(size.sum()), "<u2"), np.repeat(known, size)
                every[inside], every[~inside] = heads.ids[span(heads.ids_at[own], heads.sizes[own])], np.frombuffer(x[2], "<u2")
                out.append((every.tobytes(), packed(size, "<u4"), heads.counts[number].astype("<f4").tobytes(), packed(kind, "<u4")))
            names = [n for n in batch.schema.names if n not in ("ids", "sizes", "variants")]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), *(pa.array([x[k] for x in out], pa.binary()) for k in range(4))], [*names, "ids", "sizes", "counts", "variants"])

    names = [n for n in rows.columns if n not in ("ids", "sizes", "variants")]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, ", ".join([*(f"{n} {kinds[n]}" for n in names), "ids binary, sizes binary, counts binary, variants binary"]))


class Texts:
    """Texts as flat arrays: the words' ids, and for each token (words and ends) where it stands in blocks of STRIDE."""

    def __init__(self, ids: list[bytes], sizes: list[bytes], n_words: np.ndarray):
        self.ids = np.frombuffer(b"".join(ids), "<u2").astype(np.int64)
        self.sizes = unpacked(sizes, n_words, "<u4")
        self.at = np.cumsum(self.sizes) - self.sizes
        self._place(self.ids[self.at], self.ids[self.at + self.sizes - 1], n_words)

    @classmethod
    def by_ends(cls, low: list[bytes], high: list[bytes], ends: list[bytes], n_words: np.ndarray, heads: Heads) -> Texts:
        """Rows of prepared(): without ids but for the first and the last of each word, and with the words' numbers."""
        self = cls.__new__(cls)
        self.number = numbered(low, high)
        first, last = heads.first[self.number].astype(np.int64), heads.last[self.number].astype(np.int64)
        self.others = np.flatnonzero(self.number == heads.n)
        both = np.frombuffer(b"".join(ends), "<u2")
        first[self.others], last[self.others] = both[::2], both[1::2]
        self._place(first, last, n_words)
        return self

    def _place(self, first: np.ndarray, last: np.ndarray, n_words: np.ndarray) -> None:
        self.first, self.last, self.n_words = first, last, n_words
        n_tokens = self.n_words + 1
        self.starts = np.cumsum(n_tokens) - n_tokens
        self.is_end = np.zeros(int(n_tokens.sum()), bool)
        self.is_end[self.starts + self.n_words] = True
        blocks = -(-n_tokens // STRIDE)
        begin = np.cumsum(blocks) - blocks
        self.n_blocks = int(blocks.sum())
        self.place = np.arange(len(self.is_end)) + np.repeat(begin * STRIDE - self.starts, n_tokens)
        self.opens = np.zeros(self.n_blocks, bool)
        self.opens[begin] = True

    def targets(self, cls: np.ndarray) -> np.ndarray:
        """Class of each token."""
        out = np.full(len(self.is_end), cls[END], np.int64)
        out[~self.is_end] = cls[self.first]
        return out

    def inputs(self) -> np.ndarray:
        """(blocks, STRIDE): for each place the number of the word before its token, from 0; n words: the text's start; n + 1: no token."""
        n = len(self.first)
        before = np.full(len(self.is_end), n, np.int64)
        inner = np.ones(len(before), bool)
        inner[self.starts] = False
        before[inner] = np.arange(n)  # the tokens behind a text's first come behind its words, one by one
        out = np.full(self.n_blocks * STRIDE, n + 1, np.int64)
        out[self.place] = before
        return out.reshape(-1, STRIDE)

    def blocks(self, per_token: np.ndarray, fill) -> np.ndarray:
        out = np.full(self.n_blocks * STRIDE, fill, per_token.dtype)
        out[self.place] = per_token
        return out.reshape(-1, STRIDE)

    def vectors(self, compact: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The mean of the vectors of each word's first and last ids; then the start's, and zero."""
        out = np.empty((len(self.first) + 2, table.shape[1]), np.float32)
        out[:-2] = np.take(table, compact[self.first], axis=0)
        out[:-2] += np.take(table, compact[self.last], axis=0)
        out[:-2] /= 2
        out[-2], out[-1] = table[TOP + 1], 0
        return out


def neighbours(rows: DataFrame, compact: np.ndarray, shared: Broadcast) -> np.ndarray:
    """How often a token that starts with b comes behind a word whose first or last id is a: (a, b) are compact numbers; a = TOP + 1 is the text's start, b = TOP + 1 its end."""
    size = TOP + 2

    def run(batches):
        total = np.zeros(size * size, np.int64)
        for part in slices(batches, "low", 1 << 20):
            t = Texts.by_ends(*(part.column(i).to_pylist() for i in range(3)), part.column(3).to_numpy() - 1, shared.value)
            token = np.full(len(t.is_end), TOP + 1, np.int64)
            token[~t.is_end] = compact[t.first]
            behind = token[np.flatnonzero(~t.is_end) + 1]
            for a in (t.first, t.last):
                total += np.bincount(compact[a] * size + behind, minlength=len(total))
            total += np.bincount((TOP + 1) * size + token[t.starts], minlength=len(total))
        keys = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total[keys])], ["key", "n"])

    found = rows.select("low", "high", "ends", "n_tokens").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # at most size**2 rows
    out = np.zeros(size * size)
    out[found["key"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(size, size)


def directions(counts: np.ndarray, d: int) -> np.ndarray:
    """Rows of counts in the main directions of the roots of their shares."""
    x = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    sign = np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
    return (u * np.where(sign == 0, 1, sign))[:, :d] * s[:d]


def clusters(before: np.ndarray, weight: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """k-means of ids by the distribution of what comes before them."""
    x = directions(before, 24)
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), n, replace=False, p=(weight + 1) / (weight + 1).sum())]
    for _ in range(30):
        own = ((x[:, None, :] - centre[None]) ** 2).sum(2).argmin(1)
        for k in range(n):
            if (own == k).any():
                centre[k] = np.average(x[own == k], axis=0, weights=weight[own == k] + 1)
    return own


# --- the attention ------------------------------------------------------------------------------------------------------------------------------------


def added(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, which stays; a product with ones is faster than a sum."""
    return x @ np.ones((x.shape[-1], 1), x.dtype)


def tanh(x: np.ndarray) -> np.ndarray:
    """In place, by exponents: faster than numpy's, and as close as the numbers are to one."""
    x *= 2
    np.exp(np.clip(x, -80, 80, out=x), out=x)
    x += 1
    np.divide(-2, x, out=x)
    x += 1
    return x


class Attention:
    """One causal head over the tokens of a block and of the block before it: queries, keys, values and a residual of word vectors, a bias for each distance, and a
    softmax over classes."""

    NAMES = ("q", "k", "v", "r", "lag", "b", "out", "share")

    def __init__(self, share: np.ndarray, seed: int = 1):
        """share: log shares of the classes, where learning starts."""
        rng, d = np.random.default_rng(seed), WIDTH
        small = lambda *shape: (rng.normal(size=shape) * d**-0.5).astype(np.float32)
        self.p = {"q": small(d, d), "k": small(d, d), "v": small(d, d), "r": small(d, d), "lag": np.zeros(2 * STRIDE, np.float32), "b": np.zeros(d, np.float32), "out": small(d, len(share)) * 0.3, "share": share.astype(np.float32)}
        self.far = np.arange(STRIDE)[:, None] + STRIDE - np.arange(2 * STRIDE)[None]  # how far a key lies behind a query; negative: ahead
        self.seen = (self.far >= 0).astype(np.float32)

    def _scores(self, e: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Of classes, in rows, and what the gradient needs.  Exponents are kept in range by clipping."""
        p, n, d = self.p, len(e), WIDTH
        flat, c = e.reshape(-1, d), np.ascontiguousarray(e[:, STRIDE:]).reshape(-1, d)
        kv = (flat @ np.concatenate([p["k"], p["v"]], 1)).reshape(n, 2 * STRIDE, 2 * d)
        qr = c @ np.concatenate([p["q"] * np.float32(d**-0.5), p["r"]], 1)
        q, k, v = qr[:, :d].reshape(n, STRIDE, d), kv[:, :, :d], kv[:, :, d:]
        a = q @ k.transpose(0, 2, 1)
        a += p["lag"][np.maximum(self.far, 0)]
        np.exp(np.clip(a, -60, 60, out=a), out=a)
        a *= self.seen
        a[opens, :, :STRIDE] = 0
        a /= added(a)
        h = (a @ v).reshape(-1, d)
        h += qr[:, d:]
        h += p["b"]
        o = tanh(h) @ p["out"]
        o += p["share"]
        return np.clip(o, -80, 80, out=o), (flat, c, q, k, v, a, h)

    def forward(self, e: np.ndarray, opens: np.ndarray):
        """e: (n, 2 * STRIDE, WIDTH) word vectors; opens: which blocks have none before them.  Log probabilities of classes for the last STRIDE places, and what they
        come from."""
        o, inner = self._scores(e, opens)
        o -= np.log(added(np.exp(o)))
        return o.reshape(len(e), STRIDE, -1), inner

    def gradient(self, e: np.ndarray, opens: np.ndarray, target: np.ndarray, real: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log probability of the real targets."""
        p, n, d, (rows, (flat, c, q, k, v, a, h)) = self.p, len(e), WIDTH, self._scores(e, opens)
        np.exp(rows, out=rows)
        rows /= added(rows)
        rows.reshape(-1)[np.arange(0, rows.size, rows.shape[1]) + target.ravel()] -= 1
        if not real.all():
            rows[~real.ravel()] = 0
        g = {"out": h.T @ rows, "share": np.ones(len(rows), rows.dtype) @ rows}
        z = rows @ p["out"].T
        h *= h
        z *= np.subtract(1, h, out=h)
        g["b"] = np.ones(len(z), z.dtype) @ z
        z3, back = z.reshape(n, STRIDE, d), a.transpose(0, 2, 1)
        dkv, dqz = np.empty((n, 2 * STRIDE, 2 * d), z.dtype), np.empty((n, STRIDE, 2 * d), z.dtype)
        np.matmul(back, z3, out=dkv[:, :, d:])
        ds = z3 @ v.transpose(0, 2, 1)
        ds -= added(a * ds)
        ds *= a
        g["lag"] = np.bincount(self.far[self.far >= 0], (np.ones(n, ds.dtype) @ ds.reshape(n, -1)).reshape(self.far.shape)[self.far >= 0], 2 * STRIDE).astype(z.dtype)
        np.matmul(ds.transpose(0, 2, 1), q, out=dkv[:, :, :d])
        np.matmul(ds, k, out=dqz[:, :, :d])
        dqz[:, :, d:] = z3
        both = c.T @ dqz.reshape(-1, 2 * d)
        g["q"], g["r"] = both[:, :d] * np.float32(d**-0.5), both[:, d:]
        both = flat.T @ dkv.reshape(-1, 2 * d)
        g["k"], g["v"] = both[:, :d], both[:, d:]
        share = z.dtype.type(1 / max(real.sum(), 1))
        return {name: x * share for name, x in g.items()}

    def log_p(self, vectors: np.ndarray, inputs: np.ndarray, opens: np.ndarray, target: np.ndarray, most: int = 128) -> np.ndarray:
        """Log probabilities of target classes, block by block: forward() with what depends on one word alone computed once for each vector."""
        p, d, n = self.p, WIDTH, len(inputs)
        vectors = vectors @ np.concatenate([p["q"] * np.float32(d**-0.5), p["r"], p["k"], p["v"]], 1)
        vectors[:, d : 2 * d] += p["b"]
        lag = p["lag"][np.maximum(self.far, 0)]
        out = np.empty((n, STRIDE), np.float32)
        for at in range(0, n, most):
            to = min(n, at + most)
            x = np.take(vectors, inputs[np.maximum(np.arange(at - 1, to), 0)], axis=0)  # with the block before, for its keys and values
            own = x[1:]
            both = as_strided(x, (to - at, 2 * STRIDE, 4 * d), x.strides, writeable=False)  # each block with the one before it
            a = own[:, :, :d] @ both[:, :, 2 * d : 3 * d].transpose(0, 2, 1)
            a += lag
            np.exp(np.clip(a, -60, 60, out=a), out=a)
            a *= self.seen
            a[opens[at:to], :, :STRIDE] = 0
            h = a @ both[:, :, 3 * d :]
            h /= added(a)
            h += own[:, :, d : 2 * d]
            o = tanh(h).reshape(-1, d) @ p["out"]
            o += p["share"]
            np.clip(o, -80, 80, out=o)
            mine = o.reshape(-1)[np.arange(0, o.size, o.shape[1]) + target[at:to].ravel()]
            out[at:to] = (mine - np.log(added(np.exp(o, out=o))[:, 0])).reshape(-1, STRIDE)
        return out

    def raw(self) -> bytes:
        return b"".join(self.p[n].astype("<f4").tobytes() for n in self.NAMES)

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            size = self.p[n].size
            self.p[n] = flat[at : at + size].reshape(self.p[n].shape).astype(np.float32)
            at += size


class Adam:
    """All parameters are moved as one vector, of which the model's are views."""

    def __init__(self, model: Attention, step: float = STEP):
        self.step, self.t = step, 0
        self.flat = np.concatenate([model.p[n].ravel() for n in model.NAMES])
        self.names, at = model.NAMES, 0
        for n in self.names:
            size = model.p[n].size
            model.p[n], at = self.flat[at : at + size].reshape(model.p[n].shape), at + size
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)

    def __call__(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        x = np.concatenate([g[n].ravel() for n in self.names])
        self.m += np.float32(0.1) * (x - self.m)
        self.v += np.float32(0.01) * (x * x - self.v)
        self.flat -= np.float32(self.step / (1 - 0.9**self.t)) * self.m / (np.sqrt(self.v / np.float32(1 - 0.99**self.t)) + np.float32(1e-8))


class Model:
    """The attention, the classes, words' shares within classes, and spellings."""

    def __init__(self, counts: dict[int, tuple[np.ndarray, np.ndarray]], n_ends: int):
        """counts: for each kind of subword_counts() but pairs, keys and numbers."""

        def dense(kind: int, size: int = IDS) -> np.ndarray:
            out = np.zeros(size)
            keys, n = counts.get(kind, ([], []))
            out[keys] = n
            return out

        self.starts, self.types, self.inner, self.last = dense(STARTS), dense(TYPES), dense(INNER), dense(LAST)
        self.starts[END] = n_ends
        times, kinds = dense(TIMES, 4), dense(VARIANTS, 3)
        self.discount = float(np.clip(times[1] / (times[1] + 2 * times[2]) if times[1] else 0.5, 0.1, 0.9))
        self.log_variant = np.log((kinds + 1) / (kinds + 1).sum())
        tokens = self.starts + dense(INNER_TOKENS)
        tokens[END] = 0
        self.top = np.argsort(-tokens, kind="stable")[:TOP]
        self.compact = np.full(1 << 16, TOP, np.int64)  # all other ids
        self.compact[self.top] = np.arange(TOP)
        self.often = np.argsort(-(self.types + self.inner), kind="stable")[:TOP]  # whose pairs are told apart

    def set_pairs(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        """Spellings: P(stop | id), and P(id | id before it, no stop) by pairs of the ids that occur in most words."""
        total = self.types + self.inner
        stops = self.last.sum() / max(total.sum(), 1) if total.sum() else 0.5
        p_stop = (self.last + BETA * stops) / (total + BETA)
        p_stop = np.clip(p_stop, 1e-6, 1 - 1e-6)
        self.log_stop, self.log_go = np.log(p_stop), np.log1p(-p_stop)
        share = self.inner + FLOOR
        share /= share.sum()
        self.slot = np.full(1 << 16, TOP, np.int64)
        self.slot[self.often] = np.arange(TOP)
        seen = np.zeros((TOP, TOP))
        seen[self.slot[a], self.slot[b]] = n
        more = (total - self.last)[self.often]
        own, others = share[self.often], 1 - share[self.often].sum()
        table = np.zeros((TOP + 1, TOP + 1))
        table[:TOP, :TOP] = np.log((seen + BETA * own) / (more + BETA)[:, None])
        table[:TOP, TOP] = np.log((np.maximum(more - seen.sum(1), 0) + BETA * others) / (more + BETA)) - np.log(others)
        table[TOP, :TOP] = np.log(own)
        self.table, self.log_other = table, np.where(self.slot[:IDS] == TOP, np.log(share), 0.0)

    def set_classes(self, follows: np.ndarray) -> None:
        """Classes of first ids, and vectors of all ids, from neighbours()."""
        self.cls = np.full(1 << 16, CLASSES - 1, np.int64)
        self.cls[self.top] = clusters(follows[:, :TOP].T, self.starts[self.top], CLASSES - 2)
        self.cls[END] = CLASSES - 2
        cls = self.cls[:IDS]
        first = self.types + FLOOR
        self.log_first = np.log(first / np.bincount(cls, first, CLASSES)[cls])
        tokens, types = np.bincount(cls, self.starts, CLASSES), np.bincount(cls, self.types, CLASSES)
        self.log_tokens = np.log(np.maximum(tokens, 1))
        #: The mass of words by their spelling.
        self.log_free = np.log(np.where(tokens > 0, np.maximum(self.discount * types / np.maximum(tokens, 1), 1e-300), 1.0))
        x = directions(follows, WIDTH)
        weight = follows.sum(1) + 1e-9
        x = x - np.average(x, axis=0, weights=weight)
        x /= np.sqrt(np.average(x * x, axis=0, weights=weight)) + 1e-3
        self.vectors = (np.clip(x, -4, 4) * (follows.sum(1) > 0)[:, None]).astype(np.float32)
        self.attention = Attention(np.log((tokens + 1) / (tokens + 1).sum()))

    def spelling(self, t: Texts, kinds: np.ndarray) -> np.ndarray:
        """log P(spelling | class) of each word."""
        steps = np.zeros(len(t.ids))
        if len(t.ids) > 1:
            a, b = t.ids[:-1], t.ids[1:]
            steps[1:] = self.table[self.slot[a], self.slot[b]] + self.log_go[a] + self.log_other[b]
        steps[t.at] = self.log_first[t.first]
        out = np.add.reduceat(steps, t.at) if len(t.at) else np.zeros(0)
        out += self.log_stop[t.last] + self.log_variant[np.minimum(kinds, BYTES)]
        return out - math.log(257) * np.maximum(kinds - BYTES + 1, 0)  # by their bytes, with an end

    def within(self, t: Texts, counts: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """log P(word | class)."""
        cls = self.cls[t.first]
        out = self.log_free[cls] + spelled
        known = counts > 0
        out[known] = np.logaddexp(out[known], np.log(counts[known] - self.discount) - self.log_tokens[cls[known]])
        return out

    def log_class(self, t: Texts) -> np.ndarray:
        """log P(class | what comes before) of each token."""
        out = self.attention.log_p(t.vectors(self.compact, self.vectors), t.inputs(), t.opens, t.blocks(t.targets(self.cls), 0))
        return out.ravel()[t.place].astype(float)


def trained(model: Model, rows: DataFrame, n_shards: int, heads: Broadcast) -> None:
    """Rounds of Adam on shards; then the parameters' average, weighted by tokens.  A token is a target once in all rounds."""
    spark = rows.sparkSession
    compact, cls, table = model.compact, model.cls, model.vectors

    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model.attention)
        step = STEP / (k + 1)

        def run(batches, shared=shared, step=step):
            shard = own = adam = None
            seen = 0
            forget()

            def done():
                return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([seen], pa.int64()), pa.array([own.raw()], pa.binary())], ["shard", "seen", "raw"])

            for part in slices(batches, "low", 1 << 19):
                shards = part.column(3).to_numpy()
                edges = np.flatnonzero(np.diff(shards, prepend=-1, append=-1))
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    if shards[a] != shard:
                        if own is not None:
                            yield done()
                        shard, own, seen = int(shards[a]), Attention(shared.value.p["share"]), 0
                        own.p = {n: x.copy() for n, x in shared.value.p.items()}
                        adam = Adam(own, step)
                    t = Texts.by_ends(*(part.column(i).slice(a, b - a).to_pylist() for i in range(3)), part.column(4).slice(a, b - a).to_numpy() - 1, heads.value)
                    vectors, inputs = t.vectors(compact, table), t.inputs()
                    target, real = t.blocks(t.targets(cls), 0), t.blocks(np.ones(len(t.is_end), bool), False)
                    # Blocks in an order that mixes texts, by a fixed stride.
                    order = np.random.default_rng(1).permutation(len(inputs))
                    for at in range(0, len(order), BATCH):
                        i = order[at : at + BATCH]
                        both = np.concatenate([inputs[np.maximum(i - 1, 0)], inputs[i]], 1)
                        adam(own.gradient(np.take(vectors, both, axis=0), t.opens[i], target[i], real[i]))
                    seen += len(t.is_end)
            if own is not None:
                yield done()

        of_round = rows.where(F.col("round") == k).select("low", "high", "ends", "shard", "n_tokens", "h").repartition(n_shards, "shard").sortWithinPartitions("shard", "h")
        found = of_round.select("low", "high", "ends", "shard", "n_tokens").mapInArrow(run, "shard long, seen long, raw binary").collect()  # at most MOST_SHARDS models of a few kilobytes
        if found:
            found = sorted(found, key=lambda r: r["shard"])
            weight = np.array([r["seen"] for r in found], float)
            model.attention.load(np.average(np.stack([np.frombuffer(bytes(r["raw"]), "<f4").astype(np.float64) for r in found]), axis=0, weights=weight))
        shared.unpersist()


def shards(n_tokens: int) -> int:
    """Shards of a round."""
    return max(1, min(MOST_SHARDS, -(-n_tokens // (SHARD * ROUNDS))))


def counted(own: DataFrame, path: str, base: str) -> tuple[Model, DataFrame, DataFrame, dict]:
    """A model without attention, (word, c) of the training words, their ids, and the numbers of distinct (v) and all (n) training tokens.  own: (doc_id, text)."""
    vocabulary = written(word_counts(own), f"{base}/words")
    words = written(spelt(vocabulary, path), f"{base}/spelt")
    counts = written(subword_counts(words), f"{base}/subwords")
    single = counts.where(F.col("kind") != PAIRS).toArrow().to_pandas()  # at most 5 * IDS rows and some
    ends = vocabulary.where("octet_length(word) = 0").first()
    model = Model({int(k): (g["key"].to_numpy(), g["n"].to_numpy()) for k, g in single.groupby("kind")}, ends["c"] if ends else 0)
    often = [int(k) for k in model.often]
    pairs = counts.where(F.col("kind") == PAIRS).select(F.shiftright("key", 16).alias("a"), F.col("key").bitwiseAND(F.lit(65535)).alias("b"), "n").where(F.col("a").isin(often) & F.col("b").isin(often)).toArrow()  # at most TOP**2 rows
    model.set_pairs(*(pairs[c].to_numpy() for c in "abn"))
    return model, vocabulary, words, vocabulary.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first().asDict()


def head(words: DataFrame, most: int | None = None) -> tuple[Heads, int]:
    """The most frequent words with their counts, at most `most` (HEAD), and the least count among them: words of that count or more are all there.  words: spelt()."""
    level = F.floor(F.log2("c") * 8).cast("int")
    left, least = HEAD if most is None else most, None
    for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("level")).collect():  # a few hundred levels
        if r["n"] > left:
            break
        left, least = left - r["n"], r["least"]
    if least is None:
        return Heads(), 1 << 62
    rows = words.where(F.col("c") >= least).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    if len(rows) >= 1 << 24:
        raise ValueError("numbers of words do not fit 24 bits")
    return Heads(rows["word"].to_pylist(), rows["c"].to_numpy(), rows["ids"].to_pylist(), rows["kind"].to_numpy()), least


def fitted(own: DataFrame, path: str, base: str) -> tuple[Model, DataFrame, DataFrame, dict, int, Broadcast]:
    """The model, all rows as prepared() has them, (word, c, ids, kind) of the training words, their totals, the least count of the words in the head, and the head."""
    model, _, words, totals = counted(own, path, base)
    heads, least = head(words)
    shared = own.sparkSession.sparkContext.broadcast(heads)
    n_shards = shards(totals["n"])
    prepared(own, path, shared, n_shards).write.mode("overwrite").partitionBy("round").parquet(f"{base}/rows")
    rows = own.sparkSession.read.schema(SCHEMA).parquet(f"{base}/rows")
    training = rows.where("round >= 0")
    model.set_classes(neighbours(training, model.compact, shared))
    trained(model, training, n_shards, shared)
    return model, rows, words, totals, least, shared


def learned(own: DataFrame, path: str, base: str) -> tuple[Model, DataFrame, DataFrame, dict, int, int]:
    """The model, all rows as ids, (word, c, ids, kind) of the training words, their totals, the least count of the words that rows hold the counts of, and the number of
    training documents."""
    model, rows, words, totals, least, shared = fitted(own, path, base)
    return model, whole(rows, shared), words, totals, least, int(model.starts[END])


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, sums double, low binary, high binary, ends binary, ids binary, sizes binary, variants binary, rest array<struct<word:binary,n:long>>, h long, row long, shard long, round int"


def scores(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, for each row."""
    spark = docs.sparkSession
    base = scratch(spark, "lm")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model, rows, words, totals, least, known = fitted(own, path, base)
    n_ends, heads = int(model.starts[END]), known.value
    t = Texts([heads.ids.tobytes()], [packed(heads.sizes, "<u4")], np.array([heads.n]))
    # log P(word | class) of the head's words.
    shared = spark.sparkContext.broadcast((model, np.append(model.within(t, heads.counts[:-1].astype(float), model.spelling(t, heads.kinds)), 0)))

    def run(batches):
        lm, log_word = shared.value
        forget()
        for part in slices(batches, "low", 1 << 18):
            low, high, ends, ids, sizes, kinds = (part.column(i).to_pylist() for i in range(6))
            t = Texts.by_ends(low, high, ends, part.column(6).to_numpy() - 1, known.value)
            log_p, own = lm.log_class(t), log_word[t.number]
            n = np.array(list(map(len, ends))) // 4
            others = Texts(ids, sizes, n)
            own[t.others] = lm.within(others, np.zeros(len(t.others)), lm.spelling(others, unpacked(kinds, n, "<u4")))
            log_p[~t.is_end] += own
            yield pa.RecordBatch.from_arrays([part.column(7), pa.array(np.add.reduceat(log_p, t.starts) / math.log(10))], ["row", "score"])

    def spelled(batches):
        for batch in batches:
            if batch.num_rows:
                raw = batch.column(2).to_pylist()
                t = Texts([b"".join(raw)], [packed(np.array(list(map(len, raw))) // 2, "<u4")], np.array([len(raw)]))
                lm = shared.value[0]
                cls = lm.cls[t.first]
                p = lm.spelling(t, batch.column(3).to_numpy()) + lm.log_free[cls] + lm.log_tokens[cls]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p)], ["word", "c", "p"])

    scored = written(rows.select("low", "high", "ends", "ids", "sizes", "variants", "n_tokens", "row").mapInArrow(run, "row long, score double"), f"{base}/scored")
    # What the share adds to a spelled word: log(1 + share / spelled), for exponents of any size.
    rare = words.where((F.col("c") < least) | F.col("word").isin(heads.excluded)).mapInArrow(spelled, "word binary, c long, p double")
    ahead = F.log(F.col("c") - model.discount) - F.col("p")
    gain = (F.greatest(ahead, F.lit(0.0)) + F.log1p(F.exp(-F.abs(ahead)))) / math.log(10)
    rare = rows.select("row", F.explode("rest").alias("x")).select("row", "x.word", "x.n").join(rare.select("word", "c", gain.alias("gain")), "word")
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"), F.sum("n").alias("more_known"), F.sum(F.col("n") * F.col("gain")).alias("gain"))
    log_all = math.log10(totals["n"] + totals["v"] + 1)
    log_end = math.log10(n_ends + 1)
    out = rows.select("row", "doc_id", "held_out", "n_tokens", "n_known", "sums").join(scored, "row").join(rare, "row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(n_ends > 0))).cast("long").alias("n_known"),
        F.lit(totals["n"]).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce("more", F.lit(0.0)) + F.lit(log_end) - F.col("n_tokens") * log_all).alias("base_score"),
        (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )

