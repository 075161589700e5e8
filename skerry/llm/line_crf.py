"""Document quality from a linear-chain conditional random field over lines.

Every line of a document is labelled good or bad.  A line's features are shares of character classes, its length, repeated words and repeated lines; its
emission also sees the features of the lines before and behind it, and the chain has weights for pairs of neighbouring labels.  Training lines
take their document's label.  Forward-backward gives each line's probability of being good; their mean, weighted by line length, and a logistic
calibration on the training documents give the document's score.

The fit uses at most `most_docs` labelled rows, in the order of a hash of their doc_id and lines, and of a longer text a window of `most_lines` neighbouring lines, whose
start is a hash of its doc_id: documented bounds, which hold what meets at the driver below 30 MB.  Scoring covers whole texts.  Labels, lang, source and doc_id are no inputs of a score.

Defined cases: null and empty texts are one empty line; labels that are null or contradict each other are not learned from; without labels of both classes every
score is 0.5; repeated rows are kept one for one; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

MOST_DOCS, MOST_LINES, THRESHOLD = 4000, 100, 0.3
FOLDS, HELD_OUT = 5, 0
N_CLASSES = 10


def _classes() -> np.ndarray:
    out = np.full(256, 9, np.uint8)  # continuation bytes, control characters
    for k, members in enumerate([b" \t\x0b\x0c\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,;:'\"()-?", b"!", b"|", b"#*$%&<>@=_~^\\/{}[]+`"]):
        out[list(members)] = k
    out[192:] = 8  # first bytes of other characters
    return out


CLASSES = _classes()
#: Shares of nine classes, length, words, repeated words, repeated line, empty line, first line, last line.
N_OWN = 16


def line_features(texts: list[bytes], block: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts, each line's length in bytes, and the number of lines of each text."""
    counts_of_text = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    whole = np.frombuffer(b"\n".join(texts), np.uint8)
    n = int(counts_of_text.sum())
    counts = np.zeros((n, N_CLASSES), np.int64)
    line = 0
    for at in range(0, len(whole), block):
        part = whole[at : at + block]
        breaks = part == 10
        own = np.cumsum(breaks) - breaks
        last = int(own[-1] + breaks[-1])
        key = (own * N_CLASSES + CLASSES[part])[~breaks]
        counts[line : line + last + 1] += np.bincount(key, minlength=(last + 1) * N_CLASSES).reshape(-1, N_CLASSES)[: min(last + 1, n - line)]
        line += last
    length = counts.sum(1)
    n_words, repeated, again = np.zeros(n), np.zeros(n), np.zeros(n)
    k = 0
    for text in texts:
        seen = set()
        for own in text.split(b"\n"):
            words = own.split()
            if words:
                n_words[k], repeated[k] = len(words), 1 - len(set(words)) / len(words)
                again[k] = own in seen
                seen.add(own)
            k += 1
    ends = np.cumsum(counts_of_text)
    first, last = np.zeros(n), np.zeros(n)
    first[ends - counts_of_text] = 1
    last[ends - 1] = 1
    shares = counts[:, :9] / np.maximum(length, 1)[:, None]
    spread = np.sqrt(shares)  # small shares count
    out = np.column_stack([spread, np.log1p(length) / 5, np.log1p(n_words) / 3, repeated, again, length == 0, first, last])
    return out.astype(np.float32), length, counts_of_text


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A line's features, those of the lines before and behind it in its document (zero: none), and a constant."""
    ends = np.cumsum(counts)
    before, behind = np.zeros_like(own), np.zeros_like(own)
    before[1:], behind[:-1] = own[:-1], own[1:]
    before[ends - counts] = 0
    behind[ends - 1] = 0
    return np.column_stack([own, before, behind, np.ones(len(own), np.float32)])


class Chains:
    """Lines of many documents, in an order that lets one step work on all documents that are long enough."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        starts = (np.cumsum(counts) - counts)[order]
        longest = counts[order]
        active = np.searchsorted(-longest, -np.arange(longest[0] if len(longest) else 0), side="left")
        self.steps = [starts[:a] + t for t, a in enumerate(active)]

    def marginals(self, emission: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(label) of every line, expected label pairs, and the log of the partition function.  emission: (lines, 2); pair[a, b]: from a to b."""
        top = emission.max(1, keepdims=True) if len(emission) else emission
        e, p = np.exp(emission - top), np.exp(pair)
        forward, scale = np.empty_like(e), np.ones(len(e))
        for t, at in enumerate(self.steps):
            f = e[at] if t == 0 else (forward[self.steps[t - 1][: len(at)]] @ p) * e[at]
            scale[at] = s = f.sum(1)
            forward[at] = f / s[:, None]
        backward = np.ones_like(e)
        pairs = np.zeros((2, 2))
        for t in range(len(self.steps) - 1, 0, -1):
            at, before = self.steps[t], self.steps[t - 1][: len(self.steps[t])]
            right = e[at] * backward[at] / scale[at][:, None]
            pairs += p * (forward[before].T @ right)
            backward[before] = right @ p.T
        return forward * backward, pairs, float(np.log(scale).sum() + top.sum())


class Model:
    """Weights of emissions (features, 2 labels), of label pairs, and of the calibration; scaled is (mean, deviation) of the features."""

    def __init__(self, weights: np.ndarray, pair: np.ndarray, scaled: tuple[np.ndarray, np.ndarray], calibration: tuple[float, float]):
        self.weights, self.pair, self.scaled, self.calibration = weights, pair, scaled, calibration

    def quality(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Length-weighted mean of the lines' log odds of being good, per text, and the lines' probabilities."""
        own, length, counts = line_features(texts)
        return self.aggregated(own, length, counts)

    def aggregated(self, own: np.ndarray, length: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (with_neighbours(own, counts) - self.scaled[0]) / self.scaled[1]
        good = Chains(counts).marginals(x.astype(np.float64) @ self.weights, self.pair)[0][:, 1]
        weight = np.maximum(length, 1).astype(float)
        at = np.cumsum(counts) - counts
        mean = np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at) if len(counts) else np.zeros(0)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean)), good

    def scores(self, texts: list[bytes]) -> np.ndarray:
        a, b = self.calibration
        return 1 / (1 + np.exp(-(a * self.quality(texts)[0] + b)))


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one value, by Newton's method with a little regularisation."""
    w = np.array([1.0, 0.0])
    m = np.column_stack([x, np.ones_like(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        w -= np.linalg.solve(m.T @ (m * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), m.T @ (p - y) + 1e-2 * (w - [1, 0]))
    return float(max(w[0], 1e-3)), float(w[1])


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 120, rate: float = 0.1, ridge: float = 1e-3) -> Model:
    """rows: features and lengths of a document's lines, and its label.  Adam on the regularised log likelihood of the label sequences, a document counting
    by the root of its number of lines."""
    size = 3 * N_OWN + 1
    if len({y for *_, y in rows}) < 2:
        return Model(np.zeros((size, 2)), np.zeros((2, 2)), (np.zeros(size), np.ones(size)), (1.0, 0.0))
    counts = np.array([len(x) for x, *_ in rows])
    own, length = np.concatenate([x for x, *_ in rows]), np.concatenate([n for _, n, _ in rows])
    y = np.array([v for *_, v in rows])
    x = with_neighbours(own, counts).astype(np.float64)
    mean, deviation = x.mean(0), x.std(0)
    mean[-1], deviation = 0, np.where(deviation < 1e-6, 1, deviation)
    deviation[-1] = 1
    x = (x - mean) / deviation
    labels = np.repeat(y, counts)
    seen = np.zeros((len(x), 2))
    seen[np.arange(len(x)), labels] = 1
    seen_pairs = np.diag([float((counts - 1)[y == k].sum()) for k in (0, 1)])
    chains = Chains(counts)
    state = np.zeros(2 * size + 4)
    m, v = np.zeros_like(state), np.zeros_like(state)
    for k in range(1, rounds + 1):
        weights, pair = state[: 2 * size].reshape(size, 2), state[2 * size :].reshape(2, 2)
        p, pairs, _ = chains.marginals(x @ weights, pair)
        gradient = np.concatenate([(x.T @ (p - seen)).ravel(), (pairs - seen_pairs).ravel()]) / len(x) + ridge * state
        # Lines take their document's label, so label changes are never seen; a stronger pull keeps changes possible within a document.
        gradient[2 * size :] += 0.05 * state[2 * size :]
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        state = state - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    model = Model(state[: 2 * size].reshape(size, 2), state[2 * size :].reshape(2, 2), (mean, deviation), (1.0, 0.0))
    model.calibration = _calibrated(model.aggregated(own, length, counts)[0], y.astype(float))
    return model


def learned(docs: DataFrame, labels: DataFrame, most_docs: int = MOST_DOCS, most_lines: int = MOST_LINES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on labelled rows outside the held-out fold, at most most_docs of them."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    known = known.where(F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS != HELD_OUT)
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("id", "y")
    chosen = docs.sparkSession.createDataFrame(known.orderBy(F.xxhash64("id"), "id").limit(most_docs).collect(), "id long, y int")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("id", "y", "text")

    def run(batches):
        for part in slices(batches, "text"):
            rows = []
            for key, y, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), utf8(part.column(2))):
                own, length, _ = line_features([text])
                at = zlib.crc32(str(key).encode()) % max(1, len(own) - most_lines + 1)
                rows.append((key, y, own[at : at + most_lines].astype("<f4").tobytes(), length[at : at + most_lines].astype("<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["id", "y", "own", "length"])

    rows = texts.mapInArrow(run, "id long, y int, own binary, length binary")
    found = rows.orderBy(F.xxhash64("id", "own"), "id", "own").limit(most_docs).collect()  # a task keeps its first most_docs rows
    found = sorted((r["id"], r["y"], bytes(r["own"]), bytes(r["length"])) for r in found)
    return fit([(np.frombuffer(a, "<f4").reshape(-1, N_OWN), np.frombuffer(b, "<i8"), y) for _, y, a, b in found])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    def run(batches):
        for part in slices(batches, "text", 4 << 20):
            s = shared.value.scores(utf8(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    return own.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs without the rows whose score is below the threshold; columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(iter([batch.rename_columns([str(i) for i in range(batch.num_columns)])]), str(at), 4 << 20):
                s = shared.value.scores(utf8(part.column(at)))
                yield part.filter(pa.array(s >= threshold)).rename_columns(batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
