"""BPE automaton against the library; line CRF by its parts, planted lines and held-out accuracy."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from skerry.llm import bpe_automaton, line_crf
from skerry.llm.queries import tokenizer

SF = "/root/testdata/sf0.01"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))


def test_automaton_accepts_exactly_bpe():
    """On a small vocabulary: of all ways to split a word into tokens, the automaton has arcs for the merged one only."""
    merges = [(b"a", b"a"), (b"a", b"b"), (b"aa", b"aa"), (b"b", b"ab"), (b"aa", b"b")]
    labels = {bytes([b]): b for b in range(256)} | {a + b: 256 + i for i, (a, b) in enumerate(merges)}
    auto = bpe_automaton.Automaton(labels, merges)

    def merged(word):
        out = [bytes([b]) for b in word]
        for a, b in merges:
            i, new = 0, []
            while i < len(out):
                pair = out[i : i + 2] == [a, b]
                new.append(a + b if pair else out[i])
                i += 1 + pair
            out = new
        return [labels[x] for x in out]

    def ways(word):
        return [[labels[word[:i]], *rest] for i in range(1, len(word) + 1) if word[:i] in labels for rest in ways(word[i:])] if word else [[]]

    for n in range(1, 8):
        for word in map(bytes, itertools.product(b"ab", repeat=n)):
            accepted = [w for w in ways(word) if all(auto.follows(x, y) for x, y in itertools.pairwise(w))]
            assert accepted == [merged(word)]
            assert auto.encode(word) == merged(word)


def test_codec_equals_the_library():
    whole, own = library(), bpe_automaton.codec(tokenizer("byte_bpe_50k.json"))
    rnd = random.Random(2)
    parts = ["'s", "don't", " ", "  ", "the", "A", "É", "\n", "\x1c", "\x85", "<|endoftext|>", "12", "é", " ́", "!!", "½", "日", " ", "\x00", "aaaaaaa", "      ", "\t", "\xa0", "-----", "😀"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(9))) for _ in range(4000)] + ["x" * 5000, " " * 3000, "ab" * 4000]
    for text in texts:
        ids = whole.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(own.encode(text.encode()), "<u4")
        assert got.tolist() == ids, text
        assert own.decode(got) == whole.decode(ids, skip_special_tokens=False).encode()
    assert own.decode(np.array([whole.encode("日").ids[0]])) == whole.decode([whole.encode("日").ids[0]]).encode()  # half a character


def test_round_trip_query(spark):
    whole = library()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(None, None), (7, ""), (7, "")]
    got = bpe_automaton.round_trip(spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, n_tokens int"), tokenizer("byte_bpe_50k.json")).collect()
    want = []
    for doc_id, text in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    back = bpe_automaton.decoded(bpe_automaton.encoded(df, tokenizer("byte_bpe_50k.json")), tokenizer("byte_bpe_50k.json")).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((a, b or "") for a, b in rows), key=str)


def test_improper_vocabularies_are_refused():
    labels = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257}
    with pytest.raises(ValueError):
        bpe_automaton.Automaton(labels, [(b"ab", b"c"), (b"a", b"b")])


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    counts = np.array([3, 1, 5])
    emission, pair = rng.normal(size=(9, 2)), rng.normal(size=(2, 2))
    got, pairs, log_z = line_crf.Chains(counts).marginals(emission, pair)
    want, want_pairs, total, at = np.zeros((9, 2)), np.zeros((2, 2)), 0.0, 0
    for n in counts:
        weights = {}
        for path in itertools.product((0, 1), repeat=int(n)):
            weights[path] = np.exp(sum(emission[at + i, k] for i, k in enumerate(path)) + sum(pair[a, b] for a, b in itertools.pairwise(path)))
        z = sum(weights.values())
        total += np.log(z)
        for path, w in weights.items():
            for i, k in enumerate(path):
                want[at + i, k] += w / z
            for a, b in itertools.pairwise(path):
                want_pairs[a, b] += w / z
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, total)


def test_line_features_do_not_depend_on_blocks_or_batches():
    texts = [b"", b"One line", "Ünï cödé\n\n!!! A | b\nA | b\nA | b".encode(), b"x" * 1000 + b"\n" + b"y z y", b"\n"]
    own, length, counts = line_features = line_crf.line_features(texts)
    assert counts.tolist() == [1, 1, 5, 2, 2] and length.sum() == sum(len(t.replace(b"\n", b"")) for t in texts)
    for block in (1, 7, 64):
        assert all(np.array_equal(a, b) for a, b in zip(line_features, line_crf.line_features(texts, block)))
    assert np.array_equal(own, np.concatenate([line_crf.line_features([t])[0] for t in texts]))


def test_held_out_quality_and_odd_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = line_crf.learned(docs, labels)
    odd = spark.createDataFrame([(None, None, "x"), (10_000_001, "", "y"), (10_000_002, "\n" * 3000, "z"), (10_000_002, "word " * 200_000, "z")], "doc_id long, text string, score string")
    out = line_crf.score(odd, model).collect()
    assert len(out) == 4 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    rows = line_crf.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([(r["predicted"] == r["quality"]) for r in rows]) > 0.95
    kept = line_crf.accepted(docs.join(labels, "doc_id").where("quality = 1").select(docs.columns), model)
    assert kept.columns == docs.columns and kept.count() > 0.97 * labels.where("quality = 1").join(docs, "doc_id").count()
    empty = docs.limit(0)
    assert line_crf.score(empty, line_crf.learned(empty, labels)).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    model = line_crf.learned(docs, spark.createDataFrame([(1, None), (2, 1)], "doc_id long, quality int"))
    assert [r["score"] for r in line_crf.score(docs, model).collect()] == [0.5]


def test_scores_equal_enumeration(spark):
    """The whole score of short texts: all label paths, weighted by length, then the calibration."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = line_crf.learned(docs, labels)
    texts = ["", "One line only.", "First line.\n\n!!! ### 12\nFirst line.", "a | b\nc | d\n" * 3 + "End of it, really."]
    got = [r["score"] for r in line_crf.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    for text, score in zip(texts, got):
        own, length, counts = line_crf.line_features([text.encode()])
        n = len(own)
        zero = np.zeros((1, own.shape[1]))
        x = np.hstack([own, np.vstack([zero, own[:-1]]), np.vstack([own[1:], zero]), np.ones((n, 1))])
        emission = (x - model.scaled[0]) / model.scaled[1] @ model.weights
        good, total = np.zeros(n), 0.0
        for path in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(emission[i, k] for i, k in enumerate(path)) + sum(model.pair[a, b] for a, b in itertools.pairwise(path)))
            good += w * np.array(path)
            total += w
        weight = np.maximum(length, 1)
        mean = np.clip((good / total * weight).sum() / weight.sum(), 1e-6, 1 - 1e-6)
        a, b = model.calibration
        assert abs(score - 1 / (1 + np.exp(-(a * np.log(mean / (1 - mean)) + b)))) < 1e-6


def test_long_and_repeated_labelled_rows(spark):
    rows = [(1, "A fine sentence of prose.\n" * 500), (1, "Another fine one."), (1, "Another fine one."), (2, "### | 12 | $$\n" * 300), (3, "Good words follow here."), (4, "$$ ## 99 |")]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    for most in (4000, 6):
        model = line_crf.learned(docs, labels, most_docs=most)
        assert line_crf.score(docs, model).count() == 18
    scores = {r["doc_id"]: r["score"] for r in line_crf.score(docs, line_crf.learned(docs, labels)).collect()}
    assert scores[3] > scores[4]
