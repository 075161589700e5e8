"""Quality rules, personal data, LM scores and the pipeline against brute force."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skerry.llm import line_crf, lm_score, pii, quality_rules, token_store
from skerry.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "a b c a b c a b c d"), (3, "a b c a b c a b c d"), (None, "one\n\none\none two\n \none"), (4, "x " * 20_000), (5, "## $$ |%<>&* word\x0b\x0cmore")]


def whitespace_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute_rules(text):
    text = text or ""
    words = whitespace_words(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = collections.Counter(grams)
    covered = {k for i, g in enumerate(grams) if times[g] > 1 for k in range(i, i + 3)}
    lines = [x for x in text.split("\n") if whitespace_words(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_measures_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(i and 10**6 + i, t) for i, t in ODD], "doc_id long, text string"))
    got = quality_rules.judged(docs.withColumn("code", F.lit("clash"))).collect()
    want = [(r["doc_id"], *brute_rules(r["text"])) for r in docs.collect()]
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality_rules.judged(docs.limit(0)).count() == 0
    kept = quality_rules.kept_only(docs, quality_rules.judged(docs))
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


def test_em_equals_numpy(spark):
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 3 ** len(quality_rules.RULES), 40)
    counts = {int(c): int(n) for c, n in zip(codes, rng.integers(1, 500, 40))}
    row = quality_rules.estimated(spark.createDataFrame(list(counts.items()), "code int, n long")).first()
    k = len(quality_rules.RULES)
    votes = np.array([[c // 3**j % 3 for j in range(k)] for c in sorted(counts)])
    n = np.array([counts[c] for c in sorted(counts)], float)
    post = np.where((votes == 0).any(1), 1 - quality_rules.START, quality_rules.START)
    for _ in range(quality_rules.ROUNDS):
        odds = np.full(len(n), math.log(((n * post).sum() + 1) / ((n * (1 - post)).sum() + 1)))
        for j in range(k):
            share = {}
            for y, w in (("g", n * post), ("b", n * (1 - post))):
                share[y] = np.array([(w[votes[:, j] == a].sum() + quality_rules.PRIOR[y][a]) / (w.sum() + sum(quality_rules.PRIOR[y])) for a in range(3)])
            odds += np.log(share["g"] / share["b"])[votes[:, j]]
        post = 1 / (1 + np.exp(-odds))
    assert np.allclose([x["post"] for x in sorted(row["posts"], key=lambda x: x["code"])], post)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c)) % 10 + 2 * int(c) // 10 for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in patterns.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d or "1"), "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PRIVATE = ["a@b.c..d_e@f.g x@y a@b@c.d 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 4111 1111 1111 1111, +1 (555) 123-4567 é😀 z@q.com", "", None, "q" * 20_000 + "@" + "b." * 5000 + "c", " 4111-1111-1111-1111", "1.1.1.1 " * 300, "+123456789+987654321012", "aé.x_%@b-.c-", "4111 1111 1111 1112 12"]


def test_spans_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10**6 + i // 2, t) for i, t in enumerate(PRIVATE + PRIVATE[:1])], "doc_id long, text string")).withColumn("row", F.lit("clash"))
    got = pii.spans(docs).collect()
    want = []
    for r in docs.collect():
        s = brute_spans(r["text"])
        want.append((r["doc_id"], *[sum(x.startswith(f"{k}:") for x in s) for k in ("email", "ip", "card", "phone")], hashlib.sha256(",".join(s).encode()).hexdigest(), ",".join(s)))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((w[:6] for w in want), key=str)
    base = {(w[0], w[5]): w[6] for w in want}
    assert all(r["spans"].startswith(base[r["doc_id"], r["base_sha256"]]) for r in got)
    assert pii.spans(docs.limit(0)).count() == 0


def test_telling_terms_go_and_others_stay(spark):
    rows = [(i, f"words before number{i % 7} {a} Quillfeather {b} reach me at q@corp.example thanks {c}", "kept") for i, (a, b, c) in enumerate(zip("red green blue black white".split(), "one two three four five".split(), "ab cd ef gh ij".split()))]
    rows += [(100 + i, f"thanks reach words before me at the place {i}", "kept") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, told string")
    out = {r["doc_id"]: r for r in pii.sanitised(df).collect()}
    for i, text, _ in rows:
        if i < 100:
            assert "[EMAIL]" in out[i]["text"] and "Quillfeather" not in out[i]["text"] and "thanks" in out[i]["text"] and out[i]["told"] == "kept"
        else:
            assert out[i]["text"] == text
    spans = {r["doc_id"]: r["spans"] for r in pii.spans(df).collect()}
    at = rows[0][1].index("Quillfeather")
    assert f"term:{at}:{at + 12}" in spans[0] and spans[100] == ""


def test_base_scores_equal_brute_force(spark, monkeypatch):
    odd = [(None, "Null id WORD"), (10**6, None), (10**6 + 1, ""), (10**6 + 1, "é\xa0  \xa0 x"), (7, "the the THE")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = [(r["doc_id"], [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in whitespace_words(r["text"])] + [None]) for r in docs.collect()]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(itertools.chain.from_iterable(w for i, w in rows if not out(i)))
    n, v = c.total(), len(c)
    want = [(i, out(i), len(w), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in rows]
    for most in (lm_score.HEAD, 50):  # with most words, and with nearly none, among the broadcast ones
        monkeypatch.setattr(lm_score, "HEAD", most)
        got = lm_score.scores(docs.withColumn("score", F.lit(1)), tokenizer("word_bpe_49k.json")).collect()
        assert sorted(((*tuple(r)[:5], round(r["base_score"], 6)) for r in got), key=str) == sorted(want, key=str)
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_scores_depend_on_neither_the_broadcast_nor_the_layout(spark, monkeypatch):
    path = tokenizer("word_bpe_49k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(0, "rare rare q" + "x" * 2000), (1, "q" + "x" * 2000 + " unheard rare"), (None, "word " * 40_000)], "doc_id long, text string"))
    found = []
    for most, parts in ((lm_score.HEAD, 1), (50, 5), (0, 3)):
        monkeypatch.setattr(lm_score, "HEAD", most)
        found.append(sorted(((str(r["doc_id"]), r["n_known"], r["score"]) for r in lm_score.scores(docs.repartition(parts), path).collect()), key=str))
    for other in found[1:]:
        assert [x[:2] for x in found[0]] == [x[:2] for x in other] and np.allclose([x[2] for x in found[0]], [x[2] for x in other], rtol=1e-4)


def test_held_out_bits_are_below_those_of_words_and_spellings(spark):
    """The base gives each unheard word, of which there is no end, the share of one word; with that share spread over spellings it is a distribution, as the score is."""
    path = tokenizer("word_bpe_49k.json")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model, rows, _, totals, *_ = lm_score.learned(docs, path, lm_score.scratch(spark, "test"))
    bits = np.zeros(2)
    for r in rows.where("held_out").collect():
        n = np.array([r["n_tokens"] - 1])
        t = lm_score.Texts([bytes(r["ids"])], [bytes(r["sizes"])], n)
        c, kind = np.frombuffer(bytes(r["counts"]), "<f4").astype(float), lm_score.unpacked([bytes(r["variants"])], n, "<u4")
        spelled = model.spelling(t, kind)
        log_p = model.log_class(t)
        log_p[~t.is_end] += model.within(t, c, spelled)
        start = np.log(np.bincount(model.cls[: lm_score.IDS], model.types, lm_score.CLASSES)[model.cls[t.first]] + 1) - math.log(model.types.sum() + lm_score.CLASSES)
        all_words = totals["n"] + totals["v"] + 1
        base = np.where(c > 0, np.log(c + 1), spelled + start) - math.log(all_words)
        bits += [-log_p.sum() / math.log(2), -(base.sum() + math.log(model.starts[lm_score.END] + 1) - math.log(all_words)) / math.log(2)]
    assert bits[0] < 0.9 * bits[1]


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.scores(empty, tokenizer("word_bpe_49k.json")).count() == 0


def test_rare_terms_of_rare_entities_go_wherever_they_stand(spark):
    far = "plain words follow here " * 10
    rows = [(0, f"Write to solo@corp.example, says Zephyrine. {far}Zephyrine again"), (1, f"{far}Oddname"), *[(2, f"copied Vandermolen text {far} at twin@corp.example")] * 30]
    rows += [(100 + i, f"Write to me, says the copied text, again {far}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert "Zephyrine" not in out[0] and "solo" not in out[0] and "says" in out[0] and far.strip() in out[0]
    assert "Vandermolen" not in out[2] and "copied" in out[2]
    assert out[1] == rows[1][1] and out[100] == rows[-1][1]
    spans = {r["doc_id"]: r["spans"] for r in pii.spans(df).collect()}
    assert spans[0].count("term:") == 2 and spans[2].count("term:") == 1 and spans[1] == ""


def test_long_numbers_are_terms(spark):
    rows = [(0, "years 2019 2020 2021 of a clean text"), (1, "solo@corp.example has account 123 456 789 and years 2019 2020 2021"), (2, "account 123456788 of nobody")]
    rows += [(100 + i, "has years of account 2019 2020 2021 and a clean text of nobody") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert out[0] == rows[0][1] and out[2] == rows[2][1] and out[100] == rows[-1][1]
    assert out[1] == "[EMAIL] has account [NUMBER] and years 2019 2020 2021"
    spans = {r["doc_id"]: r["spans"] for r in pii.spans(df).collect()}
    at = rows[1][1].index("123")
    assert spans[0] == spans[2] == "" and spans[1].endswith(f",term:{at}:{at + 11}")


def test_every_training_token_is_a_target_once(spark):
    path = tokenizer("word_bpe_49k.json")
    texts = [" ".join(f"word{k}" for k in range(n)) for n in (0, 1, 3, 14, 15, 16, 17, 40, 500)]
    raw = [token_store.encode_text(t.encode(), path) for t in texts]
    words = [lm_score.ids_of(t.encode().split(), path) for t in texts]
    assert all(np.array_equal(a, b) for a, (b, _) in zip(raw, words))
    t = lm_score.Texts([ids.astype("<u2").tobytes() for ids, _ in words], [lm_score.packed(n, "<u4") for _, n in words], np.array([len(n) for _, n in words]))
    cls = np.arange(1 << 16)
    target, real = t.blocks(t.targets(cls), -1), t.blocks(np.ones(len(t.is_end), bool), False)
    want = [x for ids, n in words for x in [*ids[np.cumsum(n) - n].tolist(), lm_score.END]]
    assert target[real].tolist() == want and (target[~real] == -1).all()
    # A token's input is the word before it; the first one's is the start.
    n = len(t.at)
    inputs, k = t.inputs()[real].tolist(), 0
    for own in t.n_words.tolist():
        assert inputs[:1] == [n] and inputs[1 : own + 1] == list(range(k, k + own))
        inputs, k = inputs[own + 1 :], k + own
    rows = lm_score.prepared(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), path, spark.sparkContext.broadcast({}), 3).collect()
    assert all((r["shard"] is None) == lm_score.held_out(r["doc_id"]) and r["n_tokens"] == len(texts[r["doc_id"]].split()) + 1 for r in rows)


def model():
    rng = np.random.default_rng(1)
    keys = np.arange(lm_score.IDS - 2)
    n = lambda high: (keys, rng.integers(0, high, len(keys)).astype(float))
    types, inner, last = n(20), n(20), n(3)
    last = (keys, np.minimum(last[1], types[1] + inner[1]))
    m = lm_score.Model({lm_score.STARTS: (keys, types[1] * 3), lm_score.TYPES: types, lm_score.INNER: inner, lm_score.INNER_TOKENS: n(9), lm_score.LAST: last, lm_score.TIMES: (np.arange(1, 4), np.array([50.0, 20, 9]))}, 100)
    a = np.repeat(m.often, 2)
    b = m.often[rng.integers(0, lm_score.TOP, len(a))]
    pairs, k = np.unique(np.stack([a, b]), axis=1, return_counts=True)
    more = (m.types + m.inner - m.last)[pairs[0]]
    m.set_pairs(pairs[0], pairs[1], np.minimum(k, more / 2))
    m.set_classes(rng.integers(0, 20, (lm_score.TOP + 2, lm_score.TOP + 2)).astype(float))
    m.attention.p["q"] *= 2
    m.attention.p["lag"] = rng.normal(size=2 * lm_score.STRIDE).astype(np.float32)
    return m


def test_probabilities_add_up_to_one():
    m = model()
    # First ids within each class; stops or next ids behind an id, whether its pairs are told apart or not; variants.
    assert np.allclose(np.bincount(m.cls[: lm_score.IDS], np.exp(m.log_first), lm_score.CLASSES), 1)
    every = np.arange(lm_score.IDS)
    for a in (*m.often[:5], *np.flatnonzero(m.slot[: lm_score.IDS] == lm_score.TOP)[:5]):
        go = np.exp(m.table[m.slot[a], m.slot[every]] + m.log_other[every] + m.log_go[a]).sum()
        assert abs(go + np.exp(m.log_stop[a]) - 1) < 1e-3
    assert abs(np.exp(m.log_variant).sum() - 1) < 1e-9
    # Shares of all words of a class and the mass of spellings: each type has its tokens, less the discount.
    tokens, types = (np.bincount(m.cls[: lm_score.IDS], x, lm_score.CLASSES) for x in (m.starts, m.types))
    some = types > 0
    assert np.allclose((tokens[some] - m.discount * types[some]) / tokens[some] + np.exp(m.log_free[some]), 1)
    rng = np.random.default_rng(2)
    e = rng.normal(size=(3, 32, lm_score.WIDTH)).astype(np.float32)
    assert np.allclose(np.exp(m.attention.forward(e, np.array([True, False, False]))[0]).sum(2), 1, atol=1e-4)


def test_windows_agree():
    """Blocks of many texts at once, one text at a time, and an exact restatement."""
    m, rng = model(), np.random.default_rng(2)
    own = [(rng.integers(0, lm_score.IDS - 2, 3 * n).astype("<u2"), np.full(n, 3, "<u4")) for n in (0, 1, 15, 16, 17, 100)]
    raw = [(a.tobytes(), b.tobytes()) for a, b in own]
    whole = lm_score.Texts(*zip(*raw), np.array([len(b) for _, b in own]))
    assert np.array_equal(lm_score.unpacked([lm_score.packed(np.array(x), '<u4') for x in ([1, 2], [], [300, 5])], np.array([2, 0, 2]), '<u4'), [1, 2, 300, 5])
    together = m.log_class(whole)
    assert np.allclose(together, np.concatenate([m.log_class(lm_score.Texts([a], [b], np.array([len(b) // 4]))) for a, b in raw]), atol=1e-4)
    at, s = 0, lm_score.STRIDE
    for a, b in raw:
        t = lm_score.Texts([a], [b], np.array([len(b) // 4]))
        v = t.vectors(m.compact, m.vectors)
        seq = np.concatenate([v[-2:-1], v[:-2]])  # the start, then the words
        target = t.targets(m.cls)
        for i in range(len(seq)):
            low = max(0, i // s * s - s)
            e = np.zeros((1, 2 * s, lm_score.WIDTH), np.float32)
            e[0, s - (i // s * s - low) : s + i % s + 1] = seq[low : i + 1]
            want = m.attention.forward(e, np.array([i < s]))[0][0, i % s, target[i]]
            assert abs(together[at + i] - want) < 1e-3
        at += len(seq)
    # All blocks at once, or a few.
    t = whole
    args = (t.vectors(m.compact, m.vectors), t.inputs(), t.opens, t.blocks(t.targets(m.cls), 0))
    assert np.allclose(m.attention.log_p(*args, most=3), m.attention.log_p(*args), atol=1e-5)


def test_gradient():
    rng = np.random.default_rng(4)
    a = lm_score.Attention(rng.normal(size=8))
    a.p = {n: x.astype(np.float64) for n, x in a.p.items()}
    e, opens = rng.normal(size=(3, 32, lm_score.WIDTH)), np.array([True, False, False])
    target, real = rng.integers(0, 8, (3, 16)), np.ones((3, 16), bool)
    g = a.gradient(e, opens, target, real)
    loss = lambda: -np.take_along_axis(a.forward(e, opens)[0], target[:, :, None], 2).mean()
    for name, at in (("q", (1, 2)), ("k", (2, 3)), ("v", (4, 5)), ("r", (0, 1)), ("lag", (3,)), ("b", (2,)), ("out", (3, 4)), ("share", (5,))):
        a.p[name][at] += 1e-5
        up = loss()
        a.p[name][at] -= 2e-5
        slope = (up - loss()) / 2e-5
        a.p[name][at] += 1e-5
        assert abs(slope - g[name][at]) < 1e-5, name


def test_variants_tell_words_with_equal_ids_apart():
    path = tokenizer("word_bpe_49k.json")
    words = ["élan", "Élan", "ÉLAN", "e\u0301lan", "a", "a\xa0", "straße", "ΑΣ", "don't"]
    ids = [lm_score.ids_of([w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode()], path)[0].tobytes() for w in words]
    kinds = lm_score.variants([w.encode() for w in words]).tolist()
    assert kinds[:3] == [0, 1, 2 + len("ÉLAN".encode())] and kinds[3] > 1 and kinds[4] == 0 and kinds[5] > 1
    plain = [(i, k) for i, k in zip(ids, kinds) if k < lm_score.BYTES]
    assert len(plain) == len(set(plain))


def brute_quality(model, text):
    """The line CRF's score by a forward and a backward pass in log space, line by line."""
    own, length, _ = line_crf.line_features([text.encode()])
    n, zero = len(own), np.zeros((1, own.shape[1]))
    x = np.hstack([own, np.vstack([zero, own[:-1]]), np.vstack([own[1:], zero]), np.ones((n, 1))])
    e = (x - model.scaled[0]) / model.scaled[1] @ model.weights
    f, g = [e[0]], [np.zeros(2)]
    for i in range(1, n):
        f.append(e[i] + np.logaddexp(f[-1][0] + model.pair[0], f[-1][1] + model.pair[1]))
        g.append(np.logaddexp(model.pair[:, 0] + e[n - i][0] + g[-1][0], model.pair[:, 1] + e[n - i][1] + g[-1][1]))
    both = np.array(f) + np.array(g[::-1])
    good = 1 / (1 + np.exp(both[:, 0] - both[:, 1]))
    weight = np.maximum(length, 1)
    mean = np.clip((good * weight).sum() / weight.sum(), 1e-6, 1 - 1e-6)
    a, b = model.calibration
    return 1 / (1 + np.exp(-(a * np.log(mean / (1 - mean)) + b)))


def test_pipeline_equals_its_stages_by_brute_force(spark):
    from test_store_counts_scan import brute_fingerprint, brute_scan
    from tokenizers import Tokenizer

    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    crf = line_crf.learned(docs, labels)
    rows = [r for r in docs.collect() if brute_quality(crf, r["text"]) >= 0.3]
    fps = [brute_fingerprint(r["text"]) for r in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    rows = [r for i, r in enumerate(rows) if least[find(i)] == r["doc_id"]]
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    rows = [r for r in rows if not brute_scan(r["text"], items)[-1]]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == sorted(r["doc_id"] for r in rows)
    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    untouched = 0
    for r in rows:
        ids = got[r["doc_id"]]["ids"]
        text = library.decode(ids, skip_special_tokens=False)
        assert library.encode(text, add_special_tokens=False).ids == ids
        assert hashlib.sha256(text.encode()).hexdigest() == got[r["doc_id"]]["decoded_sha256"]
        assert not any(s.split(":")[0] in ("email", "ip", "phone") for s in brute_spans(text))
        if not brute_spans(r["text"]) and not re.search("[0-9]{9}", r["text"]):
            assert text == r["text"]
            untouched += 1
    assert untouched > len(rows) / 2
    stages = [name for name, _ in corpus_pipeline.STAGES]
    assert len(stages) == 5


@pytest.mark.parametrize("n", range(4))
def test_stages_keep_columns(spark, n):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).withColumn("fp", F.lit(1))
    out = corpus_pipeline.STAGES[n][1](spark, docs, SF)
    assert out.columns == docs.columns and out.count() <= 40


def test_terms_equal_brute_force(spark):
    """All terms that tell of an entity, on a small corpus with repeats, shared entities, several entities in a text and repeated words."""
    rnd = np.random.default_rng(5)
    vocabulary = [f"w{''.join(chr(97 + int(x)) for x in rnd.integers(0, 26, 4))}" for _ in range(60)]
    mails = ["a@x.org", "b@x.org", "c@y.net", "10.1.2.3"]
    rows = []
    for i in range(150):
        text = " ".join(vocabulary[int(k)] for k in (rnd.integers(0, 60, 8) ** 2 // 60))
        own = [mails[int(k)] for k in rnd.integers(0, 4, int(rnd.integers(0, 3)) if i % 3 == 0 else 0)]
        rows.append((i % 140, f"{text} {' '.join(own)} {vocabulary[59] if 'a@x.org' in own else 'plain'}"))
    rows += [(900, "Éclatab@x.org stands before it"), (901, "straßec@y.net")]
    holds, words = [], []
    for _, text in rows:
        spans = [tuple(x.split(":")) for x in brute_spans(text)]
        holds.append({text[int(a) : int(b)].lower() for _, a, b in spans})
        at = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{3,}", text)]
        words.append([(a, b, w) for a, b, w in at if not any(int(s) < b and a < int(e) for _, s, e in spans)])
    every = [{m[0].lower() for m in re.finditer(r"[^\W\d_]{3,}", text)} for _, text in rows]
    n = len(rows)
    want = []
    for (doc_id, _), own, places in zip(rows, holds, words):
        gone = set()
        for e in own:
            n_e = sum(e in h for h in holds)
            for w in {w for _, _, w in places}:
                n_t = sum(w in x for x in every)
                n_et = sum(e in h and w in {v for _, _, v in p} for h, p in zip(holds, words))
                m = n_e * n_t / n
                told = math.log2(n_et / m) / math.log2(n / n_e) if n > n_e else 0
                if told >= pii.GENERALISE and n_et * math.log(n_et / m) - n_et + m >= -math.log(pii.CHANCE):
                    gone.add(w)
        want.append((doc_id, ",".join(f"term:{a}:{b}" for a, b, w in places if w in gone)))
    got = pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = [(r["doc_id"], ",".join(x for x in r["spans"].split(",") if x.startswith("term"))) for r in got]
    assert sorted(found) == sorted(want) and sum(bool(t) for _, t in want) > 5


def test_many_entities_in_one_text(spark):
    """The work grows about as the number of entities, and the text comes out as by hand."""
    import time

    text = " ".join(f"user{i} wrote é{i}x from u{i}@mail{i % 50}.example at 10.{i % 250}.3.4 then" for i in range(3000))
    df = spark.createDataFrame([(1, text), (2, "plain text"), (3, None)], "doc_id long, text string")
    start = time.perf_counter()
    out = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert time.perf_counter() - start < 60
    assert out[2] == "plain text" and out[3] is None and out[1].count("[EMAIL]") == 3000 and out[1].count("[IP]") == 3000 and "@" not in out[1]
    spans = pii.spans(df).where("doc_id = 1").first()
    assert spans["n_email"] == spans["n_ip"] == 3000


@pytest.mark.parametrize("n", range(5))
def test_stages_on_odd_rows(spark, n):
    """Null and empty texts, repeated and null ids, and empty tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    keep = docs.limit(5).collect()
    odd = [keep[0].asDict() | {"doc_id": i, "text": t} for i, t in ((None, None), (None, ""), (None, "a text of its own"), (None, "another one here"), (7, "first text of seven"), (7, "second text of seven"), (7, "second text of seven"))]
    df = spark.createDataFrame([r.asDict() for r in keep] + odd, docs.schema).withColumn("row", F.lit("x"))
    out = corpus_pipeline.STAGES[n][1](spark, df, SF)
    assert n == 4 or out.columns == df.columns
    found = out.collect()
    assert len(found) <= df.count() and (n in (0, 1, 2) or len(found) == df.count())
    if n == 1:
        texts = [r["text"] for r in found]
        assert {"a text of its own", "another one here", "first text of seven", "second text of seven"} <= set(texts) and texts.count("second text of seven") == 1
        assert sum(not t for t in texts) == 1
    assert corpus_pipeline.STAGES[n][1](spark, df.limit(0), SF).count() == 0


def test_rows_hold_words_by_number_and_give_all_of_them_back(spark):
    """Rows for training and scoring take three bytes a word of the head, and no ids of such words; ids, counts and variants of all words follow from them."""
    path = tokenizer("word_bpe_49k.json")
    texts = ["The words of the head, élan Élan straße", "", None, "unheard the words unheard \xa0 of ÉLAN", "of the", " ".join(f"w{k} the" for k in range(300)), "q" * 900 + " the"]
    lower = lambda t: [w.encode() for w in (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split(" ") if w]
    words = sorted({w for t in texts[:2] for w in lower(t)})
    encoded = lambda words: [lm_score.ids_of([w], path)[0].astype("<u2").tobytes() for w in words]
    heads = lm_score.Heads(words, range(1, len(words) + 1), encoded(words), lm_score.variants(words))
    assert heads.numbers([*words, b"unheard", b"x"]).tolist() == [*range(len(words)), heads.n, heads.n]
    shared = spark.sparkContext.broadcast(heads)
    rows = lm_score.prepared(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, shared, 3)
    count = dict(zip(words, range(1, len(words) + 1)))
    for r in rows.collect():
        own = lower(texts[r["doc_id"]])
        others = [w for w in own if w not in count]
        assert len(r["low"]) + len(r["high"]) == 3 * len(own) and bytes(r["ids"]) == b"".join(encoded(others)) and len(r["ends"]) == 4 * len(others)
        assert r["n_known"] == len(own) - len(others) and math.isclose(r["sums"], sum(math.log10(count.get(w, 0) + 1) for w in own), abs_tol=1e-9)
        assert sorted((bytes(x["word"]), x["n"]) for x in r["rest"]) == sorted(collections.Counter(others).items())
    for r in lm_score.whole(rows, shared).collect():
        own = lower(texts[r["doc_id"]])
        n = np.array([len(own)])
        assert bytes(r["ids"]) == b"".join(encoded(own)) and lm_score.unpacked([bytes(r["sizes"])], n, "<u4").tolist() == [len(x) // 2 for x in encoded(own)]
        assert np.frombuffer(bytes(r["counts"]), "<f4").tolist() == [count.get(w, 0) for w in own] and lm_score.unpacked([bytes(r["variants"])], n, "<u4").tolist() == lm_score.variants(own).tolist()


def test_words_whose_hashes_agree_are_not_in_the_head(spark, monkeypatch):
    """They are counted where rare words are."""
    real = lm_score.hashes
    short = lambda data, starts, ends: real(data, starts, ends) % np.uint64(50)
    monkeypatch.setattr(lm_score, "hashes", short)
    words = [b"w%d" % k for k in range(60)]
    heads = lm_score.Heads(words, range(60), [b"\1\0"] * 60, [0] * 60)
    found = heads.numbers(words)
    assert 0 < len(heads.excluded) < 60 and {words[i] for i in np.flatnonzero(found == heads.n)} == set(heads.excluded)
    assert all(k == i for i, k in enumerate(found.tolist()) if k < heads.n)


def test_scores_equal_those_of_whole_rows(spark):
    """Words by number and others by their ids give what all ids, counts and variants give."""
    path = tokenizer("word_bpe_49k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id is not null")
    model, rows, *_ = lm_score.learned(docs, path, lm_score.scratch(spark, "test"))
    want = {}
    for r in rows.collect():
        n = np.array([r["n_tokens"] - 1])
        t = lm_score.Texts([bytes(r["ids"])], [bytes(r["sizes"])], n)
        log_p = model.log_class(t)
        log_p[~t.is_end] += model.within(t, np.frombuffer(bytes(r["counts"]), "<f4").astype(float), model.spelling(t, lm_score.unpacked([bytes(r["variants"])], n, "<u4")))
        want[r["doc_id"]] = log_p.sum() / math.log(10)
    got = {r["doc_id"]: r["score"] for r in lm_score.scores(docs, path).collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), rtol=1e-4)
