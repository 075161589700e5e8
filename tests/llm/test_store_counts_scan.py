"""Token store, token counts, SimHash, decontamination and chat against brute force, on the small tables and on planted cases."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.llm import chat, decontaminate, simhash, token_counts, token_store
from skerry.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.IntegerType()), T.StructField("segment", T.StringType())])
ODD = [(3, None, 1, "a"), (1, "", 2, None), (None, "lone words here", None, "c"), (2, "Twice the same.", 1, "d"), (2, "Twice the same.", 1, "d"), (5, "x" * 30_000 + " " + "ab " * 40_000, 1, "e"), (6, "don't stop <|endoftext|> ́é ΑΣ 日本  two  spaces \n", 0, "f")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_store_reads_back_what_the_library_encodes(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    for df in (docs(spark), odd):
        want, start = [], 0
        rows = sorted(((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        for doc_id, text in rows:
            ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 2], "<u4")
            want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), True))
            start += len(ids)
        store = f"file://{tmp_path}/{len(rows)}"
        token_store.write_store(df, store, tokenizer("word_bpe_49k.json"), 2)
        got = token_store.read_back(spark, store).select("doc_id", "start", "n_tokens", "ids_crc32", "verified").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
        names = [r["digest"] for r in spark.read.parquet(f"{store}/chunks").collect()]
        assert len(names) == len(set(names))
        one = token_store.documents_of(spark, store, F.col("doc_id") == 5).collect()
        assert all(len(r["ids"]) == w[2] for r in one for w in want if w[0] == 5)
        roots = {r["segment"]: r["root"] for r in spark.read.parquet(f"{store}/manifest").collect()}
        for segment, root in roots.items():
            peaks = token_store.Peaks()
            for r in spark.read.parquet(f"{store}/recipes").where(F.col("segment") == segment).orderBy("doc_id", "leaf").collect():
                peaks.add(bytes(r["leaf"]))
            assert peaks.root() == bytes(root)


def test_a_changed_chunk_is_noticed(spark, tmp_path):
    store = f"file://{tmp_path}/s"
    token_store.write_store(docs(spark).limit(5), store, tokenizer("word_bpe_49k.json"), 2)
    chunks = spark.read.parquet(f"{store}/chunks").collect()
    spark.createDataFrame([(r["digest"], bytes(r["ids"])[2:] + b"\1\0" if i == 0 else bytes(r["ids"])) for i, r in enumerate(chunks)], "digest binary, ids binary").write.mode("overwrite").parquet(f"{store}/chunks")
    assert [r["verified"] for r in token_store.read_back(spark, store).collect()].count(False) >= 1


def test_changed_recipes_and_manifests_are_noticed(spark, tmp_path):
    store, changed = f"file://{tmp_path}/s", f"file://{tmp_path}/c"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several segments
    try:
        token_store.write_store(docs(spark).limit(40), store, tokenizer("word_bpe_49k.json"), 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    recipes, manifest, chunks = (spark.read.parquet(f"{store}/{t}") for t in ("recipes", "manifest", "chunks"))
    rows, roots = recipes.orderBy("segment", "doc_id").collect(), manifest.orderBy("segment").collect()
    first, n = rows[0]["segment"], len(rows)
    assert len(roots) > 1
    at = next(i for i in range(1, n) if rows[i]["segment"] == first and rows[i]["leaf"] != rows[0]["leaf"])

    def verified(new_rows, new_roots):
        for t, df in (("recipes", spark.createDataFrame(new_rows, recipes.schema)), ("manifest", spark.createDataFrame(new_roots, manifest.schema)), ("chunks", chunks)):
            df.write.mode("overwrite").parquet(f"{changed}/{t}")
        return [(r["doc_id"], r["verified"]) for r in token_store.read_back(spark, changed).collect()]

    whole = verified(rows, roots)
    assert len(whole) == n and all(ok for _, ok in whole)
    of_first = {r["doc_id"] for r in rows if r["segment"] == first}
    replaced = [rows[0].asDict() | {"doc_id": rows[at]["doc_id"]} if i == at else r.asDict() for i, r in enumerate(rows)]
    wrong_root = [r.asDict() | {"root": bytes(16)} if r["segment"] == first else r.asDict() for r in roots]
    for new_rows, new_roots in ((rows[1:], roots), (rows[:1] + rows, roots), (replaced, roots), (rows, wrong_root), (rows, roots[1:]), (rows, roots[:1] + roots)):
        got = verified(new_rows, new_roots)
        assert len(got) == len(new_rows) and not any(ok for doc_id, ok in got if doc_id in of_first)
    assert not any(ok for _, ok in verified([r for r in rows if r["segment"] != roots[-1]["segment"]], roots))


def test_equal_passages_share_chunks():
    rng = np.random.default_rng(1)
    same = rng.integers(0, 49_000, 20_000).astype("<u2")
    a, b = (np.concatenate([rng.integers(0, 49_000, n).astype("<u2"), same]) for n in (777, 1234))
    ends = [token_store.cuts(x) for x in (a, b)]
    parts = [{x[i:j].tobytes() for i, j in zip([0, *c], c)} for x, c in zip((a, b), ends)]
    assert len(parts[0] & parts[1]) > 0.9 * len(parts[0])


def test_empty_store(spark, tmp_path):
    token_store.write_store(spark.createDataFrame([], DOCS), f"file://{tmp_path}/e", tokenizer("word_bpe_49k.json"), 2)
    assert token_store.read_back(spark, f"file://{tmp_path}/e").count() == 0


def test_counts_equal_the_library(spark, odd):
    model = token_counts.units(tokenizer("piece_bpe_32k.model")).model
    for df in (docs(spark), odd):
        want = [(r["doc_id"], len((r["text"] or "").encode()), len(model.encode(r["text"] or ""))) for r in df.collect()]
        got = token_counts.count_tokens(df, tokenizer("piece_bpe_32k.model")).collect()
        assert sorted((tuple(r)[:3] for r in got), key=str) == sorted(want, key=str)
        assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)
    rnd = random.Random(3)
    units = token_counts.units(tokenizer("piece_bpe_32k.model"))
    for _ in range(5000):
        text = "".join(rnd.choice(["  ", " ", "▁", "the", "a", "\n", "é", "<s>", "日本", "😀", ".", "12", "\x00", "\xa0"]) for _ in range(rnd.randrange(9)))
        assert units.count(text.encode()) == len(model.encode(text)), text


def test_masks_cover_every_pair():
    masks = simhash.masks()
    assert len(masks) == 7
    assert all(any(not (1 << i | 1 << j) & m for m in masks) for i, j in itertools.combinations(range(64), 2))


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = regex.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark, odd):
    for df in (docs(spark), odd):
        rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in df.collect()]
        root = list(range(len(rows)))
        find = lambda i: i if root[i] == i else find(root[i])
        for i, j in itertools.combinations(range(len(rows)), 2):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
        least = {}
        for i, (d, _) in enumerate(rows):
            if d is not None:
                least[find(i)] = min(least.get(find(i), d), d)
        want = [(d, f"{fp:016x}", least.get(find(i))) for i, (d, fp) in enumerate(rows)]
        got = simhash.near_duplicates(df).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_chains_and_crowded_buckets(spark):
    rnd = random.Random(5)
    fps = {0, 1, 3, 7, 15, 31, 0xFF00FF, (1 << 63) | 5, 1 << 63}
    for _ in range(60):
        base = rnd.getrandbits(64)
        for _ in range(rnd.randrange(1, 12)):
            fps.add(base)
            base ^= 1 << rnd.randrange(64)
            base ^= (1 << rnd.randrange(64)) * rnd.randrange(2)
    fps = sorted(fps)
    root = {f: f for f in fps}
    find = lambda i: i if root[i] == i else find(root[i])
    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    base = simhash.scratch(spark, "test")
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, base), base).collect()}
    for a, b in itertools.combinations(fps, 2):
        x, y = simhash._signed(a), simhash._signed(b)
        assert (find(a) == find(b)) == (got.get(x, x) == got.get(y, y))


def test_one_of_each_keeps_columns_and_one_row(spark, odd):
    out = simhash.one_of_each(odd).collect()
    assert out[0].__fields__ == [f.name for f in DOCS.fields]
    # 1 and 3 have no words; 2 comes twice; 'lone words here' has no id but is alone.
    assert sorted(str(r["doc_id"]) for r in out) == ["1", "2", "5", "6", "None"]


def test_one_row_of_each_component_whatever_its_id(spark):
    first, second, third, fourth = ("alpha beta gamma delta epsilon", "one two three four five six", "lorem ipsum dolor sit amet", "red green blue black white grey")
    rows = [(None, first), (None, second), (None, second), (7, third), (7, fourth), (2, third), (None, fourth)]
    out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(None, first), (None, second), (2, third), (7, fourth)], key=str)


def brute_scan(doc, items):
    words = lambda t: regex.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    own, hit, names = words(doc), set(), set()
    for name, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for k in range(len(own) - n + 1):
                if own[k : k + n] == w[i : i + n]:
                    hit |= set(range(k, k + n))
                    names |= {str(name)} - {"None"}
    return len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most", [decontaminate.MOST_WORDS, 0])
def test_scan_equals_brute_force(spark, most):
    items = [(1, "One two three four FIVE six, seven-eight nine ten eleven twelve"), (2, "short item"), (3, ""), (4, None), (None, "nobody"), (5, "ñandú"), (10, "short  ITEM"), (2, "short item")]
    rows = [(1, "zero one two three four five six seven eight nine ten x"), (2, None), (3, ""), (4, "a short item of ñandú."), (5, "one two three four five six seven eight nine"), (6, "One two three four five six seven eight nine ten eleven twelve One two three four five six seven eight nine ten eleven"), (6, "nobody"), (None, "SHORT item")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(spark.createDataFrame(rows, "doc_id long, text string"), bench, most_words=most).drop("items").collect()
    want = [(d, *brute_scan(t, items)) for d, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_scan_of_the_small_tables(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = decontaminate.scan(docs(spark), spark.read.parquet(f"{SF}/benchmark.parquet")).drop("items").collect()
    assert sorted(map(tuple, got)) == sorted((r["doc_id"], *brute_scan(r["text"], items)) for r in docs(spark).collect())


@pytest.mark.parametrize("most", [decontaminate.MOST_WORDS, 0])
def test_spans_or_documents_go(spark, most):
    ten = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, ten), (None, "secret word"), (2, ten)], "item_id long, text string")
    rows = [(1, "Keep, ONE two three four five six seven eight nine ten! this", 7), (1, "clean twin", 8), (None, "a secret word", 9), (None, "clean too", 10), (3, None, 9), (4, "", 9), (5, "secret word", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, contaminated int")
    got = decontaminate.without_hits(df, bench, most_words=most)
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted([rows[1], rows[3], rows[4], rows[5]], key=str)
    got = decontaminate.without_hits(df, bench, whole=False, most_words=most)
    want = [(1, "Keep, ! this", 7), rows[1], (None, "a ", 9), rows[3], rows[4], rows[5], (5, "", 1)]
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    for empty in (df.limit(0), df):
        none = decontaminate.scan(empty, bench.limit(0), most_words=most).collect()
        assert len(none) == empty.count() and not any(r["contaminated"] for r in none)


def test_a_very_long_text_is_scanned(spark):
    text = "filler words " * 200_000 + "one two three"
    bench = spark.createDataFrame([(1, "one two three"), (2, "nothing of it")], "item_id long, text string")
    r = decontaminate.scan(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, n_hit string"), bench).first()
    assert (r["n_words"], r["n_hit"], r["items"]) == (400_003, 3, ["1"])


def test_chat_collapses_snapshots(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 1, "assistant", "b"), (3, 0, "user", "a"), (4, 0, "user", None), (5, 0, "", "usera"), (None, 0, "user", "z"), (6, 0, "user", "a"), (6, 1, "assistant", "c")]
    rows += [(None, 0, "user", "z"), (None, 1, "user", "y"), (None, 0, "user", "a")]
    out = chat.formatted(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, hash int")).collect()
    assert sorted(((r["conv_id"], r["n_turns"], r["n_copies"]) for r in out), key=str) == sorted([(2, 2, 2), (4, 1, 1), (5, 1, 1), (None, 1, 2), (None, 1, 1), (6, 2, 1)], key=str)
    assert next(r["text"] for r in out if r["conv_id"] == 6) == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"


def test_long_conversations_equal_turns_and_empty_tables(spark):
    long = [(1, k, "user", f"turn {k}") for k in range(300)] + [(2, k, "user", f"turn {k}") for k in range(299)] + [(3, 0, "user", "x" * 100_000)]
    same = [(4, 0, "user", "b"), (4, 0, "user", "a"), (5, 0, "user", "a"), (5, 0, "user", "a"), (6, 0, "user", "a"), (6, None, "user", "first")]
    df = spark.createDataFrame(long + same, "conv_id long, turn int, role string, text string")
    out = {r["conv_id"]: r for r in chat.formatted(df).collect()}
    assert {k: r["n_turns"] for k, r in out.items()} == {1: 300, 3: 1, 4: 2, 5: 2, 6: 2}
    assert out[4]["text"].index("a<") < out[4]["text"].index("b<") and out[6]["text"].index("first") < out[6]["text"].index("a<") and len(out[3]["text"]) > 100_000
    hashes = chat.prefixes(df.where("conv_id <= 2")).orderBy("conv_id").collect()
    want, h = [], ""
    for k in range(300):
        h = hashlib.sha256(f"{h}4:user{len(f'turn {k}')}:turn {k}".encode()).hexdigest()
        want.append(h)
    assert hashes[0]["hashes"] == want and hashes[1]["hashes"] == want[:299]
    assert chat.formatted(df.limit(0)).count() == 0


def test_empty_tables_and_pieces(spark):
    from tokenizers import Tokenizer

    from skerry.llm import bpe_automaton, pieces

    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == token_counts.count_tokens(empty, tokenizer("piece_bpe_32k.model")).count() == bpe_automaton.round_trip(empty, tokenizer("byte_bpe_50k.json")).count() == 0
    path = tokenizer("word_bpe_49k.json")
    whole, own = Tokenizer.from_file(path), pieces.Encoder(path, most=50)
    rnd = random.Random(2)
    parts = ["don't", "'s", " ", "  ", "the", "A", "É", "\n", "\x1c", "\x85", "<|endoftext|>", "<|ENDOFTEXT|>", "12", "é", " \u0301", "é", "!!", "½", "日", "\x00", "aaaa", "\t", "\xa0", "---", "😀", "×", "÷", "ÀÉb", "ß", "ÿ", "I\u0307", "İ", "\x7f", "a.b", "Ünï1x", "Ā"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(9))) for _ in range(3000)] + ["", "x" * 30_000, "ab " * 4000]
    ids, sizes = own.encode([t.encode() for t in texts])
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [k for w in want for k in w]
    words, at, counts = pieces.distinct_words([t.encode() for t in texts])
    assert [words[k] for k in at] == [w for t in texts for w in t.encode().split()] and counts.tolist() == [len(t.encode().split()) for t in texts]
    # Strings that hash alike are told apart.
    data = np.frombuffer(b"ab cd ab ef", np.uint8)
    values = pieces.VALUES.copy()
    try:
        pieces.VALUES[:] = 1
        first, same = pieces.grouped(data, np.array([0, 3, 6, 9]), np.array([2, 5, 8, 11]))
    finally:
        pieces.VALUES[:] = values
    assert len(first) == 3 and same[0] == same[2] and len(set(same.tolist())) == 3


def test_encoder_holds_strings_over_many_calls(monkeypatch):
    from tokenizers import Tokenizer

    from skerry.llm import pieces

    path = tokenizer("word_bpe_49k.json")
    whole, rnd = Tokenizer.from_file(path), random.Random(5)
    words = ["".join(rnd.choice("abcdeéß<1 '") for _ in range(rnd.randrange(1, 9))) for _ in range(1500)]
    want = {w: whole.encode(w, add_special_tokens=False).ids for w in words}
    for most, values in ((200, pieces.VALUES), (1 << 20, pieces.VALUES), (200, np.ones(256, np.uint64))):  # the last: many strings hash alike
        monkeypatch.setattr(pieces, "VALUES", values)
        own = pieces.Encoder(path, most)
        for _ in range(40):
            part = rnd.choices(words, k=60)
            ids, sizes = own.encode([w.encode() for w in part])
            assert sizes.tolist() == [len(want[w]) for w in part] and ids.tolist() == [k for w in part for k in want[w]]


def test_encoder_merges_the_strings_of_a_large_vocabulary_once(monkeypatch):
    from skerry.llm import pieces

    own, merged = pieces.Encoder(tokenizer("word_bpe_49k.json")), []
    inner = own._merged
    monkeypatch.setattr(own, "_merged", lambda words: merged.append(len(words)) or inner(words))
    letters = np.frombuffer(b"abcdefghijklmnop", "S1")
    words = [letters[[i >> k & 15 for k in (0, 4, 8, 12, 16)]].tobytes() for i in range(250_000)]
    first = own.encode([b" ".join(words)])
    assert sum(merged) == len(words)
    for at in range(0, len(words), 50_000):
        own.encode([b" ".join(words[at : at + 50_000])])
    assert sum(merged) == len(words) and np.array_equal(own.encode([b" ".join(words)])[0], first[0])


def test_common_keys_meet_apart(spark):
    from skerry.llm.common import joined_apart, scratch, written

    left = written(spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).cast("long").alias("k"), F.col("id").alias("x")), scratch(spark, "test"))
    right = spark.range(6000).select(F.col("id").alias("k"), (2 * F.col("id")).alias("y")).where("k % 5 != 0")
    for how in ("left", "inner"):
        assert sorted(map(tuple, joined_apart(left, right, "k", how).collect()), key=str) == sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
