"""Byte-level BPE by a tokenization automaton, and decoding by its arc labels.

`Automaton` starts from one state with an arc for each byte.  Each merge (u, v) -> w, in order of rank, is a gadget (after Berglund, Martens and van der Merwe,
"Constructing a BPE tokenization DFA", 2024):

* v no longer follows u: the state behind u loses its arc v;
* wherever u could be read, w can be read now;
* the state behind w is a copy of the state behind v, as it was before the gadget.

After all gadgets the automaton is deterministic, its states are the tokens last read, and a path spells a token sequence exactly if BPE makes that sequence of
its text.  Written out, the table would have some 50,000 rows of up to 50,000 arcs; the gadgets are kept instead (two parts and a rank for each token), and an
arc is derived from them on first use and put into the transition table.  A vocabulary in which a token's merge can never apply, or where parts
come after their token, is refused, for which ranks decide otherwise.

Encoding a pre-split word needs no search: exactly one token ends the encoding of each prefix, the one whose arc leaves the state of the prefix before it.  So a
word is read from left to right, by byte transitions of a suffix trie and table look-ups.  Words are held in a bounded cache.

Defined cases: null counts as empty and gives no ids; special strings in a text are their own tokens, as the library has them by default; rows, nulls and repeats are
kept one for one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PieceCache, slices, utf8

#: The pre-tokenizer's pattern, with white space as Unicode has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable in Latin-1, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The gadgets of all merges, the transition table as far as it was used, and the tokens' byte strings (arc labels)."""

    def __init__(self, labels: dict[bytes, int], merges: list[tuple[bytes, bytes]], most_arcs: int = 500_000):
        n = max(labels.values()) + 1
        self.labels: list[bytes] = [b""] * n
        self.left, self.right, self.rank = [0] * n, [0] * n, [-1] * n  # rank -1: a byte's arc, there from the start
        self.merged: dict[int, int] = {}
        self.arcs: dict[int, bool] = {}
        self.size, self.most_arcs = n, most_arcs
        for text, k in labels.items():
            self.labels[k] = text
        made = [False] * n
        for b in range(256):
            made[labels[bytes([b])]] = True
        for rank, (a, b) in enumerate(merges):
            u, v, w = labels[a], labels[b], labels[a + b]
            if made[w] or not (made[u] and made[v]):
                raise ValueError(f"merge {rank} is no gadget")
            self.gadget(u, v, w, rank)
            made[w] = True
        #: Tokens by their bytes read backwards, as a trie: state -> byte -> state, and the token that ends at a state.
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for text, k in labels.items():
            if text and made[k]:
                at = 0
                for byte in reversed(text):
                    at = self.trie[at].setdefault(byte, len(self.trie))
                    if at == len(self.trie):
                        self.trie.append({})
                        self.ends.append(-1)
                self.ends[at] = k

    def gadget(self, u: int, v: int, w: int, rank: int) -> None:
        if not self._arc(u, v, rank):
            raise ValueError(f"merge {rank} can never apply")
        self.left[w], self.right[w], self.rank[w] = u, v, rank
        self.merged[u * self.size + v] = rank

    def _arc(self, x: int, y: int, time: int) -> bool:
        """Whether the state behind x has an arc y once the gadgets of ranks below `time` are in place."""
        rank, merged, size = self.rank, self.merged, self.size
        while True:
            if merged.get(x * size + y, time) < time:
                return False
            if rank[y] >= rank[x] and rank[y] >= 0:  # y's gadget came last: it could be read wherever its left part could, without the arc that it took away
                time, y = rank[y] + 1, self.left[y]
            elif rank[x] >= 0:  # x's state is a copy of its right part's, before the gadget
                time, x = rank[x], self.right[x]
            else:
                return True

    def follows(self, x: int, y: int) -> bool:
        """The transition table: whether y may be read behind x."""
        key = x * self.size + y
        out = self.arcs.get(key)
        if out is None:
            if len(self.arcs) >= self.most_arcs:
                self.arcs.clear()
            out = self.arcs[key] = self._arc(x, y, len(self.rank) + 1)
        return out

    def encode(self, word: bytes) -> list[int]:
        """The ids of one pre-split word."""
        trie, ends, arcs, size, labels = self.trie, self.ends, self.arcs, self.size, self.labels
        state = [-1] * (len(word) + 1)
        for i in range(1, len(word) + 1):
            at, j = 0, i
            while j:
                at = trie[at].get(word[j - 1])
                if at is None:
                    break
                j -= 1
                k = ends[at]
                if k >= 0:
                    before = state[j]
                    if before < 0 if not j else ((ok := arcs.get(before * size + k)) or ok is None and self.follows(before, k)):
                        state[i] = k
                        break
        out, i = [], len(word)
        while i:
            out.append(state[i])
            i -= len(labels[state[i]])
        return out[::-1]


_codecs: dict[str, "Codec"] = {}


class Codec:
    """Whole texts to ids and back, for a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_characters()
        raw = lambda s: bytes(to_byte[c] for c in s)
        vocabulary = {raw(s): k for s, k in spec["model"]["vocab"].items() if all(c in to_byte for c in s)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        for s in self.special:
            vocabulary.pop(s, None)
        self.automaton = Automaton(vocabulary, [(raw(a), raw(b)) for a, b in merges])
        self.labels = self.automaton.labels + [b""] * (max([0, *self.special.values()]) + 1 - len(self.automaton.labels))
        for s, k in self.special.items():
            self.labels[k] = s
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile(b"(" + b"|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + b")") if self.special else None
        self.words = PieceCache(lambda w: np.array(self.automaton.encode(w), "<u4").tobytes())
        self.pieces = PieceCache(self._piece)

    def _piece(self, piece: bytes) -> bytes:
        words = self.pattern.findall(piece.decode())
        if len(words) == 1:  # is held as a piece
            return self.words.get(piece) or self.words.encode(piece)
        return b"".join([self.words[w.encode()] for w in words])

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.split is not None and any(s in text for s in self.special):
            return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._plain(p) for p in self.split.split(text))
        return self._plain(text)

    def _plain(self, text: bytes) -> bytes:
        # The pattern always splits before a space that is followed by something else than white space.  Cutting there is exact; where what follows a space is
        # not plainly visible (ASCII controls, spaces, characters beyond ASCII that may be white space), pieces are kept together.
        pieces = text.split(b" ")
        out, at, n = [], 0, len(pieces)
        if n == 1:
            return self.pieces[text] if text else b""
        held = pieces[0]
        for p in pieces[1:]:
            if p and (33 <= p[0] < 127 or p[0] == 195):  # 195 starts U+00C0 to U+00FF: letters and signs
                if held or at:
                    out.append(held)
                held = b" " + p
            else:
                held += b" " + p
            at = 1
        out.append(held)
        return b"".join(map(self.pieces.__getitem__, out))

    def decode(self, ids: np.ndarray) -> bytes:
        """The arcs' labels one behind the other; what is no UTF-8 is replaced, as the library does."""
        raw = b"".join(map(self.labels.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "replace").encode()


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row: ids of the whole text, and the text decoded from them; with_ids: and the ids."""

    def run(batches):
        own = codec(path)
        for part in slices(batches, "text", 4 << 20):
            raws = [own.encode(text) for text in utf8(part.column(1))]
            text_hash = [hashlib.sha256(own.decode(np.frombuffer(raw, "<u4"))).hexdigest() for raw in raws]
            columns = {"doc_id": part.column(0), "n_tokens": pa.array([len(r) // 4 for r in raws], pa.int64()), "ids_sha256": pa.array([hashlib.sha256(r).hexdigest() for r in raws], pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())}
            if with_ids:
                columns["ids"] = pa.array([np.frombuffer(r, "<i4") for r in raws], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>)."""

    def run(batches):
        own = codec(path)
        for part in slices(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.frombuffer(own.encode(t), "<u4").astype(np.int32) for t in utf8(part.column(1))], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids array<int>); null ids give an empty text."""

    def run(batches):
        own = codec(path)
        for batch in batches:
            texts = [own.decode(np.array(x or [], np.uint32)).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
