"""Token counts by whole-token shortcut, for a SentencePiece BPE model.

The model's normaliser is the identity with a dummy prefix, white space other than U+0020 is ordinary text, and no piece holds U+2581 behind another
character.  So a text splits before every run of spaces into units that merge alone.  `whole_tokens` proves offline, by encoding every piece of the
vocabulary, which unit strings come out as one token; those are counted by lookup.  Only the other units are merged.

Defined cases: null counts as empty and has 0 tokens; rows, nulls and repeats are kept one for one; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

SPACE = "▁"
LIMIT = 4096

_models: dict[str, "Units"] = {}


class Units(dict):
    """Unit (bytes without its leading space) -> number of tokens that it adds behind one space."""

    def __init__(self, path: str, most: int = 300_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most = most
        self.whole = whole_tokens(self.model)
        super().__init__(self.whole)

    def __missing__(self, unit: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(self.whole)
        # The dummy prefix stands for the unit's leading space; alone, as the last space of a text, it needs no merging.
        out = self[unit] = len(self.model.encode(unit.decode())) if unit else 1
        return out

    def count(self, text: bytes) -> int:
        units = text.split(b" ")
        if b"" not in units and SPACE_BYTES not in text:
            return sum(map(self.__getitem__, units))
        if not text:
            return 0
        return self.spaced(text)

    def spaced(self, text: bytes) -> int:
        """Texts with runs of spaces, or with U+2581 itself, which the model takes for a space: a unit is a run of spaces and what follows it."""
        total, unit, open_run = 0, [], False
        for piece in text.replace(SPACE_BYTES, b" ").split(b" "):
            # Pieces alternate with single spaces; empty ones extend the run in front of the next piece.
            unit.append(piece)
            open_run = not piece
            if not open_run:
                total += self[b" ".join(unit)]
                unit = []
        return total + (self[b" ".join(unit)] if open_run else 0)


SPACE_BYTES = SPACE.encode()


def whole_tokens(model) -> dict[bytes, int]:
    """The offline proof: of the vocabulary's strings that can be a unit, those that encode alone as exactly themselves."""
    out = {}
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or not piece.startswith(SPACE) or not piece.strip(SPACE):
            continue
        unit = piece[1:].replace(SPACE, " ")
        if model.encode(unit) == [k]:
            out[unit.encode()] = 1
    return out


def units(path: str) -> Units:
    if path not in _models:
        _models[path] = Units(path)
    return _models[path]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row."""

    def run(batches):
        model = units(path)
        for part in slices(batches, "text"):
            texts = utf8(part.column(1))
            n = [model.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
