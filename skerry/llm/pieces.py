"""Words and subword ids of many texts at once: numpy finds the words of a slice of texts, equal ones are met by a hash that is verified byte by byte, and each distinct
one is looked up or encoded once.

A tokenizer that drops white space, normalises (NFC, lower case) and merges within pre-tokens only encodes pieces between ASCII white space alone as it does in their text:
white space ends a pre-token and composes with nothing.  Pieces of printable ASCII and Latin-1 letters, which NFC leaves alone, are cut into their pre-tokens here, and
the library's model merges all distinct pre-tokens of a slice in a few calls; the whole tokenizer gets the other pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np

#: At most this many bytes are looked at together; longer texts are cut at white space.
MOST = 4 << 20
MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
SPACES = re.compile(rb"[\x20\x09-\x0d]")

_powers: list[np.ndarray] = []
_encoders: dict[str, "Encoder"] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of MULTIPLIER and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = -(-n >> 18) << 18  # little more than n: workers keep 16 bytes for each
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, m, np.uint64)]), dtype=np.uint64) for m in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64))]
    return _powers[0][:n], _powers[1][:n]


def _kinds() -> np.ndarray:
    """Of bytes: 0 white space, 1 letter, 2 digit, 3 other printable ASCII, 4 all else."""
    out = np.full(256, 4, np.uint8)
    out[33:127] = 3
    out[[9, 10, 11, 12, 13, 32]] = 0
    out[97:123] = out[65:91] = out[0xC3] = 1
    out[48:58] = 2
    out[[ord("'"), ord("<")]] = 4  # contractions and special tokens
    return out


KINDS = _kinds()
VALUES = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)


def runs(solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(solid.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each segment of the data, which does not depend on where it lies."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUES[data] * down[: len(data)], out=sums[1:])
    return (sums[ends] - sums[starts]) * up[starts]


def span(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of segments, one behind the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, every: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first, own): numbers of segments of the data, one for each distinct string, and for each segment the number of its string.  Hashes (every, if they are there)
    tell strings apart; that those of a group are equal is verified."""
    key = hashes(data, starts, ends) if every is None else every
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    own = np.empty(len(key), np.int64)
    own[order] = np.cumsum(new) - 1
    first = order[new]
    size = ends - starts
    if np.array_equal(size, size[first][own]) and np.array_equal(data[span(starts, size)], data[span(starts[first][own], size)]):
        return first, own
    raw, place = data.tobytes(), {}
    own = np.array([place.setdefault(raw[a:b], len(place)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
    return np.unique(own, return_index=True)[1], own


def counted(places: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the ascending places fall before each end and not before the one before it."""
    return np.diff(np.searchsorted(places, ends), prepend=0)


def distinct_words(texts: Sequence[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, own, counts): the distinct words between ASCII white space, the number of each word in order, and how many each text has."""
    if sum(map(len, texts)) <= MOST:
        return _distinct(texts)
    place: dict[bytes, int] = {}
    every, counts = [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
    for numbers, part in _blocks(texts):
        words, own, n = _distinct(part)
        every.append(np.array([place.setdefault(w, len(place)) for w in words], np.int64)[own])
        np.add.at(counts, numbers, n)
    return list(place), np.concatenate(every), counts


def distinct_segments(texts: Sequence[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(joined, starts, ends, keys, own, counts): where the distinct words lie in the joined texts, of MOST bytes or little more, and their hashes; the others as in distinct_words()."""
    joined = b" ".join(texts)
    data = np.frombuffer(joined, np.uint8)
    starts, ends = runs(KINDS[data] != 0)
    counts = counted(starts, np.cumsum([len(t) + 1 for t in texts], dtype=np.int64))
    if not len(starts):
        return joined, starts, ends, np.zeros(0, np.uint64), np.zeros(0, np.int64), counts
    keys = hashes(data, starts, ends)
    first, own = grouped(data, starts, ends, keys)
    return joined, starts[first], ends[first], keys[first], own, counts


def _distinct(texts: Sequence[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    joined, starts, ends, _, own, counts = distinct_segments(texts)
    return [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())], own, counts


def _blocks(texts: Sequence[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """The texts' parts in blocks of about MOST bytes, with the numbers of their texts."""
    numbers, held, size = [], [], 0
    for i, text in enumerate(texts):
        for part in [text] if len(text) <= MOST else parted(text, MOST):
            if held and size + len(part) > MOST:
                yield numbers, held
                numbers, held, size = [], [], 0
            numbers.append(i)
            held.append(part)
            size += len(part)
    if held:
        yield numbers, held


def parted(text: bytes, most: int) -> list[bytes]:
    """A text in parts of about `most` bytes, cut before white space."""
    out, at = [], 0
    while len(text) - at > most and (m := SPACES.search(text, at + most)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def spread(rows: np.ndarray, sizes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The rows of groups own[0], own[1], ..., one behind the other; rows holds the groups in order, which have these sizes."""
    return rows[span((np.cumsum(sizes) - sizes)[own], sizes[own])]


class Held:
    """Strings with their ids in flat arrays: numbers of strings by their hashes in order, and bytes and ids of all strings, one behind the other."""

    def __init__(self):
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.bytes, self.ids = np.zeros(0, np.uint8), np.zeros(0, "<u2")
        self.at, self.size, self.ids_at, self.n_ids = (np.zeros(0, np.int32) for _ in range(4))

    def find(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the segments of the data are here, the numbers of those); bytes are compared."""
        here = np.zeros(len(keys), bool)
        if not len(self.keys) or not len(keys):
            return here, np.zeros(0, np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        number = self.numbers[at]
        own = np.flatnonzero((self.keys[at] == keys) & (self.size[number] == sizes))
        n = sizes[own]
        same = data[span(starts[own], n)] == self.bytes[span(self.at[number[own]], n)]
        if not same.all():
            own = own[np.logical_and.reduceat(same, np.cumsum(n) - n)]
        here[own] = True
        return here, number[own]

    def add(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, n_ids: np.ndarray) -> None:
        """Takes segments in, of strings with the same hash the first one only; ids: of all of them, one behind the other."""
        keys, own = np.unique(keys, return_index=True)
        at = np.searchsorted(self.keys, keys)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != keys
            keys, own, at = keys[new], own[new], at[new]
        number = np.arange(len(self.size), len(self.size) + len(own), dtype=np.int32)
        place = at + np.arange(len(own))
        others = np.ones(len(self.keys) + len(own), bool)
        others[place] = False
        for name, x in (("keys", keys), ("numbers", number)):
            both = np.empty(len(others), x.dtype)
            both[place], both[others] = x, getattr(self, name)
            setattr(self, name, both)
        for whole, begins, lengths, x, first, n in (("bytes", "at", "size", data, starts, sizes), ("ids", "ids_at", "n_ids", ids, np.cumsum(n_ids) - n_ids, n_ids)):
            first, n = first[own], n[own]
            for name, more in ((begins, len(getattr(self, whole)) + np.cumsum(n) - n), (lengths, n), (whole, x[span(first, n)])):
                setattr(self, name, np.concatenate([getattr(self, name), more.astype(getattr(self, name).dtype)]))


class Encoder:
    """Ids of whole texts.  Strings are held with their ids; when there are more than `most`, or MOST bytes of them, they become the old ones, of which those that are met
    again are kept."""

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.whole, self.merger = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.merger.normalizer, self.merger.pre_tokenizer = None, WhitespaceSplit()
        self.pieces = self.whole.get_vocab()
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        self.final = np.zeros(1 << 16, bool)
        self.final[[k for s, k in self.pieces.items() if s.endswith("</w>")]] = True
        self.letters = np.arange(256, dtype="<u4")  # the merger splits at the space
        for byte, character in byte_letters().items():
            self.letters[byte] = ord(character) if byte != 32 else 32
        self.most, self.held, self.old = most, Held(), Held()

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, one behind the other, and their numbers: each pre-token ends with the one id that ends a word."""
        text = self.letters[np.frombuffer(b" ".join(words), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.merger.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2")
        sizes = np.diff(np.flatnonzero(self.final[ids]), prepend=-1)
        if len(sizes) != len(words):
            raise AssertionError("a pre-token without an end")
        return ids, sizes

    def strings(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, one behind the other, and their numbers, of segments of the data with these hashes: pre-tokens, or whole pieces where odd."""
        size, at, n = ends - starts, np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        missing, parts, ahead, fresh = np.arange(len(keys)), [], 0, None
        for known in (self.held, self.old):
            here, numbers = known.find(keys[missing], data, starts[missing], size[missing])
            own, missing = missing[here], missing[~here]
            at[own], n[own] = known.ids_at[numbers] + ahead, known.n_ids[numbers]
            parts.append(known.ids)
            ahead += len(known.ids)
            fresh = missing if fresh is None else fresh
        raw = data.tobytes() if len(missing) else b""
        plain, strange = missing[~odd[missing]], missing[odd[missing]]
        numbers = [np.zeros(0, np.int64)]
        for k in range(0, len(plain), 2000):
            own = plain[k : k + 2000]
            ids, sizes = self._merged([raw[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist())])
            parts.append(ids)
            numbers.append(sizes)
        for a, b in zip(starts[strange].tolist(), ends[strange].tolist()):
            parts.append(np.array(self.whole.encode(raw[a:b].decode(), add_special_tokens=False).ids, "<u2"))
            numbers.append(np.array([len(parts[-1])]))
        new, numbers = np.concatenate([plain, strange]), np.concatenate(numbers)
        at[new], n[new] = ahead + np.cumsum(numbers) - numbers, numbers
        every = np.concatenate(parts)
        if len(fresh):
            self.held.add(keys[fresh], data, starts[fresh], size[fresh], every[span(at[fresh], n[fresh])], n[fresh])
        out = every[span(at, n)]
        if len(self.held.keys) > self.most or len(self.held.bytes) > MOST:
            self.old, self.held = self.held, Held()
        return out, n

    def _encode(self, texts: Sequence[bytes], distinct: bool = False) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b" ".join(texts), np.uint8).copy()
        kind = KINDS[data]
        pairs = np.flatnonzero(data == 0xC3) + 1  # two bytes of U+00C0 to U+00FF
        pairs = pairs[~np.isin(data[pairs], (0x97, 0xB7))]  # two signs
        kind[pairs] = 1
        starts, ends = runs(kind != 0)
        strange = np.flatnonzero(kind == 4)
        if len(strange):
            words = np.unique(np.searchsorted(starts, strange, side="right") - 1)
            inside = np.zeros(len(data) + 1, np.int8)
            inside[starts[words]] += 1
            inside[ends[words]] -= 1
            inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
            kind[inside] = 4
        data[(data >= 65) & (data <= 90) & (kind == 1)] += 32
        capital = pairs[(data[pairs] <= 0x9E) & (kind[pairs] == 1)]
        data[capital] += 32
        cut = np.ones(len(data), bool)
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        at = np.flatnonzero((cut | (kind == 2)) & (kind != 0))
        lengths = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        if not len(at):
            return np.zeros(0, "<u2"), np.zeros(len(texts), np.int64)
        # A pre-token ends where the next one or white space starts.
        ends = np.minimum(np.append(at[1:], len(data)), ends[np.searchsorted(ends, at, side="right")])
        # Of words that come once each, so do most pre-tokens.
        keys = hashes(data, at, ends)
        first, own = (np.arange(len(at)),) * 2 if distinct else grouped(data, at, ends, keys)
        ids, sizes = self.strings(data, at[first], ends[first], keys[first], kind[at[first]] == 4)
        until = np.concatenate([[0], np.cumsum(sizes[own])])[np.searchsorted(at, lengths)]
        return ids if distinct else spread(ids, sizes, own), np.diff(until, prepend=0)

    def encode(self, texts: Sequence[bytes], distinct: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and how many each has, as the tokenizer's encode without special tokens gives them.  distinct: the texts are
        words that come once each."""
        if sum(map(len, texts)) <= MOST:
            return self._encode(texts, distinct)
        out, sizes = [np.zeros(0, "<u2")], np.zeros(len(texts), np.int64)
        for numbers, part in _blocks(texts):
            ids, n = self._encode(part, distinct)
            out.append(ids)
            np.add.at(sizes, numbers, n)
        return np.concatenate(out), sizes


def byte_letters() -> dict[int, str]:
    """The printable characters that stand for bytes in byte-level vocabularies: the byte's own in Latin-1 where that is printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return dict(zip((b for b in range(256) if b not in plain), map(chr, range(256, 512))))


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Gives the memory of held strings back; workers are used again by stages that need none."""
    for own in _encoders.values():
        own.held, own.old = Held(), Held()
