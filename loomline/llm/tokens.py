"""Byte-level BPE ids of whole Arrow columns.

Byte-level BPE works on pieces of text alone (a word with the space before it, a run of digits,
signs or white space). Texts of common characters are cut into these pieces in numpy, and each
distinct piece is encoded once and remembered in the worker by a 64-bit hash. Where the file's merges
are in the order of their ids, byte-level BPE is merging by least id: `tiktoken` does that on bytes;
other files' pieces are encoded by the `tokenizers` library's model. Texts with other characters, or
with the string of an added token, go to that library whole. All give its ids, an added token in a text
counting as that token.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa

from . import kernels as K

#: Pieces a worker remembers, at most; it then starts anew. A single text may have more.
CACHE_PIECES = 500_000
#: Slots of the table of pieces when it is made: a power of two.
_SLOTS = 1 << 20
_LETTER, _DIGIT, _WHITE, _SIGN, _OTHER = range(5)
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters after an apostrophe that make a piece with it.
_SHORT = ("s", "t", "m", "d", "re", "ve", "ll")


def _kinds() -> np.ndarray:
    """Kind of each code point below 0x2100; _OTHER for those that are not surely of one kind in every version of Unicode."""
    kind = np.full(0x2100, _OTHER, np.uint8)
    for i in (*range(0x530), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC):
        c = unicodedata.category(chr(i))
        kind[i] = _LETTER if c[0] == "L" else _DIGIT if c[0] == "N" else _SIGN
        if c == "Cn":
            kind[i] = _OTHER
    kind[[x for x in _SPACES if x < 0x2100]] = _WHITE
    return kind


_KIND = _kinds()
#: The character by which byte-level BPE writes each byte: visible ones themselves, the others from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_WRITTEN = {b: (b if b in _VISIBLE else 256 + sum(x not in _VISIBLE for x in range(b))) for b in range(256)}


def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts (in bytes) of the pieces of all texts, and which texts hold characters of unsure kind."""
    points = K.codepoints(data)
    cut = K.char_offsets(data, offs)
    kind = np.where(points < len(_KIND), _KIND[np.minimum(points, len(_KIND) - 1)], _OTHER).astype(np.uint8)
    n = len(points)
    odd = np.zeros(len(offs) - 1, bool)
    if not n:
        return np.zeros(0, np.int64), odd
    odd[np.searchsorted(cut, np.flatnonzero(kind == _OTHER), "right") - 1] = True
    head = np.zeros(n + 1, bool)
    head[cut] = True
    new = head[:-1].copy()
    new[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(new)
    ends = np.append(runs[1:], n)
    begin = np.zeros(n, bool)
    white = kind[runs] == _WHITE
    begin[runs[white]] = True
    after = white & (ends - runs > 1) & ~head[ends]
    begin[ends[after] - 1] = True
    solid = runs[~white]
    spaced = np.zeros(len(solid), bool)
    inner = ~head[solid]
    spaced[inner] = points[solid[inner] - 1] == 32
    begin[solid[~spaced]] = True
    mark = np.flatnonzero((points == 39) & new & begin)
    for i in mark.tolist():
        if i + 1 < n and new[i + 1] and kind[i + 1] == _LETTER and not head[i + 1]:
            tail = "".join(map(chr, points[i + 1 : i + 3])) if not head[min(i + 2, n)] else chr(points[i + 1])
            long = next((len(s) for s in _SHORT if tail.startswith(s)), 0)
            if long:
                begin[i + 1] = False
                if i + 1 + long < n and kind[i + 1 + long] == _LETTER and not head[i + 1 + long]:
                    begin[i + 1 + long] = True
    return np.flatnonzero((data & 0xC0) != 0x80)[begin], odd


class Numbers:
    """Numbers 0, 1, ... of 64-bit hashes in the order in which they came: a table with open addressing, looked up many at a time.

    It grows, so that at least half of its slots stay free.
    """

    def __init__(self):
        self.keys, self.values, self.n = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int32), 0

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for new ones."""
        out = np.full(len(hashes), -1, np.int64)
        left, slot = np.arange(len(hashes)), self._slot(hashes)
        while len(left):
            key = self.keys[slot]
            same = key == hashes[left]
            out[left[same]] = self.values[slot[same]]
            on = ~same & (key != 0)
            left, slot = left[on], (slot[on] + 1) % len(self.keys)
        return out

    def add(self, hashes: np.ndarray) -> None:
        """New hashes, each once."""
        slots = len(self.keys)
        while 2 * (self.n + len(hashes)) > slots:
            slots *= 2
        if slots > len(self.keys):
            full = self.keys != 0
            keys, values = self.keys[full], self.values[full]
            self.keys, self.values = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
            self._put(keys, values)
        self._put(hashes, np.arange(self.n, self.n + len(hashes), dtype=np.int32))
        self.n += len(hashes)

    def _put(self, hashes: np.ndarray, values: np.ndarray) -> None:
        left, slot = np.arange(len(hashes)), self._slot(hashes)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]] = hashes[left[first]]
            self.values[slot[first]] = values[left[first]]
            on = np.ones(len(left), bool)
            on[first] = False
            left, slot = left[on], (slot[on] + 1) % len(self.keys)


def _ranked(path: str) -> Callable[[bytes], list[int]] | None:
    """Encoding of one piece by merging the neighbours of least id; None if the file's merges are in another order or it has more than merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocabulary = model.get("vocab")
    plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain:
        return None
    made = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    bytes_of = {chr(c): b for b, c in _WRITTEN.items()}
    if None in made or made != sorted(made) or len(made) + 256 != len(vocabulary) or any(c not in bytes_of for w in vocabulary for c in w):
        return None
    import tiktoken

    ranks = {bytes(bytes_of[c] for c in w): i for w, i in vocabulary.items()}
    return tiktoken.Encoding("pieces", pat_str=r"\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """a, doubled until it has n places."""
    while len(a) < n:
        a = np.concatenate((a, np.zeros_like(a)))
    return a


class Encoder:
    """A tokenizer file, with the ids of the pieces seen so far."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ranked = _ranked(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.seen = Numbers()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.long = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Ids of the pieces at these bytes, by the model alone."""
        size = ends - starts
        cut = np.concatenate(([0], np.cumsum(size)))
        raw = data[np.repeat(starts - cut[:-1], size) + np.arange(cut[-1])].tobytes()
        cut = cut.tolist()
        if self.ranked:
            found = [self.ranked(raw[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
        else:
            tokenize, raw = self.tokenizer.model.tokenize, raw.decode("latin-1").translate(_WRITTEN)
            found = [[x.id for x in tokenize(raw[a:b])] for a, b in zip(cut, cut[1:], strict=False)]
        n, long = self.seen.n, np.fromiter(map(len, found), np.int32, len(found))
        used = self.used + int(long.sum())
        self.flat = _room(self.flat, used)
        self.at, self.long = _room(self.at, n + len(found)), _room(self.long, n + len(found))
        self.flat[self.used : used] = np.fromiter(chain.from_iterable(found), np.uint32, used - self.used)
        self.long[n : n + len(found)] = long
        self.at[n : n + len(found)] = self.used + np.cumsum(long) - long
        self.used = used

    def encode(self, column: pa.Array):
        """(row, ids) of each text, in order."""
        for at, _, data, offs in K.slices(column, 1 << 19):
            starts, odd = pieces(data, offs)
            n = len(offs) - 1
            for token in self.added:
                raw, place = data.tobytes(), -1
                while (place := raw.find(token, place + 1)) >= 0:
                    odd[np.searchsorted(offs, place, "right") - 1] = True
            ends = np.append(starts[1:], len(data))
            ids, cut = np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
            if len(starts):
                hashes = np.maximum(K.run_hashes(data, starts, ends), np.uint64(1))
                entry = self.seen.find(hashes)
                new = np.flatnonzero(entry < 0)
                if len(new):
                    fresh, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
                    if self.seen.n and self.seen.n + len(fresh) > CACHE_PIECES:
                        self._clear()
                        new = np.arange(len(hashes))
                        fresh, first, back = np.unique(hashes, return_index=True, return_inverse=True)
                    at_first = new[first]
                    begin = self.seen.n
                    self._learn(data, starts[at_first], ends[at_first])
                    entry[new] = begin + back
                    self.seen.add(fresh)
                long = self.long[entry].astype(np.int64)
                total = np.concatenate(([0], np.cumsum(long)))
                ids = self.flat[np.repeat(self.at[entry] - total[:-1], long) + np.arange(total[-1])]
                cut = total[np.searchsorted(starts, offs, "left")]
            for i in range(n):
                if odd[i]:
                    yield at + i, np.array(self.tokenizer.encode(data[offs[i] : offs[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
                else:
                    yield at + i, ids[cut[i] : cut[i + 1]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
