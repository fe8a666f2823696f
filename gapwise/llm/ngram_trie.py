"""An n-gram trie in memory-mapped Elias-Fano levels: building blocks for language-model scoring.

The words stand in order of their hash. The pairs of words, and the triples, are cut into chunks, each a file
that is a trie of its own: for every first word a monotone pointer to where its successors begin, the successors
of each as a monotone sequence (what precedes a range is added to it), with a pointer of each pair to its own
successors, and 8-bit codes of the probabilities and back-off weights. All sequences are in Elias-Fano form, and a
word is sought only among the successors of its context.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow.fs

U = np.uint64
_SELECT = np.full((256, 8), 8, dtype=np.uint8)
for _byte in range(256):
    _ones = [b for b in range(8) if _byte >> b & 1]
    _SELECT[_byte, : len(_ones)] = _ones

#: Log10 probabilities and weights, of at most 1, are rounded to multiples of 1/STEPS and held as 8 bits.
STEPS = 28
_RESTORED = 10.0 ** (-np.arange(256) / STEPS)


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(p) * STEPS), 0, 255).astype(np.uint8)


def restore(codes: np.ndarray) -> np.ndarray:
    return _RESTORED[codes]


def elias_fano(values: np.ndarray) -> dict[str, np.ndarray]:
    """Sections for non-decreasing int64 values: low bits packed, high bits in unary, ranks of zeros and ones per 64 of them."""
    n, first = len(values), int(values[0])
    reach = int(values[-1]) - first
    width = min(56, max(0, (reach // n).bit_length() - 1))
    x = (values - first).astype(U)
    high = (x >> U(width)).astype(np.int64)
    size = -(-(n + int(high[-1]) + 1) // 64) * 64
    bits = np.zeros(size, dtype=np.uint8)
    bits[high + np.arange(n)] = 1
    unary = np.packbits(bits, bitorder="little").view("<u8")
    zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(unary).astype(np.int64))[:-1]]).astype("<u8")
    ones = (np.arange(len(unary)) * 64 - zeros.astype(np.int64)).astype("<u8")
    low = np.zeros(n * width // 64 + 3, dtype="<u8")
    if width:
        part, at = x & U((1 << width) - 1), np.arange(n, dtype=np.uint64) * U(width)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        np.bitwise_or.at(low, word, part << shift)
        over = np.flatnonzero(shift + U(width) > U(64))
        np.bitwise_or.at(low, word[over] + 1, part[over] >> (U(64) - shift[over]))
    return {"head": np.array([n, first, width, int(high[-1])], dtype="<i8"), "unary": unary, "zeros": zeros, "ones": ones, "low": low}


class EliasFano:
    """Access and search in what ``elias_fano`` wrote."""

    SECTIONS = ("head", "unary", "zeros", "ones", "low")

    def __init__(self, head: np.ndarray, unary: np.ndarray, zeros: np.ndarray, ones: np.ndarray, low: np.ndarray):
        self.n, self.first, self.width, self.top = (int(v) for v in head)
        self.unary, self.zeros, self.ones = unary, zeros, ones
        raw = low.view(np.uint8)
        self.unaligned = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))

    @staticmethod
    def _select(word: np.ndarray, bits: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The place of the one with ``left`` ones before it in its word: by halves of the word."""
        at = word * 64
        for width in (32, 16, 8):
            count = np.bitwise_count(bits & U((1 << width) - 1)).astype(np.int64)
            upper = left >= count
            left = left - count * upper
            bits = np.where(upper, bits >> U(width), bits)
            at = at + width * upper
        return at + _SELECT[(bits & U(255)).astype(np.int64), left]

    def _select_zero(self, rank: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, rank.astype(U), side="right") - 1
        return self._select(word, ~self.unary[word], rank - self.zeros[word].astype(np.int64))

    def _low(self, at: np.ndarray) -> np.ndarray:
        bit = at * self.width
        return (self.unaligned[bit >> 3] >> (bit & 7).astype(U)) & U((1 << self.width) - 1)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at these places."""
        word = np.searchsorted(self.ones, at.astype(U), side="right") - 1
        high = self._select(word, self.unary[word], at - self.ones[word].astype(np.int64)) - at
        return (high << self.width | self._low(at).astype(np.int64)) + self.first

    def _first_not_less(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of x within reach: the first place whose value isn't less, the end of the run of x's high bits, and x's low bits."""
        high, low = x >> self.width, x.astype(U) & U((1 << self.width) - 1)
        bit = np.where(high > 0, self._select_zero(np.maximum(high - 1, 0)) + 1, 0)
        start, shift = bit - high, bit & 63
        after = ~(self.unary[bit >> 6] >> shift.astype(U))
        run = np.bitwise_count((after & (~after + U(1))) - U(1)).astype(np.int64)
        end = start + run
        if len(over := np.flatnonzero(run + shift >= 64)):  # the run of ones may go on in the next word
            end[over] = self._select_zero(high[over]) - high[over]
        a, b = start, end.copy()
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            less = self._low(np.minimum(mid, self.n - 1)) < low
            a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
        return a, end, low

    def find(self, values: np.ndarray) -> np.ndarray:
        """The position of each value, or -1."""
        out = np.full(len(values), -1, dtype=np.int64)
        x = values - self.first
        rows = np.flatnonzero((x >= 0) & (x >> self.width <= self.top))
        if len(rows):
            a, end, low = self._first_not_less(x[rows])
            hit = (a < end) & (self._low(np.minimum(a, self.n - 1)) == low)
            out[rows[hit]] = a[hit]
        return out

    def successor(self, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The position of each value in its range [low, high), or -1: the first there that isn't less, if it is equal."""
        at = self.find(values)
        return np.where((at >= low) & (at < high), at, -1)


def write_sections(folder: str, name: str, sections: dict[str, np.ndarray]) -> dict:
    """Write arrays into one file of the shared folder; returns path and places. A rerun replaces the file whole."""
    store, path = pyarrow.fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    places, at = {}, 0
    part = f"{path}/{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        for key, array in sections.items():
            array = np.ascontiguousarray(array)
            places[key] = [at, array.nbytes, array.dtype.str]
            pad = -array.nbytes % 8
            out.write(array.tobytes() + b"\0" * pad)
            at += array.nbytes + pad
    store.move(part, f"{path}/{name}")
    return {"path": f"{folder}/{name}", "places": places}


def open_sections(meta: dict) -> dict[str, np.ndarray]:
    """Map a file of a local or mounted shared folder; from another store read it."""
    store, path = pyarrow.fs.FileSystem.from_uri(meta["path"])
    if isinstance(store, pyarrow.fs.LocalFileSystem):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
    else:
        with store.open_input_stream(path) as source:
            raw = np.frombuffer(source.read(), dtype=np.uint8)
    return {key: raw[at : at + size].view(kind) for key, (at, size, kind) in meta["places"].items()}


def named(name: str, sections: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}_{k}": v for k, v in sections.items()}


def opened(parts: dict[str, np.ndarray], name: str) -> EliasFano | None:
    return EliasFano(*[parts[f"{name}_{s}"] for s in EliasFano.SECTIONS]) if f"{name}_head" in parts else None


@dataclass
class Level:
    """The chunks of a sorted table of keys with counts. ``base`` is the position of a chunk's first key in the table."""

    metas: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.firsts = np.array([m["first"] for m in self.metas], dtype=np.int64)
        self.bases = np.array([m["base"] for m in self.metas], dtype=np.int64)
        self._open: dict[int, dict] = {}

    def __getstate__(self):
        return {"metas": self.metas}

    def __setstate__(self, state):
        self.metas = state["metas"]
        self.__post_init__()

    def chunk(self, i: int) -> dict:
        if i not in self._open:
            parts = open_sections(self.metas[i])
            self._open[i] = parts | {"keys": opened(parts, "keys")}
        return self._open[i]

    def _routed(self, bounds: np.ndarray, asked: np.ndarray, in_order: bool = False):
        """(chunk, rows): queries in key order, so that each chunk is met once and read in one direction."""
        if not len(self.metas) or not len(asked):
            return
        order = None if in_order else np.argsort(asked, kind="stable")
        cuts = [0, *np.searchsorted(asked if in_order else asked[order], bounds[1:], side="left").tolist(), len(asked)]
        for i, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if low < high:
                yield i, slice(low, high) if in_order else order[low:high]

    def find(self, keys: np.ndarray, in_order: bool = False) -> np.ndarray:
        """The position of each key in the level, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        for i, rows in self._routed(self.firsts, keys, in_order):
            found = self.chunk(i)["keys"].find(keys[rows])
            out[rows] = np.where(found >= 0, found + self.bases[i], -1)
        return out

    def take(self, section: str, at: np.ndarray) -> np.ndarray:
        """An entry of a section for each position in the level; 0 for -1."""
        out = np.zeros(len(at), dtype=np.int64)
        known = np.flatnonzero(at >= 0)
        for i, rows in self._routed(self.bases, at[known]):
            rows = known[rows]
            out[rows] = self.chunk(i)[section][at[rows] - self.bases[i]]
        return out


def children(pointers: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray]:
    """The successors ``words`` of contexts, those of context i at pointers[i] up to pointers[i + 1], as a monotone sequence.

    To each range the last value of the one before is added.
    """
    sizes = np.diff(pointers)
    full = sizes > 0
    lasts = words[pointers[1:][full] - 1].astype(np.int64)
    return elias_fano(words + np.repeat(np.cumsum(lasts) - lasts, sizes[full]))


class Chunk:
    """All n-grams from one (pair, word) up to that of the next chunk. Words are numbers from 1."""

    def __init__(self, meta: dict):
        parts = open_sections(meta)
        self.first = meta["word"]
        self.codes = {k: parts.get(k) for k in ("g1", "d2", "g2", "d3")}
        self.pointers2, self.words2, self.pointers3, self.words3 = (opened(parts, k) for k in ("p2", "w2", "p3", "w3"))

    @staticmethod
    def sections(pairs: np.ndarray, thirds: np.ndarray, base: int, codes: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """From sorted (pair, third) rows, without thirds of 0 but for pairs that have no other; ``base`` is 1 + the number of words."""
        begins = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        firsts, seconds = np.divmod(pairs[begins], base)
        span = np.arange(firsts[0], firsts[-1] + 2)
        p2 = np.searchsorted(firsts, span)
        real = thirds > 0
        p3 = np.concatenate([[0], np.cumsum(np.add.reduceat(real.astype(np.int64), begins))])
        out = codes | named("p2", elias_fano(p2)) | named("w2", children(p2, seconds)) | named("p3", elias_fano(p3))
        return out | (named("w3", children(p3, thirds[real])) if real.any() else {})

    @staticmethod
    def _child(pointers: EliasFano, words: EliasFano, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        low, high = pointers.access(context), pointers.access(context + 1)
        before = np.where(low > 0, words.access(np.maximum(low - 1, 0)), 0)
        return words.successor(before + word, low, high)

    def weight(self, first: np.ndarray) -> np.ndarray:
        """The back-off weight of words as contexts; 1 of those that aren't."""
        at = first - self.first
        inside = (at >= 0) & (at < self.pointers2.n - 1)
        return np.where(inside, restore(self.codes["g1"][np.where(inside, at, 0)]), 1.0)

    def pair(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The positions of pairs, or -1."""
        out, at = np.full(len(first), -1, dtype=np.int64), first - self.first
        rows = np.flatnonzero((at >= 0) & (at < self.pointers2.n - 1))
        if len(rows):
            out[rows] = self._child(self.pointers2, self.words2, at[rows], second[rows])
        return out

    def third(self, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The positions of triples from those of their pairs, or -1."""
        out, rows = np.full(len(pair), -1, dtype=np.int64), np.flatnonzero(pair >= 0)
        if len(rows) and self.words3 is not None:
            out[rows] = self._child(self.pointers3, self.words3, pair[rows], word[rows])
        return out


@dataclass
class Trie:
    """The words and the chunks of longer n-grams; ``tokens`` is the number of training tokens, ``words`` of distinct ones."""

    words: int
    tokens: int
    level: Level
    metas: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.pairs = np.array([m["pair"] for m in self.metas], dtype=np.int64)
        self.thirds = np.array([m["third"] for m in self.metas], dtype=np.int64)
        self._open: dict[int, Chunk] = {}

    def __getstate__(self):
        return {"words": self.words, "tokens": self.tokens, "level": self.level, "metas": self.metas}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def chunk(self, i: int) -> Chunk:
        if i not in self._open:
            self._open[i] = Chunk(self.metas[i])
        return self._open[i]

    def _runs(self, of: np.ndarray):
        """(chunk, rows) of sorted chunk numbers; none for those before the first."""
        if not len(of):
            return
        cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist()
        for low, high in zip(cuts, [*cuts[1:], len(of)], strict=True):
            if of[low] >= 0:
                yield self.chunk(int(of[low])), slice(low, high)

    def weights(self, words: np.ndarray) -> np.ndarray:
        """Back-off weights of sorted words."""
        out = np.ones(len(words))
        for chunk, rows in self._runs(np.searchsorted(self.pairs // (self.words + 1), words, side="right") - 1):
            out[rows] = chunk.weight(words[rows])
        return out

    def pair_codes(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Discounted probabilities (0 if unknown) and back-off weights (1 if unknown) of sorted pairs.

        The last chunk that starts at or before a pair holds it, if any does.
        """
        p, weight = np.zeros(len(pairs)), np.ones(len(pairs))
        for chunk, rows in self._runs(np.searchsorted(self.pairs, pairs, side="right") - 1):
            at = chunk.pair(*np.divmod(pairs[rows], self.words + 1))
            p[rows] = np.where(at >= 0, restore(chunk.codes["d2"][np.maximum(at, 0)]), 0.0)
            weight[rows] = np.where(at >= 0, restore(chunk.codes["g2"][np.maximum(at, 0)]), 1.0)
        return p, weight

    def third_codes(self, pairs: np.ndarray, which: np.ndarray, thirds: np.ndarray) -> np.ndarray:
        """Discounted probabilities of the triples (pairs[which], thirds), which are sorted; 0 if unknown."""
        out = np.zeros(len(which))
        # A pair may go on over several chunks: the third tells which.
        of = np.searchsorted(self.pairs, pairs, side="right") - 1
        lowest = np.searchsorted(self.pairs, pairs, side="left")
        of = of[which]
        for k in np.flatnonzero(lowest <= np.searchsorted(self.pairs, pairs, side="right") - 1).tolist():
            rows = slice(*np.searchsorted(which, [k, k + 1]).tolist())
            starts = self.thirds[lowest[k] : np.searchsorted(self.pairs, pairs[k], side="right")]
            of[rows] = lowest[k] - 1 + np.searchsorted(starts, thirds[rows], side="right")
        for chunk, rows in self._runs(of):
            asked, back = np.unique(which[rows], return_inverse=True)
            at = chunk.third(chunk.pair(*np.divmod(pairs[asked], self.words + 1))[back], thirds[rows])
            out[rows] = np.where(at >= 0, restore(chunk.codes["d3"][np.maximum(at, 0)]), 0.0) if chunk.words3 else 0.0
        return out
