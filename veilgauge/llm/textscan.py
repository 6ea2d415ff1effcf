"""Words, lines and shingles of whole texts, found in the UTF-8 bytes of Arrow batches with numpy.

White space is ``[\\x20\\x09-\\x0D]``, all of it ASCII, so that bytes and code points give the same words. Nothing here
works per word in Python: positions come from byte masks, hashes of words and lines from mixed lanes of eight bytes, hashes of runs of words from
rolling polynomials. A batch is cut into pieces of bounded size (a single longer text is a piece by itself).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 4 * 2**20
PIECE_DOCS = 4096
BLOCK = 2**20

U = np.uint64
_MASK = 2**64 - 1
_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_ROLL = 0xA24BAED4963EE407


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, tag: int) -> np.ndarray:
    """``n`` fixed pseudo-random values for one use."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U(_ODD) + U((tag * _BASE) & _MASK))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, extended when longer ones are needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK)
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        return self.up[:n], self.down[:n]


_roll_powers = Powers(_ROLL)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Byte classes: 0 lies between tokens, and a token is a run of bytes of one other class.
SPACED = np.ones(256, dtype=np.uint8)
SPACED[[32, *range(9, 14)]] = 0
_PUNCT = [i for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "_"]
LETTERS = SPACED.copy()
LETTERS[_PUNCT] = 0
WORD_OR_PUNCT = SPACED.copy()
WORD_OR_PUNCT[_PUNCT] = 2


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most ``limit`` (``PIECE_BYTES``) bytes of text and ``PIECE_DOCS`` rows, or one row with more text."""
    limit = PIECE_BYTES if limit is None else limit
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        before = total[at] - size[at]
        end = int(np.searchsorted(total, before + limit, side="right"))
        end = min(max(end, at + 1), at + PIECE_DOCS, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def content(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and the offsets of the texts in them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of ascending byte spans that do not overlap; ``lower`` treats A-Z as a-z.

    A span is cut into lanes of eight bytes, the last one filled up with zeros. Each lane is mixed with its place in the span, and the mixed
    lanes are added up with the span's length. No step is linear in the bytes, so regular texts collide no more often than others.
    """
    out = np.empty(len(start), dtype=np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + BLOCK, side="right")))
        base, stop = int(start[lo]), int(end[hi - 1])
        part = np.zeros(stop - base + 8, dtype=np.uint8)
        part[:-8] = LOWER[data[base:stop]] if lower else data[base:stop]
        at_byte = np.ndarray(stop - base + 1, dtype="<u8", buffer=part.data, strides=(1,))
        size = end[lo:hi] - start[lo:hi]
        lanes = (size + 7) >> 3
        upto = np.cumsum(lanes)
        place = np.arange(int(upto[-1])) - np.repeat(upto - lanes, lanes)
        value = at_byte[np.repeat(start[lo:hi] - base, lanes) + (place << 3)]
        tail = np.flatnonzero((size & 7) != 0)
        value[upto[tail] - 1] &= (U(1) << ((size[tail] & 7).astype(np.uint64) << U(3))) - U(1)
        sums = np.zeros(len(place) + 1, dtype=np.uint64)
        np.cumsum(mix((value + U(_BASE)) ^ ((place + 1).astype(np.uint64) * U(_ODD))), out=sums[1:])
        out[lo:hi] = sums[upto] - sums[upto - lanes] + size.astype(np.uint64) * U(_ODD)
        lo = hi
    return mix(out)


@dataclass
class Words:
    """Words of several texts: byte spans, owner, and the index of each text's first word (one more at the end)."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return hash_spans(self.data, self.start, self.end, lower)


def words_of(column: pa.Array, classes: np.ndarray = SPACED) -> Words:
    data, offsets = content(column)
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return Words(data, offsets, none, none, np.zeros(len(offsets), dtype=np.int64))
    kind = classes[data]
    differs = kind[1:] != kind[:-1]
    begins, ends = kind != 0, kind != 0
    inside = offsets[(offsets > 0) & (offsets < len(data))]  # a word never goes on in the next text
    differs[inside - 1] = True
    begins[1:] &= differs
    ends[:-1] &= differs
    start = np.flatnonzero(begins)
    return Words(data, offsets, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def windows(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every run of ``k`` words inside one text (rolling polynomial)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    left = np.repeat(words.first[1:], words.counts)[:n] - np.arange(n)
    at = np.flatnonzero(left >= k)
    up, down = _roll_powers.get(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:-1], out=sums[1:])
    return at, mix((sums[at + k] - sums[at]) * down[at] + U(k))


def shingle_sets(column: pa.Array, k: int, whole_if_short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct lower-cased ``k``-word shingles of at most ``PIECE_DOCS`` texts: hashes, text index, and first
    index per text. A text of fewer words is one shingle if ``whole_if_short``, else it has none."""
    words = words_of(column)
    hashes = words.hashes(lower=True)
    at, value = windows(words, hashes, k)
    owner = words.doc[at]
    if whole_if_short:
        short = np.flatnonzero((words.counts > 0) & (words.counts < k))
        if len(short):
            extra = np.zeros(len(short), dtype=np.uint64)
            for i in range(k - 1):
                has = words.counts[short] > i
                extra[has] = mix(extra[has] * U(_ROLL) + hashes[words.first[short[has]] + i] + U(i + 1))
            value, owner = np.concatenate([value, extra]), np.concatenate([owner, short])
    order = np.argsort(value)
    order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]  # few texts: sorted by digits
    value, owner = value[order], owner[order]
    if len(value):
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])
        value, owner = value[new], owner[new]
    return value, owner, np.searchsorted(owner, np.arange(len(words.first)))
