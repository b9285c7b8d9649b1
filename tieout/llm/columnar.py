"""Text columns as flat byte arrays, for Arrow batches inside Spark tasks.

Every helper works on whole texts. Batches are cut into pieces of a few MB at
row borders, so that the working arrays of a task stay small whatever the
batch; one text is never cut.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
U64 = np.uint64

#: Words between ASCII blanks: 0x20 and 0x09 to 0x0D separate, all else belongs to a word.
BLANK_WORDS = np.ones(256, bool)
BLANK_WORDS[[0x20, 9, 10, 11, 12, 13]] = False
#: Words of ASCII letters, ASCII digits and everything beyond ASCII.
ALNUM_WORDS = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    ALNUM_WORDS[_low : _high + 1] = True
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


#: Hashes are polynomials modulo this prime, whose value at an unknown base no text can be made to share.
PRIME = (1 << 61) - 1
_P, _LOW32, _LOW29 = U64(PRIME), U64((1 << 32) - 1), U64((1 << 29) - 1)
#: Base for hashes that decide nothing alone (features, grams that are compared afterwards).
BASE = 0x16E8FEB86659FD93
#: Bytes whose products with half a power can be summed in 64 bits.
_STRETCH = 1 << 22
_POWERS: dict[int, np.ndarray] = {}


def draw_base() -> int:
    """A base for one run; the driver draws it and hands it to every task."""
    return secrets.randbelow(PRIME - (1 << 32)) + (1 << 31)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> U64(61))
    return np.minimum(x, x - _P)  # below the prime the difference wraps round to a large number


def _times_2_32(x: np.ndarray) -> np.ndarray:
    """x * 2**32 modulo the prime, below 2**62 + 2**35, for any x of 64 bits."""
    return (x >> U64(29)) + ((x & _LOW29) << U64(32))


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, by 32-bit halves."""
    a1, a0, b1, b0 = a >> U64(32), a & _LOW32, b >> U64(32), b & _LOW32
    low = a0 * b0
    return _reduced((a1 * b1 << U64(3)) + _times_2_32(a1 * b0 + a0 * b1) + (low & _P) + (low >> U64(61)))


def _powers(base: int, n: int) -> np.ndarray:
    """The first powers of a base modulo the prime, at least n."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        if len(_POWERS) > 1:  # a base and its inverse; a worker that lives on does not keep those of earlier runs
            _POWERS.clear()
        size = max(n, PIECE_BYTES * 5 // 4)
        known = np.ones(1, U64) if known is None else known
        while len(known) < size:
            more = known[: size - len(known)]
            known = np.concatenate([known, multiply(more, np.full(1, pow(base, len(known), PRIME), U64))])
        _POWERS[base] = known
    return known


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the accented capitals of Latin-1, byte for byte."""
    out = LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    out[at] += 0x20
    return out


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values in a row, and where each value starts (one entry more
    than there are values). A null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], *texts: str, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose text columns hold about ``size`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        width = np.zeros(batch.num_rows, np.int64)
        for name in texts:
            width += np.diff(flat(batch.column(name))[1])
        piece = np.cumsum(width) // size
        cuts = np.flatnonzero(np.diff(piece)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(a, b - a)


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and value number of each run of ``inside`` bytes; runs end with their value."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    on = inside[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = on[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = on[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start, end = np.flatnonzero(on & ~before), np.flatnonzero(on & ~after) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


class Hasher:
    """64-bit hashes of any spans of one byte array: their polynomial at ``base``
    modulo the prime. Two different spans of n bytes share it with
    probability n / 2**61 over the draw of the base, whatever their bytes."""

    def __init__(self, data: np.ndarray, base: int = BASE):
        n = len(data)
        power = _powers(base, n + 1)
        self.inverse = _powers(pow(base, -1, PRIME), n + 1)
        # sums of the products with the low and the high halves of the powers, reduced where a stretch ends
        self.low, self.high = np.zeros(n + 1, U64), np.zeros(n + 1, U64)
        for at in range(0, n, _STRETCH):
            value = data[at : at + _STRETCH].astype(U64) + U64(1)
            some = power[at : at + len(value)]
            for sums, half in ((self.low, some & _LOW32), (self.high, some >> U64(32))):
                np.cumsum(value * half, out=sums[at + 1 : at + 1 + len(value)])
        self.carry = np.zeros(max(1, -(-n // _STRETCH)) + 1, U64)
        for i, at in enumerate(range(0, n, _STRETCH)):
            self.carry[i + 1] = (int(self.carry[i]) + int(self._sum(np.array([min(n, at + _STRETCH)]))[0])) % PRIME

    def _sum(self, at: np.ndarray) -> np.ndarray:
        low = self.low[at]
        return _reduced((low & _P) + (low >> U64(61)) + _times_2_32(self.high[at]))

    def _prefix(self, at: np.ndarray) -> np.ndarray:
        if len(self.carry) == 2:
            return self._sum(at)
        stretch = np.maximum(at - 1, 0) // _STRETCH
        return _reduced(self._sum(at) + self.carry[stretch])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(multiply(_reduced(self._prefix(end) + _P - self._prefix(start)), self.inverse[start]))


def grams(data: np.ndarray, words: int) -> np.ndarray:
    """Hash of the 8 * ``words`` bytes from each position on; equal bytes, equal hash."""
    n = len(data) - 8 * words + 1
    out = np.zeros(max(n, 0), U64)
    if n > 0:
        data = np.ascontiguousarray(data)
        for i in range(words):
            out = mix(out + np.ndarray((n,), "<u8", data, 8 * i, (1,)))
    return out


def shingles(words: np.ndarray, doc: np.ndarray, n_docs: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of a document, with repeats, and their
    document numbers in order. A document with fewer words gives one for all
    of them; one without words gives none."""
    count = np.bincount(doc, minlength=n_docs)
    long, short = count >= k, (count > 0) & (count < k)
    step = mix(np.arange(1, k + 1, dtype=U64)) | U64(1)
    first = np.cumsum(count) - count
    at = np.flatnonzero(long[doc]) if len(doc) else np.zeros(0, np.int64)
    at = at[at - first[doc[at]] + k <= count[doc[at]]]
    value = np.zeros(len(at), U64)
    for j in range(k):
        value += words[at + j] * step[j]
    few = np.flatnonzero(short)
    rest = np.zeros(len(few), U64)
    for j in range(k - 1):
        has = count[few] > j
        rest[has] += words[first[few[has]] + j] * step[j]
    value, owner = np.concatenate([mix(value), mix(rest + count[few].astype(U64))]), np.concatenate([doc[at], few])
    if len(few):
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    return value, owner


def unique_pairs(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value), in order."""
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[keep], owner[keep]


def sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` for each owner 0 .. n-1; owners in order. Wraps for integers."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    edge = np.searchsorted(owner, np.arange(n + 1))
    return total[edge[1:]] - total[edge[:-1]]


def minima(values: np.ndarray, owner: np.ndarray, n: int, empty: int) -> np.ndarray:
    """Smallest value of each owner 0 .. n-1; owners in order."""
    out = np.full(n, empty, values.dtype)
    if len(values):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[owner[first]] = np.minimum.reduceat(values, first)
    return out


def take_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The given byte spans as a binary column."""
    picked, edges = gather(data, start, end - start)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edges), pa.py_buffer(picked)])
    return column.cast(pa.binary())


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values`` of the given runs one after another, and where each run begins (one entry more)."""
    edges = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=edges[1:])
    return values[np.arange(edges[-1]) + np.repeat(start - edges[:-1], size)], edges
