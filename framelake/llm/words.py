"""Word scanning on Arrow text columns, as numpy array work.

A word is a maximal run of kept bytes; all the word rules used here are byte rules (every byte of a multi-byte
character counts alike), so a text never has to be decoded. A word's hash is SipHash-1-3 of its bytes as they are read
(a keyed pseudo-random function, computed for all words at once), or a keyed BLAKE2b of a word of LONG_WORD bytes or
more. Two keys give two independent hashes. Memory is bounded by slicing texts at non-word bytes.

Runs of words are hashed by sums of word hashes times odd random factors, one for each place. Two different runs get
equal 64-bit hashes with a probability of about 2**-60, and nothing about the words (their length, letters or order)
raises it: the keys and factors are random bits, fixed only so that every task and every later run agrees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
GROUP_BYTES = 1 << 20
LONG_WORD = 64
_U = np.uint64
_KEYS = [hashlib.sha256(b"word hash %d" % i).digest() for i in range(2)]
_TAILS = np.array([(1 << 8 * n) - 1 for n in range(8)], _U)
_factors = np.random.default_rng(20240229).integers(0, 1 << 63, 64, np.uint64) << _U(1) | _U(1)


def byte_table(*, words: str, lower: bool) -> np.ndarray:
    """256 entries: the byte a kept byte is read as (never 0), or 0 for a byte that ends words.

    ``words`` is "alnum" (ASCII letters, digits and every byte of a non-ASCII character) or "nonspace" (all but
    space and tab to carriage return). NUL bytes under "nonspace" are read as 256, see ``_values``.
    """
    kept = np.zeros(256, np.uint16)
    for b in range(256):
        if words == "alnum":
            ok = b >= 0x80 or chr(b).isalnum()
        else:
            ok = b != 0x20 and not 0x09 <= b <= 0x0D
        if ok:
            kept[b] = (b + 32 if lower and 0x41 <= b <= 0x5A else b) or 256
    return kept


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _round(v: list[np.ndarray]) -> None:
    """One SipRound, in place."""

    def turn(i: int, n: int) -> None:
        v[i] = v[i] << _U(n) | v[i] >> _U(64 - n)

    for a, b, n, m, half in ((0, 1, 13, 32, True), (2, 3, 16, 0, False), (0, 3, 21, 0, False), (2, 1, 17, 32, True)):
        v[a] += v[b]
        turn(b, n)
        v[b] ^= v[a]
        if half:
            turn(a, m)


def word_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray, which: int = 0) -> np.ndarray:
    """SipHash-1-3 of the words of ``data`` (as they are read) at ``start``; a keyed BLAKE2b of long ones."""
    key = _KEYS[which]
    out = np.empty(len(start), _U)
    for i in np.flatnonzero(size >= LONG_WORD):
        word = data[start[i] : start[i] + size[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=key).digest(), "little")
    # Eight bytes from any place on, read as a number.
    lanes = np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    k0, k1 = np.frombuffer(key[:16], "<u8")
    rows = np.flatnonzero(size < LONG_WORD)
    at, left = start[rows], size[rows]
    ends = left.astype(_U) << _U(56)
    v = [np.full(len(rows), x ^ _U(c)) for x, c in ((k0, 0x736F6D6570736575), (k1, 0x646F72616E646F6D), (k0, 0x6C7967656E657261), (k1, 0x7465646279746573))]
    while len(rows):
        last = left < 8
        lane = lanes[at]
        lane = np.where(last, lane & _TAILS[np.minimum(left, 7)] | ends, lane)
        v[3] ^= lane
        _round(v)
        v[0] ^= lane
        done = [x[last] for x in v]
        done[2] ^= _U(0xFF)
        for _ in range(3):
            _round(done)
        out[rows[last]] = done[0] ^ done[1] ^ done[2] ^ done[3]
        more = ~last
        rows, at, left, ends, v = rows[more], at[more] + 8, left[more] - 8, ends[more], [x[more] for x in v]
    return out


@dataclass
class Words:
    """The words of the documents ``first .. first + n_docs - 1`` of a batch."""

    first: int
    n_docs: int
    data: np.ndarray  # the batch's bytes
    offs: np.ndarray  # where each document starts in ``data``, and the end
    doc: np.ndarray  # document of each word, counted from ``first``; ascending
    start: np.ndarray  # byte positions in ``data``
    end: np.ndarray
    hash: np.ndarray  # uint64

    def bounds(self) -> np.ndarray:
        """Word number at which each document starts, and the total."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offs


def scan(data: np.ndarray, offs: np.ndarray, table: np.ndarray, which: int = 0) -> tuple[np.ndarray, ...]:
    """(doc, start, end, hash) of all words of the documents given by ``offs``."""
    parts: list[tuple[np.ndarray, ...]] = []
    at, stop = int(offs[0]), int(offs[-1])
    while at < stop:
        upto = min(stop, at + SLICE_BYTES)
        if upto < stop:
            nearest = offs[np.searchsorted(offs, upto, "right") - 1]
            if nearest > at:
                upto = int(nearest)
            else:  # inside one long document: cut after a byte that ends words
                ends = np.flatnonzero(table[data[at:upto]] == 0)
                while not len(ends) and upto < stop:
                    last, upto = upto, min(stop, upto + SLICE_BYTES)
                    ends = np.flatnonzero(table[data[last:upto]] == 0) + (last - at)
                upto = at + int(ends[-1]) + 1 if len(ends) else upto
        value = table[data[at:upto]]
        word = value != 0
        edge = np.zeros(len(word) + 1, bool)
        edge[0] = edge[-1] = True
        inner = offs[(offs > at) & (offs < upto)] - at
        edge[inner] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        h = word_hashes(value.astype(np.uint8), s, e - s, which)
        doc = np.searchsorted(offs, s + at, "right") - 1
        parts.append((doc, s + at, e + at, h))
        at = upto
    if not parts:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, _U)
    return tuple(np.concatenate(x) for x in zip(*parts))


def groups(column: pa.Array, table: np.ndarray, which: int = 0) -> Iterator[Words]:
    """The column's documents in groups of at most GROUP_BYTES, or one longer document."""
    data, offs = text_buffer(column)
    at, n = 0, len(offs) - 1
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offs, offs[at] + GROUP_BYTES, "right")) - 1)
        yield Words(at, upto - at, data, offs[at : upto + 1], *scan(data, offs[at : upto + 1], table, which))
        at = upto
    pa.default_memory_pool().release_unused()  # what the last batches left, before the next is read


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive word hashes (may span documents; see ``whole``)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    by = factors(k)
    out = h[:n] * by[0]
    for j in range(1, k):
        out += h[j : j + n] * by[j]
    return mix(out)


def factors(k: int) -> np.ndarray:
    """The first k odd random factors."""
    global _factors
    if k > len(_factors):
        _factors = np.random.default_rng(20240229).integers(0, 1 << 63, 2 * k, np.uint64) << _U(1) | _U(1)
    return _factors


def whole(doc: np.ndarray, k: int) -> np.ndarray:
    """For each run of k words, whether one document holds it."""
    n = len(doc) - k + 1
    return doc[:n] == doc[k - 1 :] if n > 0 else np.zeros(0, bool)


def sliding_least(g: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, g.dtype)
    least = g[:n].copy()
    for j in range(1, w):
        np.minimum(least, g[j : j + n], out=least)
    return least


def winnow(g: np.ndarray, doc: np.ndarray, k: int, w: int) -> np.ndarray:
    """Positions of the k-grams that are the least of some w consecutive k-grams of one document, all ties included."""
    least = sliding_least(g, w)
    n = len(least)
    if not n:
        return np.zeros(0, np.int64)
    ok = whole(doc, k + w - 1)
    chosen = np.zeros(len(g), bool)
    for j in range(w):
        chosen[j : j + n] |= ok & (g[j : j + n] == least)
    return np.flatnonzero(chosen)


def covered(n_words: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n_words words lie in a window of ``length`` words at one of ``starts``."""
    change = np.zeros(n_words + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + length, n_words), -1)
    return np.cumsum(change[:-1]) > 0


def offsets_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))


def large_list(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column from flat values and each row's count."""
    return pa.ListArray.from_arrays(pa.array(offsets_of(counts), pa.int32()), values)
