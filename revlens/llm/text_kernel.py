"""Vectorised word and shingle hashing over Arrow string columns.

The operators that look at every word of every text work on the UTF-8 bytes
of whole Arrow batches with numpy instead of looping over Python strings.
Separators are ASCII in every word definition used here, so a word is a run
of non-separator bytes and multi-byte characters need no decoding.

Memory: about 60 bytes per text byte of one slice; a slice holds rows of
together ``SLICE_BYTES`` or one longer text.  A longer text is split part by
part (``PART_BYTES``, cut behind a word), so it costs 1 byte per text byte and
24 per word, and 60 per byte of one part only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
PART_BYTES = 4 << 20
_U = np.uint64


def _table(is_separator) -> np.ndarray:
    return np.array([not is_separator(b) for b in range(256)])


#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased.
ALNUM = _table(lambda b: b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F)
#: Word bytes of ``[^\x20\x09-\x0D]+``.
NON_SPACE = _table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256).astype(_U)
_SHINGLE = _rng.integers(1, 2**62, 64).astype(_U) * _U(2) + _U(1)
_POWER = np.ones(1 << 12, _U)
_POWER[1:] = _U(0x9E3779B97F4A7C15)
np.multiply.accumulate(_POWER, out=_POWER)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing (the MurmurHash3 finalizer)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash base (grown on demand, kept per worker)."""
    global _POWER
    if n > len(_POWER):
        more = np.full(max(n, 2 * len(_POWER)), _POWER[1], _U)
        more[0] = 1
        np.multiply.accumulate(more, out=more)
        _POWER = more
    return _POWER[:n]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (NULL: empty) and the n + 1 row offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return buf[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of together at most ``limit`` bytes (one row may be longer)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


@dataclass
class Words:
    """Words of a range of rows: byte bounds, hashes, and each row's first word."""

    buf: np.ndarray      # folded bytes of the rows
    start: np.ndarray    # byte where each word starts
    end: np.ndarray
    hash: np.ndarray     # uint64
    first: np.ndarray    # rows + 1 entries: index of each row's first word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, lo: int, hi: int) -> str:
        """Words lo..hi-1 joined by single spaces."""
        b = self.buf
        return b" ".join(b[s:e].tobytes() for s, e in zip(self.start[lo:hi], self.end[lo:hi])).decode("utf-8", "replace")


def words_of(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, part: int = PART_BYTES, fold: bool = True) -> Words:
    """Split rows, lower-cased (A-Z only) if ``fold``, into words and hash every word."""
    offsets = offsets - offsets[0]
    if len(buf) <= part:
        return _split(buf, offsets, is_word, fold)
    cuts = part_ends(buf, is_word, part)
    folded = np.empty(len(buf), np.uint8)
    starts, ends, hashes = [], [], []
    for lo, hi in zip([0, *cuts[:-1]], cuts):
        inner = offsets[np.searchsorted(offsets, lo, "right"):np.searchsorted(offsets, hi, "left")]
        w = _split(buf[lo:hi], np.concatenate([[lo], inner, [hi]]) - lo, is_word, fold)
        folded[lo:hi] = w.buf
        starts.append(w.start + lo)
        ends.append(w.end + lo)
        hashes.append(w.hash)
    start = np.concatenate(starts)
    return Words(folded, start, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(start, offsets))


def part_ends(buf: np.ndarray, is_word: np.ndarray, part: int) -> list[int]:
    """Ends of consecutive parts of at least ``part`` bytes, each before a byte that belongs to no word."""
    ends, at, look = [], 0, 1 << 16
    while at + part < len(buf):
        at += part
        while at < len(buf):
            free = np.flatnonzero(~is_word[LOWER[buf[at:at + look]]])
            if len(free):
                at += int(free[0])
                break
            at = min(at + look, len(buf))
        if at < len(buf):
            ends.append(at)
    return [*ends, len(buf)]


def _split(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: bool) -> Words:
    buf = LOWER[buf] if fold else buf
    n = len(buf)
    inside = is_word[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    after[-1:] = False
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (edge[:-1] | ~before))
    end = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
    first = np.searchsorted(start, offsets)
    if not len(start):
        return Words(buf, start, end, np.zeros(0, _U), first)
    at = np.flatnonzero(inside)
    length = end - start
    place = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
    value = _BYTE[buf[at]] * powers(int(length.max()))[place]
    return Words(buf, start, end, mix64(np.add.reduceat(value, np.cumsum(length) - length)), first)


def shingle_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words inside a row, and the word each starts at."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    total = np.full(n, _U(k))
    for j in range(k):
        total += words.hash[j:j + n] * _SHINGLE[j]
    ok = np.zeros(n, bool)
    counts = words.counts
    rows = counts >= k
    lo, hi = words.first[:-1][rows], words.first[1:][rows] - k + 1
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, lo, 1)
    np.add.at(delta, hi, -1)
    ok = np.cumsum(delta)[:-1] > 0
    at = np.flatnonzero(ok)
    return mix64(total[at]), at


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def gathered(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans one after another, and the n + 1 offsets of the spans in them."""
    length = end - start
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])
    return buf[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], length)], offsets
