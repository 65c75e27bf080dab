"""Whole Arrow columns of text as numpy arrays: words, word hashes and word shingles without a Python loop."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that one pass of array operations takes at most; a longer text is a pass of its own.
CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = pow(int(_BASE), -1, 2**64)
_PAD = np.uint64(0xD6E8FEB86659FD93)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole rows."""
    n, row = len(offsets) - 1, 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """(first row, row after the last, bytes, offsets, whether the rows end here) of runs of whole rows, and of parts of longer rows.

    A longer row is cut before white space that follows a word, at about ``size`` bytes; a word
    beyond that stays whole.
    """
    for row, end, part, cuts in chunks(data, offsets, size):
        if len(part) <= size:
            yield row, end, part, cuts, True
            continue
        at = 0
        while at < len(part):
            stop = word_end(part, at + size)
            yield row, end, part[at:stop], np.array([0, stop - at]), stop == len(part)
            at = stop


def word_end(data: np.ndarray, at: int, look: int = 4096) -> int:
    """The first place from ``at`` on where a word has ended and white space follows; the end if there is none."""
    at = max(at, 1)
    while at < len(data):
        window = data[at - 1 : at + look]
        found = np.flatnonzero(SPACE[window[1:]] & ~SPACE[window[:-1]])
        if len(found):
            return at + int(found[0])
        at += look
    return len(data)


def word_spans(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words: runs of bytes other than ASCII white space, within rows.

    With ``kinds``, a number for each byte value, a word also ends between bytes of two kinds other
    than 0, and after each byte of kind 1 that one of kind 1 follows.
    """
    solid = ~SPACE[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = solid[:-1]
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = solid[1:]
    if kinds is not None and len(data):
        kind = kinds[data]
        a, b = kind[:-1], kind[1:]
        cut = (a != b) & (a > 0) & (b > 0) | (a == 1) & (b == 1)
        before[1:] &= ~cut
        after[:-1] &= ~cut
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: int = int(_BASE)) -> np.ndarray:
    """The first ``n`` powers; up to ``CHUNK_BYTES`` of them are kept."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(n, min(CHUNK_BYTES, 2 * n))
        known = np.full(size, base, dtype=np.uint64)
        if size:
            known[0] = 1
            np.multiply.accumulate(known, out=known)
        if size <= CHUNK_BYTES:
            _POWERS[base] = known
    return known[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that don't overlap, in order; equal bytes have equal hashes.

    Spans are worked on in runs of ``CHUNK_BYTES`` of the data, so that memory follows the number of
    spans and not the length of the data; one longer span is a run of its own.
    """
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = int(starts[first])
        stop = max(first + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, "right")))
        out[first:stop] = _hashes(data[base : int(ends[stop - 1])], starts[first:stop] - base, ends[first:stop] - base)
        first = stop
    return out


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if len(starts) == 1 and len(data) > CHUNK_BYTES:  # Horner's rule over parts
        raw = np.uint64(0)
        for at in range(len(data) // CHUNK_BYTES * CHUNK_BYTES, -1, -CHUNK_BYTES):
            part = data[at : at + CHUNK_BYTES]
            own = ((part.astype(np.uint64) + np.uint64(1)) * _powers(len(part))).sum(dtype=np.uint64)
            raw = np.array([raw]) * np.uint64(pow(int(_BASE), CHUNK_BYTES, 2**64)) + own
            raw = raw[0]
        raw = np.array([raw])
    else:
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data)), out=sums[1:])
        raw = (sums[ends] - sums[starts]) * _powers(len(data), _INVERSE)[starts]  # as if each span began at place 0
    return mix(raw ^ ((ends - starts).astype(np.uint64) * _PAD))


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of ``n`` words, lower case, in order; a row of fewer words, one at least, is one shingle."""
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    total = len(words)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(counts) - counts
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    at = np.arange(total)
    left = first[rows] + counts[rows] - at
    h = np.zeros(total, np.uint64)
    for k in range(n):
        part = padded[k : k + total] * np.uint64((int(_BASE) * (2 * k + 1) + 2 * k) % 2**64)
        h = mix(h + np.where(left > k, part, _PAD))
    keep = (left >= n) | ((at == first[rows]) & (counts[rows] < n))
    return h[keep], rows[keep]


class SpanCache:
    """What spans of bytes turn into, each distinct span worked out once.

    ``work(data, starts, ends)`` gives (values one after the other, number of values of each span).
    Up to ``limit`` spans are remembered; when they are more, the cache starts anew. Spans over
    ``long`` bytes are worked out each time, so that no text can be made to collide.
    """

    def __init__(self, work: Callable, kind, limit: int = 600_000, long: int = 64):
        self.work, self.kind, self.limit, self.long = work, kind, limit, long
        self._forget()

    def _forget(self):
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.kind)

    def resolve(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, place, number): the values of a span are ``pool[place : place + number]``."""
        keys = span_hashes(data, starts, ends)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        long = (ends - starts)[first] > self.long
        fresh = np.flatnonzero(~self._known(distinct) & ~long)
        if len(fresh) and len(self.keys) + len(fresh) > self.limit:
            self._forget()
            fresh = np.flatnonzero(~long)
        if len(fresh):
            values, sizes = self.work(data, starts[first[fresh]], ends[first[fresh]])
            at = np.searchsorted(self.keys, distinct[fresh])
            self.keys = np.insert(self.keys, at, distinct[fresh])
            self.starts = np.insert(self.starts, at, len(self.pool) + np.cumsum(sizes) - sizes)
            self.sizes = np.insert(self.sizes, at, sizes)
            self.pool = np.concatenate([self.pool, values])
        pool = self.pool
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
            where, size = self.starts[at][inverse], self.sizes[at][inverse]
        else:
            where = size = np.zeros(len(keys), np.int64)
        if long.any():
            each = np.flatnonzero(ends - starts > self.long)
            values, sizes = self.work(data, starts[each], ends[each])
            where, size = where.copy(), size.copy()
            where[each] = len(pool) + np.cumsum(sizes) - sizes
            size[each] = sizes
            pool = np.concatenate([pool, values])
        return pool, where, size

    def _known(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        return known


def joined(pool: np.ndarray, where: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The values of spans one after the other."""
    to = np.cumsum(size) - size
    return pool[np.repeat(where - to, size) + np.arange(int(size.sum()))]
