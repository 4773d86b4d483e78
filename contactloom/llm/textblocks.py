"""Words and word windows of Arrow text columns, as numpy arrays.

Texts come in slices of bounded size, words are found byte by byte (UTF-8 bytes
above 0x7F belong to words), and each word gets a 64-bit hash from prefix sums of
a polynomial. Everything here works on what one Arrow batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one step looks at; a longer text is a slice of its own.
SLICE_BYTES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.random.default_rng(20240301).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def byte_class(predicate) -> np.ndarray:
    """A table of 256 booleans, from a predicate over lower-cased byte values."""
    return np.array([bool(predicate(int(LOWER[b]))) for b in range(256)])


#: Words of letters, digits and everything beyond ASCII.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: Words between ASCII white space.
NONSPACE = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, about ``most`` bytes of ``column`` at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and n + 1 offsets into them; a null has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """``start`` and ``end`` (bytes), ``hash`` and ``doc`` (row) of all words, in order; ``first``: n + 1 offsets of the rows' words."""

    def __init__(self, texts: pa.Array, inside: np.ndarray):
        self.raw, self.offsets = text_bytes(texts)
        starts, ends, hashes = [], [], []
        n, at = len(self.raw), 0
        while at < n:
            to = min(at + SLICE_BYTES, n)
            while to < n and inside[self.raw[to]] and not self._row_begins(to):
                to += 1
            a, b, h = self._segment(at, to, inside)
            starts.append(a), ends.append(b), hashes.append(h)
            at = to
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.start, self.end, self.hash = join(starts, np.int64), join(ends, np.int64), join(hashes, np.uint64)
        self.first = np.searchsorted(self.start, self.offsets)
        self.first[-1] = len(self.start)
        self.doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def _row_begins(self, at: int) -> bool:
        k = int(np.searchsorted(self.offsets, at))
        return k < len(self.offsets) and self.offsets[k] == at

    def _segment(self, at: int, to: int, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = LOWER[self.raw[at:to]]
        word = inside[part]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        rows = self.offsets[np.searchsorted(self.offsets, at) : np.searchsorted(self.offsets, to)] - at
        begins[rows] = word[rows]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        cut = rows[rows > 0] - 1
        ends[cut] = word[cut]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if len(_powers[0]) <= len(part):
            size = max(len(part) + 1, SLICE_BYTES + 1)
            for k, p in enumerate((_P, _P_INVERSE)):
                steps = np.full(size, p)
                steps[0] = 1
                _powers[k] = np.cumprod(steps, dtype=np.uint64)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _powers[0][: len(part)], out=sums[1:])
        hashed = mix((sums[end] - sums[start]) * _powers[1][start] + (end - start).astype(np.uint64))
        return start + at, end + at, hashed

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, size: int, salt: int = 0) -> np.ndarray:
        """A hash for each word: of it and the ``size - 1`` next ones, whichever row they are in."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        total = np.full(n, np.uint64(size * 0x1000193 + salt), np.uint64)
        for k in range(size):
            total += self.hash[k : k + n] * _STEP[(k + salt) % 64]
            total = total * _P if k % 16 == 15 else total
        return mix(total)

    def lowered(self, start: int, end: int) -> bytes:
        """The words from ``start`` to ``end``, lower-cased, with a blank between."""
        return b" ".join(LOWER[self.raw[a:b]].tobytes() for a, b in zip(self.start[start:end], self.end[start:end]))
