"""Vectorised text kernels shared by the training-data operators.

Everything works on whole Arrow string columns: the column's own byte buffer is
tokenised, hashed and windowed with numpy, so no Python object is made per word.
All hashes are 64-bit: a polynomial over a fixed random byte table, then a
finaliser. They are the same in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def separator_table(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: Words are runs of anything but space and 0x09-0x0D.
SPACE_SEPARATED = separator_table((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of ASCII letters, ASCII digits and everything beyond ASCII.
ALNUM_WORDS = separator_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: The same before lower-casing.
ALNUM_WORDS_ANY_CASE = ALNUM_WORDS.copy()
ALNUM_WORDS_ANY_CASE[65:91] = False


class _Powers:
    """r**i and r**-i, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.p = base, np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.p) < n:
            size = max(n, 1 << 16, 2 * len(self.p))
            steps = np.full(size, self.base, dtype=np.uint64)
            steps[0] = 1
            self.p = np.multiply.accumulate(steps)
        return self.p[:n]


_POW, _INV = _Powers(_R), _Powers(_RINV)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string_view(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0 or offs is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of rows of about `limit` bytes; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of some rows: byte ranges, first word of each row, and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        self.data, self.offsets = data, offsets
        sep = separators[data]
        n = len(data)
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], before[1:] = True, sep[:-1]
            after[-1], after[:-1] = True, sep[1:]
            edges = offsets[(offsets > 0) & (offsets < n)]
            before[edges] = True
            after[edges - 1] = True
        word = ~sep
        self.starts = np.flatnonzero(word & before)
        self.ends = np.flatnonzero(word & after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        data = LOWER[self.data] if lower else self.data
        n = len(data)
        if not n:
            return np.empty(0, np.uint64)
        prefix = np.empty(n + 1, np.uint64)
        prefix[0] = 0
        np.cumsum(_BYTES[data] * _POW(n), out=prefix[1:])
        return mix((prefix[self.ends] - prefix[self.starts]) * _INV(n)[self.starts])


def windows(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each k consecutive values, across rows as well; the last k-1 are missing."""
    n = len(hashes)
    if n < k:
        return np.empty(0, np.uint64)
    h = mix(hashes + np.uint64(salt)) if salt else hashes
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(h * _POW(n), out=prefix[1:])
    return mix((prefix[k:] - prefix[:-k]) * _INV(n)[: n - k + 1] + np.uint64(k))


def inside(first: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """Which of the windows() start and end in one row."""
    m = max(0, n_words - k + 1)
    counts = np.diff(first)
    last = np.repeat(first[1:], counts)[:m]
    return np.arange(m) + k <= last


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    if len(values) < w:
        return np.empty(0, values.dtype)
    m, span = values, 1
    while 2 * span <= w:
        m, span = np.minimum(m[:-span], m[span:]), 2 * span
    return m if span == w else np.minimum(m[: len(m) - (w - span)], m[w - span :])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    padded = np.zeros(len(flags) + 2, np.int8)
    padded[1:-1] = flags
    step = np.diff(padded)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + l)."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    out = np.ones(total, np.int64)
    at = np.cumsum(lengths) - lengths
    keep = lengths > 0
    at, s, l = at[keep], starts[keep], lengths[keep]
    out[at] = s
    out[at[1:]] -= s[:-1] + l[:-1] - 1
    return np.cumsum(out)


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in any of the spans."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0


def text_table(batches):
    """Iterates over (batch, byte chunk, offsets, first row, end row) of a mapInArrow iterator whose column `text` holds the texts."""
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for i, j in chunks(offsets):
            yield batch, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i, j
