"""Packed shuffles: many small numbers travel as one binary value to their bucket.

A task gathers entries (a 64-bit key and some fixed-size fields), sorts them by
bucket and key, and emits one blob per bucket. Keys are stored as gaps in six
bytes where they fit, else in eight, so nothing is lost. The receiving side
sees whole buckets as numpy arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOB_SCHEMA = "part int, blob binary"
_ARROW = pa.schema([("part", pa.int32()), ("blob", pa.binary())])


def _pack_keys(keys: np.ndarray) -> bytes:
    gaps = np.diff(keys, prepend=np.uint64(0))
    wide = len(gaps) and int(gaps[1:].max(initial=0)) >= 1 << 48
    head = np.array([len(keys), 8 if wide else 6], np.int64).tobytes() + keys[:1].tobytes()
    gaps[:1] = 0
    body = gaps.view(np.uint8).reshape(-1, 8)
    return head + (body if wide else body[:, :6]).tobytes()


def _unpack_keys(raw: np.ndarray) -> tuple[np.ndarray, int]:
    n, width = raw[:16].view(np.int64)
    if not n:
        return np.empty(0, np.uint64), 16
    end = 24 + int(n) * int(width)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :width] = raw[24:end].reshape(n, width)
    gaps = gaps.view(np.uint64).ravel()
    gaps[0] = raw[16:24].view(np.uint64)[0]
    return np.cumsum(gaps, dtype=np.uint64), end


class Packer:
    """Gathers (key, *fields) arrays and gives record batches of (part, blob).

    The low `bits` of a key name its bucket; the receiver gets the key rotated so that they come first.
    """

    def __init__(self, bits: int, dtypes: list, limit: int = 2_000_000):
        self.bits, self.dtypes, self.limit = bits, [np.dtype(d) for d in dtypes], limit
        self.held: list[list[np.ndarray]] = []
        self.n = 0

    def add(self, keys: np.ndarray, *fields: np.ndarray):
        """Yields batches when enough has been gathered."""
        if len(keys):
            self.held.append([keys, *(f.astype(d, copy=False) for f, d in zip(fields, self.dtypes, strict=True))])
            self.n += len(keys)
        if self.n >= self.limit:
            yield self.flush()

    def done(self):
        if self.n:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        keys, *fields = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        b = np.uint64(self.bits)
        if self.bits:
            keys = (keys << np.uint64(64 - self.bits)) | (keys >> b)
        order = np.argsort(keys, kind="stable")
        keys, fields = keys[order], [f[order] for f in fields]
        part = keys >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(keys), np.uint64)
        at = np.flatnonzero(np.diff(part, prepend=part[0] + np.uint64(1)))
        ends = np.append(at[1:], len(keys))
        blobs = [_pack_keys(keys[i:j]) + b"".join(f[i:j].tobytes() for f in fields) for i, j in zip(at, ends, strict=True)]
        return pa.record_batch([pa.array(part[at].astype(np.int32)), pa.array(blobs, pa.binary())], schema=_ARROW)


def unpack(blobs, dtypes: list) -> list[np.ndarray]:
    """All blobs of a bucket -> keys and fields, in the order of arrival."""
    found: list[list[np.ndarray]] = []
    for blob in blobs:
        raw = np.frombuffer(blob.as_buffer() if hasattr(blob, "as_buffer") else blob, np.uint8)
        keys, at = _unpack_keys(raw)
        row = [keys]
        for d in map(np.dtype, dtypes):
            row.append(np.frombuffer(raw[at : at + len(keys) * d.itemsize].tobytes(), d))
            at += len(keys) * d.itemsize
        found.append(row)
    if not found:
        return [np.empty(0, np.uint64), *(np.empty(0, d) for d in dtypes)]
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def bits_for(parts: int) -> int:
    """Bits of a power of two of buckets, at least `parts`."""
    return max(1, (max(2, parts) - 1).bit_length())


def bucketed(blobs, fn, schema: str):
    """Runs fn(pa.Table of one bucket) -> iterator of arrays/batches for each bucket of a (part, blob) DataFrame."""
    return blobs.groupBy("part").applyInArrow(fn, schema)
