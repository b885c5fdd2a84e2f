"""Substring dedup by super-k-mers: removes words covered by repeated windows.

A window is `size` consecutive words of one document. Its minimiser is the
least hash of its `minimiser` -word substrings. Consecutive windows with one
minimiser form a super-k-mer. Equal windows have equal minimisers, so:

1. each super-k-mer sends (minimiser, row, place) to the minimiser's bucket; those whose
   minimiser occurs once in the corpus cannot hold a repeated window and go. Where a task has a minimiser
   twice, one mark is sent for all of them: what one task knows to recur needs no bucket;
2. each remaining super-k-mer travels as one packed string to its bucket (equal
   strings of one task as one mark, as they are repeated whatever others have), where all
   windows are sorted and counted exactly (two 64-bit hashes);
3. spans of repeated windows return to their rows and the words go.

A minimiser that occurs more than `frequent` times, and often enough that there are at most HOT_KEYS such ones, would fill its
bucket. Its windows travel singly, as their two hashes, dealt by these.

Defined results: null text and text without a word -> 0 words, empty text.
Repeated rows, copies and rows with a null or repeated doc_id count as other occurrences, so all of their windows
are removed (in every copy). Texts of fewer than `size` words are unchanged. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .packed import Packer, bits_for, unpack
from .shared import HOT_KEYS, bounded_batches, cut, parts_of, scratch, with_row


def _super_kmers(w: K.Words, size: int, m: int):
    """(minimiser, row, first word in row, number of windows) of all super-k-mers; the number is negative where the minimiser occurs in it twice, so that it may repeat itself."""
    h = w.hashes()
    g = K.windows(h, m)
    low = K.sliding_min(g, size - m + 1)
    ok = K.inside(w.first, len(h), size)
    row = w.row[: len(low)]
    cut_here = np.ones(len(low), bool)
    cut_here[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1]) | ~ok[:-1]
    cut_here &= ok
    at = np.flatnonzero(cut_here)
    closing = np.flatnonzero(cut_here | ~ok) if len(low) else at
    after = np.append(closing, len(low))[np.searchsorted(closing, at, "right")] if len(at) else at
    count = after - at
    if not len(at):
        return low[at], at, at, count
    span = count + size - m
    hits = g[K.ranges(at, span)] == np.repeat(low[at], span)
    own = np.add.reduceat(hits, np.cumsum(span) - span, dtype=np.int64) > 1
    return low[at], row[at], at - w.first[row[at]], np.where(own, -count, count)


#: Rows of a bucket: a blob to be unpacked there, and finished (row, start, count) triples that only pass through.
TOLD_SCHEMA = "part int, blob binary, done binary"
_TOLD = pa.schema([("part", pa.int32()), ("blob", pa.binary()), ("done", pa.binary())])
#: Triples that pass through a bucket in one value.
DONE = 100_000


def _passing(triples: np.ndarray, parts: int, turn: int) -> list[tuple[int, bytes]]:
    """(part, packed triples), dealt evenly."""
    return [((turn + k) * 0x9E3779B1 % parts, triples[i : i + DONE].tobytes()) for k, i in enumerate(range(0, len(triples), DONE))]


def _triples(values) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() or b"" for v in values), np.int64).reshape(-1, 3)


def _twice(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which entries have a key that another entry has, the first entry of each such key)."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] &= k[1:] == k[:-1]
    new[1:] = ~new[1:]
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(order)))
    many = np.zeros(len(order), bool)
    many[order] = np.repeat(size > 1, size)
    return many, order[head[size > 1]]


def _announce(size: int, m: int, bits: int, limit: int = 500_000):
    """Blobs of (minimiser, row, start, count); a mark, of start -1, has the number of entries it stands for as its row."""

    def run(batches):
        held, turn = [], 0

        def emit():
            key, ids, start, count = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            many, head = _twice(key)
            many |= count < 0  # it repeats itself
            head = np.union1d(head, np.flatnonzero(count < 0))
            _, times = np.unique(key[many], return_counts=True)
            marks, at = np.unique(key[head], return_index=True)
            packer = Packer(bits, [np.int64, np.int32, np.int32])
            packer.held.append([np.concatenate([key[~many], marks]), np.concatenate([ids[~many], times]), np.concatenate([start[~many], np.full(len(at), -1)]).astype(np.int32), np.concatenate([count[~many], np.ones(len(at), np.int64)]).astype(np.int32)])
            found = packer.flush()
            yield pa.record_batch([found.column(0), found.column(1), pa.nulls(found.num_rows, pa.binary())], schema=_TOLD)
            done = _passing(np.stack([ids[many], start[many], np.abs(count[many])], 1).astype(np.int64), 1 << bits, turn)
            if done:
                yield pa.record_batch([pa.array([d[0] for d in done], pa.int32()), pa.nulls(len(done), pa.binary()), pa.array([d[1] for d in done], pa.binary())], schema=_TOLD)

        n = 0
        for batch, data, offsets, i, _ in K.text_table(batches):
            key, row, start, count = _super_kmers(K.Words(data, offsets, K.SPACE_SEPARATED), size, m)
            if not len(key):
                continue
            held.append((key, batch.column("row").to_numpy(zero_copy_only=False)[i + row], start, count))
            n += len(key)
            if n >= limit:
                yield from emit()
                n, turn = 0, turn + 1
        if held:
            yield from emit()

    return run


_PLACES = pa.schema([("row", pa.int64()), ("places", pa.binary())])


def _by_document(ids: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.Table:
    """One row per row of the table with its (start, count) pairs packed."""
    if not len(ids):
        return _PLACES.empty_table()
    order = np.argsort(ids, kind="stable")
    ids, start, count = ids[order], start[order], count[order]
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    head = np.flatnonzero(new)
    pairs = np.stack([start, count], 1).astype(np.int32)
    ends = np.append(head[1:], len(ids))
    return pa.table([pa.array(ids[head]), pa.array([pairs[i:j].tobytes() for i, j in zip(head, ends, strict=True)], pa.binary())], schema=_PLACES)


def _recurring(bits: int, frequent: int):
    """(row, places, n): places of the super-k-mers of a bucket whose minimiser occurs again; and with row null, minimisers of more than `frequent` occurrences and their number n."""

    def run(table: pa.Table) -> pa.Table:
        key, ids, start, count = unpack([x for x in table.column("blob") if x.is_valid], [np.int64, np.int32, np.int32])
        order = np.argsort(key, kind="stable")
        key, ids, start, count = key[order], ids[order], start[order], count[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        head = np.flatnonzero(new)
        mark = start < 0
        n = np.where(mark, ids, 1)
        total = np.add.reduceat(n, head) if len(head) else n
        known = np.logical_or.reduceat(mark, head) if len(head) else mark
        again = (total > 1) | known
        many = np.repeat(again, np.diff(np.append(head, len(key)))) & ~mark
        done = _triples(table.column("done"))
        places = _by_document(np.concatenate([ids[many], done[:, 0]]), np.concatenate([start[many], done[:, 1]]), np.concatenate([count[many], done[:, 2]]))
        often = np.flatnonzero(again & (total > frequent))
        b = np.uint64(bits)
        keys = (key[head][often] << b) | (key[head][often] >> (np.uint64(64) - b))  # as the tasks know them
        keys = [x.tobytes() for x in keys]
        return pa.table([pa.concat_arrays([*places.column("row").chunks, pa.nulls(len(keys), pa.int64())]), pa.concat_arrays([*places.column("places").chunks, pa.array(keys, pa.binary())]), pa.concat_arrays([pa.nulls(places.num_rows, pa.int64()), pa.array(total[often], pa.int64())])], names=["row", "places", "n"])

    return run


def _pairs(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.int32).reshape(-1, 2)


def _bytes_of(value) -> list[bytes]:
    return value.as_py() or []


_PACKED = pa.schema([("part", pa.int32()), ("strings", pa.list_(pa.binary())), ("places", pa.list_(pa.binary())), ("blob", pa.binary()), ("done", pa.binary())])
PACKED_SCHEMA = "part int, strings array<binary>, places array<binary>, blob binary, done binary"


def _packed_rows(part: list, strings=None, places=None, blob=None, done=None) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c if c is not None else [None] * len(part), f.type) for c, f in zip((part, strings, places, blob, done), _PACKED, strict=True)], schema=_PACKED)


def _pack_strings(size: int, m: int, bits: int, hot: np.ndarray):
    """Packed strings of the announced super-k-mers, one row per bucket and gathering; windows of the minimisers in `hot` (ordered) as blobs of two hashes."""

    def strings_of(held):
        by_part: dict[int, tuple[list, list]] = {}
        done = []
        for (part, string), (words, *places) in held.items():
            strings, lists = by_part.setdefault(part, ([], []))
            strings.append(string)
            if len(places) > 2:  # repeated already: its places need not travel
                lists.append(b"")
                pairs = np.array(places, np.int64).reshape(-1, 2)
                done.append(np.column_stack([pairs, np.full(len(pairs), words)]))
            else:
                lists.append(np.array(places, np.int64).tobytes())
        yield _packed_rows(list(by_part), strings=[x[0] for x in by_part.values()], places=[x[1] for x in by_part.values()])
        yield from passing(done, len(held))

    def passing(done: list, turn: int):
        if done:
            found = _passing(np.concatenate(done).astype(np.int64), 1 << bits, turn)
            yield _packed_rows([x[0] for x in found], done=[x[1] for x in found])

    def windows_of(singles):
        key, other, ids, start = (np.concatenate(x) for x in zip(*singles, strict=True))
        many, head = _twice(key, other)
        packer = Packer(bits, [np.uint64, np.int64, np.int32])
        keep = np.concatenate([np.flatnonzero(~many), head])
        place = start[keep].astype(np.int32)
        place[len(keep) - len(head) :] = -1
        packer.held.append([key[keep], other[keep], ids[keep], place])
        found = packer.flush()
        yield _packed_rows(found.column(0).to_pylist(), blob=found.column(1).to_pylist())
        yield from passing([np.column_stack([ids[many], start[many], np.full(int(many.sum()), size)])], len(key))

    def run(batches):
        held: dict[tuple[int, bytes], list] = {}
        room, mask = 32 << 20, np.uint64((1 << bits) - 1)
        singles, n_single = [], 0
        for batch, data, offsets, i, j in K.text_table(batches):
            ids = batch.column("row").to_numpy(zero_copy_only=False)
            w = K.Words(data, offsets, K.SPACE_SEPARATED)
            h = w.hashes()
            low = K.sliding_min(K.windows(h, m), size - m + 1)
            one = two = None
            raw = data.tobytes()
            for d in range(j - i):
                blobs = _bytes_of(batch.column("places")[i + d])
                if not blobs:
                    continue
                doc, base = int(ids[i + d]), w.first[d]
                pairs = _pairs(blobs)
                at = base + pairs[:, 0]
                if len(hot):
                    often = hot[np.minimum(np.searchsorted(hot, low[at]), len(hot) - 1)] == low[at]
                    if often.any():
                        if one is None:
                            one, two = K.windows(h, size), K.windows(h, size, salt=0x51ED27)
                        k = np.unique(K.ranges(at[often], pairs[often, 1].astype(np.int64)))
                        singles.append((one[k], two[k], np.full(len(k), doc, np.int64), (k - base).astype(np.int64)))
                        n_single += len(k)
                        pairs, at = pairs[~often], at[~often]
                begin, end = w.starts[at], w.ends[at + pairs[:, 1] + size - 2]
                for part, s, c, b, e in zip((low[at] & mask).tolist(), pairs[:, 0].tolist(), pairs[:, 1].tolist(), begin.tolist(), end.tolist(), strict=True):
                    string = raw[b:e]
                    places = held.get((part, string))
                    if places is None:
                        held[part, string] = [c + size - 1, doc, s]
                        room -= len(string) + 200
                    else:
                        places += (doc, s)
                        room -= 16
                if room < 0:
                    yield from strings_of(held)
                    held, room = {}, 32 << 20
                if n_single >= 500_000:
                    yield from windows_of(singles)
                    singles, n_single = [], 0
        if held:
            yield from strings_of(held)
        if singles:
            yield from windows_of(singles)

    return run


def _repeated_singles(blobs: list, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of windows that came singly and are repeated."""
    key, other, ids, start = unpack(blobs, [np.uint64, np.int64, np.int32])
    many, _ = _twice(key, other)
    if len(start):
        # a mark alone stands for places that have passed through
        many &= start >= 0
    return ids[many], start[many].astype(np.int64), np.full(int(many.sum()), size)


def _repeated_strings(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of spans of repeated windows of the packed strings."""
    whole = table.filter(table.column("strings").is_valid())
    none = np.empty(0, np.int64)
    if not whole.num_rows:
        return none, none, none
    strings = pa.concat_arrays([c.flatten() for c in whole.column("strings").chunks])
    places = pa.concat_arrays([c.flatten() for c in whole.column("places").chunks])
    data, offsets = K.buffers(strings)
    place_raw, place_at = K.buffers(places)
    had = np.diff(place_at) // 16
    times = np.where(had == 0, 2, had)  # without a place: repeated in the task it comes from
    keys, others, owner, index = [], [], [], []
    for i, j in K.chunks(offsets):
        w = K.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], K.SPACE_SEPARATED)
        h = w.hashes()
        at = np.flatnonzero(K.inside(w.first, len(h), size))
        row = w.row[at]
        keys.append(K.windows(h, size)[at])
        others.append(K.windows(h, size, salt=0x51ED27)[at])
        owner.append(row + i)
        index.append(at - w.first[row])
    key, other, owner, index = (np.concatenate(x) for x in (keys, others, owner, index))
    order = np.lexsort((other, key)) if len(key) else np.empty(0, np.int64)
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[order][1:] != key[order][:-1]) | (other[order][1:] != other[order][:-1])
    group = np.cumsum(fresh) - 1
    total = np.zeros(int(group[-1]) + 1 if len(group) else 0, np.int64)
    np.add.at(total, group, times[owner[order]])
    repeated = np.zeros(len(key), bool)
    repeated[order] = total[group] > 1
    # runs of repeated windows of one string become spans of words
    owner, index = owner[repeated], index[repeated]
    opens = np.ones(len(owner), bool)
    opens[1:] = (owner[1:] != owner[:-1]) | (index[1:] != index[:-1] + 1)
    at = np.flatnonzero(opens)
    length = np.diff(np.append(at, len(owner))) + size - 1
    owner, index = owner[at], index[at]
    n = had[owner]
    place = place_raw.view(np.int64).reshape(-1, 2)[K.ranges(place_at[owner] // 16, n)]
    return place[:, 0], place[:, 1] + np.repeat(index, n), np.repeat(length, n)


def _count_windows(size: int):
    def run(table: pa.Table) -> pa.Table:
        done = _triples(table.column("done"))
        found = [_repeated_strings(table, size), _repeated_singles([x for x in table.column("blob") if x.is_valid], size), (done[:, 0], done[:, 1], done[:, 2])]
        return _by_document(*(np.concatenate(x) for x in zip(*found, strict=True)))

    return run


def _without(with_text: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text

    def run(batches):
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            n_words, n_removed, digests, texts = [], [], [], []
            for i, j in K.chunks(offsets):
                w = K.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], K.SPACE_SEPARATED)
                size = w.ends - w.starts
                joined = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
                to = np.cumsum(size + 1) - size - 1
                joined[K.ranges(to, size)] = w.data[K.ranges(w.starts, size)]
                to = np.append(to, len(joined))
                raw = joined.tobytes()
                for d in range(j - i):
                    a, b = w.first[d], w.first[d + 1]
                    blobs = _bytes_of(batch.column("spans")[i + d])
                    n, gone = int(b - a), 0
                    kept = raw[to[a] : to[b] - 1] if n else b""
                    if blobs and n:
                        pairs = _pairs(blobs)
                        bad = K.covered(pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64), n)
                        gone = int(bad.sum())
                        opens, closes = K.runs(~bad)
                        kept = b" ".join(raw[to[a + s] : to[a + e] - 1] for s, e in zip(opens.tolist(), closes.tolist(), strict=True))
                    n_words.append(n)
                    n_removed.append(gone)
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        texts.append(kept.decode("utf-8"))
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.record_batch(columns + [pa.array(texts, pa.string())] * with_text, names=names)

    return run


#: Minimisers that occur more often are dealt window by window.
FREQUENT = 1000


def _frequent(again: DataFrame) -> np.ndarray:
    """The most frequent minimisers, ordered: at most HOT_KEYS of them, so they can be sent to the tasks."""
    told = again.where("row is null")
    total = int(told.agg(F.sum("n")).first()[0] or 0)
    rows = told.where(F.col("n") > total // HOT_KEYS).select("places").collect()
    return np.sort(np.frombuffer(b"".join(bytes(r["places"]) for r in rows), np.uint64))


def remove_repeats(docs: DataFrame, size: int = 35, minimiser: int = 8, with_text: bool = False) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_words, n_removed, kept_sha256[, kept]): kept words joined by one space."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = with_row(docs, "doc_id", "text", "row")
    bits = bits_for(parts_of(docs, 16, 2))
    with scratch():
        told = docs.select("row", "text").mapInArrow(_announce(size, minimiser, bits), TOLD_SCHEMA)
        again = cut(told.groupBy("part").applyInArrow(_recurring(bits, FREQUENT), "row long, places binary, n long"), "again")
        hot = _frequent(again)
        places = again.where("row is not null").groupBy("row").agg(F.collect_list("places").alias("places"))
        chosen = docs.select("row", "text").join(places, "row").mapInArrow(_pack_strings(size, minimiser, bits, hot), PACKED_SCHEMA)
        spans = cut(chosen.groupBy("part").applyInArrow(_count_windows(size), "row long, places binary"), "spans", keep=True)
    spans = spans.groupBy("row").agg(F.collect_list("places").alias("spans"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return docs.join(spans, "row", "left").mapInArrow(_without(with_text), schema)
