"""Benchmark decontamination by an FM-index per training shard.

A shard is about a million words of one task. Words that no benchmark item has,
and words in no short word sequence (q-gram) of an item, cannot lie in an occurrence; they
become separators, the rest are runs in the FM-index. All windows of the
benchmark are searched backward at once through wavelet ranks, occurrences are
located by sampled suffix places, and spans that overlap are merged.

Words are compared by 64-bit hashes. Windows go to the tasks in blocks of
bounded size (`BLOCK_BYTES` of benchmark text), which are built by tasks and only relayed by the driver. A benchmark of one block is
searched in one pass. One of several is searched block by block: each pass broadcasts one block, writes
the hits of the documents that have any, and drops the block, so neither the driver nor a task ever holds two.

Rows of one doc_id, or without one, are rows of their own. Defined results: null text or no word -> n_words 0, nothing hit. Null or empty items have no
window. Repeated items and rows are allowed. Extra columns
are ignored. An empty benchmark hits nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import bounded_batches, cut, with_row
from .fm_index import FMIndex

BLOCK_BYTES = 4 << 20
SHARD_WORDS = 1_000_000


class Patterns:
    """Distinct windows of a block of items, as symbols, and the items that have them."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        data, offsets = K.buffers(pa.array([t or "" for _, t in items], pa.large_string()))
        w = K.Words(data, offsets, K.ALNUM_WORDS_ANY_CASE)
        h = w.hashes(lower=True)
        self.vocabulary = np.unique(h)
        symbols = np.searchsorted(self.vocabulary, h) + 1
        found: dict[bytes, list] = {}
        for i, (item, _) in enumerate(items):
            s = symbols[w.first[i] : w.first[i + 1]].astype(np.int32)
            for a in range(max(1, len(s) - width + 1) if len(s) else 0):
                found.setdefault(s[a : a + width].tobytes(), []).append(item)
        rows = [np.frombuffer(x, np.int32) for x in found]
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.windows = np.full((len(rows), width), -1, np.int32)
        for row, r in zip(self.windows, rows, strict=True):
            row[width - len(r) :] = r
        self.items = [sorted(set(x)) for x in found.values()]
        self.q = int(min(3, self.lengths.min(initial=3)))
        grams = [self._grams(r) for r in rows]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.uint64)

    def _grams(self, symbols: np.ndarray) -> np.ndarray:
        return K.windows(symbols.astype(np.uint64), self.q)


def _member(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in `ordered` and whether it is there."""
    if not len(ordered):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return at, ordered[at] == values


def _hits(hashes: np.ndarray, first: np.ndarray, p: Patterns):
    """(first word, length, pattern) of all occurrences; places count the words of the shard."""
    none = np.empty(0, np.int64)
    if not len(p.windows) or not len(hashes):
        return none, none, none
    symbol, known = _member(hashes, p.vocabulary)
    grams = K.windows(np.where(known, symbol + 1, 0).astype(np.uint64), p.q)
    good = K.inside(first, len(hashes), p.q)
    good &= _member(grams, p.grams)[1]
    use = np.zeros(len(hashes), bool)
    for k in range(p.q):
        use[k : k + len(good)] |= good
    edge = np.zeros(len(hashes) + 1, bool)
    edge[first] = True
    opens = use & (edge[:-1] | ~np.concatenate([[False], use[:-1]]))
    begin = np.flatnonzero(opens)
    if not len(begin):
        return none, none, none
    closes = use & (edge[1:] | ~np.concatenate([use[1:], [False]]))
    length = np.flatnonzero(closes) + 1 - begin
    keep = length >= p.lengths.min()
    begin, length = begin[keep], length[keep]
    if not len(begin):
        return none, none, none
    at = np.cumsum(length + 1) - length - 1
    seq = np.zeros(int((length + 1).sum()), np.int64)
    seq[K.ranges(at, length)] = symbol[K.ranges(begin, length)] + 1
    index = FMIndex(seq, len(p.vocabulary) + 1)
    lo, hi = index.search(p.windows)
    n = hi - lo
    found = np.flatnonzero(n > 0)
    rows, pattern = K.ranges(lo[found], n[found]), np.repeat(found, n[found])
    place = np.concatenate([index.locate(rows[i : i + 1_000_000]) for i in range(0, len(rows), 1_000_000)]) if len(rows) else none
    run = np.searchsorted(at, place, "right") - 1
    return begin[run] + place - at[run], p.lengths[pattern], pattern


def _merged(start: np.ndarray, length: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as [start, end), ordered; spans that touch are joined within a document (first: where each begins)."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate((start + length)[order])
    doc = np.searchsorted(first, start, "right")
    opens = np.ones(len(start), bool)
    opens[1:] = (start[1:] > end[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(opens)
    return start[at], end[np.append(at[1:], len(start)) - 1] if len(at) else end[:0]


class _Shard:
    """Documents of a task until there are enough words for an index."""

    def __init__(self, block, with_text: bool):
        self.p, self.with_text = None if block is None else SimpleNamespace(**pickle.loads(block.value)), with_text
        self.clear()

    def clear(self):
        self.hashes, self.counts, self.batches, self.spans, self.n = [], [], [], [], 0

    def add(self, batch: pa.RecordBatch):
        data, offsets = K.buffers(batch.column("text"))
        for i, j in K.chunks(offsets):
            w = K.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], K.ALNUM_WORDS_ANY_CASE)
            self.hashes.append(w.hashes(lower=True))
            self.counts.append(w.counts)
            self.n += len(w.starts)
        self.batches.append(batch if self.with_text else batch.drop_columns(["text"]))
        if self.n >= SHARD_WORDS:
            yield from self.flush()

    def flush(self):
        if not self.batches:
            return
        hashes = np.concatenate([np.empty(0, np.uint64), *self.hashes])
        counts = np.concatenate([np.empty(0, np.int64), *self.counts])
        first = np.concatenate([[0], np.cumsum(counts)])
        starts, lengths, items = [], [], [set() for _ in range(len(counts))]
        if self.p is not None:
            start, length, pattern = _hits(hashes, first, self.p)
            doc = np.searchsorted(first, start, "right") - 1
            for d, k in np.unique(np.stack([doc, pattern], 1), axis=0).tolist() if len(doc) else ():
                items[d].update(self.p.items[k])
            starts.append(start)
            lengths.append(length)
        start, end = _merged(np.concatenate([np.empty(0, np.int64), *starts]), np.concatenate([np.empty(0, np.int64), *lengths]), first)
        doc = np.searchsorted(first, start, "right") - 1
        n_hit = np.zeros(len(counts), np.int64)
        np.add.at(n_hit, doc, end - start)
        spans = np.split(np.stack([start - first[doc], end - first[doc]], 1), np.searchsorted(doc, np.arange(1, len(counts)))) if len(counts) else []
        at = 0
        for batch in self.batches:
            i, at = at, at + batch.num_rows
            yield batch, counts[i:at], n_hit[i:at], items[i:at], spans[i:at]
        self.clear()


def _facts(n: list[int], hit: list[int], items: list) -> list[pa.Array]:
    names = [sorted(set(map(str, x))) for x in items]
    digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
    return [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(digest, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())]


FACTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
FACTS_SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _shards(block, with_text: bool, out):
    """Runs out(batch, counts, n_hit, items, spans) over the documents of a task, shard by shard."""

    def run(batches):
        shard = _Shard(block, with_text)
        for batch in batches:
            for found in shard.add(batch):
                yield from out(*found)
        for found in shard.flush():
            yield from out(*found)

    return run


def _reported(batch, n, hit, items, _):
    yield pa.record_batch([batch.column("doc_id"), *_facts(n.tolist(), hit.tolist(), items)], names=["doc_id", *FACTS])


def _hit_rows(batch, n, hit, items, spans):
    """(row, spans, items) of documents with a hit."""
    use = np.flatnonzero(hit)
    yield pa.record_batch([batch.column("row").take(pa.array(use)), pa.array([spans[d].astype(np.int64).tobytes() for d in use], pa.binary()), pa.array([sorted(map(str, items[d])) for d in use], pa.list_(pa.string()))], names=["row", "spans", "items"])


def _without(raw: bytes, data: np.ndarray, spans: list) -> str:
    w = K.Words(data, np.array([0, len(data)]), K.ALNUM_WORDS_ANY_CASE)
    at, kept = 0, []
    for a, b in spans:
        kept.append(raw[at : w.starts[a]])
        at = int(w.ends[b - 1])
    return b"".join([*kept, raw[at:]]).decode("utf-8")


def _cleaned(batch, _, hit, items, spans):
    if not hit.any():
        yield batch
        return
    data, offsets = K.buffers(batch.column("text"))
    texts = batch.column("text").to_pylist()
    for d in np.flatnonzero(hit):
        own = data[offsets[d] : offsets[d + 1]]
        texts[d] = _without(own.tobytes(), own, spans[d].tolist())
    k = batch.schema.get_field_index("text")
    yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))


def _joined_spans(values) -> list:
    """The union of some blocks' spans of one document."""
    had = np.concatenate([np.frombuffer(v, np.int64) for v in values]).reshape(-1, 2)
    start, end = _merged(had[:, 0], had[:, 1] - had[:, 0], np.array([0]))
    return np.stack([start, end], 1).tolist()


def _after_blocks(with_text: bool):
    """What _reported or _cleaned give, of documents joined with the hits of all blocks."""

    def run(batches):
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            spans = [_joined_spans(x) if (x := v.as_py()) else [] for v in batch.column("spans")]
            if with_text:
                texts = batch.column("text").to_pylist()
                for d, s in enumerate(spans):
                    if s:
                        own = data[offsets[d] : offsets[d + 1]]
                        texts[d] = _without(own.tobytes(), own, s)
                k = batch.schema.get_field_index("text")
                yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type)).drop_columns(["row", "spans", "items"])
                continue
            n = [int(x) for i, j in K.chunks(offsets) for x in K.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], K.ALNUM_WORDS_ANY_CASE).counts]
            items = [[y for x in v.as_py() or () for y in x] for v in batch.column("items")]
            yield pa.record_batch([batch.column("doc_id"), *_facts(n, [sum(b - a for a, b in s) for s in spans], items)], names=["doc_id", *FACTS])

    return run


def _built(width: int):
    def run(table: pa.Table) -> pa.Table:
        blob = pickle.dumps(vars(Patterns(list(zip(table.column("item").to_pylist(), table.column("text").to_pylist(), strict=True)), width)))
        return pa.table({"block": table.column("block")[:1], "blob": pa.array([blob], pa.binary())})

    return run


def pattern_blocks(benchmark: DataFrame, width: int) -> tuple[DataFrame, int]:
    """(block, blob): windows of at most about BLOCK_BYTES of items a row, built by tasks in the shared folder; and the number of blocks."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("item", "text"), F.lit(max(1, n))).cast("int").alias("block")
    return cut(items.select(block, "item", "text").groupBy("block").applyInArrow(_built(width), "block int, blob binary"), "benchmark", keep=True), n


def _hits_of_blocks(docs: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """(row, spans, items) of docs(row, text): one pass for each block of the benchmark."""
    spark, found = docs.sparkSession, None
    for k in range(n):
        blob = blocks.where(F.col("block") == k).select("blob").first()
        if blob is None:
            continue
        block = spark.sparkContext.broadcast(bytes(blob["blob"]))
        rows = cut(docs.mapInArrow(_shards(block, False, _hit_rows), "row long, spans binary, items array<string>"), "hits", keep=True)
        block.destroy()
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("row").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))


def _one_block(blocks: DataFrame):
    """The only block as a broadcast, or None if the benchmark has no text."""
    blob = blocks.select("blob").first()
    return None if blob is None else blocks.sparkSession.sparkContext.broadcast(bytes(blob["blob"]))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of docs(doc_id, text)."""
    bounded_batches(docs.sparkSession)
    blocks, n = pattern_blocks(benchmark, width)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FACTS_SCHEMA}"
    if n <= 1:
        return docs.mapInArrow(_shards(_one_block(blocks), False, _reported), schema)
    rows = with_row(docs, "doc_id", "text", "row")
    return rows.join(_hits_of_blocks(rows.select("row", "text"), blocks, n), "row", "left").mapInArrow(_after_blocks(False), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """docs with every merged span of benchmark words cut out of `text`, from the span's first word to its last; all columns stay."""
    bounded_batches(docs.sparkSession)
    blocks, n = pattern_blocks(benchmark, width)
    if n <= 1:
        return docs.mapInArrow(_shards(_one_block(blocks), True, _cleaned), docs.schema)
    # columns travel in one, so that none of them clashes
    carried = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("had"))
    rows = with_row(carried, "doc_id", "text", "row")
    joined = rows.join(_hits_of_blocks(rows.select("row", "text"), blocks, n), "row", "left").select("text", "had", "row", "spans", "items")
    done = joined.mapInArrow(_after_blocks(True), rows.select("text", "had").schema)
    return done.select(*(F.col("text") if c == "text" else F.col(f"had.`{c}`") for c in docs.columns))
