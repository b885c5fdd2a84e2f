"""Line dedup by a segment-partition edit join.

A line with a word is removed if a line before it, in the order of (doc_id, row, line number),
is within `EDITS` code-point edits of it; lines of fewer than `LEAST` code points
must be equal. Lines without a word stay where they are.

A line of length n is cut into EDITS + 1 segments. If two lines are within EDITS edits,
one segment of the shorter line stands unchanged in the longer one, near its own place. So each line
enters (length, segment number, segment) keys into an index, and probes the keys
of lengths n - EDITS to n with the few substrings whose place a match allows. Entries
are packed by key; lines that meet in a key are a group. Groups travel with their texts, and
are verified by a banded bit-parallel edit distance over whole lines, many pairs at
once. Only lines that are late leave a group, never pairs.

Within a group only pairs whose counts of characters allow `EDITS` edits are compared.

Defined results: null text is empty and has no lines. Rows of one doc_id are rows of their own, in an
order that is fixed once: a repeated row loses its lines to the first. Very long lines are lines like others.
Extra columns are kept by `dedup_lines`; those of the names it adds are replaced. An
empty table gives no rows. Rows with a null doc_id stay unchanged, and no line is lost to them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .packed import BLOB_SCHEMA, Packer, bits_for, bucketed, unpack
from .shared import bounded_batches, cut, fresh_name, parts_of, scratch, small, spread_join, with_row

EDITS = 2
LEAST = 30


class Lines:
    """Lines with a word of some rows, as code points with hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        newline = data == 10
        starts = np.zeros(n + 1, bool)
        starts[offsets[:-1][np.diff(offsets) > 0]] = True
        starts[1:] |= newline
        starts[n] = False
        begin = np.flatnonzero(starts)
        ends = np.append(begin[1:], n) if len(begin) else begin
        row = np.searchsorted(offsets, begin, "right") - 1
        ends = ends - newline[ends - 1] if len(begin) else ends  # without the newline that closes the line
        # a row may end right after a newline: the next row starts there, and its first line is not preceded by one
        first_of_row = np.searchsorted(begin, offsets[:-1])
        number = np.arange(len(begin)) - first_of_row[row]
        word = np.concatenate([[0], np.cumsum(~K.SPACE_SEPARATED[data])])
        full = word[ends] > word[begin]
        self.begin, self.end, self.row, self.number = begin[full], ends[full], row[full], number[full]
        w = K.Words.__new__(K.Words)
        w.data, w.starts, w.ends = data, self.begin, self.end
        self.hash = w.hashes().view(np.int64)
        self.data = data

    def code_points(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points of some lines and their lengths."""
        length = self.end[pick] - self.begin[pick]
        raw = self.data[K.ranges(self.begin[pick], length)]
        code = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        char = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        at = np.concatenate([[0], np.cumsum(length)])
        return code, np.diff(char[at])


def _occurrences(batches):
    for batch in batches:
        data, offsets = K.buffers(batch.column("text"))
        ids = batch.column("row").to_numpy(zero_copy_only=False)
        for i, j in K.chunks(offsets):
            lines = Lines(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.record_batch([pa.array(lines.hash), pa.array(ids[i + lines.row], pa.int64()), pa.array(lines.number.astype(np.int32))], names=["line", "row", "number"])


def segments(n: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, length) of the edits + 1 segments of lines of n; the last ones are longer by one where n does not divide."""
    k = edits + 1
    short, long = n // k, n % k
    out = []
    for i in range(k):
        extra = np.maximum(0, i - (k - long))
        out.append((i * short + extra, short + (i >= k - long)))
    return out


def probes(n: np.ndarray, edits: int):
    """(segment number, shift of length, start, segment length, own) of all substrings that a line of n must look up; own: the line's own segments."""
    for delta in range(edits + 1):
        m = n - delta
        for i, (start, length) in enumerate(segments(m, edits)):
            lo = max(-i, delta - (edits - i))
            hi = min(i, delta + (edits - i))
            for shift in range(lo, hi + 1):
                at = start + shift
                yield i, delta, at, length, delta == 0 and shift == 0


def _keys(least: int, edits: int, bits: int):
    def run(batches):
        packer, sent = Packer(bits, [np.int64, np.uint8]), np.empty(0, np.int64)
        for _, data, offsets, _, _ in K.text_table(batches):
            lines = Lines(data, offsets)
            _, pick = np.unique(lines.hash, return_index=True)
            pick = pick[~np.isin(lines.hash[pick], sent)]
            if not len(pick):
                continue
            code, n = lines.code_points(pick)
            first = np.cumsum(n) - n
            big = np.flatnonzero(n >= least)
            name, n, first = lines.hash[pick][big], n[big], first[big]
            prefix = np.zeros(len(code) + 1, np.uint64)
            np.cumsum(K.mix(code.astype(np.uint64) + np.uint64(1)) * K._POW(len(code) + 1)[: len(code)], out=prefix[1:])
            inverse = K._INV(len(prefix))
            for i, delta, at, length, own in probes(n, edits):
                ok = np.flatnonzero((at >= 0) & (at + length <= n) & (n - delta >= least))
                s, l = first[ok] + at[ok], length[ok]
                h = K.mix((prefix[s + l] - prefix[s]) * inverse[s])
                key = K.mix(h + ((n[ok] - delta).astype(np.uint64) << np.uint64(3)) + np.uint64(i))
                for out in packer.add(key, name[ok], np.full(len(ok), own, np.uint8)):
                    sent = np.empty(0, np.int64)
                    yield out
            sent = np.concatenate([sent, name])
        yield from packer.done()

    return run


def _meetings(table: pa.Table) -> pa.Table:
    """Groups of lines that share a key which one of them indexed: (group, line, size). Equal groups of one bucket are one."""
    key, name, own = unpack(table.column("blob"), [np.int64, np.uint8])
    order = np.lexsort((name, key))
    key, name, own = key[order], name[order], own[order]
    new_key = np.ones(len(key), bool)
    new_key[1:] = key[1:] != key[:-1]
    new = new_key.copy()
    new[1:] |= name[1:] != name[:-1]
    at = np.flatnonzero(new)
    indexed = np.bitwise_or.reduceat(own, at) if len(at) else own
    name, head = name[at], np.flatnonzero(new_key[at])
    size = np.diff(np.append(head, len(at)))
    keep = (size > 1) & (np.add.reduceat(indexed.astype(np.int64), head) > 0) if len(head) else size > 1
    head, size = head[keep], size[keep]
    if not len(head):
        return _GROUPS.empty_table()
    pick = K.ranges(head, size)
    begin = np.cumsum(size) - size
    mark = np.add.reduceat(K.mix(name[pick].view(np.uint64)), begin) ^ size.astype(np.uint64)
    _, one = np.unique(mark, return_index=True)
    n = size[one]
    return pa.table([pa.array(np.repeat(mark[one].view(np.int64), n)), pa.array(name[K.ranges(head[one], n)]), pa.array(np.repeat(n, n))], schema=_GROUPS)


_GROUPS = pa.schema([("group", pa.int64()), ("line", pa.int64()), ("size", pa.int64())])


def _line_texts(least: int):
    def run(batches):
        for _, data, offsets, _, _ in K.text_table(batches):
            lines = Lines(data, offsets)
            _, pick = np.unique(lines.hash, return_index=True)
            pick = pick[(lines.end - lines.begin)[pick] >= least]
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(lines.begin[pick].tolist(), lines.end[pick].tolist(), strict=True)]
            yield pa.record_batch([pa.array(lines.hash[pick]), pa.array(texts, pa.binary()).cast(pa.string())], names=["line", "text"])

    return run


def within(xs: list[str], ys: list[str], edits: int) -> np.ndarray:
    """Whether the edit distance of each pair is at most `edits`: Hyyrö's banded bit vectors, one pair per element."""
    n = len(xs)
    m1, m2 = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    out = np.zeros(n, bool)
    alive = np.flatnonzero(np.abs(m1 - m2) <= edits)
    order = alive[np.argsort(m1[alive], kind="stable")]
    for i in range(0, len(order), 512):
        part = order[i : i + 512]
        out[part] = _banded([xs[k] for k in part], [ys[k] for k in part], m1[part], m2[part], edits) <= edits
    return out


def _banded(xs: list[str], ys: list[str], m1: np.ndarray, m2: np.ndarray, t: int) -> np.ndarray:
    """Distances, exact up to t (t <= 15). Bit b of a vector is the cell of pattern place j + b - t in text column j."""
    n, longest1, longest2 = len(xs), int(m1.max(initial=0)), int(m2.max(initial=0))
    size = max(longest1, longest2) + 2 * t + 2
    pattern = np.full((size, n), 0xFFFFFFFF, np.uint32)
    text = np.full((size, n), 0xFFFFFFFE, np.uint32)
    for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
        pattern[t : t + m1[k], k] = np.frombuffer(x.encode("utf-32-le"), np.uint32)
        text[: m2[k], k] = np.frombuffer(y.encode("utf-32-le"), np.uint32)
    one, width = np.uint64(1), 2 * t + 1
    mask = np.uint64((1 << width) - 1)
    vp = np.full(n, ((1 << width) - 1) & ~((1 << t) - 1), np.uint64)
    vn = np.zeros(n, np.uint64)
    distance = np.minimum(t, m1).astype(np.int64)
    for j in range(longest2):
        match = np.zeros(n, np.uint64)
        for b in range(width):
            match |= (pattern[j + b] == text[j]).astype(np.uint64) << np.uint64(b)
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        live = j < m2
        diagonal = j + t < m1
        step = np.where(diagonal, ((d0 >> np.uint64(2 * t)) & one == 0).astype(np.int64), 0)
        place = np.maximum(m1 - 1 - j + t, 0).clip(max=2 * t).astype(np.uint64)  # bit of the last pattern place
        side = ((hp >> place) & one).astype(np.int64) - ((hn >> place) & one).astype(np.int64)
        distance += np.where(live, np.where(diagonal, step, side), 0)
        low = d0 >> one
        vp = (hn | ~(low | hp)) & mask
        vn = low & hp
    return np.where(m1 == 0, m2, distance)


#: Characters are counted in so many bins.
BINS = 32


def _histograms(texts: list[str]) -> np.ndarray:
    """Counts of each text's characters in BINS bins. An edit changes two of them by one at most."""
    length = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    at = np.repeat(np.arange(len(texts)), length) * BINS + code % BINS
    return np.bincount(at, minlength=len(texts) * BINS).reshape(-1, BINS).astype(np.int32)


def _late(edits: int):
    """Lines of whole groups that come after a line within `edits` edits. Each group's first line is compared with all others; only those it does not settle are compared with the rest."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("group", "ascending"), ("block", "ascending"), ("row", "ascending"), ("number", "ascending"), ("line", "ascending")])
        group, block, line, side = (table.column(c).to_numpy() for c in ("group", "block", "line", "side"))
        text = table.column("text").to_pylist()
        head = np.ones(len(line), bool)
        head[1:] = (group[1:] != group[:-1]) | (block[1:] != block[:-1])
        head = np.flatnonzero(head)
        end = np.append(head[1:], len(line))
        late: set[int] = set()
        waiting: list[tuple[int, int]] = []

        def settle():
            if waiting:
                hit = within([text[i] for i, _ in waiting], [text[j] for _, j in waiting], edits)
                late.update(int(line[waiting[k][1]]) for k in np.flatnonzero(hit))
                waiting.clear()

        for a, b in zip(head.tolist(), end.tolist(), strict=True):
            for j in range(a + 1, b):
                if int(line[j]) not in late and (side[a] < 0 or side[a] != side[j]):
                    waiting.append((a, j))
                    if len(waiting) >= 8192:
                        settle()
        settle()
        for a, b in zip(head.tolist(), end.tolist(), strict=True):
            rest = [j for j in range(a + 1, b) if int(line[j]) not in late]
            if not rest or rest[-1] == a + 1:
                continue
            counts = _histograms(text[a:b])
            for j in rest:
                # nearest first: a late line is settled by few comparisons
                gap = np.abs(counts[1 : j - a] - counts[j - a]).sum(1)
                near = np.flatnonzero((gap <= 2 * edits) & ((side[j] < 0) | (side[a + 1 : j] != side[j])))
                waiting += [(a + 1 + i, j) for i in near[np.argsort(gap[near], kind="stable")].tolist()]
                if len(waiting) >= 8192:
                    settle()
        settle()
        return pa.table({"line": pa.array(sorted(late), pa.int64())})

    return run


#: Groups of more lines are compared block by block.
BLOCK_LINES = 4096


def late_lines(docs: DataFrame, first: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(line): hashes of lines within `edits` edits of a different line that comes before; first: (line, first) of all lines."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    parts = 1 << bits_for(parts_of(docs, 32, 2))
    blobs = texts.mapInArrow(_keys(least, edits, bits_for(parts)), BLOB_SCHEMA)
    groups = cut(bucketed(blobs, _meetings, "group long, line long, size long").distinct(), "groups")
    wanted = cut(groups.select("line").distinct(), "wanted")
    # the lines that met are few; the hint goes only to a counted table
    lines = texts.mapInArrow(_line_texts(least), "line long, text string").join(small(wanted, 16), "line", "left_semi").dropDuplicates(["line"])
    placed = lines.join(first.select("line", "first.row", "first.number"), "line")
    blocks = F.ceil(F.col("size") / BLOCK_LINES).cast("int")
    own = F.pmod(F.xxhash64("line"), blocks).cast("int")
    rows = groups.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own")).alias("side")  # two lines of one side meet in that side's own block
    rows = rows.select("group", "line", side, (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).cast("long").alias("block"))
    rows = rows.join(placed, "line").withColumn("part", F.pmod(F.xxhash64("group", "block"), F.lit(parts)).cast("int"))
    return rows.groupBy("part").applyInArrow(_late(edits), "line long").distinct()


def removals(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(row, gone): the numbers of the lines to be removed, of those rows of docs(row, text) with any."""
    with scratch():
        lines = cut(docs.mapInArrow(_occurrences, "line long, row long, number int"), "occurrences")
        at = F.struct("row", "number")
        first = lines.groupBy("line").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
        # a line close to an earlier one goes in all its occurrences, any other one in all but its first
        late = cut(late_lines(docs, first, edits, least), "late").withColumn("late", F.lit(True))
        verdict = cut(first.join(late, "line", "left").where("n > 1 or late").select("line", "first", "n", F.coalesce("late", F.lit(False)).alias("late")), "verdict")
        gone = spread_join(lines, verdict, "line", "n").where(F.col("late") | (F.col("first") < at))
        return cut(gone.groupBy("row").agg(F.collect_list("number").alias("gone")), "gone", keep=True)


def _kept(with_text: bool):
    def run(batches):
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            raw = data.tobytes()
            n_lines, n_gone, digest, texts = [], [], [], []
            gone_of = batch.column("gone")
            for i, j in K.chunks(offsets):
                lines = Lines(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n_lines += np.bincount(lines.row, minlength=j - i).tolist()
            for d in range(batch.num_rows):
                text = raw[offsets[d] : offsets[d + 1]]
                gone = set(gone_of[d].as_py() or ())
                if gone:
                    text = b"\n".join(x for k, x in enumerate(text.split(b"\n")) if k not in gone)
                n_gone.append(len(gone))
                if with_text:
                    texts.append(text.decode("utf-8"))
                else:
                    digest.append(hashlib.sha256(text).hexdigest())
            done = pa.array(texts if with_text else digest, pa.large_string() if with_text else pa.string())
            yield pa.record_batch([batch.column("had"), done, pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64())], names=["had", "text", "n_lines", "n_removed"])

    return run


def _judged(docs: DataFrame, had, with_text: bool, edits: int, least: int) -> DataFrame:
    """(had, text or its digest, n_lines, n_removed); had: a column of docs that is carried along."""
    bounded_batches(docs.sparkSession)
    row = fresh_name(docs, "row")
    named = docs.where("doc_id is not null")
    rows = with_row(named, "doc_id", "text", row)
    slim = rows.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text"), had.alias("had"))
    none = F.lit(None).cast("array<int>").alias("gone")
    # texts are shuffled at any size, so that small inputs say what large ones need
    found = slim.join(removals(slim.select("row", "text"), edits, least).hint("merge"), "row", "left").select("text", "had", "gone")
    unnamed = docs.where("doc_id is null").select(F.col("text").cast("string").alias("text"), had.alias("had"), none)
    kind = found.schema["had"].dataType.simpleString()
    return found.unionByName(unnamed).mapInArrow(_kept(with_text), f"had {kind}, text string, n_lines long, n_removed long")


def report(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(doc_id, n_lines with a word, n_removed, kept_sha256 of the text that is left)."""
    found = _judged(docs, F.col("doc_id").cast("long"), False, edits, least)
    return found.select(F.col("had").alias("doc_id"), "n_lines", "n_removed", F.col("text").alias("kept_sha256"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """docs without the removed lines, all columns, with n_lines and n_removed (which replace columns of these names)."""
    others = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_removed")]
    found = _judged(docs, F.struct(*(F.col(f"`{c}`") for c in others)), True, edits, least)
    columns = [F.col("text") if c.lower() == "text" else F.col(f"had.`{c}`") for c in docs.columns if c in others or c.lower() == "text"]
    return found.select(*columns, "n_lines", "n_removed")
