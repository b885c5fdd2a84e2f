"""SentencePiece encoding and decoding with N-best segmentations.

A text is a lattice of vocabulary pieces. Pieces never cross the start of a run of
spaces nor touch characters that are in no longer piece, so the lattice falls
into segments; equal segments of a chunk are solved once, all together:

* forward Viterbi gives each node the best score from its segment's start;
* the same backward gives, over all edges off the best path, the gap to the second best;
* for the segments with a document's smallest gaps, an A* search runs backward from
  the segment's end with the forward scores as its exact heuristic, so complete
  segmentations leave the queue in order of score. A document's N best are the N
  best sums over its segments, found from those alone.

Piece scores are the model's where they are log-probabilities (unigram models). Scores of a BPE model are the ranks of its
merges, whose sums mean nothing; ranks follow frequency, so its pieces get the log-probabilities of Zipf's law,
-log(rank + 2) less the log of their sum, and the best path is the likeliest segmentation. It is not the
merge order's result; README says how often they agree. A character without a piece of its own becomes its
UTF-8 bytes at the score `least - 10`; so does U+2581 itself, which otherwise
stands for a space. Decoding is exact for every text.

The model file's path is a parameter; the driver reads it and sends the pieces (their number is the
bound of what is broadcast) to the executors.

Defined results: null text is empty. The empty text has no pieces, score 0 and one
segmentation. Other columns are kept as asked; of columns named like an output, the output's is given. Repeated rows
are encoded alike. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import bounded_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Models give this score or a lower one to pieces that are not meant to be used.
UNUSED = -1e8
CHUNK = 1 << 18
_FILTER_BITS, _FIRST_BITS = 22, 16


def read_model(path: str = MODEL) -> dict:
    """Pieces, scores and the ids of byte pieces, as plain data."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores, ids, byte_ids, text_of = [], [], [], [0] * 256, {}
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            text_of[i] = bytes([int(piece[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces.append(piece)
            scores.append(sp.get_score(i))
            ids.append(i)
            text_of[i] = piece.replace(SPACE, " ").encode()
    ranks = -np.array(scores)
    used = ranks < -UNUSED
    if used.sum() > 1 and (ranks == np.round(ranks)).all() and len(np.unique(ranks[used])) == used.sum():  # merge ranks
        likely = 1.0 / (ranks[used] - ranks[used].min() + 2)
        ranks[used] = -np.log(likely / likely.sum())
        scores = (-ranks).tolist()
    return {"pieces": pieces, "scores": scores, "ids": ids, "byte_ids": byte_ids, "text_of": text_of, "size": sp.get_piece_size()}


def _hash_prefix(code: np.ndarray) -> np.ndarray:
    prefix = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(K.mix(code.astype(np.uint64) + np.uint64(1)) * K._POW(max(1, len(code)))[: len(code)], out=prefix[1:])
    return prefix


def _hash_spans(prefix: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    return K.mix((prefix[start + length] - prefix[start]) * K._INV(len(prefix))[start] + np.uint64(length))


class Vocabulary:
    def __init__(self, model: dict):
        pieces = model["pieces"]
        lengths = np.array([len(p) for p in pieces])
        self.longest = int(lengths.max(initial=1))
        starts = np.cumsum(lengths) - lengths
        code = np.frombuffer("".join(pieces).replace(SPACE, " ").encode("utf-32-le"), np.uint32)
        prefix = _hash_prefix(code)
        self.ids, self.scores = np.array(model["ids"], np.int32), np.array(model["scores"], np.float64)
        self.by_length = []
        for n in range(1, self.longest + 1):
            own = np.flatnonzero(lengths == n)
            h = _hash_spans(prefix, starts[own], n)
            order = np.argsort(h)
            maybe = np.zeros(1 << _FILTER_BITS, bool)
            maybe[h >> np.uint64(64 - _FILTER_BITS)] = True
            h = h[order]
            # where the hashes of each prefix begin, and the most of one prefix
            first = np.searchsorted(h >> np.uint64(64 - _FIRST_BITS), np.arange((1 << _FIRST_BITS) + 1, dtype=np.uint64)).astype(np.int32)
            self.by_length.append((h, own[order], maybe, first, int(np.diff(first).max())) if len(own) else None)
        self.least = float(self.scores[self.scores > UNUSED].min(initial=0.0)) - UNKNOWN_PENALTY
        many = {c for p in pieces if len(p) > 1 for c in p}
        #: ASCII characters at which a text can always be cut, besides the starts of runs of spaces
        self.lonely = np.array([i < 128 and i != 32 and chr(i) not in many for i in range(256)])
        self.byte_ids = np.array(model["byte_ids"], np.int32)
        texts = [model["text_of"].get(i, b"") for i in range(model["size"])]
        self.text_length = np.array([len(t) for t in texts], np.int64)
        self.text_start = np.cumsum(self.text_length) - self.text_length
        self.text = np.frombuffer(b"".join(texts), np.uint8)


class Lattices:
    """The lattices of many segments, solved together. code: their characters, plain spaces, U+2581 as itself.

    `piece` holds for each character and length the piece that starts there (none: `self.none`, a
    character without a piece: `self.lost` at length 1). Segments are solved longest first, so those
    that reach a depth are a prefix of all, and each depth is a few array operations.
    """

    def __init__(self, v: Vocabulary, code: np.ndarray, lengths: np.ndarray):
        self.v, self.code, self.lengths = v, code, lengths
        n_seg, n = len(lengths), len(code)
        self.first = np.cumsum(lengths) - lengths  # first character of each segment
        self.lost, self.none = len(v.ids), len(v.ids) + 1
        self.value = np.concatenate([v.scores, [v.least, -np.inf]])
        kind = np.uint16 if self.none < 1 << 16 else np.uint32
        self.width = max(1, min(v.longest, int(lengths.max(initial=1))))
        self.piece = np.full((self.width, n), self.none, kind)
        room = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)
        prefix = _hash_prefix(code)
        self.piece[0] = self.lost
        for k in range(1, self.width + 1):
            if v.by_length[k - 1] is None:
                continue
            h, own, maybe, begin, most = v.by_length[k - 1]
            at = np.flatnonzero(room >= k)
            key = _hash_spans(prefix, at, k)
            hit = maybe[key >> np.uint64(64 - _FILTER_BITS)]
            at, key = at[hit], key[hit]
            place = begin[key >> np.uint64(64 - _FIRST_BITS)]
            for _ in range(most):
                np.minimum(place, len(h) - 1, out=place)
                hit = h[place] == key
                self.piece[k - 1][at[hit]] = own[place[hit]]
                at, key, place = at[~hit], key[~hit], place[~hit] + 1
                if not len(at):
                    break
        self.order = np.argsort(-lengths, kind="stable")
        self.reach = np.searchsorted(-lengths[self.order], -np.arange(int(lengths.max(initial=0)) + 1), "right")  # segments of at least each depth
        self.node = np.arange(n_seg) + self.first  # node before the first character
        self.forward = np.full(n + n_seg, -np.inf)
        self.forward[self.node] = 0.0
        self.back = np.zeros(n + n_seg, np.uint8)
        start, node = self.first[self.order], self.node[self.order]
        for d in range(1, len(self.reach)):
            c, m = start[: self.reach[d]] + d, node[: self.reach[d]] + d
            best, back = np.full(len(c), -np.inf), np.zeros(len(c), np.uint8)
            for k in range(min(d, self.width), 0, -1):  # the longest piece wins a tie
                total = self.forward[m - k] + self.value[self.piece[k - 1][c - k]]
                better = total > best
                np.copyto(best, total, where=better)
                np.copyto(back, k, where=better, casting="unsafe")
            self.forward[m], self.back[m] = best, back
        self.best_score = self.forward[self.node + lengths]

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best paths: (first character of each piece in order, its length, first piece of each segment)."""
        length = np.zeros(len(self.code), np.uint8)
        own = np.flatnonzero(self.lengths > 0)
        left = self.lengths[own].copy()
        while len(own):
            k = self.back[self.node[own] + left]
            left -= k
            length[self.first[own] + left] = k
            go = left > 0
            own, left = own[go], left[go]
        at = np.flatnonzero(length)
        return at, length[at], np.searchsorted(at, np.append(self.first, len(self.code)))

    def gaps(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Best score minus second best of each segment (inf if there is one segmentation only); at, length: the best paths."""
        n, n_seg = len(self.code), len(self.lengths)
        backward = np.full(n + n_seg, -np.inf)
        end, last = (self.first + self.lengths)[self.order], (self.node + self.lengths)[self.order]
        backward[last] = 0.0
        for d in range(1, len(self.reach)):
            c, m = end[: self.reach[d]] - d, last[: self.reach[d]] - d
            best = np.full(len(c), -np.inf)
            for k in range(1, min(d, self.width) + 1):
                np.maximum(best, backward[m + k] + self.value[self.piece[k - 1][c]], out=best)
            backward[m] = best
        node = np.arange(n) + np.repeat(np.arange(n_seg), self.lengths)
        through = np.full(n, -np.inf)
        taken = np.zeros(n, np.uint8)
        taken[at] = length
        for k in range(1, self.width + 1):
            c = np.flatnonzero((self.piece[k - 1] != self.none) & (taken != k))
            m = node[c]
            through[c] = np.maximum(through[c], self.forward[m] + self.value[self.piece[k - 1][c]] + backward[m + k])
        full = np.flatnonzero(self.lengths > 0)
        second = np.full(n_seg, -np.inf)
        if len(full):
            second[full] = np.maximum.reduceat(through, self.first[full])
        return self.best_score - second

    def n_best(self, segment: int, n: int) -> list[tuple[float, list[tuple[int, int]]]]:
        """The n best (score, [(start, length)]) of a segment: A* backward from its end; the forward scores are exact, so paths come in order."""
        size, first, node = int(self.lengths[segment]), int(self.first[segment]), int(self.node[segment])
        pieces = self.piece[:, first : first + size].tolist()
        ahead = self.forward[node : node + size + 1].tolist()
        queue: list = [(-ahead[size], 0, size, 0.0, None)]
        out, count = [], 0
        while queue and len(out) < n:
            f, _, d, g, path = heapq.heappop(queue)
            if d == 0:
                steps = []
                while path:
                    steps.append(path[0])
                    path = path[1]
                out.append((-f, steps))
                continue
            for k in range(1, min(d, self.width) + 1):
                p = pieces[k - 1][d - k]
                if p != self.none:
                    count += 1
                    to = g + float(self.value[p])
                    heapq.heappush(queue, (-(to + ahead[d - k]), count, d - k, to, ((d - k, k), path)))
        return out

    def ids(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of a path and how many each step gives; a character without a piece gives bytes."""
        piece = self.piece[length.astype(np.int64) - 1, at].astype(np.int64)
        lost = np.flatnonzero(piece == self.lost)
        count = np.ones(len(at), np.int64)
        if not len(lost):
            return self.v.ids[piece], count
        raw = [chr(c).encode() for c in self.code[at[lost]].tolist()]
        count[lost] = [len(r) for r in raw]
        out = np.empty(int(count.sum()), np.int32)
        begin = np.cumsum(count) - count
        out[begin] = self.v.ids[np.where(piece == self.lost, 0, piece)]
        out[K.ranges(begin[lost], count[lost])] = self.v.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return out, count


class Encoded:
    """A chunk of texts: ids of all rows, and what their N-best search needs."""

    def __init__(self, v: Vocabulary, data: np.ndarray, offsets: np.ndarray):
        self.v, self.known, self.others = v, {}, {}
        size = np.diff(offsets)
        # a space before each text that is not empty, as the model wants
        lead = (size > 0).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(size + lead)])
        self.data = np.full(int(self.offsets[-1]), 0x20, np.uint8)
        self.data[K.ranges(self.offsets[:-1] + lead, size)] = data
        space = self.data == 0x20
        lonely = v.lonely[self.data]
        starts = np.zeros(len(self.data), bool)
        starts[self.offsets[:-1][size > 0]] = True
        starts |= lonely
        starts[1:] |= (space[1:] & ~space[:-1]) | lonely[:-1]
        begin = np.flatnonzero(starts)
        end = np.append(begin[1:], len(self.data)) if len(begin) else begin
        self.row_first = np.searchsorted(begin, self.offsets)
        words = K.Words.__new__(K.Words)
        words.data, words.starts, words.ends = self.data, begin, end
        hashes = words.hashes()
        _, index, self.segment = np.unique(hashes, return_index=True, return_inverse=True)
        length = end[index] - begin[index]
        raw = self.data[K.ranges(begin[index], length)]
        text = raw.tobytes().decode("utf-8")
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        char = np.cumsum((raw & 0xC0) != 0x80)
        ends = np.cumsum(length)
        chars = np.diff(np.concatenate([[0], char[ends - 1]])) if len(ends) else length
        code = np.where(code == 0x2581, 0x110000, code)  # a literal U+2581 matches no piece
        self.lattices = Lattices(v, code, chars)
        self.lattices.code = np.where(code == 0x110000, 0x2581, code)
        self.path = self.lattices.best()
        at, steps, first = self.path
        ids, count = self.lattices.ids(at, steps)
        begin = np.concatenate([[0], np.cumsum(count)])
        self.seg_ids, self.seg_first = ids, begin[first]
        n = np.diff(self.seg_first)
        self.ids = ids[K.ranges(self.seg_first[:-1][self.segment], n[self.segment])]
        self.at_segment = np.concatenate([[0], np.cumsum(n[self.segment])])  # first id of each segment of the rows
        self.id_first = self.at_segment[self.row_first]
        best = self.lattices.best_score[self.segment]
        self.scores = np.array([best[a:b].sum() for a, b in zip(self.row_first[:-1].tolist(), self.row_first[1:].tolist(), strict=True)], np.float64)

    def round_trips(self, choices: list | tuple = ()) -> np.ndarray:
        """Whether the decoded ids of each row equal its text; with all rows' n_best_choices, those of each of them."""
        raw, first = decode(self.v, self.ids, self.id_first)
        same = np.diff(first) == np.diff(self.offsets)
        if same.all():
            wrong = np.flatnonzero(raw != self.data)
            same[np.searchsorted(self.offsets, wrong, "right") - 1] = False
        else:
            for d in np.flatnonzero(same):
                same[d] = np.array_equal(raw[first[d] : first[d + 1]], self.data[self.offsets[d] : self.offsets[d + 1]])
        for d, row in enumerate(choices):
            # sequences differ in these segments only
            a = int(self.row_first[d])
            same[d] &= all(self._other(int(self.segment[a + k]), r)[1] for _, chosen in row for k, r in chosen)
        return same

    def n_best_choices(self, n: int) -> list[list[tuple[float, tuple]]]:
        """For each row its n best segmentations as (score lost against the best, ((segment of the row, rank of its segmentation), ...)); the first is (0, ())."""
        gaps = self.lattices.gaps(self.path[0], self.path[1])
        out = []
        for a, b in zip(self.row_first[:-1].tolist(), self.row_first[1:].tolist(), strict=True):
            seg = self.segment[a:b]
            gap = gaps[seg]
            # a choice other than the best in any of more than n - 1 segments would lose to n - 1 better ones
            pick = np.argsort(gap, kind="stable")[: n - 1] if b - a <= 4 * n else (p := np.argpartition(gap, n - 1)[: n - 1])[np.argsort(gap[p], kind="stable")]
            sums: list[tuple[float, tuple]] = [(0.0, ())]
            for k in pick.tolist():
                if gap[k] == np.inf:
                    break
                s = int(seg[k])
                if s not in self.known:
                    found = self.lattices.n_best(s, n)
                    self.known[s] = [found[0][0] - x for x, _ in found], [steps for _, steps in found]
                sums = heapq.nsmallest(n, ((x + y, c + ((k, r),) * (r > 0)) for x, c in sums for r, y in enumerate(self.known[s][0])))
            out.append(sums)
        return out

    def n_best_losses(self, n: int) -> list[list[float]]:
        """For each row the score losses of its n best segmentations against the best (the first is 0)."""
        return [[x for x, _ in row] for row in self.n_best_choices(n)]

    def n_best_ids(self, row: int, choices: list[tuple[float, tuple]]) -> list[np.ndarray]:
        """The id sequences of a row's n_best_choices: the best one's ids, but for the segments in which they differ."""
        first = int(self.row_first[row])
        out = []
        for _, chosen in choices:
            parts, done = [], self.id_first[row]
            for k, r in sorted(chosen):
                parts += [self.ids[done : self.at_segment[first + k]], self._other(int(self.segment[first + k]), r)[0]]
                done = self.at_segment[first + k + 1]
            parts.append(self.ids[done : self.id_first[row + 1]])
            out.append(np.concatenate(parts))
        return out

    def _other(self, segment: int, rank: int) -> tuple[np.ndarray, bool]:
        """Ids of a segment's segmentation of this rank, and whether they decode to what the best one's do."""
        if (segment, rank) not in self.others:
            steps = np.array(self.known[segment][1][rank], np.int64)
            ids = self.lattices.ids(steps[:, 0] + int(self.lattices.first[segment]), steps[:, 1])[0]
            best = self.seg_ids[self.seg_first[segment] : self.seg_first[segment + 1]]
            raw, cuts = decode(self.v, np.concatenate([best, ids]), np.array([0, len(best), len(best) + len(ids)]))
            self.others[segment, rank] = ids, np.array_equal(raw[: cuts[1]], raw[cuts[1] :])
        return self.others[segment, rank]


def decode(v: Vocabulary, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the rows (each with the leading space of the model) and their offsets."""
    n = v.text_length[ids]
    at = np.concatenate([[0], np.cumsum(n)])
    return v.text[K.ranges(v.text_start[ids], n)], at[first]


def decode_text(v: Vocabulary, ids) -> str:
    raw, _ = decode(v, np.asarray(ids, np.int64), np.array([0, len(ids)]))
    return raw.tobytes()[1:].decode("utf-8")


OUTPUTS = ("n_pieces", "ids_sha256", "score", "n_best", "second_loss", "round_trip", "ids", "n_best_ids", "n_best_losses")


def _encode(model, keep: list[str], n: int, with_ids: bool, with_n_best: bool):
    def run(batches):
        v = Vocabulary(model.value)
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            for i, j in K.chunks(offsets, CHUNK):
                e = Encoded(v, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                raw = e.ids.astype("<i4")
                cuts = e.id_first.tolist()
                choices = e.n_best_choices(n)
                columns = [batch.column(c).slice(i, j - i) for c in keep]
                columns += [
                    pa.array(np.diff(e.id_first), pa.int64()),
                    pa.array([hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string()),
                    pa.array(e.scores, pa.float64()),
                    pa.array([len(x) for x in choices], pa.int64()),
                    pa.array([x[1][0] if len(x) > 1 else None for x in choices], pa.float64()),
                    pa.array(e.round_trips(choices if with_n_best else ())),
                ]
                names = [*keep, *OUTPUTS[:6]]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(e.id_first, pa.int32()), pa.array(raw, pa.int32())))
                    names.append("ids")
                if with_n_best:
                    found = [x for d, c in enumerate(choices) for x in e.n_best_ids(d, c)]
                    rows = pa.array(np.cumsum([0, *map(len, choices)]), pa.int32())
                    own = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found).astype(np.int32, copy=False)))
                    columns += [pa.ListArray.from_arrays(rows, own), pa.ListArray.from_arrays(rows, pa.array([x for c in choices for x, _ in c], pa.float64()))]
                    names += OUTPUTS[7:]
                yield pa.record_batch(columns, names=names)

    return run


def encode(docs: DataFrame, model_path: str = MODEL, n: int = 3, keep: tuple = ("doc_id",), with_ids: bool = False, with_n_best: bool = False) -> DataFrame:
    """Columns `keep` of docs with n_pieces, ids_sha256 (of the ids as little-endian int32), score, n_best (found, n at most), second_loss (score lost by the second best), round_trip (the ids, with n_best_ids all of these, decode to the text)[, ids][, n_best_ids (the best first), n_best_losses (the score that each loses)]."""
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    keep = [c for c in keep if c.lower() not in OUTPUTS]
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in keep)
    schema += "n_pieces long, ids_sha256 string, score double, n_best long, second_loss double, round_trip boolean" + ", ids array<int>" * with_ids + ", n_best_ids array<array<int>>, n_best_losses array<double>" * with_n_best
    return source.withColumn("text", F.col("text").cast("string")).mapInArrow(_encode(model, keep, n, with_ids, with_n_best), schema)


def _decode(model):
    def run(batches):
        v = Vocabulary(model.value)
        k = None
        for batch in batches:
            texts = [decode_text(v, x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in batch.column("ids")]
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, "text", pa.array(texts, pa.string()))

    return run


def decode_ids(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """encoded(ids, ...) with a column `text` (it replaces one of that name): the exact text of encode(); null ids give null."""
    bounded_batches(encoded.sparkSession)
    model = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))
    source = encoded.withColumn("text", F.lit(None).cast("string"))
    return source.mapInArrow(_decode(model), source.schema)
