"""N-gram Jaccard join: classes of documents whose shingle sets overlap.

The document-by-shingle incidence matrix A is multiplied with its transpose in
blocks. A block is a range of shingle hashes; the product of a block adds to the
overlap counts of the pairs that meet there, and pairs whose accumulated count
stays below a bound that follows from the two set sizes are discarded. Four
exact reductions keep the product small:

* documents with equal sets are one row of A (a class);
* equal columns of A (shingles that the same classes have) are one column with a weight;
* at first only a prefix of each class's sorted set enters the blocks. Two sets of
  sizes n and m with Jaccard >= t share at least t * max(n, m) shingles, so their
  prefixes of n - ceil(t n) + l shingles share at least l of them; a class with fewer
  shared prefix shingles than the smallest possible l has no partner. Those left
  enter with whole sets and need t * n shared shingles;
* a column of the block is multiplied with one pivot class after the other,
  and only pairs not connected by then are multiplied out. A group of near copies thus costs a
  number of products proportional to its size, not to its square, and no
  link between different components is lost.

Surviving pairs are verified with whole sets.

Defined results: null text, text without a word -> empty set, linked with
nothing, its own component. Equal sets are always linked. Repeated rows and
repeated ids are harmless (links are between sets; a component's id is its
least doc_id). Extra columns are ignored. An empty table gives no rows. A null
doc_id is kept as a row with a null id and never names a component unless
it is alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernel as K
from .components import components
from .packed import BLOB_SCHEMA, Packer, bits_for, bucketed, unpack
from .shared import bounded_batches, cut, parts_of, scratch, small, spread_join

#: Share of a set, in percent, by which prefixes are longer than the shortest valid ones (l of the bound above).
EXTRA = 15
#: Pivots per column before what is left open is multiplied out.
MOST_PIVOTS = 12
#: Columns of a class that an entry carries; pairs that share more may be made more than once.
CARRIED = 64
#: Columns of more classes are multiplied block by block.
BLOCK_ROWS = 2048


def least_shared(n, extra: int = EXTRA):
    """l for a set of n shingles (numpy, int or Column arithmetic alike: integer percent of n, at least 1)."""
    return np.maximum(1, n * extra // 100)


def _sets(w: K.Words, k: int):
    """Per row with words: (row, sorted distinct shingle hashes). Fewer than k words are one shingle."""
    h = w.hashes(lower=True)
    s = K.windows(h, k)
    first, counts = w.first, w.counts
    for d in np.flatnonzero(counts):
        a, c = first[d], counts[d]
        if c >= k:
            yield d, np.unique(s[a : a + c - k + 1])
        else:
            yield d, K.windows(h[a : a + c], int(c), salt=int(c) + 1)


def _digest(u: np.ndarray) -> int:
    """Order-free 64-bit digest of a set, as a signed long."""
    x = K.mix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    with np.errstate(over="ignore"):
        total = np.sum(x, dtype=np.uint64) + np.uint64(len(u)) * np.uint64(0x9E3779B97F4A7C15)
    return int(np.int64(K.mix(np.array([total]))[0].astype(np.int64)))


def _document_rows(k: int):
    def run(batches):
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            n = np.zeros(batch.num_rows, np.int64)
            digest = np.zeros(batch.num_rows, np.int64)
            for i, j in K.chunks(offsets):
                w = K.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], K.SPACE_SEPARATED)
                for d, u in _sets(w, k):
                    n[i + d], digest[i + d] = len(u), _digest(u)
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(digest)], names=["doc_id", "n_shingles", "digest"])

    return run


def _incidence(k: int, percent: int, bits: int, whole: bool):
    """Blobs of (shingle, class): the prefix of each class, or its whole set; a class is sent once per gathering."""

    def run(batches):
        packer, sent = Packer(bits, [np.int64], limit=1_000_000), set()
        for _, data, offsets, _, _ in K.text_table(batches):
            w = K.Words(data, offsets, K.SPACE_SEPARATED)
            keys, ids, lengths = [], [], []
            for _, u in _sets(w, k):
                digest, n = _digest(u), len(u)
                if digest in sent:
                    continue
                sent.add(digest)
                p = n if whole else min(n, n - -(-n * percent // 100) + int(least_shared(n)))
                keys.append(u[:p])
                ids.append(digest)
                lengths.append(p)
            if keys:
                for out in packer.add(np.concatenate(keys), np.repeat(np.array(ids, np.int64), lengths)):
                    sent.clear()
                    yield out
        yield from packer.done()

    return run


def _many(blobs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Columns of a block with two classes or more: (shingle, class) ordered, and where each column begins and how long it is."""
    key, cls = unpack(blobs, [np.int64])
    order = np.argsort(key, kind="stable")
    key, cls = key[order], cls[order]
    many = np.zeros(len(key), bool)
    many[1:] = key[1:] == key[:-1]
    many[:-1] |= many[1:]
    key, cls = key[many], cls[many]
    # a class may come from several tasks
    order = np.lexsort((cls, key))
    key, cls = key[order], cls[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    key, cls = key[fresh], cls[fresh]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(key))) if len(head) else head
    return key, cls, head[size > 1], size[size > 1]


def _shared_counts(table: pa.Table) -> pa.Table:
    """(class, c): how many shingles of a class in this block another class has too."""
    _, cls, head, size = _many(table.column("blob"))
    found, c = np.unique(cls[K.ranges(head, size)], return_counts=True)
    return pa.table({"cls": pa.array(found.astype(np.int64)), "c": pa.array(c.astype(np.int64))})


def _shared_columns(table: pa.Table) -> pa.Table:
    """A block's columns with two classes or more as (shingle, class, weight); equal columns are merged into the one of the least shingle, their number is its weight."""
    key, cls, head, size = _many(table.column("blob"))
    if not len(head):
        return pa.table({"shingle": pa.array([], pa.int64()), "cls": pa.array([], pa.int64()), "weight": pa.array([], pa.int64())})
    at = K.ranges(head, size)
    key, cls = key[head], cls[at]
    head = np.cumsum(size) - size
    one = np.bitwise_xor.reduceat(K.mix(cls.view(np.uint64)), head)
    two = np.add.reduceat(K.mix(cls.view(np.uint64) ^ np.uint64(0x5BD1E995)), head)
    order = np.lexsort((key.view(np.int64), size, two, one))
    new = np.ones(len(order), bool)
    for x in (one, two, size):
        x = x[order]
        new[1:] &= x[1:] == x[:-1]
    new[1:] = ~new[1:]
    first = np.flatnonzero(new)
    weight, rep = np.diff(np.append(first, len(order))), order[first]
    n = size[rep]
    return pa.table({"shingle": pa.array(np.repeat(key[rep].view(np.int64), n)), "cls": pa.array(cls[K.ranges(head[rep], n)]), "weight": pa.array(np.repeat(weight, n))})


def _whole_sets(k: int):
    def run(batches):
        for batch, data, offsets, i, _ in K.text_table(batches):
            w = K.Words(data, offsets, K.SPACE_SEPARATED)
            cls, sets = [], []
            for d, u in _sets(w, k):
                cls.append(_digest(u))
                sets.append(u.tobytes())
            yield pa.record_batch([pa.array(cls, pa.int64()), pa.array(sets, pa.binary())], names=["cls", "shingles"])

    return run


def _verified(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([a, b]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(mask)

    return run


def _open_products(now: DataFrame) -> int:
    """Products of the rare columns that could still connect two components."""
    each = now.where("rare").groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("c"))
    column = each.groupBy("shingle").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q"))
    return int(column.agg(F.sum((F.col("n") * F.col("n") - F.col("q")) / 2)).first()[0] or 0)


def _overlaps(lists: list[np.ndarray], weights: list[np.ndarray] | None) -> np.ndarray:
    """Weighted sizes of all intersections of some lists of columns: the product of their incidence with its transpose, some columns at a time."""
    n = len(lists)
    out = np.zeros((n, n), np.float64)
    size = np.array([len(x) for x in lists])
    if not size.sum():
        return out
    _, index, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    value = np.concatenate(weights).astype(np.float32) if weights else np.ones(len(row), np.float32)
    shared = count[index] > 1
    place = np.cumsum(count > 1) - 1
    row, column, value = row[shared], place[index[shared]], value[shared]
    order = np.argsort(column, kind="stable")
    row, column, value = row[order], column[order], value[order]
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        a, b = np.searchsorted(column, [c, c + 2048])
        x = np.zeros((n, 2048), np.float32)
        y = np.zeros((n, 2048), np.float32)
        x[row[a:b], column[a:b] - c] = 1
        y[row[a:b], column[a:b] - c] = value[a:b]
        out += x @ y.T
    return out


class _Merged:
    """Which components a task has connected so far."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        at = x
        while (up := self.parent.get(at, at)) != at:
            at = up
        while (up := self.parent.get(x, x)) != at:
            self.parent[x], x = at, up
        return at

    def roots(self, comp: np.ndarray) -> np.ndarray:
        found, place = np.unique(comp, return_inverse=True)
        return np.array([self.root(x) for x in found.tolist()], np.int64)[place]

    def join(self, x: int, y: int) -> bool:
        """Whether x and y were apart; they are one afterwards."""
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _forest(near: np.ndarray, comp: np.ndarray, merged: _Merged) -> list[tuple[int, int]]:
    """Of the pairs in the matrix `near`, those that connect components which nothing before connects: at most components - 1."""
    near = near | near.T
    todo = np.ones(len(comp), bool)
    out = []
    for start in range(len(comp)):
        if not todo[start]:
            continue
        front = np.flatnonzero(todo & (comp == comp[start])).tolist()
        todo[front] = False
        while front:
            i = front.pop()
            for j in np.flatnonzero(near[i] & todo).tolist():
                if todo[j]:
                    own = np.flatnonzero(todo & (comp == comp[j]))
                    todo[own] = False
                    front += own.tolist()
                    if merged.join(int(comp[i]), int(comp[j])):
                        out.append((i, j))
    return out


def _block_products(percent: int):
    """Links between classes of different components that meet in a column. Of a block's pairs only a spanning forest leaves the task, and what a task has connected is not multiplied again."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("shingle", "ascending"), ("block", "ascending")])
        get = {c: table.column(c).to_numpy() for c in ("shingle", "block", "side", "cls", "n", "comp")}
        lists = {c: table.column(c).combine_chunks() for c in ("before", "ids", "weights")}

        def of(name: str, i: int) -> np.ndarray:
            return lists[name][i].values.to_numpy()

        new = np.ones(len(get["cls"]), bool)
        new[1:] = (get["shingle"][1:] != get["shingle"][:-1]) | (get["block"][1:] != get["block"][:-1])
        head = np.flatnonzero(new)
        merged, us, vs = _Merged(), [], []
        for a, b in zip(head.tolist(), np.append(head[1:], len(new)).tolist(), strict=True):
            at = np.arange(a, b)
            for again in (False, True):
                n, comp, side = get["n"][at], merged.roots(get["comp"][at]), get["side"][at]
                wanted = np.triu(comp[:, None] != comp[None, :], 1)
                wanted &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
                wanted &= (side[:, None] < 0) | (side[:, None] != side[None, :])
                if not wanted.any():
                    break
                if not again:
                    wanted &= _overlaps([of("before", i) for i in at], None) == 0
                    at = at[wanted.any(0) | wanted.any(1)]
                if len(at) < 2:
                    break
                if again:
                    both = _overlaps([of("ids", i) for i in at], [of("weights", i) for i in at])
                    near = wanted & (100 * both >= percent * (n[:, None] + n[None, :] - both))
                    cls = get["cls"][at]
                    for i, j in _forest(near, comp, merged):
                        us.append(min(int(cls[i]), int(cls[j])))
                        vs.append(max(int(cls[i]), int(cls[j])))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def _near_labels(links: DataFrame) -> DataFrame:
    """(node, label): the least class within two links of each other's reach. Equal labels are connected, which is all that the pruning needs; whole components come at the end."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    one = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    far = both.join(one.select(F.col("u").alias("v"), F.col("m").alias("far")), "v").groupBy("u").agg(F.min("far").alias("label"))
    return far.select(F.col("u").alias("node"), "label")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of classes whose whole sets reach the threshold."""
    a = sets.select(F.col("cls").alias("u"), F.col("shingles").alias("x"))
    b = sets.select(F.col("cls").alias("v"), F.col("shingles").alias("y"))
    both = pairs.select("u", "v").join(a, "u").join(b, "v").select("u", "v", "x", "y")
    return both.mapInArrow(_verified(percent), "u long, v long")


def class_links(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Links between classes of different sets that connect every component; classes: (digest, rep, n) of docs."""
    bits = bits_for(parts_of(docs, 32, 2))
    classes = classes.select(F.col("digest").alias("cls"), "rep", "n")
    # the partner of a set of n has percent * n at least, and its l may be the smaller one
    least = F.greatest(F.lit(1), F.floor((F.ceil(F.col("n") * percent / 100) - 1) * EXTRA / 100))
    blobs = docs.select("text").mapInArrow(_incidence(k, percent, bits, False), BLOB_SCHEMA)
    alive = bucketed(blobs, _shared_counts, "cls long, c long").groupBy("cls").agg(F.sum("c").alias("c"))
    alive = cut(alive.join(classes, "cls").where(F.col("c") >= least).select("cls", "n", "rep"), "alive")
    if alive.isEmpty():
        return None
    # what is left enters the blocks with whole sets: now a class needs percent of its own shingles to be shared
    need = F.ceil(F.col("n") * percent / 100)
    texts = cut(docs.select("doc_id", "text").join(small(alive.select(F.col("rep").alias("doc_id")), 16), "doc_id", "left_semi").select("text"), "texts")
    blobs = texts.mapInArrow(_incidence(k, percent, bits, True), BLOB_SCHEMA)
    columns = cut(bucketed(blobs, _shared_columns, "shingle long, cls long, weight long"), "columns")
    alive = columns.groupBy("cls").agg(F.sum("weight").alias("c")).join(alive.select("cls", "n"), "cls").where(F.col("c") >= need)
    live = columns.join(alive.select("cls", "n"), "cls")
    # equal columns of different blocks are merged as well: a column is known by two hashes of its classes
    same = live.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.first("weight").alias("w"), F.bit_xor(F.xxhash64("cls")).alias("a"), F.bit_xor(F.xxhash64("cls", F.lit(7))).alias("b"))
    merged = same.where("df > 1").groupBy("a", "b", "df").agg(F.min("shingle").alias("shingle"), F.sum("w").alias("w"))
    entries = cut(live.select("shingle", "cls", "n").join(merged.select("shingle", "df", "w"), "shingle"), "merged")
    # classes that still share enough among themselves; of these, the rarest columns that two similar sets cannot all miss
    alive = cut(entries.groupBy("cls").agg(F.sum("w").alias("c"), F.first("n").alias("n")).where(F.col("c") >= need), "alive")
    if alive.isEmpty():
        return None
    w = Window.partitionBy("cls").orderBy("df", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    entries = entries.join(alive.select("cls", "c"), "cls").withColumn("rare", F.coalesce(F.sum("w").over(w), F.lit(0)) <= F.col("c") - need)
    entries = cut(entries.select("shingle", "cls", "n", "w", "rare"), "entries")
    sets = cut(texts.mapInArrow(_whole_sets(k), "cls long, shingles binary").join(alive.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "sets")
    near = lambda: (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    links = None
    label = docs.sparkSession.createDataFrame([], "node long, label long")
    size, still_open = entries.where("rare").count(), None
    for turn in range(MOST_PIVOTS):
        # another pivot per column each time; a product only counts where it could connect two components
        now = entries.join(label, entries.cls == label.node, "left").select("shingle", "cls", "n", "w", "rare", F.coalesce("label", "cls").alias("comp"))
        now = cut(now, "labelled")
        # pivots go on while they close products: a group whose members are not similar to most others gains nothing from more of them
        had, still_open = still_open, _open_products(now) if turn else None
        if turn and (still_open <= 2 * size or had is not None and still_open > 0.9 * had):
            break
        piv = now.groupBy("shingle").agg(F.min(F.struct(F.xxhash64("cls", F.lit(turn)).alias("h"), "cls", "n", "comp")).alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        met = now.join(piv.select("shingle", "p"), "shingle").where("cls <> p.cls and comp <> p.comp")
        pairs = met.groupBy(F.col("cls").alias("u"), F.col("p.cls").alias("v")).agg(F.sum("w").alias("c"), F.first("n").alias("n"), F.first("p.n").alias("m"))
        # a pivot of some columns only sees part of the overlap, so half the bound is asked for here; the last product asks for nothing less than all
        pairs = pairs.where(near()).where(2 * F.col("c") * (100 + percent) >= percent * (F.col("n") + F.col("m")))
        found = cut(_links(pairs, sets, percent), "links")
        links = found if links is None else links.union(found)
        label = cut(_near_labels(links), "labels")
    else:
        now = entries.join(label, entries.cls == label.node, "left").select("shingle", "cls", "n", "w", "rare", F.coalesce("label", "cls").alias("comp"))
        now = cut(now, "labelled")
    open_columns = now.where("rare").groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("shingle", "df")
    left = now.where("rare").join(open_columns, "shingle").select("shingle", "df", "cls", "n", "comp")
    # each class carries its first columns in the order of all, so that a pair is made in the first column they share, not in each
    order = Window.partitionBy("cls").orderBy("df", "shingle")
    left = left.withColumn("at", F.row_number().over(order)).withColumn("before", F.collect_list("shingle").over(order.rowsBetween(-CARRIED, -1)))
    left = cut(left, "open")
    # of the open columns the products are taken block by block; each row brings all columns of its class, so overlaps are whole
    whole = entries.groupBy("cls").agg(F.collect_list("shingle").alias("ids"), F.collect_list("w").alias("weights"))
    blocks = F.ceil(F.col("df") / BLOCK_ROWS).cast("int")
    rows = left.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own")).alias("side")
    block = (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).cast("long").alias("block")
    rows = rows.select("shingle", block, side, "cls", "n", "comp", "before").join(whole, "cls")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("shingle", "block"), F.lit(1 << bits)).cast("int"))
    more = cut(rows.groupBy("part").applyInArrow(_block_products(percent), "u long, v long").distinct(), "links")
    return links.union(more)


def similarity_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_shingles, component_id). Shingles are k words `[^ \\t-\\r]+`, A-Z lower-cased; link: 100 * |intersection| >= percent * |union|."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(docs.mapInArrow(_document_rows(k), "doc_id long, n_shingles long, digest long"), "documents", keep=True)
    with scratch():
        found = rows.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"))
        classes = cut(found, "classes")
        links = class_links(docs, classes, k, percent)
        label = classes.select(F.col("digest").alias("node"), F.col("digest").alias("label")).limit(0) if links is None else components(links)
        member = cut(classes.join(label, classes.digest == label.node, "left").select("digest", "rep", "copies", F.coalesce("label", "digest").alias("comp")), "members")
        least = cut(member.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("size")), "least")
        named = cut(spread_join(member, least, "comp", "size").select("digest", "component_id", "copies"), "named", keep=True)
    whole = spread_join(rows.where("n_shingles > 0"), named, "digest", "copies").select("doc_id", "n_shingles", "component_id")
    return whole.union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
