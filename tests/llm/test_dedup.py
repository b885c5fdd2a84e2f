"""Near duplicates, repeated passages and lines against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from quadspark.llm import jaccard_join, kernel, line_dedup, substring_dedup
from quadspark.llm.components import components

from .helpers import corpus, edit_distance, jaccard_classes, prose, repeated_words

SCHEMA = "doc_id long, text string"


def frame(spark, docs):
    """With extra columns whose names operators use themselves."""
    return spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA + ", places string, n long")


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, k, percent):
    docs = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similarity_components(frame(spark, docs), k, percent).collect()}
    assert got == jaccard_classes(docs, k, percent)


def test_jaccard_chain_of_near_copies(spark):
    """A chain in which only neighbours are similar is one component."""
    words = prose(11, 100).split()
    docs = []
    for i in range(12):
        docs.append((i, " ".join(words)))
        words[5 + 7 * i] = f"new{i}"
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similarity_components(frame(spark, docs), 4, 85).collect()}
    assert got == jaccard_classes(docs, 4, 85)


def test_jaccard_empty(spark):
    assert jaccard_join.similarity_components(frame(spark, [])).collect() == []
    assert [tuple(r) for r in jaccard_join.similarity_components(frame(spark, [(4, None)])).collect()] == [(4, 0, 4)]


@pytest.mark.parametrize(("size", "m"), [(35, 8), (5, 2)])
def test_substring_dedup(spark, size, m):
    docs = corpus()
    want = repeated_words(docs, size)
    rows = substring_dedup.remove_repeats(frame(spark, docs), size, m, with_text=True).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256, r.kept) == (n, gone, hashlib.sha256(kept).hexdigest(), kept.decode())


def test_substring_dedup_empty(spark):
    assert substring_dedup.remove_repeats(frame(spark, [])).collect() == []


def test_banded_edit_distance():
    r = random.Random(3)
    xs, ys = [], []
    for _ in range(400):
        a = "".join(r.choice("abcé") for _ in range(r.randint(0, 20)))
        b = list(a)
        for _ in range(r.randint(0, 4)):
            b[r.randint(0, len(b)) : r.randint(0, len(b))] = r.choice("abcé")
        xs.append(a)
        ys.append("".join(b))
    for t in (1, 2, 3):
        assert (line_dedup.within(xs, ys, t) == np.array([edit_distance(a, b) <= t for a, b in zip(xs, ys, strict=True)])).all()


def test_line_dedup(spark):
    lines = [prose(20 + i, 6 + i % 5) for i in range(12)]
    near = [x[:10] + "Q" + x[11:] for x in lines[:4]] + [x[:5] + x[7:] for x in lines[4:8]]
    far = ["ZZZ" + x for x in lines[8:10]]
    docs = [(1, "\n".join(lines)), (2, "\n".join(near + far)), (3, None), (4, ""), (5, "\n \n\n"), (6, "short\nshort\nshorT\n"), (7, "\n".join(lines)), (8, lines[0] + "\n")]
    before, want = [], {}
    for i, text in docs:
        kept = []
        for line in (text or "").split("\n"):
            hit = line.strip(" \t\r\x0b\x0c") and any(line == b or len(line) >= 30 and len(b) >= 30 and edit_distance(line, b) <= 2 for b in before)
            if line.split():
                before.append(line)
            if not hit:
                kept.append(line)
        want[i] = hashlib.sha256("\n".join(kept).encode()).hexdigest()
    got = {r.doc_id: r.kept_sha256 for r in line_dedup.report(frame(spark, docs)).collect()}
    assert got == want
    assert line_dedup.report(frame(spark, [])).collect() == []
    kept = line_dedup.dedup_lines(spark.createDataFrame([(1, "a b c", "x"), (2, "a b c", "y")], "doc_id long, text string, source string")).orderBy("doc_id").collect()
    assert [(r.text, r.source, r.n_removed) for r in kept] == [("a b c", "x", 0), ("", "y", 1)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(1, 31), 1), 90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("block", [2048, 8])
def test_jaccard_dense_group(spark, monkeypatch, block):
    """Copies with many different edits, of which only some are similar enough, whole and block by block."""
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(jaccard_join, "MOST_PIVOTS", 1)
    r = random.Random(5)
    base = prose(31, 120).split()
    docs = []
    for i in range(40):
        words = list(base)
        for _ in range(r.randint(1, 4)):
            words[r.randrange(len(words))] = f"edit{r.randint(0, 9)}"
        docs.append((i, " ".join(words)))
    want = jaccard_classes(docs, 4, 85)
    assert 1 < len({c for _, c in want.values()}) < 40
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.similarity_components(frame(spark, docs), 4, 85).collect()}
    assert got == want


@pytest.mark.parametrize("block", [4096, 3])
def test_line_groups_in_blocks(spark, monkeypatch, block):
    """Many variants of one line, whole and block by block."""
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", block)
    base = prose(41, 8)
    lines = [base[: 3 * i] + "#" * (i % 4) + base[3 * i :] for i in range(14)]
    docs = [(i, x) for i, x in enumerate(lines)]
    want = {i: int(any(x == y or edit_distance(x, y) <= 2 for y in lines[:i])) for i, x in docs}
    got = {x.doc_id: x.n_removed for x in line_dedup.report(frame(spark, docs)).collect()}
    assert got == want


def test_jaccard_blocks_send_a_forest(spark):
    """Of a dense block only a spanning forest of its pairs leaves the task."""
    r = random.Random(8)
    n = 300
    lists = [sorted(r.sample(range(1000), 6)) + list(range(1000, 1060)) for _ in range(n)]
    comp = [i - i % 3 for i in range(n)]
    one = {"shingle": [1] * n, "block": [0] * n, "side": [-1] * n, "cls": list(range(n)), "n": [66] * n, "comp": comp, "before": [[]] * n, "ids": lists, "weights": [[1] * 66] * n}
    # the same classes meet again in a second column: nothing is left to connect
    table = pa.table({k: v + ([2] * n if k == "shingle" else v) for k, v in one.items()} | {"before": pa.array([[]] * (2 * n), pa.list_(pa.int64()))})
    got = jaccard_join._block_products(80)(table)
    assert 0 < got.num_rows <= len(set(comp)) - 1
    parent = {c: c for c in comp}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for u, v in zip(got["u"].to_pylist(), got["v"].to_pylist(), strict=True):
        both = len(set(lists[u]) & set(lists[v]))
        assert 100 * both >= 80 * (132 - both) and find(comp[u]) != find(comp[v])
        parent[find(comp[u])] = find(comp[v])
    assert len({find(c) for c in comp}) == 1


def test_lines_of_repeated_ids_and_clashing_columns(spark):
    """Rows of one doc_id do not lose each other's lines, null ids stay, columns of any name are kept or replaced."""
    y = "y line that both of them have"
    docs = [(0, y, 1), (1, "a\n" + y, 2), (1, y + "\nb", 3), (2, "same row", 4), (2, "same row", 4), (None, y, 5), (None, None, 6)]
    df = spark.createDataFrame([(*d, "g", 7, 8, 9) for d in docs], "doc_id long, text string, line int, gone string, n_lines long, row int, number int")
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "line", "gone", "row", "number", "n_lines", "n_removed"]
    rows = sorted(((r.line, r.text, r.n_removed) for r in got.collect()), key=str)
    assert rows == [(1, y, 0), (2, "a", 1), (3, "b", 1), (4, "", 1), (4, "same row", 0), (5, y, 0), (6, "", 0)]
    assert sorted((r.n_lines, r.n_removed) for r in line_dedup.report(df).collect()) == sorted([(1, 0), (2, 1), (2, 1), (1, 1), (1, 0), (1, 0), (0, 0)])


def test_distant_lines_of_a_group_need_little(spark):
    """A group of thousands of lines that share a third but are far apart is settled without its pairs in memory."""
    r = random.Random(2)
    texts = [("#" * 14) + "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(28)) for _ in range(1500)]
    texts.append(texts[700][:-1] + "!")
    n = len(texts)
    table = pa.table({"group": [1] * n, "block": [0] * n, "side": [-1] * n, "line": list(range(n)), "row": list(range(n)), "number": [0] * n, "text": texts})
    assert line_dedup._late(2)(table)["line"].to_pylist() == [n - 1]


@pytest.mark.parametrize("frequent", [1000, 2])
def test_substring_dedup_of_frequent_passages(spark, monkeypatch, frequent):
    """Repeated and null ids are rows of their own; a passage of many documents, whose minimisers are dealt by window, and a text that repeats itself."""
    monkeypatch.setattr(substring_dedup, "FREQUENT", frequent)
    shared = prose(70, 25)
    docs = [(i // 2, prose(100 + i, 20 + i) + " " + shared + " " + prose(200 + i, 10)) for i in range(40)]
    docs += [(None, prose(80, 30)), (90, prose(80, 30)), (None, prose(81, 30)), (91, shared + " x " + shared), (91, prose(100, 60)), (92, "y " * 30), (1, prose(5, 200)), (1, prose(5, 40))]
    want = repeated_words(list(enumerate(t for _, t in docs)), 10)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    hot = []
    find = substring_dedup._frequent
    monkeypatch.setattr(substring_dedup, "_frequent", lambda again: hot.append(find(again)) or hot[0])
    rows = substring_dedup.remove_repeats(df, 10, 4).collect()
    w = kernel.Words(*kernel.buffers(pa.array([shared])), kernel.SPACE_SEPARATED)
    common = kernel.sliding_min(kernel.windows(w.hashes(), 4), 7)
    assert len(hot[0]) == 0 if frequent == 1000 else set(common.tolist()) <= set(hot[0].tolist())
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows), key=key) == sorted(((docs[i][0], n, gone, hashlib.sha256(kept).hexdigest()) for i, (n, gone, kept) in want.items()), key=key)
