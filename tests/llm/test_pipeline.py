"""The pipeline's stages one after the other, held against what each of them must do."""

import random
import re

import corpus_pipeline
from quadspark.llm.sentence_pieces import decode_ids
from quadspark.llm.shared import cut

from .helpers import edit_distance, jaccard_classes, prose


def test_stages(spark, tmp_path):
    near = prose(2, 100).split()
    near[50] = "other"
    docs = [(i, prose(100 + i, 60) + "\n" + prose(200 + i, 60), "en", "s", 0) for i in range(30)]
    docs += [(40, prose(2, 100), "en", "s", 0), (41, " ".join(near), "en", "s", 0), (42, docs[0][1], "en", "s", 0), (43, "123", "en", "s", 0), (44, None, None, None, None), (45, "start " + prose(300, 12) + " end", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(300, 12))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        now = cut(stage(spark, now, str(tmp_path)), name)
        left[name] = {r.doc_id: r for r in now.collect()}
        if name != "sentencepiece":
            assert now.columns == columns
    assert set(left["language_id"]) == set(range(30)) | {40, 41, 42, 45}
    assert set(left["line_dedup"]) == set(range(30)) | {40, 41, 45}
    assert set(left["ngram_jaccard_join"]) == set(range(30)) | {40, 45}
    assert left["benchmark_decontamination"][45].text == "start  end"
    assert left["benchmark_decontamination"][45].n_chars == len("start  end")
    last = left["sentencepiece"]
    assert set(last) == set(range(30)) | {40, 45}
    assert all(r.round_trip and len(r.ids) == r.n_pieces for r in last.values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(last)


def brute_force(docs, bench):
    """What stages two to four leave of docs (doc_id, text): doc_id -> text."""
    before, texts = [], {}
    for i, text in docs:
        kept, removed = [], 0
        for line in text.split("\n"):
            hit = bool(line.split()) and any(line == b or len(line) >= 30 and len(b) >= 30 and abs(len(line) - len(b)) <= 2 and edit_distance(line, b) <= 2 for b in before)
            if line.split():
                before.append(line)
            removed += hit
            if not hit:
                kept.append(line)
        if not removed or "".join(kept).strip():
            texts[i] = "\n".join(kept)
    groups = jaccard_classes(sorted(texts.items()), 5, 80)
    texts = {i: t for i, t in texts.items() if groups[i][1] == i}
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for b in bench:
        w = pattern.findall(b.lower())
        windows.update(tuple(w[a : a + 10]) for a in range(max(1, len(w) - 9)))
    out = {}
    for i, t in texts.items():
        words = list(pattern.finditer(t.lower()))
        hit = {k for n in {len(x) for x in windows} for a in range(len(words) - n + 1) if tuple(m.group() for m in words[a : a + n]) in windows for k in range(a, a + n)}
        at, parts = 0, []
        for k in sorted(hit):
            if k - 1 not in hit:
                parts.append(t[at : words[k].start()])
            at = words[k].end()
        out[i] = "".join([*parts, t[at:]])
    return out


def test_against_brute_force(spark, tmp_path):
    """All of run() on random documents that share lines, passages and whole texts, with columns of the operators' own names."""
    r = random.Random(6)
    common = [prose(500 + i, 8) for i in range(6)]
    docs = []
    for i in range(60):
        parts = [r.choice(common)[r.randint(0, 1) :] if r.random() < 0.3 else prose(600 + i * 9 + k, r.randint(1, 14)) for k in range(r.randint(1, 6))]
        if i % 7 == 3:
            parts = docs[i - 2][1].split("\n") + parts[:1]
        if i % 5 == 1:
            parts.append("so " + prose(700 + i % 3, 12) + " it")
        docs.append((i, "\n".join(parts)))
    bench = [prose(700 + i, 12) for i in range(3)]
    extra = "gone int, n_lines int, row int, whole string, score double, spans string, lang_pred string, ids string"
    rows = [(i, t, "en", "s", len(t), 1, 2, 3, "w", 0.5, "x", "y", "z") for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = cut(stage(spark, now, str(tmp_path)), name)
        assert now.columns == columns
        if name == "language_id":
            left = {x.doc_id: x.text for x in now.collect()}
            assert {x.doc_id for x in now.collect()} == {i for i, _ in docs}
    assert {x.doc_id: x.text for x in now.collect()} == brute_force(sorted(left.items()), bench)
    assert all((x.gone, x.n_lines, x.row, x.whole, x.score, x.spans, x.lang_pred, x.ids, x.n_chars) == (1, 2, 3, "w", 0.5, "x", "y", "z", len(x.text)) for x in now.collect())
    last = decode_ids(corpus_pipeline.run(spark, str(tmp_path)))
    assert {x.doc_id: x.text for x in last.collect()} == {x.doc_id: x.text for x in now.collect()}


def test_empty_tables_and_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    docs = [(1, prose(1, 40), "en", None, 0), (1, prose(2, 40), "en", None, 0), (None, prose(3, 40), "en", None, 0), (2, prose(2, 40), "en", None, 0), (3, prose(4, 20000), "en", "s", 0)]
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/odd/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/odd/benchmark.parquet")
    got = decode_ids(corpus_pipeline.run(spark, f"{tmp_path}/odd")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(d[0], d[1]) for d in docs if d[0] != 2], key=str)
