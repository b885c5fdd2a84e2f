"""Language identification by a string kernel.

The kernel of two texts is the blended-spectrum presence kernel: the number of
n-grams (1 to 3 bytes of the lower-cased UTF-8 text) present in both, divided by the root of the
product of their numbers. Nyström: the kernel to `landmarks` texts of the
training sample, whitened by their own kernel matrix, is a text's feature vector;
one-versus-rest ridge regression on it gives a score per language. Scoring a
batch is a product of its presence matrix with the landmarks' and one
with the folded weights.

The model is fitted on the driver from a sample of at most about `per_label`
texts of each language (a documented bound), chosen by a hash of doc_id. There is no
other bound: sampled texts are whole, however long and in however many languages. What reaches the driver is
each text's set of n-grams, made where the text lies and of 32 KB at most, so it holds per_label * 32 KB
a language at most. Scoring covers every whole text of every row.

Defined results: null text or a text without a letter -> `und`, score 0. With
no labelled text everything is `und`. Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import bounded_batches

PER_LABEL = 300
LANDMARKS = 192
RIDGE = 1e-3
_SLOTS = 1 << 18


def _grams(data: np.ndarray, offsets: np.ndarray):
    """For n = 1, 2, 3: (slot of each n-gram, row of each n-gram); n-grams do not cross rows."""
    low = K.LOWER[data].astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    code = low.copy()
    yield code, row
    for n in (2, 3):
        code = (code[:-1] << 8) | low[n - 1 :]
        ok = row[: len(code)] == row[n - 1 :]
        slot = 256 + ((code * 0x9E3779B1) >> 7) % (_SLOTS - 256)
        yield slot[ok], row[: len(code)][ok]


def gram_set(data: np.ndarray) -> bytes:
    """The slots of one text's n-grams: as numbers, or as a bitmap where that is smaller."""
    seen = np.zeros(_SLOTS, bool)
    for part, ends in _slices(data):
        for slot, _ in _grams(part, ends):
            seen[slot] = True
    slots = np.flatnonzero(seen).astype(np.uint32)
    return slots.tobytes() if 4 * len(slots) < _SLOTS // 8 else np.packbits(seen).tobytes()


def _slices(data: np.ndarray):
    """A text in slices that overlap by two bytes, so that each of its n-grams lies in one."""
    for i in range(0, max(1, len(data) - 2), K.CHUNK_BYTES):
        part = data[i : i + K.CHUNK_BYTES + 2]
        yield part, np.array([0, len(part)])


def slots_of(grams: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(grams, np.uint8))) if len(grams) == _SLOTS // 8 else np.frombuffer(grams, np.uint32).astype(np.int64)


class Model:
    """Fitted on (n-gram set, label) pairs; plain arrays only, so that it can be broadcast."""

    def __init__(self, grams: list[bytes], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.labels = sorted(set(labels))
        n = len(grams)
        spread = np.linspace(0, n - 1, min(landmarks, n)).astype(int) if n else np.empty(0, int)
        by_label = sorted(range(n), key=lambda i: labels[i])
        marks = [by_label[i] for i in spread]
        known = np.unique(np.concatenate([np.empty(0, np.int64), *(slots_of(grams[i]) for i in marks)]))
        self.width = len(known)
        self.column = np.full(_SLOTS, self.width, np.int32)
        self.column[known] = np.arange(self.width)
        self.weights = np.zeros((0, max(1, len(self.labels))), np.float32)
        x = self._features([grams[i] for i in marks])
        self.marks = x / np.sqrt(np.maximum(1, x.sum(1)))[:, None]
        if not n:
            return
        kernel = self.marks.astype(np.float64) @ self.marks.T.astype(np.float64)
        value, vector = np.linalg.eigh(kernel)
        keep = value > 1e-6 * value.max()
        whiten = vector[:, keep] / np.sqrt(value[keep])
        rows = [kernel_to(self._features(grams[i : i + 256]), self.marks) for i in range(0, n, 256)]
        phi = np.concatenate(rows).astype(np.float64) @ whiten
        phi = np.hstack([phi, np.ones((n, 1))])
        target = np.array([[1.0 if y == k else 0.0 for k in self.labels] for y in labels])
        count = target.sum(0)
        weight = (target / count).sum(1) * n / len(self.labels)  # languages weigh alike
        a = phi.T @ (phi * weight[:, None]) + ridge * n * np.eye(phi.shape[1])
        beta = np.linalg.solve(a, phi.T @ (target * weight[:, None]))
        self.weights, self.bias = (whiten @ beta[:-1]).astype(np.float32), beta[-1].astype(np.float32)

    def _features(self, grams: list[bytes]) -> np.ndarray:
        x = np.zeros((len(grams), self.width + 1), np.float32)
        for row, g in zip(x, grams, strict=True):
            row[self.column[slots_of(g)]] = 1
        return x[:, : self.width]


def presence(data: np.ndarray, offsets: np.ndarray, column: np.ndarray, width: int) -> np.ndarray:
    """Presence matrix over the model's n-grams; column: slot -> column, or `width` if the model lacks it."""
    x = np.zeros((len(offsets) - 1, width + 1), np.float32)
    flat = x.reshape(-1)
    for slot, row in _grams(data, offsets):
        flat[row * (width + 1) + column[slot]] = 1
    return x[:, :width]


def kernel_to(x: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Normalised kernel of presence rows to the landmarks, as one matrix product."""
    return (x @ marks.T) / np.sqrt(np.maximum(1, x.sum(1)))[:, None]


def _score(model, keep: list[str]):
    def run(batches):
        m = model.value
        labels = np.array([*m["labels"]], object)
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            texts = batch.column("text")
            letter = np.array([any(map(str.isalpha, t)) if (t := v.as_py()) else False for v in texts], bool)
            pred = np.full(batch.num_rows, "und", object)
            score = np.zeros(batch.num_rows)
            for i, j in K.chunks(offsets) if len(labels) else ():
                for a in range(i, j, 128):
                    b = min(j, a + 128)
                    x = presence(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], m["column"], m["width"])
                    y = kernel_to(x, m["marks"]) @ m["weights"] + m["bias"]
                    pred[a:b] = labels[y.argmax(1)]
                    score[a:b] = np.clip(y.max(1), 0, 1)
            pred[~letter], score[~letter] = "und", 0.0
            out = [batch.column(c) for c in keep] + [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            yield pa.record_batch(out, names=[*keep, "lang_pred", "score"])

    return run


def chosen(labelled: DataFrame, per_label: int) -> DataFrame | None:
    """(key, doc_id, text, lang) of about per_label rows of each label at most: those of the least hashes of doc_id."""
    key = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.lit(1 << 30))
    n = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not n:
        return None
    rows = labelled.withColumn("key", key)
    limit = F.lit(0)
    for lang, c in sorted(n.items()):
        limit = F.when(F.col("lang") == lang, F.lit(int(min(1.0, per_label / c) * (1 << 30)))).otherwise(limit)
    return rows.where(F.col("key") < limit).select("key", "doc_id", "text", "lang")


def sample(labelled: DataFrame, per_label: int = PER_LABEL) -> list[tuple[str, str]]:
    """The sampled (text, label) rows themselves, least hashes of doc_id first; whole texts."""
    taken = chosen(labelled, per_label)
    return [] if taken is None else [(r["text"], r["lang"]) for r in sorted(taken.toLocalIterator(), key=lambda r: (r["key"], str(r["doc_id"])))]


def _gram_sets(batches):
    for batch in batches:
        data, offsets = K.buffers(batch.column("text"))
        sets = [gram_set(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.record_batch([batch.column("key"), batch.column("doc_id"), batch.column("lang"), pa.array(sets, pa.binary())], names=["key", "doc_id", "lang", "grams"])


def fit(labelled: DataFrame, per_label: int = PER_LABEL, landmarks: int = LANDMARKS):
    """labelled(doc_id, text, lang) -> broadcast model; only text and lang are learnt from."""
    bounded_batches(labelled.sparkSession)
    slim = labelled.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    taken = chosen(slim, per_label)
    rows = [] if taken is None else taken.mapInArrow(_gram_sets, "key long, doc_id string, lang string, grams binary").collect()
    rows = sorted(rows, key=lambda r: (r["key"], str(r["doc_id"]), r["grams"]))
    model = vars(Model([bytes(r["grams"]) for r in rows], [r["lang"] for r in rows], landmarks))
    return labelled.sparkSession.sparkContext.broadcast(model)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def identify(docs: DataFrame, model, keep: list[str]) -> DataFrame:
    """Columns `keep` of docs with lang_pred and score of every whole text."""
    bounded_batches(docs.sparkSession)
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.withColumn("text", F.col("text").cast("string")).mapInArrow(_score(model, keep), f"{schema}, lang_pred string, score double")


def predict(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from rows that are not held out, predicts all."""
    model = fit(docs.where(~F.coalesce(held_out(), F.lit(True))))
    return identify(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])
