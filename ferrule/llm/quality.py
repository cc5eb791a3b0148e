"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Indicators of a text: byte pairs, hashed byte triples, four-grams of character classes, and the tenth in which the share
of its repeated three-word runs falls. They are scaled by the log ratio of their counts in the two classes and a linear
hinge-loss model is fitted to them by dual coordinate descent. A part of the sample that the descent does not see turns
margins into probabilities.

The model is fitted on a bounded sample of labelled rows (max_train, by the order of a hash of the id); scoring reads
every text whole, in the tasks that read it, and nothing is shuffled.

Defined results: a null or empty text is scored from its (few) indicators like any other; null ids are scored but never
learned from; labels with a null are skipped and of several labels for one id the lower counts; without labels, or with
one class only, the score is the share of good labels (0.5 if there are none); repeated rows get equal scores; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import CHUNK_BYTES, sequence_hashes, word_hashes

PAIRS, TRIPLES, CLASSES, TENTHS = 1 << 16, 1 << 16, 8**4, 12
SIZE = PAIRS + TRIPLES + CLASSES + TENTHS
#: The most labelled rows that a fit uses.
MAX_TRAIN = 6000
THRESHOLD = 0.7
_KIND = np.full(256, 5, np.uint32)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r")):
    _KIND[list(_chars)] = _k
_KIND[128:] = 6


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def indicators(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Sorted numbers of the indicators that each text has."""
    flags = np.zeros(SIZE, bool)
    for first, words, bounds in word_hashes(texts):
        runs = sequence_hashes(words, 3)
        for i in range(len(bounds) - 1):
            own = runs[bounds[i] : max(bounds[i], bounds[i + 1] - 2)]
            share = 0 if not len(own) else 1 + int(10 * (1 - len(np.unique(own)) / len(own)))
            text = texts[first + i]
            for at in range(0, len(text), CHUNK_BYTES):
                a = np.frombuffer(text[at : at + CHUNK_BYTES + 3], np.uint8).astype(np.uint32)
                flags[(a[:-1] << np.uint32(8)) | a[1:]] = True
                triple = a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA6B) + a[2:] * np.uint32(0xC2B2AE35)
                flags[PAIRS + (triple >> np.uint32(16))] = True
                k = _KIND[a]
                flags[PAIRS + TRIPLES + ((k[:-3] << np.uint32(9)) | (k[1:-2] << np.uint32(6)) | (k[2:-1] << np.uint32(3)) | k[3:])] = True
            flags[PAIRS + TRIPLES + CLASSES + share] = True
            found = np.flatnonzero(flags)
            flags[found] = False
            yield found.astype(np.uint32)


@dataclass
class Model:
    """Score = 1 / (1 + exp(-(slope * margin + bias))), margin = mean weight of a text's indicators times root of their number."""

    weights: np.ndarray
    offset: float
    slope: float
    bias: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum() / np.sqrt(max(1, len(found)))) + self.offset

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.bias, -30, 30))))


def descend(rows: list[np.ndarray], good: np.ndarray, scale: np.ndarray, cost: float = 1.0, epochs: int = 12) -> tuple[np.ndarray, float]:
    """Weights and offset that minimise half the squared norm plus cost times the hinge losses, by dual coordinate descent."""
    weights, offset = np.zeros(SIZE), 0.0
    signs = np.where(good, 1.0, -1.0)
    values = [scale[r] / np.sqrt(max(1, len(r))) for r in rows]
    norms = [float(v @ v) + 1.0 for v in values]
    duals = np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            slack = signs[i] * (float(weights[rows[i]] @ values[i]) + offset) - 1
            new = min(max(duals[i] - slack / norms[i], 0.0), cost)
            if step := (new - duals[i]) * signs[i]:
                weights[rows[i]] += step * values[i]
                offset += step
                moved = max(moved, abs(step))
                duals[i] = new
        if moved < 1e-3:
            break
    return weights, offset


def fit_rows(rows: list[np.ndarray], good: np.ndarray) -> Model:
    """Fit on indicator lists; every fifth row sets the probabilities instead of the weights."""
    if not len(good) or good.all() or not good.any():
        share = float(good.mean()) if len(good) else 0.5
        odds = np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))
        return Model(np.zeros(SIZE), 0.0, 0.0, float(odds))
    late = np.arange(len(rows)) % 5 == 4
    if not (good[late].any() and (~good[late]).any() and good[~late].any() and (~good[~late]).any()):
        late[:] = False
    learn = np.flatnonzero(~late)
    counts = np.ones((2, SIZE))
    for i in learn:
        counts[int(good[i])][rows[i]] += 1
    seen = counts.sum(axis=0) >= 5
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio *= seen
    inner, offset = descend([rows[i] for i in learn], good[learn], ratio)
    model = Model(inner * ratio, offset, 1.0, 0.0)
    check = np.flatnonzero(late) if late.any() else learn
    x = np.array([model.margin(rows[i]) for i in check])
    y = np.where(good[check], 1 - 1 / (good[check].sum() + 2), 1 / ((~good[check]).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method on the two numbers of the logistic curve
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, w = p - y, p * (1 - p) + 1e-9
        hessian = np.array([[(w * x * x).sum() + 1e-6, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        da, db = np.linalg.solve(hessian, [(g * x).sum(), g.sum()])
        a, b = a - float(np.clip(da, -5, 5)), b - float(np.clip(db, -5, 5))
        if abs(da) + abs(db) < 1e-9:
            break
    return Model(model.weights, offset, a, b)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [x.tobytes() for x in indicators(batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.binary())], ["doc_id", "quality", "found"])


def _raw(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw")


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on at most max_train labelled rows that are not held out."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("long").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _raw()).join(F.broadcast(picked), "doc_id")
    rows = rows.select("doc_id", "quality", "raw").mapInArrow(_found, "doc_id long, quality long, found binary")
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "found").limit(max_train).toArrow()
    lists = [np.frombuffer(x, np.uint32) for x in got.column("found").to_pylist()]
    return fit_rows(lists, np.array(got.column("quality").to_pylist(), int) == 1)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (a probability of good quality) and predicted (1 if score >= threshold, else 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(x) for x in indicators(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", _raw()).mapInArrow(score, f"doc_id {kind}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with held_out, score and predicted."""
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier does not reject; scored in place, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]  # as texts may be invalid UTF-8
            yield batch.filter(pa.array([shared.value.score(x) >= threshold for x in indicators(raw)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
