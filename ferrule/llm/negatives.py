"""Hard-negative mining by segment summaries.

A vector is cut into 1, 2, 4 and 8 segments, and each segment's mean and deviation are stored beside it. For a segment of n
components with means a, b and deviations s, t the inner product lies within n * (a * b - s * t) and n * (a * b + s * t). A
search adds these up over all segments of a level, drops the pairs whose bounds exclude them, and goes on to the next level
with the rest; what is left is scored exactly. What excludes a pair is the window of scores that is asked for and the worst of
the best rows so far.

Anchors are a stated query set. They are taken in blocks of at most BLOCK_BYTES; each block is broadcast and meets all rows,
which stream through the tasks and are not shuffled. A task gives back its best rows for each question, and a ranking with a
partial step merges those of all tasks. So rows of a hot label lie in as many tasks as there are partitions.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. A component x counts as
floor(256 * x). Rows of an anchor's vec_id are the anchor itself and never its partners; rows that share another vec_id each
count. A vector of another length than the anchor's has no score with it; empty vectors score 0. Scores beyond the range of a
long are cut to its ends. Ties go to the smaller vec_id. An empty table, or one without anchors, gives no rows. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.llm.common import written
from ferrule.operators.ordering import numbered

LEVELS = (1, 2, 4, 8)
#: Bytes of anchors that are broadcast at once, and pairs that a task looks at together.
BLOCK_BYTES, PAIRS = 16 << 20, 1 << 20
LONG = np.iinfo(np.int64)


def _cuts(length: int, segments: int) -> np.ndarray:
    return np.linspace(0, length, min(segments, max(length, 1)) + 1).astype(int)


def _summaries(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level (means, deviations) of the segments, both times the root of the segment's length."""
    out = []
    for segments in LEVELS:
        cuts = _cuts(x.shape[1], segments)
        if not x.shape[1]:
            out.append((np.zeros((len(x), 1)),) * 2)
            continue
        n = np.diff(cuts)
        mean = np.add.reduceat(x, cuts[:-1], axis=1) / n
        dev = np.sqrt(np.add.reduceat((x - np.repeat(mean, n, axis=1)) ** 2, cuts[:-1], axis=1) / n)
        out.append((mean * np.sqrt(n), dev * np.sqrt(n)))
    return out


def index(rows: DataFrame) -> DataFrame:
    """vec_id, label, units (whole numbers), means and devs (of all levels) of the rows that take part; stored."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes, flat = np.asarray(lists.value_lengths()), np.floor(256 * np.asarray(lists.flatten()))
            starts = np.cumsum(sizes) - sizes
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                x = flat[starts[at][:, None] + np.arange(n)]
                levels = _summaries(x)
                parts = [x, np.hstack([m for m, _ in levels]), np.hstack([d for _, d in levels])]
                columns = [pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32) if p.shape[1] else np.zeros(len(p) + 1, np.int32), p.ravel()) for p in parts]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), *columns], ["vec_id", "label", "units", "means", "devs"])

    kept = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(finite)
    return written(kept.mapInArrow(summed, "vec_id long, label long, units array<double>, means array<double>, devs array<double>"), "segments")


def _matrix(lists: pa.Array, n: int) -> np.ndarray:
    return np.asarray(lists.flatten(), np.float64).reshape(len(lists), n)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(ids, labels, units, summaries) of the rows of each vector length."""
    lengths = np.asarray(batch.column("units").value_lengths())
    for n in np.unique(lengths):
        rows = batch.take(pa.array(np.flatnonzero(lengths == n)))
        widths = [len(_cuts(n, s)) - 1 for s in LEVELS]
        edges = np.cumsum(widths)[:-1]
        means, devs = (np.split(_matrix(rows.column(c), sum(widths)), edges, axis=1) for c in ("means", "devs"))
        yield np.asarray(rows.column("vec_id")), np.asarray(rows.column("label")), _matrix(rows.column("units"), n), list(zip(means, devs, strict=True))


def _exact(x: np.ndarray, q: np.ndarray, r: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (row r of x, row a of q) as longs."""
    most = np.sqrt((x * x).sum(1).max(initial=0)) * np.sqrt((q * q).sum(1).max(initial=0))
    if not most < 2.0**53:  # doubles would round
        scores = [sum(int(i) * int(j) for i, j in zip(x[i], q[j], strict=True)) for i, j in zip(r, a, strict=True)]
        return np.array([min(max(s, LONG.min), LONG.max) for s in scores], np.int64)
    if len(r) > 0.1 * len(x) * len(q):
        return (x @ q.T)[r, a].astype(np.int64)
    return np.concatenate([np.einsum("ij,ij->i", x[r[i : i + 65536]], q[a[i : i + 65536]]) for i in range(0, len(r), 65536)] or [np.zeros(0)]).astype(np.int64)


class Questions:
    """Vectors with label and id, each with windows [low, high] of scores: the best k rows of each window are asked for."""

    def __init__(self, batch: pa.RecordBatch, windows: list[list[tuple[int, int]]], same: bool, k: int) -> None:
        self.same, self.k, self.groups = same, k, []
        lengths = np.asarray(batch.column("units").value_lengths())
        self.first = np.cumsum([0] + [len(w) for w in windows])
        for n in np.unique(lengths):
            place = np.flatnonzero(lengths == n)
            place = place[[len(windows[p]) > 0 for p in place]]
            if not len(place):
                continue
            (ids, labels, units, summaries), *_ = _by_length(batch.take(pa.array(place)))
            counts = np.array([len(windows[p]) for p in place])
            owner = np.repeat(np.arange(len(place)), counts)
            low, high = (np.array([w[i] for p in place for w in windows[p]], np.int64) for i in (0, 1))
            number = np.concatenate([np.arange(self.first[p], self.first[p + 1]) for p in place])
            self.groups.append((n, ids, labels, units, summaries, counts, owner, low, high, number))

    def best(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """window, score and vec_id of the best k rows of each window among batches."""
        found = [(np.zeros(0, np.int64),) * 3 for _ in self.groups]  # window within the group, score, id
        seen = 0
        for batch in batches:
            done = 0
            while done < batch.num_rows:  # few rows first, so that there is something to beat
                most = max(16, PAIRS // max([1, *(len(g[1]) for g in self.groups)]))
                rows = batch.slice(done, min(most, max(16, seen)))
                done, seen = done + rows.num_rows, seen + rows.num_rows
                for x in _by_length(rows):
                    for i, g in enumerate(self.groups):
                        if g[0] == x[2].shape[1]:
                            found[i] = self._met(x, g, found[i])
        for g, (w, score, ids) in zip(self.groups, found, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(g[9][w]), pa.array(score), pa.array(ids)], ["win", "score", "vec_id"])

    def _met(self, rows: tuple, group: tuple, found: tuple) -> tuple:
        ids, labels, x, mine = rows
        _, anchor_ids, anchor_labels, q, theirs, counts, owner, low, high, _ = group
        w, score, vec = found
        worst = np.full(len(owner), LONG.min)  # of the best k so far, where there are k
        n = np.bincount(w, minlength=len(owner))
        ends = np.cumsum(n)[n == self.k] - 1
        worst[n == self.k] = score[ends]
        need = np.maximum(low, worst)
        starts = np.cumsum(counts) - counts
        least, most = np.minimum.reduceat(need, starts).astype(float), np.maximum.reduceat(high, starts).astype(float)
        slack = 1e-9 * np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum(1).max()) + 1e-3  # of rounding
        alike = labels[:, None] == anchor_labels
        left = (alike if self.same else ~alike) & (ids[:, None] != anchor_ids)
        r, a = np.nonzero(left)
        for (mx, dx), (mq, dq) in zip(mine, theirs, strict=True):
            if len(r) > 0.1 * left.size:
                middle, wide = (mx @ mq.T)[r, a], (dx @ dq.T)[r, a]
            else:
                middle, wide = np.einsum("ij,ij->i", mx[r], mq[a]), np.einsum("ij,ij->i", dx[r], dq[a])
            wide += slack[r]
            keep = (middle + wide >= least[a]) & (middle - wide <= most[a])
            r, a = r[keep], a[keep]
        exact = _exact(x, q, r, a)
        for j in range(counts.max(initial=0)):  # the j-th window of each anchor
            win = starts[a] + j
            ok = j < counts[a]
            ok[ok] = (exact[ok] >= need[win[ok]]) & (exact[ok] <= high[win[ok]])
            w, score, vec = np.concatenate((w, win[ok])), np.concatenate((score, exact[ok])), np.concatenate((vec, ids[r[ok]]))
        order = np.lexsort((vec, ~score, w))  # ~ turns the order of whole numbers round
        w, score, vec = w[order], score[order], vec[order]
        new = np.concatenate(([True], w[1:] != w[:-1])) if len(w) else np.zeros(0, bool)
        place = np.arange(len(w)) - np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
        top = place < self.k
        return w[top], score[top], vec[top]


def _best(rows: DataFrame, questions: Questions, name: str) -> DataFrame:
    """win, rank (from 1), vec_id and score of the best rows over all tasks; stored."""
    each = rows.mapInArrow(questions.best, "win long, score long, vec_id long")
    rank = F.row_number().over(Window.partitionBy("win").orderBy(F.desc("score"), "vec_id"))
    return written(each.withColumn("rank", rank).where(F.col("rank") <= questions.k), name)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, percent: tuple[int, int] = (30, 90), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    An anchor's positives are its best rows of the same label. For each of them the best rows of other labels are given whose
    score is between percent[0] and percent[1] hundredths of the positive's.
    """
    spark, indexed = rows.sparkSession, index(rows)
    anchors = numbered(indexed.where(is_anchor), [], ["vec_id", "label"])
    last, longest = anchors.agg(F.max("number"), F.max(F.size("units"))).first()
    each = max(1, block_bytes // (8 * (2 * (longest or 0) + 64)))
    anchors = written(anchors.withColumn("block", F.expr(f"number div {each}")), "anchors")
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for block in range(0 if last is None else last // each + 1):
        asked = anchors.where(F.col("block") == block).orderBy("number").toArrow().combine_chunks()
        asked = asked.to_batches()[0]
        ids = asked.column("vec_id").to_pylist()
        first = Questions(asked, [[(int(LONG.min), int(LONG.max))]] * len(ids), True, positives)
        best = sorted((r["win"], r["rank"], r["vec_id"], r["score"]) for r in _best(indexed, first, "positives").collect())  # at most `positives` an anchor
        windows: list[list[tuple[int, int]]] = [[] for _ in ids]
        for win, _, _, score in best:
            windows[win].append((max(-(-percent[0] * score // 100), int(LONG.min)), min(percent[1] * score // 100, int(LONG.max))))
        pairs = [(i, ids[win], vec_id, score) for i, (win, _, vec_id, score) in enumerate(best)]
        found = _best(indexed, Questions(asked, windows, False, negatives), "negatives")
        pairs = spark.createDataFrame(pairs, "win long, anchor_id long, positive_id long, positive_score long")
        found = found.join(pairs, "win").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = out.union(found)
    return out
