"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased runs of letters and digits. Each fixed mask hashes some positions of a run and ignores the others,
so a substituted word spoils few seeds. The seeds of the benchmark are joined with those of all texts, and around each hit
the two word sequences are laid over each other: an item is found if some run of WINDOW aligned words (of the whole item,
if it is shorter) agrees in at least four fifths of its words.

MASKS find every such run with up to two wrong words (tested exhaustively); items of five to seven
words may have one wrong word and are also hashed whole with each position left out, shorter ones are found exactly only, as
four fifths of them are all their words. The benchmark is joined in blocks of at most BLOCK_ITEMS items, each
read by the tasks that read the texts; texts are never shuffled, and more items mean more blocks.

Defined results: a null or empty text has no items, a null or empty item is in no text; rows with equal texts get equal
results; item ids come sorted and without repeats; an empty table on either side means nothing is found; extra columns are
ignored, and a filtering keeps them.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import FACTORS, mix, word_hashes

# 1 is a position that is hashed, 0 one that is ignored.
MASKS = ["11111", "111011", "11010011"]
WINDOW = 13
PERCENT = 80
BLOCK_ITEMS = 20_000
_BITS = 22


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the mask laid on each position."""
    if len(words) < len(mask):
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - len(mask) + 1, len(mask), np.uint64)
    for j in (j for j, c in enumerate(mask) if c == "1"):
        out += words[j : len(words) - len(mask) + 1 + j] * FACTORS[j]
    return mix(out)


def masks(size: int) -> list[str]:
    """The masks that find every run of an item of this many words that agrees well enough."""
    if size >= 8:
        return MASKS
    whole = "1" * size
    return [whole] * (size > 0) + [whole[:j] + "0" + whole[j + 1 :] for j in range(size)] * (100 * (size - 1) >= PERCENT * size)


def overlaps(doc: np.ndarray, item: np.ndarray, shift: int, window: int = WINDOW, percent: int = PERCENT) -> bool:
    """Whether item, laid over doc from word shift on, has a window that agrees well enough."""
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    size = min(window, len(item))
    if b - a < size:
        return False
    same = np.concatenate(([0], np.cumsum(doc[a + shift : b + shift] == item[a:b])))
    return bool((100 * (same[size:] - same[:-size])).max() >= percent * size)


class Matcher:
    """Seeds of a block of items; find() tells for each text which items it holds."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        raw = [text.lower().encode() for _, text in items]
        self.items = [(items[first + i][0], words[bounds[i] : bounds[i + 1]]) for first, words, bounds in word_hashes(raw, bare=True) for i in range(len(bounds) - 1)]
        self.tables = []
        by_mask = defaultdict(list)
        for i, (_, words) in enumerate(self.items):
            for mask in masks(len(words)):
                by_mask[mask] += [(h, i, p) for p, h in enumerate(seeds(words, mask).tolist())]
        for mask, rows in by_mask.items():
            rows.sort()
            keys, at = np.array([r[0] for r in rows], np.uint64), np.array([r[1:] for r in rows], np.int64)
            flags = np.zeros(1 << _BITS, bool)
            flags[keys >> np.uint64(64 - _BITS)] = True
            self.tables.append((mask, keys, at, flags))

    def find(self, texts: list[bytes]) -> Iterator[list[int]]:
        for _, words, bounds in word_hashes(texts, bare=True):
            asked: set[tuple[int, int, int]] = set()
            for mask, keys, at, flags in self.tables:
                hashes = seeds(words, mask)
                where = np.flatnonzero(flags[hashes >> np.uint64(64 - _BITS)])
                low, high = np.searchsorted(keys, hashes[where], "left"), np.searchsorted(keys, hashes[where], "right")
                hit = np.flatnonzero(high > low)
                docs = np.searchsorted(bounds, where[hit], "right") - 1
                for k, doc in zip(hit.tolist(), docs.tolist(), strict=True):
                    for i, p in at[low[k] : high[k]].tolist():
                        asked.add((doc, i, int(where[k] - bounds[doc]) - p))
            found = defaultdict(set)
            for doc, i, shift in asked:
                name, item = self.items[i]
                if name not in found[doc] and overlaps(words[bounds[doc] : bounds[doc + 1]], item, shift):
                    found[doc].add(name)
            yield from (sorted(found[d]) for d in range(len(bounds) - 1))


def _blocks(benchmark: DataFrame, most: int) -> Iterator[Matcher]:
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long"), "text")
    n = max(1, math.ceil(items.count() / most))
    for k in range(n):
        yield Matcher([tuple(r) for r in items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == k).collect()])


def _passes(docs: DataFrame, benchmark: DataFrame, most: int, step: Callable, schema) -> DataFrame:
    for matcher in _blocks(benchmark, most):
        shared = docs.sparkSession.sparkContext.broadcast(matcher)
        docs = docs.mapInArrow(lambda batches, m=shared: (step(b, m.value) for b in batches), schema)
    return docs


def found_items(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, contaminated, kept (its contrary), and item_ids (those found) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    start = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).cast("binary").alias("raw"), F.array().cast("array<long>").alias("item_ids"))

    def step(batch: pa.RecordBatch, matcher: Matcher) -> pa.RecordBatch:
        new = [sorted({*old, *more}) for old, more in zip(batch.column(2).to_pylist(), matcher.find(batch.column(1).to_pylist()), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(new, pa.list_(pa.int64()))], ["doc_id", "raw", "item_ids"])

    out = _passes(start, benchmark, block_items, step, f"doc_id {kind}, raw binary, item_ids array<long>")
    found = F.size("item_ids") > 0
    return out.select("doc_id", found.alias("contaminated"), (~found).alias("kept"), "item_ids")


def clean(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item."""
    at = docs.columns.index("text")

    def step(batch: pa.RecordBatch, matcher: Matcher) -> pa.RecordBatch:
        raw = [(t or b"").decode("utf-8", "replace").lower().encode() for t in batch.column(at).cast(pa.binary()).to_pylist()]
        return batch.filter(pa.array([not x for x in matcher.find(raw)], pa.bool_()))

    return _passes(docs, benchmark, block_items, step, docs.schema)
