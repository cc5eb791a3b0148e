"""Substring dedup by level-wise doubling.

Windows are judged at one length, and only where they repeat at that length are they extended to twice it. A window of the
full length holds windows of the shorter length at several offsets; the one with the least hash stands for all of them
(both copies of a repeated window have the same one), so a level moves a few hundredths of the positions. A full window is
a candidate only if the shorter window that stands for it repeats in another text. With `levels` more than one, shorter
levels come before. The doubling ends at `window`, or sooner if no candidate survives.

Texts that are equal as a whole are settled by their ids and stand as one text in all levels. At the full length each
candidate is a row; the least id of a window decides. Hashes of the full length have 128 bits. Its least
id is found with partial aggregates and joined back to its rows, so a window that many texts share never fills one task.

Defined results: a null or empty text has no words; rows with equal ids do not remove from each other; a null id is larger
than all others, so it loses words and takes none; a text shorter than the window keeps all words; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.llm.common import FACTORS, keep_known, mix, sequence_hashes, word_hashes, written

LAST = 2**63 - 1
_NEVER = np.uint64(2**64 - 1)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each run of width values, by its start; runs at the end are shorter."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = pick(out[:-step], out[step:]) if step < len(out) else out[:-step]
        have += step
    return out


def standing(words: np.ndarray, bounds: np.ndarray, short: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of short runs; for each word, the least of those in the window that starts there; where a window fits."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    place = np.arange(len(words))
    hashes = np.full(len(words), _NEVER)
    runs = sequence_hashes(words, short)
    hashes[: len(runs)] = runs
    hashes[place + short > ends] = _NEVER
    return hashes, _sliding(hashes, window - short + 1, np.minimum), place + window <= ends


def _keyed(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(doc_id, F.lit(LAST)).alias("id0"), F.xxhash64("text").alias("th"))


def _anchors(texts: DataFrame, short: int, window: int, before: int | None) -> DataFrame:
    """(hash, th) of the short runs that stand for some window of each text (th, raw, known: hashes of the level before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy()
            known = batch.column(2).to_pylist() if before else None
            for first, words, bounds in word_hashes(batch.column(1).to_pylist()):
                hashes, least, fits = standing(words, bounds, short, window)
                if before:
                    _, old, _ = standing(words, bounds, before, window)
                    for i in range(len(bounds) - 1):
                        own = slice(bounds[i], bounds[i + 1])
                        fits[own] &= np.isin(old[own], np.array(known[first + i], np.int64).view(np.uint64))
                width = window - short + 1
                asked = np.where(fits, least, np.uint64(0))
                stands = _sliding(asked[::-1], width, np.maximum)[::-1] == hashes
                where = np.flatnonzero(stands & (hashes != _NEVER))
                own = np.searchsorted(bounds, where, "right") - 1
                found, at = np.unique(np.stack([hashes[where], own.astype(np.uint64)], axis=1), axis=0).T if len(where) else (hashes[:0], hashes[:0])
                found = np.ascontiguousarray(found).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(names[first + at.astype(np.int64)])], ["hash", "th"])

    return texts.mapInArrow(run, "hash long, th long")


def _windows(texts: DataFrame, short: int, window: int) -> DataFrame:
    """(h1, h2, id0, at) of the candidate windows; at is the word times 2^32 plus the low half of th."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ids, known = batch.column(0).to_numpy(), batch.column(3).to_numpy(), batch.column(2).to_pylist()
            for first, words, bounds in word_hashes(batch.column(1).to_pylist()):
                _, least, fits = standing(words, bounds, short, window)
                for i in range(len(bounds) - 1):
                    own = slice(bounds[i], bounds[i + 1])
                    fits[own] &= np.isin(least[own], np.array(known[first + i], np.int64).view(np.uint64))
                where = np.flatnonzero(fits)
                h1 = sequence_hashes(words, window)[where].view(np.int64) if len(where) else np.zeros(0, np.int64)
                second = np.zeros(len(where), np.uint64)
                for j in range(window):
                    second += words[where + j] * FACTORS[-1 - j]
                own = np.searchsorted(bounds, where, "right") - 1
                at = (where - bounds[own]) << 32 | (names[first + own] & 0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(mix(second).view(np.int64)), pa.array(ids[first + own]), pa.array(at)], ["h1", "h2", "id0", "at"])

    return texts.mapInArrow(run, "h1 long, h2 long, id0 long, at long")


def covered_windows(docs: DataFrame, window: int = 50, levels: int = 1) -> DataFrame:
    """(id0, tag, starts): words at which windows start that a text with a smaller id also has; equal texts are left out."""
    texts = _keyed(docs)
    firsts = texts.groupBy("th").agg(F.min("id0").alias("id0"))
    known, before = None, None
    for level in range(levels, 0, -1):
        short = -(-window // 2**level)
        if known is None:
            source = texts.select("th", F.col("text").cast("binary").alias("raw"))
        else:
            source = _with_known(texts, known).select("th", "raw", "known")
        same = Window.partitionBy("hash")  # no hash has more than one row for each text, of dozens
        repeated = _anchors(source, short, window, before).withColumns({"low": F.min("th").over(same), "high": F.max("th").over(same)}).where("low < high")
        known = repeated.groupBy("th").agg(F.collect_set("hash").alias("known"))
        known = written(known.join(firsts, "th"), "repeats")
        before = short
        if known.isEmpty():
            break
    rows = written(_windows(_with_known(texts, known).select("th", "raw", "known", "id0"), before, window), "windows")
    shared = rows.groupBy("h1", "h2").agg(F.min("id0").alias("least"), F.max("id0").alias("most")).where("least < most")
    taken = rows.join(shared.select("h1", "h2", "least"), ["h1", "h2"]).where("least < id0")
    tag = F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("tag")
    return taken.select("id0", tag, F.shiftright("at", 32).cast("int").alias("start")).groupBy("id0", "tag").agg(F.collect_set("start").alias("starts"))


def _with_known(texts: DataFrame, known: DataFrame) -> DataFrame:
    """The first row of each text that has repeats, with these."""
    near = keep_known(texts, known.select("id0", "th"), ["id0", "th"])
    near = near.select("id0", "th", F.col("text").cast("binary").alias("raw"))
    return near.join(known, ["id0", "th"]).dropDuplicates(["id0", "th"])


def _kept_words(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, starts, copy in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = _WORD.findall(raw.as_py())
                n = len(words)
                if copy and n >= window:
                    words = []
                elif starts:
                    gone = np.zeros(n + 1, np.int64)
                    at = np.array(starts)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:n] == 0)]
                text = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(text).hexdigest(), text))
            arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def deduplicated(docs: DataFrame, window: int = 50, levels: int = 1) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by one space, as bytes) of every row."""
    texts = _keyed(docs)
    starts = covered_windows(docs, window, levels)
    rows = texts.select("id0", "th")
    firsts = rows.groupBy("th").agg(F.min("id0").alias("least"), F.max("id0").alias("most")).where("least < most")
    copies = rows.join(firsts, "th").where("id0 > least").select("id0", "th", F.lit(True).alias("copy"))
    # one row for each (id0, th) that loses words: as a copy, or by windows; copies have no windows of their own
    tagged = F.col("th").bitwiseAND(F.lit(0xFFFFFFFF))
    losing = copies.distinct().select("id0", tagged.alias("tag"), F.lit(None).cast("array<int>").alias("starts"), "copy")
    losing = losing.union(starts.select("id0", "tag", "starts", F.lit(False)))
    losing = written(losing, "losing")
    full = texts.withColumn("tag", tagged).join(losing, ["id0", "tag"], "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"
    return full.select("doc_id", F.col("text").cast("binary"), "starts", F.coalesce("copy", F.lit(False))).mapInArrow(_kept_words(window), schema)
