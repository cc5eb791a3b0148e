"""Helpers shared by the training-data operators.

Word hashing is vectorised: a batch of UTF-8 texts becomes one byte array, prefix sums of a polynomial give the hash of
every word at once, and no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.storage import written

#: Bytes of text that are hashed at once; bounds the memory of a Python worker whatever a batch or a text holds.
CHUNK_BYTES = 1 << 20
#: Rows of a key list that may be broadcast: at most 16 bytes each, 32 MB.
BROADCAST_ROWS = 2_000_000


def keep_known(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df whose key is in keys: with a broadcast if keys is small enough by count, otherwise with a shuffle."""
    few = keys.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(keys) if few else keys, on, "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """Connected components: edges (a, b) of longs to (node, label), label being the smallest node of the component.

    Each round takes the least label among neighbours, then follows labels once (pointer jumping), so long chains
    shrink fast. Rounds end when no label changes. No edges give an empty table; nodes without edges are not listed.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both = written(both.toDF("node", "other"), "edges")
    labels = written(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")), "labels")
    while True:
        seen = both.join(labels.toDF("other", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        step = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.toDF("new", "far")
        step = step.join(jump, "new", "left").select("node", "label", F.least("new", F.coalesce("far", "new")).alias("new"))
        step = written(step, "labels")
        labels = step.select("node", F.col("new").alias("label"))
        if step.where("new <> label").isEmpty():
            return labels


# Word hashes -------------------------------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240607)
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PUNCTUATION = _SPACE.copy()
_PUNCTUATION[[c for c in range(128) if not chr(c).isalnum()]] = True
#: Odd factors, one for each position of a sequence.
FACTORS = _RNG.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    if kind not in _powers or len(_powers[kind]) < n:
        table = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        table[0] = 1
        _powers[kind] = np.multiply.accumulate(table)
    return _powers[kind]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64 (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hash_block(block: bytes, lower: bool, bare: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start bytes of the words of a block."""
    data = np.frombuffer(block, np.uint8)
    space = (_PUNCTUATION if bare else _SPACE)[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _TABLE)[data] * _power("up", _BASE, len(data) + 1)[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * _power("down", _INVERSE, len(data) + 1)[start]), start


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text cut after white space, so that each piece is hashed alone."""
    at = 0
    while len(text) - at > CHUNK_BYTES:
        cut = max(text.rfind(c, at, at + CHUNK_BYTES) for c in (b" ", b"\n", b"\t", b"\r"))
        cut = cut + 1 if cut > at else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(texts: list[bytes], lower: bool = False, bare: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For chunks of texts: (index of the first text, hashes of all words, bounds of each text's words in them).

    Words are runs of bytes other than 0x20 and 0x09-0x0D, or, if bare, runs of ASCII letters, digits and bytes beyond
    ASCII; lower folds A-Z alone.
    """
    i = 0
    while i < len(texts):
        if len(texts[i]) > CHUNK_BYTES:
            words = np.concatenate([_hash_block(p, lower, bare)[0] for p in _pieces(texts[i])])
            yield i, words, np.array([0, len(words)])
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and size + len(texts[j]) + 1 <= CHUNK_BYTES + 1:
            size += len(texts[j]) + 1
            j += 1
        words, start = _hash_block(b" ".join(texts[i:j]), lower, bare)
        offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[i:j]])))
        yield i, words, np.searchsorted(start, offsets)
        i = j


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by its start; runs across texts are there too and are to be skipped."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out += words[j : len(words) - k + 1 + j] * FACTORS[j]
    return mix(out)
