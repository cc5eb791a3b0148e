"""Packing of token sequences into windows, planned by non-negative least squares.

1. Texts are tokenised where they lie; a text's ids (with the end id) are cut into whole windows and one remainder, so a
   piece's checksum is known at once and ids are never stored or shuffled. Only piece lengths move.
2. The histogram of piece lengths (at most one bin for each length up to the window) is all that the driver sees. Short
   combinations of lengths that fill a window exactly are enumerated (a length alone, pairs, triples of the frequent
   lengths), their repeat counts are fitted to the histogram by non-negative least squares, rounded down so that no bin
   is overdrawn, and what is left is packed greedily, the longest first.
3. The plan is a table of rank ranges per length, of bounded size. A piece's rank among those of its length comes from
   its place in its partition plus the counts of earlier partitions, so no length, however frequent, meets in one task.

Defined results: a null or empty text is the end id alone; rows with equal ids are packed each on its own; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.llm.common import written

WINDOW = 2048
END_ID = 1
#: Words whose ids a Python worker remembers, the first that it meets.
KNOWN_WORDS = 1_500_000
#: Lengths that take part in triples; triples are about a sixth of the square of this.
TRIPLE_LENGTHS = 96
_encoders: dict[str, _Words] = {}


class _Words(dict):
    """Little-endian 32-bit ids by white-space-delimited word.

    Ids can be joined because the tokenizer never joins words; others are refused. Words are told apart by letters, so that
    capitals and a sentence's punctuation need no ids of their own: those of "Word," are those of "word" and of ",". A word
    of Latin letters alone goes to the tokenizer's model at once, as its other steps leave it as it is.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        plain = "ab cd ef"
        if any(self._encoded(x) != self._encoded(plain) for x in ("Ab\n CD\tef ", " ab  cd ef")) or self._encoded(plain) != b"".join(map(self._encoded, plain.split())):
            raise ValueError(f"{path}: this tokenizer joins words or keeps case")
        if self._encoded("ab,cd.") != b"".join(map(self._encoded, ("ab", ",", "cd", "."))):
            raise ValueError(f"{path}: this tokenizer joins punctuation to words")
        # ByteLevel shows printable bytes as they are and the others, in order, as characters from 256
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.direct = all(self._latin(x) == self._encoded(x) for x in ("unhappinesses", "über", "façade", "señoría", "œuvre", "à", "łódź"))

    def _encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _latin(self, text: str) -> bytes:
        shown = text if text.isascii() else "".join(map(self.shown.__getitem__, text.encode()))
        return np.array([t.id for t in self.tokenizer.model.tokenize(shown)], "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        lower = text.lower()
        latin = max(text + lower) < "\u0250" and "<|" not in text and unicodedata.is_normalized("NFC", text)
        if latin and lower != text:
            ids = self[lower.encode()]
        elif latin and len(text) > 1 and text[-1] in ".,;:!?" and text[-2].isalpha():
            ids = self[word[:-1]] + self[word[-1:]]
        elif latin and self.direct and text.isalpha() and text.islower():
            ids = self._latin(text)
        else:
            ids = self._encoded(text)
        if len(self) < KNOWN_WORDS and len(word) <= 64:
            self[word] = ids
        return ids


def token_ids(text: bytes, path: str) -> bytes:
    """Ids of a UTF-8 text as little-endian unsigned 32-bit numbers."""
    if path not in _encoders:
        _encoders[path] = _Words(path)
    return b"".join(map(_encoders[path].__getitem__, text.split()))


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """All pieces: doc_id, start, length, ids_crc32, doc_tokens, and part and place, which number equal lengths."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        part = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for i, raw in enumerate(batch.column(1)):
                ids = token_ids(raw.as_py(), tokenizer) + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    length = min(window, n - start)
                    rows.append((i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, part, seen[length]))
                    seen[length] += 1
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(7)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), *columns[1:]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place"])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part long, place long")


def combinations(counts: dict[int, int], window: int) -> list[tuple[int, ...]]:
    """Multisets of at most three lengths that fill the window exactly."""
    lengths = sorted(counts)
    out = [(window,)] if window in counts else []
    out += [(a, window - a) for a in lengths if a <= window - a and window - a in counts]
    frequent = sorted(sorted(counts, key=lambda x: (-counts[x], x))[:TRIPLE_LENGTHS])
    for i, a in enumerate(frequent):
        for b in frequent[i:]:
            c = window - a - b
            if c < b:
                break
            if c in counts:
                out.append((a, b, c))
    return [x for x in out if all(counts[a] >= n for a, n in Counter(x).items())]


def least_squares(columns: list[tuple[int, ...]], counts: dict[int, int], sweeps: int = 40) -> list[float]:
    """Repeat counts x >= 0 that bring the sum of x * column nearest to counts, by coordinate descent."""
    left = {k: float(v) for k, v in counts.items()}
    parts = [list(Counter(c).items()) for c in columns]
    norms = [sum(n * n for _, n in p) for p in parts]
    x = [0.0] * len(columns)
    for _ in range(sweeps):
        moved = 0.0
        for j, p in enumerate(parts):
            new = max(0.0, x[j] + sum(left[a] * n for a, n in p) / norms[j])
            if step := new - x[j]:
                for a, n in p:
                    left[a] -= step * n
                x[j] = new
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank from, rank to, first sequence, times in a sequence, offset in it) that place every rank once."""
    left = dict(counts)
    chosen: list[tuple[tuple[int, ...], int]] = []
    columns = combinations(left, window)
    for column, x in sorted(zip(columns, least_squares(columns, left), strict=True), key=lambda t: -t[1]):
        repeat = min([int(x + 1e-6), *(left[a] // n for a, n in Counter(column).items())])
        if repeat:
            chosen.append((column, repeat))
            for a in column:
                left[a] -= repeat
    lengths = sorted(a for a, n in left.items() if n)
    while lengths:
        room, column, spare = window, [], dict.fromkeys(lengths, 0)
        k = len(lengths)
        while k and room:
            k = bisect.bisect_right(lengths, room, 0, k)
            if k:
                a = lengths[k - 1]
                n = min(room // a, left[a])
                column += [a] * n
                room -= n * a
                spare[a] = n
                k -= 1
        repeat = min(left[a] // n for a, n in spare.items() if n)
        chosen.append((tuple(column), repeat))
        for a in column:
            left[a] -= repeat
        lengths = [a for a in lengths if left[a]]
    used: Counter = Counter()
    rows, sequence = [], 0
    for column, repeat in chosen:
        offset = 0
        for a, n in Counter(column).items():
            rows.append((a, used[a], used[a] + n * repeat, sequence, n, offset))
            used[a] += n * repeat
            offset += n * a
        sequence += repeat
    return rows


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Every piece with its sequence and its offset there; columns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = written(pieces(docs, tokenizer, window, end_id), "pieces")
    groups = written(cut.groupBy("length", "part").count(), "piece-counts")
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    rows = plan(counts, window)
    schema = "length long, low long, high long, sequence long, times long, within long"
    table = F.broadcast(spark.createDataFrame(rows, schema))  # a few rows for each length, whatever the input holds
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = groups.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    ranked = cut.join(first, ["length", "part"]).withColumn("rank", F.col("first") + F.col("place"))
    placed = ranked.join(table, "length").where("rank >= low and rank < high").withColumn("at", F.col("rank") - F.col("low"))
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(F.col("at") / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("within") + F.col("at") % F.col("times") * F.col("length")).alias("offset"),
    )
