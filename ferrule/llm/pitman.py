"""Hierarchical Pitman-Yor language model over words, seated by Gibbs sampling, as a distributed job.

Each word that precedes another is a restaurant, in which the words that follow it are dishes; all these restaurants share one
parent, and the parent's parent is uniform over the known words and one unknown. A dish with c customers at t tables in a
restaurant with C customers at T tables has the predictive probability
    (c - d * t) / (s + C) + (s + d * T) / (s + C) * (its probability in the parent),
and each table sends one customer to the parent. The probability of a token is averaged over the seatings of the sweeps after
the first, and a text's score is the sum of their logarithms.

A step of the Gibbs sampler draws the seating of one dish in one restaurant, given all others: its customers come in one after the other and
open a table with the weight (s + d * T) * (probability in the parent), or join one. Only the arrivals that open tables are
drawn (by thinning), so a dish costs as many steps as it has tables, not customers. Drawn like this, a seating is too likely by a
known factor; it replaces the old one with the Metropolis ratio of these factors, which makes the step exact. The dishes of a
sweep are drawn at the same time, given the totals of the sweep before, as is usual in distributed Gibbs sampling.

Texts are cut into words and counted in chunks; what travels are the counts of a chunk, packed by bucket. A bucket holds the
dishes of some words, with every restaurant that serves them, so the parent's seating is local. A word with a large share of all
tokens is dealt over all buckets by the word before it; there are at most HEAVY_WORDS of these, and only their totals meet on the
driver. The totals of restaurants are summed in other buckets and sent back. Everything is read from stored tables and
drawn from generators seeded by sweep and bucket, so a lost task gives the same again.

Null and empty texts hold the end alone. Very long texts are a chunk of their own. Null doc_ids are never learned from; repeated rows are
texts of their own. Words are identified by 64-bit hashes. An empty table gives no rows; where nothing is learned
from, every token has the probability 1 of the one unknown word. Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import mix, word_hashes
from ferrule.storage import shared_dir, written

#: Bytes of text counted together; bytes of text to a bucket; words that are dealt over all buckets.
CHUNK_BYTES, BUCKET_BYTES, HEAVY_WORDS = 8 << 20, 16 << 20, 1 << 20
#: Sweeps, those at the start that are left out of the average, steps of a dish in a sweep, and the strength of all restaurants.
SWEEPS, BURN_IN, STEPS, STRENGTH = 3, 1, 3, 1.0
END, BEGIN = np.uint64(0), np.uint64(2**64 - 1)


# Seating ------------------------------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series beyond 8."""
    shift = np.zeros_like(x)
    low = x < 8
    y = x.copy()
    for _ in range(8):
        shift[low] += np.log(y[low])
        y[low] += 1
        low = low & (y < 8)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9) - shift


@dataclass
class Seating:
    """Tables of dishes: t of each, and when each opened (customers already seated), dish after dish."""

    t: np.ndarray
    opened: np.ndarray

    def kept(self, customers: np.ndarray) -> Seating:
        """What is left when each dish has at most so many customers: the last to come go first."""
        ok = self.opened < np.repeat(customers, self.t)
        return Seating(np.bincount(np.repeat(np.arange(len(self.t)), self.t)[ok], minlength=len(self.t)), self.opened[ok])


def seat(rng: np.random.Generator, c: np.ndarray, weight: np.ndarray, discount: float, start: Seating | None = None, seated: np.ndarray | None = None) -> Seating:
    """Seat c customers of each dish one by one, after those of start; a new table has the weight, the rest weighs n - discount * t.

    The chance of a new table falls while nobody opens one. So the next opening is proposed with the chance of a moment, up to
    twice the customers of that moment, and taken with the ratio of the chances.
    """
    t = np.zeros(len(c), np.int64) if start is None else start.t.copy()
    n = np.zeros(len(c), np.int64) if seated is None else seated.copy()
    who, when = [], []
    if start is not None:
        who.append(np.repeat(np.arange(len(c)), start.t))
        when.append(start.opened)
    live = np.flatnonzero(n < c)
    while len(live):
        m, k, w = n[live], t[live], weight[live]
        rate = np.where(k == 0, 1.0, w / (w + m - discount * k))  # the first customer always opens one
        step = rng.geometric(np.clip(rate, 1e-300, 1.0)) - 1
        limit = np.maximum(m, 1)
        hop = (step >= limit) | (step < 0)
        at = m + np.where(hop, limit, step)
        chance = np.where(k == 0, 1.0, w / (w + at - discount * k))
        opens = ~hop & (at < c[live]) & (rng.random(len(live)) * rate < chance)
        who.append(live[opens])
        when.append(at[opens])
        t[live[opens]] += 1
        n[live] = np.where(hop, at, at + 1)
        live = live[n[live] < c[live]]
    who, when = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (who, when))
    order = np.lexsort((when, who))
    return Seating(t, when[order])


def excess(c: np.ndarray, weight: np.ndarray, discount: float, seating: Seating) -> np.ndarray:
    """Logarithm of how much too seldom seat() draws this seating: the sum of log(weight + n - discount * t) over arrivals but the first."""
    who = np.repeat(np.arange(len(c)), seating.t)
    if not len(who):
        return np.zeros(len(c))
    first = np.cumsum(seating.t) - seating.t
    k = np.arange(len(who)) - first[who] + 1.0
    until = np.append(seating.opened[1:], 0) + 1
    last = first + seating.t - 1
    until[last[seating.t > 0]] = c[seating.t > 0]
    base = weight[who] - discount * k
    part = log_gamma(base + until) - log_gamma(base + seating.opened + 1)
    return np.bincount(who, part, minlength=len(c))


def gibbs(rng: np.random.Generator, c: np.ndarray, weight: np.ndarray, discount: float, old: Seating | None, steps: int = STEPS) -> Seating:
    """Steps for each dish, from old (null: none yet), whose customers may have been others."""
    rare = None if old is None else excess(c, weight, discount, old)
    for _ in range(steps):
        new = seat(rng, c, weight, discount)
        seldom = excess(c, weight, discount, new)
        if old is not None:
            take = np.log(np.maximum(rng.random(len(c)), 1e-300)) < seldom - rare
            pick_new, pick_old = np.repeat(take, new.t), np.repeat(~take, old.t)
            who = np.concatenate((np.repeat(np.arange(len(c)), new.t)[pick_new], np.repeat(np.arange(len(c)), old.t)[pick_old]))
            opened = np.concatenate((new.opened[pick_new], old.opened[pick_old]))
            new = Seating(np.where(take, new.t, old.t), opened[np.argsort(who, kind="stable")])
            seldom = np.where(take, seldom, rare)
        old, rare = new, seldom
    return old


# Packed arrays ------------------------------------------------------------------------------------------------------


def pack(a: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers from 0 in the narrowest type, as differences if they rise."""
    a = np.asarray(a).astype(np.uint64)
    if rising and len(a):
        a = np.concatenate((a[:1], a[1:] - a[:-1]))
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(a) or int(a.max()) <= np.iinfo(k).max)
    return (kind[-1] + "r" * rising).encode() + b":" + zstandard.ZstdCompressor(level=1).compress(a.astype(kind).tobytes())


def unpack(data: bytes) -> np.ndarray:
    head, _, body = data.partition(b":")
    a = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), f"<u{head[:1].decode()}").astype(np.uint64)
    return np.cumsum(a, dtype=np.uint64) if head.endswith(b"r") else a


def whole(data: bytes) -> np.ndarray:
    return unpack(data).astype(np.int64)


# Chunks -------------------------------------------------------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes]]]:
    """(number, doc_ids, texts) of about CHUNK_BYTES; numbers are unique among tasks, and the same if a task runs again."""
    number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = raw.as_py()
            if texts and size + len(text) > CHUNK_BYTES:
                yield number, ids, texts
                number, ids, texts, size = number + 1, [], [], 0
            ids.append(doc_id)
            texts.append(text)
            size += len(text) + 16
    if texts:
        yield number, ids, texts


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts, each closed by END, and the lengths of the texts."""
    parts, lengths = [], []
    for _, words, bounds in word_hashes(texts, lower=True):
        parts.append(words)
        lengths.append(np.diff(bounds))
    words, n = np.concatenate(parts), np.concatenate(lengths) + 1
    out = np.full(n.sum(), END, np.uint64)
    ends = np.cumsum(n) - 1
    place = np.ones(len(out), bool)
    place[ends] = False
    out[place] = words
    return out, n


def _learned(ids: list, held_out: int, folds: int) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % folds != held_out for i in ids], bool)


@dataclass
class Model:
    """What every task knows: buckets, heavy words with their totals, and the totals of the parent after each sweep."""

    buckets: int
    heavy: np.ndarray
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    tokens: int = 0
    known: int = 0
    discount: tuple[float, float] = (0.5, 0.5)
    #: For each sweep: (customers and tables of the parent, customers and tables of the heavy words in it).
    parent: list[tuple[int, int, np.ndarray, np.ndarray]] = field(default_factory=list)

    def bucket(self, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        key = np.where(self.is_heavy(words), words + mix(before), words)
        return (mix(key + np.uint64(0x5851F42D4C957F2D)) % np.uint64(self.buckets)).astype(np.int64)

    def is_heavy(self, words: np.ndarray) -> np.ndarray:
        return np.isin(words, self.heavy)


def _heavy(texts: DataFrame, buckets: int, held_out: int, folds: int) -> np.ndarray:
    """Words with at least 1 / (8 * buckets) of the tokens of a chunk, and in sum of all tokens; at most HEAVY_WORDS."""
    share = max(1 / (8 * buckets), 1 / HEAVY_WORDS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, raw in _chunks(batches):
            tokens, n = _tokens(raw)
            tokens = tokens[np.repeat(_learned(ids, held_out, folds), n)]
            words, c = np.unique(tokens, return_counts=True)
            often = c >= share * max(1, len(tokens))
            words, c = np.append(words[often], BEGIN), np.append(c[often], len(tokens))  # BEGIN stands for all
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(c)], ["word", "n"])

    found = written(texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "heavy")
    total = found.where(F.col("word") == -1).agg(F.sum("n")).first()[0] or 0
    rows = found.where((F.col("word") != -1) & (F.col("n") >= share * total)).select("word").collect() if total else []
    return np.sort(np.array([r["word"] for r in rows], np.int64).view(np.uint64))


_COUNTED = "bucket long, kind string, chunk long, words binary, u binary, w binary, c binary, k binary, doc binary, n binary"
_NAMES = [x.split()[0] for x in _COUNTED.split(", ")]


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<binary>": pa.list_(pa.binary())}
    fields = [x.rsplit(" ", 1) for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], types[t]) for n, t in fields], [n for n, _ in fields])


def _counted(texts: DataFrame, model: Model, held_out: int, folds: int) -> DataFrame:
    """A chunk's pairs of neighbours by bucket (kind o): words, u and w (places in words) of each pair, c (how often in what is learned from), k (documents), doc and n of each.

    Kind m: the doc_ids (words; k: whether null), n_tokens (n) and whether it is learned from (c) of a chunk's documents.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, raw in _chunks(batches):
            tokens, n = _tokens(raw)
            ends = np.cumsum(n) - 1
            learned = _learned(ids, held_out, folds)
            doc_ids = np.array([i or 0 for i in ids], np.int64)
            meta = {"bucket": -1 - chunk % model.buckets, "kind": "m", "chunk": chunk, "words": pack(doc_ids.view(np.uint64)), "k": pack([i is None for i in ids]), "n": pack(n), "c": pack(learned)}
            words, w = np.unique(tokens, return_inverse=True)
            words = np.append(words, BEGIN)
            u = np.concatenate(([len(words) - 1], w[:-1]))
            u[ends[:-1] + 1] = len(words) - 1
            doc = np.repeat(np.arange(len(n)), n)
            bucket = model.bucket(words, words)[w]
            often = model.is_heavy(words)[w]
            bucket[often] = model.bucket(words[w[often]], words[u[often]])
            if model.buckets * len(words) ** 2 < 2**62:
                order = np.argsort((bucket * len(words) + u) * len(words) + w, kind="stable")
            else:
                order = np.lexsort((w, u, bucket))
            bucket, u, w, doc = bucket[order], u[order], w[order], doc[order]
            pair = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (w[1:] != w[:-1]) | (bucket[1:] != bucket[:-1]))))
            fresh = np.zeros(len(u), bool)
            fresh[pair] = True
            fresh[1:] |= doc[1:] != doc[:-1]
            entry = np.flatnonzero(fresh)
            times = np.diff(np.append(entry, len(u)))
            c = np.add.reduceat(times * learned[doc[entry]], np.searchsorted(entry, pair))
            k = np.diff(np.append(np.searchsorted(entry, pair), len(entry)))
            cut = np.flatnonzero(np.concatenate(([True], bucket[pair][1:] != bucket[pair][:-1])))
            rows, at = [meta], np.concatenate(([0], np.cumsum(k)))
            for s, e in zip(cut, np.append(cut[1:], len(pair)), strict=True):
                own, uw = np.unique(np.concatenate((u[pair[s:e]], w[pair[s:e]])), return_inverse=True)
                seen = slice(at[s], at[e])
                rows.append({
                    "bucket": bucket[pair[s]], "kind": "o", "chunk": chunk, "words": pack(words[own], True), "u": pack(uw[: e - s], True), "w": pack(uw[e - s :]),
                    "c": pack(c[s:e]), "k": pack(k[s:e]), "doc": pack(doc[entry[seen]]), "n": pack(times[seen]),
                })
            yield _batch(rows, _COUNTED)

    return texts.mapInArrow(count, _COUNTED)


def _merged(table: pa.Table) -> pa.Table:
    """A bucket's pairs over all chunks (kind d: words, u, w, c), and where each chunk has them (kind o: u is the place of the pair)."""
    rows = [r for r in table.to_pylist() if r["kind"] == "o"]
    if not rows:
        return table.select(_NAMES)
    each = [unpack(r["words"]) for r in rows]
    words = np.unique(np.concatenate(each))
    keys = []
    for r, own in zip(rows, each, strict=True):
        place = np.searchsorted(words, own)
        keys.append(place[whole(r["u"])] * len(words) + place[whole(r["w"])])
    pairs, where = np.unique(np.concatenate(keys), return_inverse=True)
    c = np.bincount(where, np.concatenate([whole(r["c"]) for r in rows]), minlength=len(pairs)).astype(np.int64)
    bucket, at = rows[0]["bucket"], 0
    out = [{"bucket": bucket, "kind": "d", "words": pack(words, True), "u": pack(pairs // len(words), True), "w": pack(pairs % len(words)), "c": pack(c)}]
    for r, key in zip(rows, keys, strict=True):
        mine = where[at : at + len(key)]
        at += len(key)
        out.append({"bucket": bucket, "kind": "o", "chunk": r["chunk"], "u": pack(mine, True), "k": r["k"], "doc": r["doc"], "n": r["n"]})  # a chunk's pairs are in the same order
    return pa.Table.from_batches([_batch(out, _COUNTED)])


# Buckets ------------------------------------------------------------------------------------------------------------

#: kind t: the seating of a sweep; s: totals; q: a question about restaurants to bucket `chunk`; a: its answer.
_SENT = "bucket long, kind string, chunk long, sweep long, words binary, vals array<binary>"


class Bucket:
    """The dishes of a bucket."""

    def __init__(self, row: dict, model: Model) -> None:
        self.number, self.model = row["bucket"], model
        self.words, self.u, self.w, self.c = unpack(row["words"]), whole(row["u"]), whole(row["w"]), whole(row["c"])
        self.heavy = model.is_heavy(self.words)
        self.many = np.flatnonzero(self.c > 1)  # a dish with one customer has one table

    def asked(self, only_many: bool) -> np.ndarray:
        """Places of the words whose restaurants matter."""
        return np.unique(self.u[self.many] if only_many else self.u)

    def questions(self, only_many: bool, values: list[np.ndarray], sweep: int) -> list[dict]:
        """Values of dishes, summed by restaurant, for the buckets that know the restaurants."""
        places = self.asked(only_many)
        sums = [np.bincount(self.u, v, minlength=len(self.words)).astype(np.int64)[places] for v in values]
        home = (mix(self.words[places] + np.uint64(1)) % np.uint64(self.model.buckets)).astype(np.int64)
        return [{"bucket": self.number, "kind": "q", "chunk": h, "sweep": sweep, "words": pack(self.words[places[at]], True), "vals": [pack(s[at]) for s in sums]} for h in np.unique(home) for at in [home == h]]

    def answers(self, rows: list[dict], only_many: bool) -> list[np.ndarray]:
        """Totals of restaurants by place in words, from the answers to questions."""
        places = self.asked(only_many)
        home = (mix(self.words[places] + np.uint64(1)) % np.uint64(self.model.buckets)).astype(np.int64)
        out: list[np.ndarray] = []
        for r in rows:
            at = places[home == r["chunk"]]
            for i, v in enumerate(r["vals"]):
                if len(out) <= i:
                    out.append(np.zeros(len(self.words), np.int64))
                out[i][at] = whole(v)
        return out

    def probability(self, sweep: int, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """In the parent, by place in words, after a sweep with these (own) customers and tables."""
        model = self.model
        total, opened, heavy_c, heavy_t = model.parent[sweep]
        c, t = customers.copy(), tables.copy()
        at = np.searchsorted(model.heavy, self.words[self.heavy])
        c[self.heavy], t[self.heavy] = heavy_c[at], heavy_t[at]
        d = model.discount[0]
        return (np.maximum(c - d * t, 0) + (STRENGTH + d * opened) / (model.known + 1)) / (STRENGTH + total)

    def state(self, dishes: Seating, customers: np.ndarray, parent: Seating, sweep: int) -> list[dict]:
        light = np.where(self.heavy, 0, customers)
        heavy = np.flatnonzero(self.heavy & (customers > 0))
        totals = [light.sum(), parent.t.sum(), *(np.sum((light == i) & ~self.heavy) for i in (1, 2))]
        return [
            {"bucket": self.number, "kind": "t", "sweep": sweep, "vals": [pack(x) for x in (dishes.t, dishes.opened, customers, parent.t, parent.opened)]},
            {"bucket": self.number, "kind": "s", "sweep": sweep, "words": pack(self.words[heavy], True), "vals": [pack(totals), pack(customers[heavy])]},
        ]

    def tables(self, many: np.ndarray) -> np.ndarray:
        """t of every dish from that of those with several customers."""
        t = np.minimum(self.c, 1)
        t[self.many] = many
        return t

    def served(self, t: np.ndarray) -> np.ndarray:
        return np.bincount(self.w, t, minlength=len(self.words)).astype(np.int64)


def _first(model: Model):
    """Totals of a bucket, and its first questions: customers and dishes of restaurants."""

    def run(table: pa.Table) -> pa.Table:
        out: list[dict] = []
        for row in table.to_pylist():
            b = Bucket(row, model)
            count, dishes = np.bincount(b.w, b.c, minlength=len(b.words)).astype(np.int64), (b.c > 0).astype(np.int64)
            served = b.served(dishes)
            heavy = np.flatnonzero(b.heavy)
            light = ~b.heavy
            totals = [b.c.sum(), np.sum(light & (count > 0)), *(np.sum(b.c == i) for i in (1, 2)), *(np.sum(light & (served == i)) for i in (1, 2)), served[light].sum(), np.sum(light & (served > 0))]
            out.append({"bucket": b.number, "kind": "s", "sweep": 0, "words": pack(b.words[heavy], True), "vals": [pack(totals), pack(count[heavy]), pack(served[heavy])]})
            out += b.questions(False, [b.c, dishes], 0)
        return pa.Table.from_batches([_batch(out, _SENT)])

    return run


def _totals(table: pa.Table) -> pa.Table:
    """Answers: the sums over all buckets that asked, in the order in which each asked."""
    rows = table.to_pylist()
    each = [unpack(r["words"]) for r in rows]
    words, where = np.unique(np.concatenate(each), return_inverse=True)
    sums = [np.bincount(where, np.concatenate([whole(r["vals"][i]) for r in rows]), minlength=len(words)).astype(np.int64) for i in range(len(rows[0]["vals"]))]
    cuts = np.cumsum([len(x) for x in each])[:-1]
    out = [{"bucket": r["bucket"], "kind": "a", "chunk": r["chunk"], "sweep": r["sweep"], "vals": [pack(s[at]) for s in sums]} for r, at in zip(rows, np.split(where, cuts), strict=True)]
    return pa.Table.from_batches([_batch(out, _SENT)])


def _swept(model: Model, sweep: int, last: bool):
    """One sweep over a bucket: the dishes, then the parent's dishes of its words; then questions about tables.

    The first sweep has the first answers (customers and dishes of each restaurant) alone; later ones also the seating before
    and the tables beyond one for each dish.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[dict] = []
        for row in left.to_pylist():
            b, got = Bucket(row, model), right.to_pylist()
            rng = np.random.default_rng([sweep, b.number])
            (_, opened) = b.answers([r for r in got if r["kind"] == "a" and r["sweep"] == 0], False)
            old = next((r["vals"] for r in got if r["kind"] == "t"), None)
            one = np.minimum(b.c, 1)
            if old is None:
                before, served, parent = None, b.served(one), None
                tables = np.minimum(served, 1)
            else:
                for more in b.answers([r for r in got if r["kind"] == "a" and r["sweep"] == sweep - 1 > 0], True):
                    opened = opened + more
                t, when, served, at, parent_when = (whole(v) for v in old)
                before, parent, tables = Seating(t, when), Seating(at, parent_when), at
            p = b.probability(sweep - 1, served, tables)
            u, w = b.u[b.many], b.w[b.many]
            dishes = gibbs(rng, b.c[b.many], (STRENGTH + model.discount[1] * opened[u]) * p[w], model.discount[1], before)
            t = b.tables(dishes.t)
            customers = b.served(t)
            own = np.where(b.heavy, 0, customers)
            weight = np.full(len(own), (STRENGTH + model.discount[0] * model.parent[sweep - 1][1]) / (model.known + 1))
            if parent is not None:  # who left has gone, who came is seated after the others
                were = np.minimum(np.where(b.heavy, 0, served), own)
                parent = seat(rng, own, weight, model.discount[0], parent.kept(own), were)
            parent = gibbs(rng, own, weight, model.discount[0], parent)
            out += b.state(dishes, customers, parent, sweep)
            if not last:
                out += b.questions(True, [t - one], sweep)
        return pa.Table.from_batches([_batch(out, _SENT)])

    return run


def _closing(model: Model, kept: list[int]):
    """Questions about the tables of all restaurants, over the kept sweeps."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[dict] = []
        for row in left.to_pylist():
            b = Bucket(row, model)
            state = {r["sweep"]: r["vals"] for r in right.to_pylist()}
            out += b.questions(False, [b.tables(whole(state[s][0])) for s in kept], -1)
        return pa.Table.from_batches([_batch(out, _SENT)])

    return run


_SUMS = "chunk long, docs binary, sums binary"


def _scored(model: Model, kept: list[int]):
    """For each chunk, the sums of its documents over a bucket: log10 of the model's and the base probability, and known tokens."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, got = left.to_pylist(), right.to_pylist()
        out: list[dict] = []
        for row in (r for r in rows if r["kind"] == "d"):
            b = Bucket(row, model)
            state = {r["sweep"]: [whole(v) for v in r["vals"]] for r in got if r["kind"] == "t"}
            customers, _ = b.answers([r for r in got if r["kind"] == "a" and r["sweep"] == 0], False)
            opened = b.answers([r for r in got if r["kind"] == "a" and r["sweep"] == -1], False)
            d, chance = model.discount[1], np.zeros(len(b.c))
            for s, tables in zip(kept, opened, strict=True):
                t, _, served, at, _ = state[s]
                p = b.probability(s, served, at)
                chance += (np.maximum(b.c - d * b.tables(t), 0) + (STRENGTH + d * tables[b.u]) * p[b.w]) / (STRENGTH + customers[b.u]) / len(kept)
            count = np.bincount(b.w, b.c, minlength=len(b.words)).astype(np.int64)
            count[b.heavy] = model.counts[np.searchsorted(model.heavy, b.words[b.heavy])]
            lp, base, known = np.log10(chance), np.log10((count + 1) / (model.tokens + model.known + 1))[b.w], (count > 0)[b.w]
            for r in (r for r in rows if r["kind"] == "o"):
                k, doc, n = whole(r["k"]), whole(r["doc"]), whole(r["n"])
                pair = np.repeat(whole(r["u"]), k)
                docs, at = np.unique(doc, return_inverse=True)
                sums = [np.bincount(at, n * v[pair]) for v in (lp, base, known)]
                out.append({"chunk": r["chunk"], "docs": pack(docs, True), "sums": b"".join((sums[0].astype("<f4").tobytes(), sums[1].astype("<f8").tobytes(), sums[2].astype("<u4").tobytes()))})
        return pa.Table.from_batches([_batch(out, _SUMS)])

    return run


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _summed(train_tokens: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        meta = next(r for r in rows if r["words"] is not None)
        ids, null, n = unpack(meta["words"]).view(np.int64), whole(meta["k"]), whole(meta["n"])
        score, base, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for r in sorted((r for r in rows if r["sums"] is not None), key=lambda r: r["sums"]):
            docs = whole(r["docs"])
            m = len(docs)
            score[docs] += np.frombuffer(r["sums"], "<f4", m)
            base[docs] += np.frombuffer(r["sums"], "<f8", m, 4 * m)
            known[docs] += np.frombuffer(r["sums"], "<u4", m, 12 * m)
        columns = [pa.array(ids, mask=null > 0), pa.array(whole(meta["c"]) == 0), pa.array(n), pa.array(known), pa.array(np.full(len(ids), train_tokens)), pa.array(base), pa.array(score)]
        return pa.Table.from_arrays(columns, [x.split()[0] for x in _OUT.split(", ")])

    return run


def _discount(ones: int, twos: int) -> float:
    """Share of a customer that a table gives up, from how many dishes have one customer and how many two."""
    return min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones else 0.5


def _gathered(sent: DataFrame, model: Model, sweep: int, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums of the totals (kind s) of a sweep over buckets, and of n values of each heavy word."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words, vals = unpack(r["words"]).view(np.int64), [whole(v) for v in r["vals"]]
                key = np.concatenate([np.arange(len(vals[0]))] + [np.full(len(words), i) for i in range(len(vals) - 1)])
                word = pa.array(np.concatenate([np.zeros(len(vals[0]), np.int64), *[words] * (len(vals) - 1)]), mask=np.arange(len(key)) < len(vals[0]))
                yield pa.RecordBatch.from_arrays([pa.array(key), word, pa.array(np.concatenate(vals))], ["key", "word", "n"])

    rows = sent.where((F.col("kind") == "s") & (F.col("sweep") == sweep)).mapInArrow(opened, "key long, word long, n long").groupBy("key", "word").agg(F.sum("n").alias("n")).collect()
    totals = np.array([x["n"] for x in sorted((r for r in rows if r["word"] is None), key=lambda r: r["key"])], np.int64)
    heavy = [np.zeros(len(model.heavy), np.int64) for _ in range(n)]
    for r in rows:  # heavy words: HEAVY_WORDS at most
        if r["word"] is not None:
            heavy[r["key"]][np.searchsorted(model.heavy, np.array([r["word"]], np.int64).view(np.uint64))[0]] = r["n"]
    return totals, heavy


def score(docs: DataFrame, held_out: int = 2, folds: int = 7, sweeps: int = SWEEPS, burn_in: int = BURN_IN, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every document (doc_id, text).

    Documents with crc32(doc_id) % folds = held_out are not learned from. base_score adds one to the counts of words.
    """
    spark = docs.sparkSession
    raw: Column = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = Model(max(1, -(-size // bucket_bytes)), np.zeros(0, np.uint64))
    model.heavy = _heavy(texts, model.buckets, held_out, folds)
    name, path = f"counted_{uuid.uuid4().hex}", f"{shared_dir(spark).rstrip('/')}/counted-{uuid.uuid4().hex}"
    counted = _counted(texts, model, held_out, folds).groupBy("bucket").applyInArrow(_merged, _COUNTED)
    counted.write.partitionBy("kind").bucketBy(model.buckets, "bucket").option("path", path).option("compression", "zstd").saveAsTable(name)
    stored = spark.table(name)
    dishes = stored.where("kind = 'd'")
    if stored.isEmpty():
        return spark.createDataFrame([], _OUT)

    def ask(sent: DataFrame) -> DataFrame:
        return sent.where("kind = 'q'").groupBy("chunk").applyInArrow(_totals, _SENT)

    def meet(left: DataFrame, right: DataFrame, function, schema: str) -> DataFrame:
        return left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(function, schema)

    sent = written(dishes.groupBy("bucket").applyInArrow(_first(model), _SENT), "asked")
    (n, known, ones, twos, few, pairs, customers, served), (count, heavy) = _gathered(sent, model, 0, 2)
    model.tokens, model.counts, model.known = int(n), count, int(known + np.sum(count > 0))
    model.discount = (_discount(few + np.sum(heavy == 1), pairs + np.sum(heavy == 2)), _discount(ones, twos))
    model.parent.append((int(customers + heavy.sum()), int(served + np.sum(heavy > 0)), heavy, np.minimum(heavy, 1)))
    first, state, extra, parent = written(ask(sent), "answered"), None, None, None
    states = []
    for sweep in range(1, sweeps + 1):
        right = first
        for more in (state, extra):
            right = right if more is None else right.union(more)
        sent = written(meet(dishes, right, _swept(model, sweep, sweep == sweeps), _SENT), "swept")
        (customers, tables, *_), (heavy,) = _gathered(sent, model, sweep, 1)
        rng, weight = np.random.default_rng([sweep, 2**31]), np.full(len(heavy), (STRENGTH + model.discount[0] * model.parent[-1][1]) / (model.known + 1))
        if parent is not None:
            parent = seat(rng, heavy, weight, model.discount[0], parent.kept(heavy), np.minimum(model.parent[-1][2], heavy))
        parent = gibbs(rng, heavy, weight, model.discount[0], parent)
        model.parent.append((int(customers + heavy.sum()), int(tables + parent.t.sum()), heavy, parent.t))
        state = sent.where("kind = 't'")
        states.append(state)
        extra = ask(sent)
    kept = list(range(burn_in + 1, sweeps + 1))
    seatings = states[burn_in]
    for more in states[burn_in + 1 :]:
        seatings = seatings.union(more)
    last = written(meet(dishes, seatings, _closing(model, kept), _SENT), "closing")
    right = first.union(seatings).union(ask(last))
    sums = meet(stored.where("kind in ('d', 'o')"), right, _scored(model, kept), _SUMS)
    none = F.lit(None).cast("binary")
    metas = stored.where("kind = 'm'").select("chunk", none.alias("docs"), none.alias("sums"), "words", "k", "n", "c")
    each = sums.select("*", *(none.alias(x) for x in ("words", "k", "n", "c"))).union(metas)
    return each.groupBy("chunk").applyInArrow(_summed(model.tokens), _OUT)
