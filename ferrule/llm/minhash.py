"""MinHash near-dedup by a multi-index Hamming join.

A document's signature has one 16-bit symbol for each of `symbols` hash functions. Two documents of similarity s differ in
a share 1 - s of their symbols, so all pairs at the threshold lie within a distance `radius` but for a chance of MISS. The
signature is split into radius // 2 + 1 chunks; by pigeonhole every pair within the radius has a chunk with at most one
wrong symbol, so each chunk is indexed once for each symbol that may be wrong (that symbol left out), and every pair within
the radius meets in a bucket, without exception.

Buckets are never expanded into all pairs. Documents with equal sets are one node. First each node is compared with two
nodes of its buckets only, the smallest and the one nearest to the bucket's majority; nodes so linked form components. Then
nodes of buckets that still hold several components are compared across components: two sets can only link if they share
one of their rarest shingles (as many as they may differ in, plus one) early enough in both, so nodes are joined on these,
and pairs count whose bit planes lie within the radius. Links are confirmed on full shingle sets. A link that is not tested
joins two nodes that are in one component already. What is rare is estimated on SAMPLE nodes; any order is exact.

Defined results: a null text, or one without words, has no shingles and links with nothing; a text of fewer than k words
is one shingle; rows are documents, also if they share an id, and get a row each; component_id is the smallest id that is
not null; kept compares null-safely; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.llm.common import FACTORS, components, keep_known, mix, sequence_hashes, word_hashes, written

MISS = 1e-5
#: Nodes on which the frequency of shingles is estimated.
SAMPLE = 4096
_SEEDS = np.random.default_rng(85).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
NO_ID = -(2**63)


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z are lower-cased."""
    for _, words, bounds in word_hashes(texts, lower=True):
        runs = sequence_hashes(words, k)
        for i in range(len(bounds) - 1):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= k:
                yield np.unique(runs[a : b - k + 1])
            elif b > a:
                yield mix((words[a:b] * FACTORS[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def radius_for(symbols: int, percent: int, miss: float = MISS) -> int:
    """The smallest odd distance that a pair at the threshold exceeds with a chance of at most miss."""
    p, tail, r = 1 - percent / 100, 1.0, -1
    while tail > miss or r % 2 == 0:
        r += 1
        tail -= math.comb(symbols, r) * p**r * (1 - p) ** (symbols - r)
    return r


def signature(shingles: np.ndarray, symbols: int) -> np.ndarray:
    """The low 16 bits of the least of each hash function's values."""
    out = np.empty(symbols, np.uint64)
    for at in range(0, symbols, 16):
        hashed = shingles[:, None] * _SEEDS[0, None, at : at + 16] + _SEEDS[1, None, at : at + 16]
        out[at : at + 16] = hashed.min(axis=0)
    return mix(out).astype(np.uint16)


def planes(signatures: np.ndarray) -> list[np.ndarray]:
    """Two bits of every symbol, as signed 64-bit words; words of the first bit come first."""
    out = []
    for bit in (0, 1):
        bits = (signatures >> bit & 1).astype(np.uint8)
        padded = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), np.uint8)
        padded[:, : bits.shape[1]] = bits
        out += list(np.packbits(padded, axis=1, bitorder="little").view("<i8").T)
    return out


def index_keys(signatures: np.ndarray, chunks: int) -> np.ndarray:
    """For each signature, one key per symbol: its chunk with this symbol left out."""
    n, symbols = signatures.shape
    wide = mix(signatures.astype(np.uint64) + (np.arange(symbols, dtype=np.uint64) << np.uint64(16)) + np.uint64(1))
    edges = np.linspace(0, symbols, chunks + 1).astype(int)
    keys = np.empty((n, symbols), np.uint64)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        whole = wide[:, a:b].sum(axis=1, dtype=np.uint64)
        keys[:, a:b] = whole[:, None] - wide[:, a:b]
    return mix(keys + np.arange(symbols, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _sketch(docs: DataFrame, k: int, symbols: int) -> DataFrame:
    words = -(-symbols // 64) * 2
    names = ["id0", "th", "doc_id", "n_shingles", "h1", "h2", "sig", *(f"p{i}" for i in range(words))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(3).to_pylist()
            n, h1, h2 = (np.zeros(len(raw), t) for t in (np.int64, np.uint64, np.uint64))
            sigs = np.zeros((len(raw), symbols), np.uint16)
            for i, s in enumerate(shingle_sets(raw, k)):
                n[i] = len(s)
                if len(s):
                    h1[i] = s.sum(dtype=np.uint64)
                    h2[i] = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                    sigs[i] = signature(s, symbols)
            sig = pa.array([x.tobytes() for x in sigs], pa.binary())
            columns = [pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), sig, *map(pa.array, planes(sigs))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], names)

    schema = "id0 long, th long, doc_id long, n_shingles long, h1 long, h2 long, sig binary, " + ", ".join(f"p{i} long" for i in range(words))
    return _keyed(docs).select("id0", "th", "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw")).mapInArrow(run, schema)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a key of the row's id and text."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), "text", F.coalesce(doc_id, F.lit(NO_ID)).alias("id0"), F.xxhash64("text").alias("th"))


def _index(nodes: DataFrame, symbols: int, chunks: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, symbols)
            for at in range(0, len(sigs), 2000):
                keys = index_keys(sigs[at : at + 2000], chunks)
                nodes_at = np.repeat(batch.column(0).to_numpy()[at : at + 2000], symbols)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes_at)], ["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def _distance(a: str, b: str, words: int) -> Column:
    """A lower bound of the signature distance of two rows with planes."""
    half = words // 2
    return sum((F.bit_count(F.col(f"{a}p{i}").bitwiseXOR(F.col(f"{b}p{i}")).bitwiseOR(F.col(f"{a}p{i + half}").bitwiseXOR(F.col(f"{b}p{i + half}")))) for i in range(half)), F.lit(0))


def _texts(needed: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the nodes in needed (column node, distinct)."""
    places = written(nodes.join(needed, "node", "left_semi").select("node", "id0", "th"), "near-places")
    texts = keep_known(_keyed(docs), places.select("id0", "th"), ["id0", "th"]).select("id0", "th", F.col("text").cast("binary").alias("text"))
    return written(texts.join(places, ["id0", "th"]).select("node", "text").dropDuplicates(["node"]), "near-texts")


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough."""
    both = pairs.join(texts.toDF("a", "left"), "a").join(texts.toDF("b", "right"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                left, right = ([*shingle_sets(part.column(i).to_pylist(), k)] for i in (2, 3))
                same = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)]
                good = [100 * n >= percent * (len(x) + len(y) - n) for n, x, y in zip(same, left, right, strict=True)]
                yield part.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _frequent(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that at least two of SAMPLE nodes have, sorted, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in shingle_sets(batch.column(0).to_pylist(), k):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["shingle"])

    names = texts.select("node").orderBy(F.xxhash64("node"), "node").limit(SAMPLE)
    some = texts.join(F.broadcast(names), "node").select("text").repartition(8)
    got = some.mapInArrow(run, "shingle long").groupBy("shingle").count().where("count > 1").orderBy(F.desc("count"), "shingle").limit(1_000_000).toArrow()
    shingles, counts = (got.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(shingles.view(np.uint64))
    return shingles.view(np.uint64)[order], counts[order]


def _rarest(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, shingle, at, size): the rarest shingles of each set, at least one of which any similar set has too."""
    shared = texts.sparkSession.sparkContext.broadcast(_frequent(texts, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, s in enumerate(shingle_sets(batch.column(1).to_pylist(), k)):
                n = len(s) - -(-percent * len(s) // 100) + 1
                place = np.searchsorted(known, s)
                place[place == len(known)] = 0
                often = np.where(known[place] == s, counts[place], 0) if len(known) else np.zeros(len(s), np.int64)
                first = s[np.lexsort((s, often))[:n]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, names[i])), pa.array(first.view(np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, len(s), np.int32))], ["node", "shingle", "at", "size"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingle long, at int, size int")


def _across(mixed: DataFrame, texts: DataFrame, k: int, percent: int, radius: int, words: int) -> DataFrame:
    """Pairs of nodes of different components (node, c, planes) that may link: shared rare shingles, and within the radius."""
    bits = [f"p{i}" for i in range(words)]
    of_shingle = Window.partitionBy("shingle")
    rare = _rarest(texts, k, percent).join(mixed, "node")
    rare = rare.withColumns({"least": F.min("c").over(of_shingle), "most": F.max("c").over(of_shingle)}).where("least < most")
    rare = rare.withColumn("same", F.count("*").over(Window.partitionBy("shingle", "c"))).withColumn("main", F.max(F.struct("same", "c")).over(of_shingle)["c"])
    rare = written(rare.select("shingle", "node", "at", "size", "c", "main", *bits), "near-rare")
    others = rare.where("c <> main").select("shingle", *(F.col(x).alias(f"x{x}") for x in ("node", "at", "size", "c", *bits)))
    different = (F.col("xc") != F.col("c")) & ((F.col("c") == F.col("main")) | (F.col("xnode") < F.col("node")))
    left = F.least(F.col("size") - F.col("at"), F.col("xsize") - F.col("xat"))  # no more can be shared, if this is the first
    enough = left * (100 + percent) >= (F.col("size") + F.col("xsize")) * percent
    more = others.join(rare, "shingle").where(different & enough & (_distance("x", "", words) <= radius))
    return more.select(F.least("xnode", "node").alias("a"), F.greatest("xnode", "node").alias("b")).distinct()


def _hubs(buckets: DataFrame, radius: int, words: int) -> DataFrame:
    """(a, b): each node with up to three nodes of its buckets.

    These are the nearest of the buckets' smallest nodes, and, of the nodes next to their bucket's majority, the nearest and
    that of the largest bucket.
    """
    bits = [f"p{i}" for i in range(words)]
    planes_of = [f"p{i}" for i in range(words // 2)]
    ones = [F.sum(F.shiftright(p, b).bitwiseAND(F.lit(1))).alias(f"{p}_{b}") for p in planes_of for b in range(64)]
    sums = buckets.groupBy("key").agg(F.count("*").alias("n"), *ones)
    power = lambda b: F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("long")
    major = [F.array(*(F.when(F.col(f"{p}_{b}") * 2 > F.col("n"), power(b)).otherwise(F.lit(0).cast("long")) for b in range(64))) for p in planes_of]
    summed = [F.aggregate(x, F.lit(0).cast("long"), lambda acc, v: acc.bitwiseOR(v)).alias(f"m{i}") for i, x in enumerate(major)]
    near = buckets.join(sums.select("key", "n", *summed), "key")
    off = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"m{i}"))) for i, p in enumerate(planes_of)), F.lit(0))
    of_key = Window.partitionBy("key")
    near = near.withColumn("off", off).withColumns({"mid": F.min(F.struct("off", "node", *bits)).over(of_key), "low": F.min(F.struct("node", *bits)).over(of_key)})
    pairs = None
    for name, first in (("mid", F.lit(0)), ("mid", -F.col("n")), ("low", F.lit(0))):
        one = near.select("node", first.alias("first"), *bits, F.col(f"{name}.node").alias("hub"), *(F.col(f"{name}.{b}").alias(f"hub_{b}") for b in bits)).where("node <> hub")
        one = one.withColumn("off", _distance("", "hub_", words)).where(F.col("off") <= radius).groupBy("node").agg(F.min(F.struct("first", "off", "hub"))["hub"].alias("hub"))
        pairs = one if pairs is None else pairs.union(one)
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, symbols: int = 96) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and id0 and th (id and text hash) of every row.

    Documents link if 100 * intersection >= percent * union of their sets of k-word shingles.
    """
    radius = radius_for(symbols, percent)
    chunks, words = radius // 2 + 1, -(-symbols // 64) * 2
    bits = [f"p{i}" for i in range(words)]
    rows = written(_sketch(docs, k, symbols), "near-rows")
    nodes = rows.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min_by(F.struct("id0", "th"), F.struct("id0", "th")).alias("at"), F.first("sig").alias("sig"), *(F.first(b).alias(b) for b in bits))
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "at.id0", "at.th", "sig", *bits)
    nodes = written(nodes, "near-nodes")  # fixes the node numbers

    of_key = Window.partitionBy("key")
    shared = _index(nodes, symbols, chunks).withColumn("n", F.count("*").over(of_key)).where("n > 1")
    buckets = written(shared.select("key", "node").join(nodes.select("node", *bits), "node"), "near-buckets")

    first = written(_hubs(buckets, radius, words), "near-first")
    texts = _texts(first.select(F.col("a").alias("node")).union(first.select("b")).distinct(), nodes, docs)
    links = written(_confirmed(first, texts, k, percent), "near-links")
    labels = components(links)

    marked = buckets.join(labels, "node", "left").withColumn("c", F.coalesce("label", "node")).drop("label")
    marked = marked.withColumns({"least": F.min("c").over(of_key), "most": F.max("c").over(of_key)}).where("least < most")
    mixed = written(marked.select("node", "c", *bits).distinct(), "near-mixed")
    texts = _texts(mixed.select("node"), nodes, docs)
    more = written(_across(mixed, texts, k, percent, radius, words).join(first, ["a", "b"], "left_anti"), "near-more")
    links = links.union(_confirmed(more, texts, k, percent))
    labels = components(links)

    named = nodes.join(labels, "node", "left").select("h1", "h2", F.coalesce("label", "node").alias("c"))
    named = rows.select("h1", "h2", "doc_id", "n_shingles", "id0", "th").join(named, ["h1", "h2"], "left")
    named = written(named.select("doc_id", "n_shingles", "id0", "th", "c"), "near-named")
    least = named.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"))
    out = named.join(least, "c", "left")
    component = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "id0", "th")


def kept(docs: DataFrame, k: int = 5, percent: int = 80, symbols: int = 96) -> DataFrame:
    """One row of docs, with all its columns, for each group of near-duplicates."""
    stay = near_duplicates(docs, k, percent, symbols).where("kept").select(F.col("id0").alias("_id0"), F.col("th").alias("_th")).distinct()
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    marked = docs.select(doc_id.alias("_id0"), F.xxhash64("text").alias("_th"), F.struct(*docs.columns).alias("_row")).join(stay, ["_id0", "_th"], "left_semi")
    return marked.dropDuplicates(["_id0", "_th"]).select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
