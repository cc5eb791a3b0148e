import random
import zlib

from pyspark.sql import functions as F

from ferrule.functions import checksums
from ferrule.operators.ordering import summed


def bit_by_bit(data, width, poly, reflected):
    """The definition: one shift for each bit."""
    state = 0
    for byte in data:
        for i in range(8):
            if reflected:
                state ^= byte >> i & 1
                state = state >> 1 ^ poly if state & 1 else state >> 1
            else:
                state ^= (byte >> (7 - i) & 1) << (width - 1)
                state = ((state << 1) ^ (poly if state >> (width - 1) & 1 else 0)) & ((1 << width) - 1)
    return state


SIZES = [0, 1, 5, 127, 128, 129, 255, 256, 257, 511, 512, 513, 2000]


def test_lanes_and_parts_agree_with_the_definition(monkeypatch):
    rng = random.Random(4)
    values = [None, *(rng.randbytes(n) for n in SIZES), bytes(300), b"\0" * 7 + b"x"]
    for part in (checksums.PART, 600):  # the latter cuts values and batches
        monkeypatch.setattr(checksums, "PART", part)
        for kind, spec in checksums.CRCS.items():
            expected = [None if v is None else bit_by_bit(v, *spec) for v in values]
            assert checksums.crcs(values, kind) == expected
            assert [None if v is None else checksums.crc(v, *spec) for v in values] == expected


def test_pieces_are_merged_at_every_split(spark):
    data = random.Random(6).randbytes(40)
    rows = []
    for cut in range(len(data) + 1):
        rows += [(cut, cut, data[cut:]), (cut, 0, data[:cut])]
    df = spark.createDataFrame([(k, p, len(d), bytearray(d)) for k, p, d in rows], "key int, pos long, size long, data binary").repartition(5)
    for kind, spec in checksums.MERGED.items():
        own = F.crc32("data") if kind == "crc32" else checksums.crc_column(kind, F.col("data"))
        got = checksums.merged(df.withColumn("crc", own), kind, "key").collect()
        want = zlib.crc32(data) if kind == "crc32" else bit_by_bit(data, *spec)
        assert len(got) == 41 and {(r["size"], r["n_missing"], r["crc"]) for r in got} == {(40, 0, want)}


def test_gaps_nulls_and_large_places(spark):
    far = (1 << 40) + 3
    rows = [("gap", 0, 2, 1), ("gap", 3, 2, 1), ("null", 0, 2, None), ("null", 2, 2, 7), ("empty", 0, 0, 0), ("far", 0, far, 0), ("far", far, 1, 9), (None, 0, 1, 5)]
    df = spark.createDataFrame(rows, "key string, pos long, size long, crc long")
    got = {r["key"]: tuple(r)[1:] for r in checksums.merged(df, "crc16r", "key").collect()}
    assert got == {"gap": (5, 1, None), "null": (4, 0, None), "empty": (0, 0, 0), "far": (far + 1, 0, 9), None: (1, 0, 5)}
    assert checksums.merged(df.limit(0), "crc8", "key").count() == 0


def test_sums_before_a_row_of_a_skewed_group(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot"] * 6 + [None, "a"]), k, rng.choice([None, 0, rng.randrange(90)])) for k in range(800)]
    df = spark.createDataFrame(rows, "folder string, id long, size long").repartition(6)
    expected, total = {}, {}
    for g, k, n in rows:
        expected[k] = total.get(g, 0)
        total[g] = total.get(g, 0) + (n or 0)
    assert {r["id"]: r["before"] for r in summed(df, ["folder"], ["id"], "size").collect()} == expected
    assert summed(df.limit(0), ["folder"], ["id"], "size").count() == 0
