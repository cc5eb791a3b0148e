from pyspark.sql import functions as F

from ferrule.operators import layouts

PIECES = "format string, pieces array<struct<depth int, kind string, pos long, size long, note string>>"


def test_layouts_by_format(spark):
    rows = [
        ("flac", [(0, "STREAMINFO", 4, 38, None), (0, "PADDING", 42, 12, None), (0, "audio", 54, 90, None), (1, "frame", 54, 6, "0")]),
        ("mkv", [(0, "EBML", 0, 20, None), (1, "DocType", 5, 7, None), (0, "Segment", 20, 99, None), (1, "Void", 28, 9, None), (1, "Cluster", 37, 10, None), (1, "Cluster", 47, 11, None), (2, "x", 48, 1, None), (1, "Void", 58, 2, None)]),
        ("mp3", [(0, "ID3v2", 0, 20, "2.3.0"), (0, "dead", 20, 3, "!dead bytes"), (0, "audio", 23, 400, "fffb9000"), (1, "Xing", 30, 120, None), (0, "APEv2", 423, 60, None), (0, "ID3v1", 483, 128, None)]),
        ("wav", [(0, "RIFF", 0, 99, "WAVE"), (1, "fmt ", 12, 24, None), (1, "data", 36, 50, None)]),
        ("wav", [(0, "RIFF", 0, 99, "WAVE"), (1, "data", 36, 50, None), (1, "LIST", 86, 9, None)]), ("png", [(0, "IHDR", 8, 25, None)]), ("mkv", []), ("mp3", None), (None, None),
    ]
    df = spark.createDataFrame(rows, PIECES).coalesce(1)
    assert [r[0] for r in df.select(layouts.layout(F.col("format"), F.col("pieces"))).collect()] == [
        "| STREAMINFO (34) | PADDING (8) | Audio (90) |", "| Void (9) | Cluster*2 (21) | Void (2) |", "| ID3v2.3 (20) | Dead (3) | Audio (400) | APE (60) | ID3v1 (128) |",
        "| Audio |", "| Audio | Tags |", None, "|", None, None,
    ]


def test_runs_of_many_pieces(spark):
    kinds = "aabbbacca" * 50
    df = spark.createDataFrame([("x", [(0, k, i, i, None) for i, k in enumerate(kinds)]), ("y", []), ("z", None)], PIECES)
    got = {r["format"]: r["runs"] for r in df.select("format", layouts.runs(F.col("pieces")).alias("runs")).collect()}
    expected = []
    for i, k in enumerate(kinds):
        if expected and expected[-1][0] == k:
            expected[-1] = (k, expected[-1][1] + 1, expected[-1][2] + i)
        else:
            expected.append((k, 1, i))
    assert [tuple(r) for r in got["x"]] == expected and got["y"] == [] and got["z"] is None
