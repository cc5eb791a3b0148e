import csv

from pyspark.sql import functions as F

from ferrule.__main__ import main
from ferrule.operators import registry, report, structures


def test_registered_and_hidden_formats(spark, monkeypatch):
    monkeypatch.setattr(registry, "FORMATS", list(registry.FORMATS))
    monkeypatch.setattr(structures, "WALKERS", dict(structures.WALKERS))

    @registry.file_format(["zap", "zapp"], magic=("5A415001", "5A415002"), rules=([(2, "4242"), (6, "43")],))
    def zap(data):
        yield structures.piece("all", 0, len(data), note="zapped")

    registry.file_format(["tmp"], sub="*hidden*")
    rows = [("/a/x.zap", "zap", b"ZAP\x01rest"), ("/a/y.png", "png", b"ZAP\x02"), ("/a/z.zapp", "zapp", b"..BB..C"), ("/a/w.zap", "zap", b"no"), ("/a/t.tmp", "tmp", b"GIF89a"), ("/a/Thumbs.db", "db", b"x"), ("/a/other.db", "db", b"GIF89a"), ("/a/q", None, b"GIF89a"), ("/a/n.gif", "gif", None)]
    df = spark.createDataFrame([(p, e, None if c is None else bytearray(c)) for p, e, c in rows], "path string, ext string, content binary")
    got = {r["path"]: (r["format"], r["is_misnamed"], r["is_hidden"]) for r in registry.identify(df).collect()}
    assert got == {
        "/a/x.zap": ("zap/zapp", False, False), "/a/y.png": ("zap/zapp", True, False), "/a/z.zapp": ("zap/zapp", False, False), "/a/w.zap": (None, False, False), "/a/t.tmp": (None, False, True),
        "/a/Thumbs.db": ("db (Thumbs)", False, False), "/a/other.db": (None, False, True), "/a/q": (None, False, False), "/a/n.gif": (None, False, False),
    }
    walked = structures.structures(df.withColumn("format", F.lit("zap")).limit(1), "path")
    assert [r["note"] for r in walked.collect()] == ["zapped"]


def test_bytes_are_escaped(spark):
    data = bytes(range(256))
    df = spark.createDataFrame([(bytearray(data),), (bytearray(b""),), (None,)], "b binary")
    expected = "".join(chr(b) if 0x20 <= b <= 0x7F else f"\\{b:02x}" for b in data)
    assert [r[0] for r in df.select(report.escaped(F.col("b"))).collect()] == [expected, "", None]


def test_reports_are_in_order_and_the_same_everywhere(spark, tmp_path, capsys):
    root = tmp_path / "in"
    for d in ("b", "a"):
        (root / d).mkdir(parents=True)
        for n in ("z.md5", "list.md5"):
            (root / d / n).write_text("00112233445566778899aabbccddeeff *gone.bin\n")
        (root / d / "a.cue").write_text('FILE "gone.wav" WAVE\n')
        (root / d / "thing.bin").write_bytes(b"x")
    assert main([str(root), "--scope", "detail", "--hash", "filemd5"]) == 5
    console = [x for x in capsys.readouterr().out.split("\n") if x and not x.endswith("misnamed")]
    names = [x.rsplit("/", 2)[1:] for x in console if x.startswith("file:")]
    assert names == [[d, n] for d in "ab" for n in ("list.md5", "thing.bin", "z.md5", "a.cue")]
    assert console.count("File size = 43") == 4 and "(md5)" in console and sum(x.startswith("File MD5  = ") for x in console) == 8
    assert main([str(root), "--scope", "detail", "--hash", "filemd5", "--out", str(tmp_path / "out")]) == 5
    written = [row[1] for p in sorted((tmp_path / "out").glob("part-*.csv")) for row in csv.reader(p.open(newline=""), delimiter="\t", escapechar="\\")]
    assert written == console
