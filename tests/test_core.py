import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ferrule import options, plans
from ferrule.__main__ import main
from ferrule.functions import bytesfn
from ferrule.operators import folder, issues, lists, report, ripping
from ferrule.operators.diagnose import diagnose
from ferrule.options import Options, Tag
from ferrule.sources import files
from ferrule.streaming import watch

from .test_structures import FILES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.6g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.sql(plans.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_crc32_query(spark):
    got = {x.doc_id: x.crc for x in plans.QUERIES["q_crc32"](spark, SF).collect()}
    assert got == {x.doc_id: zlib.crc32(x.text.encode()) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_checksums():
    # Remainders of "123456789" under the four polynomials.
    for kind, want in {"crc8": 0xF4, "crc16n": 0xFEE8, "crc16r": 0xBB3D, "crc32n0": 0x89A1897F}.items():
        assert bytesfn.crc(b"123456789", *bytesfn.CRCS[kind]) == want


def test_scalars(spark):
    df = spark.createDataFrame([(bytearray(b"\xff\xfe\x00\x01"), 614, 0x7F7F7F7F, 0x80)], "b binary, n long, s long, t long")
    row = df.select(
        bytesfn.be_uint(F.col("b"), 0, 2).alias("be"), bytesfn.le_uint(F.col("b"), 0, 4).alias("le"), bytesfn.be_uint(F.col("b"), 3, 2).alias("beyond"),
        bytesfn.signed(bytesfn.be_uint(F.col("b"), 0, 2), 16).alias("signed"), bytesfn.bit_string(F.col("n"), 10).alias("bits"),
        bytesfn.syncsafe(F.col("s")).alias("sync"), bytesfn.syncsafe(F.col("t")).alias("bad"), bytesfn.crc_column("crc8", F.col("b")).alias("crc"),
    ).first()
    assert tuple(row) == (0xFFFE, 0x0100FEFF, None, -2, "10 0110 0110", (1 << 28) - 1, None, bytesfn.crc(b"\xff\xfe\x00\x01", *bytesfn.CRCS["crc8"]))


def test_variable_length_integers():
    for n in (0, 0x7F, 0x80, 0x7FF, 0x800, 0xFFFF):
        assert bytesfn.read_varint(chr(n).encode("utf-8", "surrogatepass")) == (n, len(chr(n).encode("utf-8", "surrogatepass")))
    assert bytesfn.read_varint(bytes([0xFE] + [0xBF] * 6)) == ((1 << 36) - 1, 7)
    assert bytesfn.read_varint(b"\x80")[0] is None
    assert bytesfn.read_varint(b"\xc3A")[0] is None
    assert bytesfn.read_varint(b"") == (None, 0)
    assert bytesfn.read_vint(b"\x81") == (1, 1)
    assert bytesfn.read_vint(b"\x40\x02") == (2, 2)
    assert bytesfn.read_vint(b"\x1a\x45\xdf\xa3", marker=True) == (0x1A45DFA3, 4)
    assert bytesfn.read_vint(b"\x00") == (None, 0)


def test_options():
    o = options.parse(["root", "--hash", "FileMD5,file_sha1", "--strict", "--warn", "badtag", "--scope", "terse"])
    assert o.hashes == options.Hashes.FILE_MD5 | options.Hashes.FILE_SHA1
    assert o.strict and o.warn & Tag.BAD_TAG and o.scope == options.Scope.TERSE
    with pytest.raises(SystemExit):
        options.parse(["root", "--hash", "nothing"])


def test_escalation(spark):
    rows = [(b, t) for b in range(7) for t in (0, 1, 2, 3)]
    got = spark.createDataFrame(rows, "b int, t int").select("b", "t", issues.effective_level(F.col("b"), F.col("t"), 1, 2).alias("e")).collect()
    for x in got:
        want = x.b
        if x.b <= 4 and x.t & 2:
            want = 5
        elif x.b < 4 and x.t & 1:
            want = 4
        assert x.e == want


def test_greedy_match_equals_the_loop(spark):
    import random

    rng = random.Random(3)
    left = [(d, i, rng.choice([None, 1, 2, 3])) for d in range(20) for i in range(6)]
    right = [(d, i, rng.choice([None, 1, 2, 3])) for d in range(20) for i in range(5)]
    got = folder.greedy_match(*(spark.createDataFrame(x, "d int, pos int, crc int") for x in (left, right)), ["d"], "crc", "pos").collect()
    for d in range(20):
        free = [x for x in left if x[0] == d]
        for _, pos, crc in (x for x in right if x[0] == d):
            hit = next((x for x in free if x[2] == crc), None)
            if hit:
                free.remove(hit)
            row = next(x for x in got if x.d == d and x.right_pos == pos)
            assert (row.left_pos, row.in_place) == (hit and hit[1], bool(hit) and hit[1] == pos)


def test_three_valued_sameness(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None), (3, ""), (4, "a"), (4, None)], "k int, v string")
    assert {x.k: x.s for x in df.groupBy("k").agg(folder.all_same(F.col("v")).alias("s")).collect()} == {1: True, 2: False, 3: None, 4: False}


def test_digest_list_grammar(spark):
    h = "0123456789abcdef0123456789ABCDEF"
    text = [f"{h} *a b.txt", "", "; comment", f"{h} :m", f"name {h}", f"{h}?bad and long enough", "short", f"{h} *after"]
    df = spark.createDataFrame([("l", i + 1, x) for i, x in enumerate(text)], "list string, line_no long, line string")
    got = [(x.line_no, x.status, x.mode, x.name) for x in lists.parse_digests(df, 32, "list").orderBy("line_no").collect()]
    assert got == [(1, "ok", "Binary", "a b.txt"), (4, "ok", "Media", "m"), (5, "swapped", "Text", "name"), (6, "malformed", None, None), (7, "too short", None, None)]


def test_digest_report_is_a_digest_list(spark):
    df = spark.createDataFrame([("p", "n.flac", "a" * 40, None, "b" * 40)], "path string, name string, file_sha1 string, meta_sha1 string, media_sha1 string")
    lines = report.digest_lines(df).withColumns({"list": F.lit("l"), "line_no": F.monotonically_increasing_id()})
    assert {(x.mode, x.stored) for x in lists.parse_digests(lines, 40, "list").collect()} == {("Media", "b" * 40), ("Binary", "a" * 40)}


LOG = """Exact Audio Copy V0.99

Artist / Album

Used drive  : PLEXTOR   Adapter: 1
Read mode : Secure
Utilize accurate stream : Yes

Track  1

     Filename C:\\x\\01 - A.wav
     Peak level 50.1 %
     Track quality 100.0 %
     Test CRC 6522DF69
     Copy CRC 6522DF69
     Copy OK

Track  2

     Filename C:\\x\\02 - B.wav
     Copy CRC 003E740D

No errors occured

End of status report
"""
CUE = 'CATALOG 0000000000000\nFILE "01 - A.wav" WAVE\n  TRACK 01 AUDIO\n  FILE "02 - B.wav" WAVE\nCATALOG 12\n'


def test_rip_log_and_cue(spark):
    lines = files.text_lines(spark.createDataFrame([("d", LOG.replace("\n", "\r\n"))], "dir string, text string"), "text", "dir")
    tracks = ripping.log_tracks(lines, ripping.EAC, "dir")
    got = [(x.number, x.test_crc, x.copy_crc, x.has_ok, x.quality) for x in tracks.orderBy("idx").collect()]
    assert got == [(1, 0x6522DF69, 0x6522DF69, True, "100.0"), (2, None, 0x003E740D, False, None)]
    assert tuple(ripping.log_faults(lines, "dir").first())[1:] == (False, True)
    assert {x.name: x.value for x in ripping.log_headers(lines, "dir").collect()}["Read mode"] == "Secure"
    audio = spark.createDataFrame([("d", 1, 0x6522DF69), ("d", 2, 0x003E74D0)], "dir string, idx long, crc long")
    bad = ripping.validate_rip(tracks, audio, "dir").first()
    assert (bad.n_mismatch, bad.verdict) == (1, "failed")
    good = spark.createDataFrame([("d", 1, 0x6522DF69), ("d", 2, 0x003E740D)], "dir string, idx long, crc long")
    assert ripping.validate_rip(tracks, good, "dir").first().verdict == "success"
    cue = files.text_lines(spark.createDataFrame([("d", CUE)], "dir string, text string"), "text", "dir")
    items = ripping.cue_items(cue, "dir")
    assert [x.name for x in items.orderBy("idx").collect()] == ["01 - A.wav", "02 - B.wav"]
    assert sorted(x.is_valid for x in ripping.cue_catalogs(cue, "dir").collect()) == [False, True]
    names = spark.createDataFrame([("d", 1, "01 - A.flac"), ("d", 2, "02 - B.flac")], "dir string, idx long, name string")
    assert [x.new_name for x in ripping.fixed_cues(items, names, "dir").orderBy("idx").collect()] == ["01 - A.flac", "02 - B.flac"]


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, data in FILES.items():
        (tmp_path / "in" / "sub" / name).write_bytes(data)
    (tmp_path / "in" / "fake.png").write_bytes(FILES["icon.ico"])
    (tmp_path / "in" / "marked.mp4").write_bytes(FILES["film.mp4"] + b"mark!")
    broken = bytearray(FILES["tile.png"])
    broken[18] ^= 1
    (tmp_path / "in" / "broken.png").write_bytes(broken)
    (tmp_path / "in" / "empty.db").write_bytes(b"")
    return tmp_path / "in"


def test_diagnose(spark, tree):
    found = diagnose(spark, Options(root=str(tree), hashes=options.Hashes.FILE_MD5))
    worst = {x.name: x.level for x in found["issues"].join(found["files"].select("path", "name"), "path").groupBy("name").agg(F.max("level").alias("level")).collect()}
    assert (worst["fake.png"], worst["marked.mp4"], worst["broken.png"]) == (4, 4, 5)
    assert all(worst.get(n, 0) <= 1 for n in FILES)
    assert {x.kind for x in found["plans"].collect()} == {"trim", "rename"}
    rollup = {x.format: x for x in found["rollup"].collect()}
    assert (rollup["png"].total, rollup["png"].data_errors) == (2, 1)
    assert report.exit_code(found["issues"]) >= 5


def test_scan_options(spark, tree):
    assert files.scan(spark, str(tree), "*.png").count() == 3
    assert files.scan(spark, str(tree), None, ["/sub/"]).count() == 3  # empty files have no row
    first = files.scan(spark, str(tree), "tile.png").first()
    assert (first.name, first.ext, first.size) == ("tile.png", "png", len(FILES["tile.png"]))


def test_command_line(spark, tree, tmp_path, capsys):
    assert main([str(tree), "--scope", "quiet"]) >= 5
    assert "* Error: " in capsys.readouterr().out
    assert main([str(tree), "--out", str(tmp_path / "report")]) >= 5
    assert list((tmp_path / "report").glob("*.csv"))


def test_streams(spark, tree, tmp_path):
    q = watch.pieces(watch.arriving(spark, str(tree))).writeStream.format("memory").queryName("pieces").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("pieces").where("kind = 'IHDR'").count() == 2
    events = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).parquet(f"{SF}/events*.parquet")
    leveled = events.select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", 5).otherwise(1).alias("level"))
    q = watch.levels_by_window(leveled).writeStream.format("memory").queryName("levels").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("levels").count() > 0
