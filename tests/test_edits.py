import random

from pyspark.sql import functions as F

from ferrule.operators import edits, repair
from ferrule.operators.diagnose import diagnose
from ferrule.options import Options
from ferrule.sources import files as source
from tests.test_folder_run import sound
from tests.test_structures import FILES


def scripted(spark, rows):
    df = spark.createDataFrame([(k, bytearray(c), [("x", *s[:2], bytearray(s[2])) for s in sp]) for k, (c, sp) in enumerate(rows)], f"k int, content binary, splices array<{edits.SPLICE}>")
    return {r["k"]: None if r["c"] is None else bytes(r["c"]) for r in df.select("k", edits.applied(F.col("content"), F.col("splices")).alias("c")).collect()}


def test_scripts_compose_and_overlaps_are_refused(spark):
    rng, rows, expected = random.Random(6), [], {}
    for k in range(60):
        data = bytes(rng.randrange(256) for _ in range(rng.randrange(0, 50)))
        at, sp, out = 0, [], b""
        while rng.random() < 0.8 and at < len(data):
            start = rng.randrange(at, len(data))
            cut = rng.randrange(0, len(data) - start + 1)
            put = bytes(rng.randrange(256) for _ in range(rng.randrange(0, 4)))
            sp.append((start, cut, put))
            out += data[at:start] + put
            at = start + cut + (cut == 0)
            out += data[start:at] if cut == 0 else b""
        rng.shuffle(sp)
        rows.append((data, sp))
        expected[k] = out + data[at:]
    rows += [(b"abcdef", [(1, 3, b""), (3, 1, b"x")]), (b"abc", [(2, 2, b"")]), (b"abc", [(-1, 1, b"")]), (b"abc", [(1, 0, b"p"), (1, 0, b"q")]), (b"", [(0, 0, b"new")])]
    expected |= {60: None, 61: None, 62: None, 63: None, 64: b"new"}
    assert scripted(spark, rows) == expected


def flac_with(padding, picture):
    block = lambda kind, n, last=0: bytes([kind | last]) + n.to_bytes(3, "big") + bytes(n)
    audio = sound(1)[4 + 38 + 4 :]
    return b"fLaC" + block(0, 34) + block(6, picture) + block(1, padding, 0x80) + audio


def test_repairs_before_and_after(spark, tmp_path):
    root, copies = tmp_path / "in", tmp_path / "out"
    root.mkdir()
    copies.mkdir()
    lame = FILES["lame.mp3"]
    tag = b"TAG" + bytes(125)
    (root / "phantom.mp3").write_bytes(lame + tag + tag)
    audio = b"\xff\xfb\x90\x00" + bytes(600)
    over = b"ID3\x03\0\0\0\0\x01\x01" + bytes(128) + audio
    (root / "over.mp3").write_bytes(over)
    (root / "fat.flac").write_bytes(flac_with(700_000, 600_000))
    (root / "art.flac").write_bytes(flac_with(100, 1_200_000))
    (root / "fine.flac").write_bytes(flac_with(100, 100))
    (root / "sheet.cue").write_bytes(b'TITLE "\xe9"\r\nFILE "x.wav" WAVE\r\n  TRACK 01\r\nFILE "longer name.wav" WAVE\r\nFILE "3" WAVE')
    marked = bytearray(FILES["film.mp4"] + b"mark!")
    (root / "marked.mp4").write_bytes(marked)
    found = diagnose(spark, Options(root=str(root), repair=True))
    levels = {r["name"]: (r["max_level"], r["n_repairable"]) for r in found["issues"].groupBy("path").agg(F.max("level").alias("max_level"), F.count("repair_kind").alias("n_repairable")).join(found["files"], "path").collect()}
    assert levels["phantom.mp3"] == (4, 1) and levels["over.mp3"] == (4, 1) and levels["fat.flac"] == (4, 1) and levels["sheet.cue"] == (4, 1)
    assert levels["art.flac"] == (2, 0) and levels.get("fine.flac", (0, 0))[1] == 0
    files = source.scan(spark, str(root))
    done = repair.write_copies(files, found["plans"], str(copies), confirmed=True)
    assert all(r["ok"] for r in done.collect()) and done.count() == 5
    got = {p.name[9:]: p.read_bytes() for p in copies.iterdir()}
    assert got["phantom.mp3"] == lame + tag and got["over.mp3"] == over[:9] + b"\x00" + over[10:] and got["marked.mp4"] == FILES["film.mp4"]
    assert len(got["fat.flac"]) == len(flac_with(4096, 600_000)) and got["fat.flac"] == flac_with(4096, 600_000)
    assert got["sheet.cue"] == b'TITLE "\xe9"\r\nFILE "art.flac" WAVE\r\n  TRACK 01\r\nFILE "fat.flac" WAVE\r\nFILE "fine.flac" WAVE'
    again = diagnose(spark, Options(root=str(copies)))  # repaired files are clean, but for the sheet, whose folder is another
    assert {r["repair_kind"] for r in again["issues"].collect()} == {None}
    assert again["issues"].join(again["files"].where("ext <> 'cue'"), "path").where("level >= 4").count() == 0


def test_copies_are_staged_first_and_broken_ones_refused(spark, tmp_path):
    tile = bytearray(FILES["tile.png"])
    rows = [("/x/a.png", "a.png", tile), ("/x/b.png", "b.png", tile), ("/x/c.png", "c.png", tile), ("/x/d.bin", "d.bin", bytearray(b"plain"))]
    df = spark.createDataFrame(rows, "path string, name string, content binary")
    plan = spark.createDataFrame([("/x/a.png", "trim", 20, 1, None, None), ("/x/b.png", "rename", None, None, None, "new.png"), ("/x/c.png", "rename", None, None, None, "c2.png"), ("/x/d.bin", "trim", 0, 2, bytearray(b"P"), None), ("/x/d.bin", "trim", 1, 1, None, None)], "path string, kind string, offset long, cut long, insert binary, new_name string")
    levels = spark.createDataFrame([("/x/c.png", 5), ("/x/b.png", 4)], "path string, max_level int")
    out = {r["path"]: (r["ok"], r["error"]) for r in repair.write_copies(df, plan, str(tmp_path), True, levels).collect()}
    assert out["/x/b.png"] == (True, None) and out["/x/c.png"] == (False, "file has errors") and out["/x/d.bin"] == (False, "splices overlap")
    assert not out["/x/a.png"][0] and "checksums fail" in out["/x/a.png"][1] + "checksums fail" * ("faults" in out["/x/a.png"][1])
    assert [p.name[9:] for p in tmp_path.iterdir()] == ["new.png"]  # no staging folder, no half files
    again = {r["path"]: r["ok"] for r in repair.write_copies(df, plan.where("path = '/x/b.png'"), f"file://{tmp_path}", True).collect()}
    assert again == {"/x/b.png": True} and len(list(tmp_path.iterdir())) == 1


def test_moving_twice_does_no_harm_and_lost_copies_are_told(tmp_path):
    import pyarrow as pa

    (tmp_path / "job").mkdir()
    (tmp_path / "job" / "s1").write_bytes(b"one")
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (["p1", "p2"], ["t1", "t2"], [f"{tmp_path}/job/s1", f"{tmp_path}/job/s2"], [None, None])], ["path", "target", "staged", "error"])
    move = repair._move(str(tmp_path), "job")
    for _ in range(2):
        (got,) = move(iter([batch]))
        assert got.column("ok").to_pylist() == [True, False] and got.column("error").to_pylist() == [None, "staged copy is lost"]
    assert (tmp_path / "t1").read_bytes() == b"one"
