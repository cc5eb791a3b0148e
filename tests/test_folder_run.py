import hashlib

import pytest
from pyspark.sql import functions as F

from ferrule.__main__ import main
from ferrule.operators import companions
from ferrule.operators.diagnose import diagnose
from ferrule.options import Hashes, Options, Severity
from tests.test_logs import EAC_SERVICE, EAC_TOP, EAC_TRACKS, SEAL
from tests.test_parts import flac, png, wav

sha1 = lambda b: hashlib.sha1(b).hexdigest()
AUDIO = b"\xff\xf8\x69\x18\x00\x0f"


def sound(number):
    """A file of two frames' worth of bytes with the checksums that are looked at."""
    from ferrule.functions.bytesfn import CRCS, crc

    head = AUDIO
    head += bytes([crc(head, *CRCS["crc8"])]) + bytes([number] * 30)
    return flac(head + crc(head, *CRCS["crc16n"]).to_bytes(2, "big"))[0]


def test_paths_are_resolved(spark):
    cases = {
        ("file:/a/b", "c.txt"): "file:/a/b/c.txt", ("file:/a/b", "..\\x\\.\\c"): "file:/a/x/c", ("file:/a", "../../c"): None, ("file:/a/b", "/r/c"): "file:/r/c",
        ("hdfs://host:90/a", "b//c"): "hdfs://host:90/a/b/c", (".", "./d"): "d", ("a/b", "../../c"): "c", ("file:/a", ".."): "file:/", ("file:/a", ""): "file:/a", ("x y/é", "ü/../z"): "x y/é/z",
    }
    df = spark.createDataFrame([(*k, n) for n, k in enumerate(cases)], "d string, n string, k int")
    got = {(r["d"], r["n"]): r["p"] for r in df.select("d", "n", companions.resolved(F.col("d"), F.col("n")).alias("p")).collect()}
    assert got == cases


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("run") / "top"
    lists, rips = root / "lists", root / "rips"
    (lists / "sub").mkdir(parents=True)
    for d in ("good", "bad", "cues", "two", "mixed"):
        (rips / d).mkdir(parents=True)
    (lists / "one.bin").write_bytes(b"one")
    (lists / "sub" / "two.bin").write_bytes(b"two")
    image, idat, rest = png(b"pixels")
    (lists / "image.png").write_bytes(image)
    w, samples, meta = wav(b"abcd" * 9)
    (lists / "sub" / "s.wav").write_bytes(w)
    good = f"{sha1(b'one')} *one.bin\r\n; a comment\r\n\r\n{sha1(b'two').upper()} *sub\\two.bin\r\n"
    (lists / "ok.sha1").write_text(good)
    (lists / "bad.sha1").write_text(good.replace(sha1(b"one")[:4], sha1(b"one")[3::-1]))
    (lists / "lost.md5").write_text(hashlib.md5(b"one").hexdigest() + "  one.bin\n" + hashlib.md5(b"x").hexdigest() + " *gone.bin\n")
    (lists / "torn.sha256").write_text(hashlib.sha256(b"one").hexdigest() + " *one.bin\nnot a digest but a line of more than sixty-seven characters, so malformed\n")
    (lists / "short.md5").write_text("too short\n")
    (lists / "comments.md5").write_text("; nothing here\n")
    (lists / "parts.sha1x").write_text(f"{sha1(idat)} :image.png\n{sha1(rest)} ?image.png\n{sha1(samples)} :sub/s.wav\n{sha1(meta)} ?../lists/sub/s.wav\n{sha1(image)} *image.png\n")
    (lists / "parts.md5").write_text(f"{hashlib.md5(idat).hexdigest()} :image.png\n")
    (lists / "all.m3u").write_bytes(b"#EXTM3U\r\none.bin\r\nsub\\two.bin\r\nhttp://host/x.mp3\r\n")
    (lists / "some.m3u").write_bytes(b"one.bin\nsub/nowhere.bin\nimage.png\n")
    (lists / "names.m3u8").write_bytes("ünï.bin\n".encode())
    (lists / "ünï.bin").write_bytes(b"u")
    for d in ("good", "bad", "cues", "mixed"):
        for k in (1, 2):
            (rips / d / f"0{k} - Song.flac").write_bytes(sound(k))
    log = EAC_TOP + EAC_TRACKS + EAC_SERVICE + SEAL
    (rips / "good" / "rip.log").write_bytes(b"\xff\xfe" + log.encode("utf-16le"))
    log = log.replace("Copy V1.0", "Copy V0.99")
    (rips / "bad" / "rip.log").write_text(log.replace("Copy CRC DEADBEEF", "Copy CRC DEADBEEE"))
    sheet = 'CATALOG 1234567890123\nFILE "01 - Old.wav" WAVE\n  TRACK 01 AUDIO\nFILE "02 - Old.wav" WAVE\n'
    (rips / "cues" / "two.cue").write_text(sheet)
    (rips / "cues" / "three.cue").write_text(sheet.replace("1234567890123", "12") + 'FILE "03 - Old.wav" WAVE\n')
    (rips / "two" / "a.log").write_text(log)
    (rips / "two" / "b.log").write_text(log)
    (rips / "two" / "range.cue").write_text('FILE "Range.wav" WAVE\n')
    (rips / "mixed" / "x.mp3").write_bytes(b"ID3\3\0\0\0\0\0\0\xff\xfb\x90\x00" + bytes(400))
    (rips / "mixed" / "a.log").write_text(log)
    return root


def run(spark, tree, **more):
    found = diagnose(spark, Options(root=str(tree), **more))
    by = {}
    for r in found["issues"].join(found["files"].select("path", "dir", "name"), "path").collect():
        by.setdefault((r["dir"].rsplit("/", 1)[-1], r["name"]), {})[r["message"]] = r["level"]
    return found, by


def test_lists_logs_and_sheets_of_a_folder(spark, tree):
    found, by = run(spark, tree)
    worst = {k: max(v.values()) for k, v in by.items()}
    assert by["lists", "ok.sha1"] == {"Validation of 2 file(s) successful.": 3}
    assert by["lists", "bad.sha1"] == {"Mismatch on 'one.bin'.": 5, "Validation of 2 file(s) failed with 2 found and 1 matched.": 3}
    assert by["lists", "lost.md5"] == {"File 'gone.bin' not found.": 5, "Validation of 2 file(s) failed with 1 found and 1 matched.": 3}
    assert by["lists", "torn.sha256"] == {"Badly formed, line 2.": 6} and by["lists", "short.md5"] == {"Too short, line 1.": 6}
    assert by["lists", "comments.md5"] == {"Validation of 0 file(s) successful.": 3}
    assert by["lists", "parts.sha1x"] == {"Validation of 5 file(s) successful.": 3}
    assert by["lists", "parts.md5"]["Nonfile hashes not supported for this type."] == 5
    assert by["lists", "all.m3u"] == {"Ignoring URL 'http://host/x.mp3'.": 2, "Existence check of 3 file(s) successful.": 3}
    assert by["lists", "some.m3u"] == {"File 'sub/nowhere.bin' not found.": 3, "Existence check of 3 file(s) failed with 1 not found.": 5}
    assert by["lists", "names.m3u8"] == {"Existence check of 1 file(s) successful.": 3}
    assert by["good", "rip.log"]["FLAC rip check successful."] == 3 and worst["good", "rip.log"] == 3
    assert by["bad", "rip.log"]["FLAC rip check failed."] == 5
    assert by["two", "a.log"]["Folder contains more than one .log file."] == 5
    assert by["mixed", "a.log"]["Folder contains both .flac and .mp3 files."] == 5
    assert by["cues", "two.cue"]["Existence check of 2 file(s) failed with 2 not found."] == 5
    assert by["cues", "three.cue"]["Folder contains 2 .flac file(s) yet .cue contains 3 file reference(s)."] == 5 and by["cues", "three.cue"]["Invalid CATALOG."] == 5
    assert by["two", "range.cue"] == {"Existence check of 1 file(s) successful.": 3}
    assert by["cues", "01 - Song.flac"]["Found .flac file without .log file in same folder."] == 1 and ("good", "01 - Song.flac") not in {k for k, v in by.items() if "Found .flac file without .log file in same folder." in v}
    digests = {r["name"]: r for r in found["files"].collect()}
    assert digests["one.bin"]["file_sha1"] == sha1(b"one") and digests["ünï.bin"]["file_sha1"] is None  # only what is asked for
    assert "content" not in found["files"].columns


def test_a_sheet_can_be_repaired_in_a_repairing_run(spark, tree):
    found, by = run(spark, tree / "rips" / "cues", repair=True, hashes=Hashes.NONE)
    assert by["cues", "two.cue"]["Existence check of 2 file(s) failed with 2 not found."] == int(Severity.WARNING)
    assert {(r["message"][:9], r["repair_kind"]) for r in found["issues"].where("repair_kind IS NOT NULL").collect()} == {("Existence", "cue references")}


def test_contents_are_read_once_and_not_shuffled(spark, tree):
    from ferrule.operators import diagnose as module
    from ferrule.sources import files as source

    found = spark.createDataFrame([("file:/x", "sha1", "Binary", "00")], "target string, kind string, mode string, stored string")
    plan = module.checked(module._noted(source.scan(spark, str(tree)), found))._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert all("content" not in line for line in physical.split("\n") if "Exchange hashpartitioning" in line and "path" in line.split("Exchange")[1] and "content#" in line)


def test_exit_codes(spark, tree, capsys):
    assert main([str(tree / "rips" / "good")]) == 3
    assert main([str(tree / "lists"), "--glob", "*.sha1"]) == 5
    assert "rip check successful" in capsys.readouterr().out
