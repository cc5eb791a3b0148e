from pyspark.sql import functions as F

from ferrule.operators import companions, headers, issues, structures
from ferrule.options import Severity
from tests.test_structures import LAME

W, E = int(Severity.WARNING), int(Severity.ERROR)


def test_encoders_and_faults_of_folders(spark):
    folders = {"same": ["V2", "V2", "V2"], "mixed": ["V2", "C128", "V2"], "bare": [None, None, None], "late": [None, "V2", "V2"], "some": ["V2", None, "V2"], "bad": ["V2", "V2", "V2"], "warn": ["V2", "V2", "V2"], "fewer": ["V2", "V2"]}
    levels = {"bad": [E, W, E], "warn": [0, W, 0]}
    files = [(d, f"{i} track.mp3", "mp3", levels.get(d, [0] * 9)[i], p) for d, ps in folders.items() for i, p in enumerate(ps)] + [("same", "0 log.log", "log", 0, None)]
    rips = [(f"{d}/a.log", d, 3, 1, 0, len(ps), 0, len(ps), 0, max(levels.get(d, [0])), 0) for d, ps in folders.items()]
    df = spark.createDataFrame(rips, "path string, dir string, n_tracks long, n_log long, n_flac long, n_mp3 long, n_checked_flac long, n_checked_mp3 long, flac_level int, mp3_level int, log_level int")
    both = companions.with_encoders(df, spark.createDataFrame(files[::-1], "dir string, name string, format string, level int, profile string").repartition(3))
    told = {}
    for r in issues.from_rules(both, companions.rip_rules(), "path").collect():
        told.setdefault(r["path"][:-6], {})[r["message"]] = r["base_level"]
    good, warned, failed = {"MP3 rip check successful.": int(Severity.ADVISORY)}, {"MP3 rip check successful with warnings.": W}, {"MP3 rip check failed.": E}
    profile, mixed = {"MP3 rip profile is V2.": int(Severity.ADVISORY)}, {"Inconsistent MP3 encoder settings.": W}
    assert told == {
        "same": profile | good, "mixed": mixed | warned, "bare": good, "late": good, "some": mixed | warned, "bad": profile | {"File issues on MP3 #1, #3.": E} | failed,
        "warn": profile | {"File issues on MP3 #2.": W} | warned, "fewer": {"Folder contains 2 .mp3 files, log contains 3 tracks.": E} | failed,
    }


def test_profile_of_a_walked_file(spark):
    at = LAME.index(b"Xing") + 129  # the method's byte
    of = lambda method, rate=0x90: b"\xff\xfb" + bytes([rate]) + LAME[3:at] + bytes([method]) + LAME[at + 1 :]
    low = LAME[:at - 129 + 116] + (30).to_bytes(4, "big") + LAME[at - 129 + 120 :]  # a quality below 40
    made = [LAME, of(1), of(8, 0xB0), of(2), of(0), of(4, 0x98), of(4, 0x94), low, b"\xff\xfb\x90\x64" + bytes(400), None]
    files = spark.createDataFrame([(i, "mp3", m and bytearray(m)) for i, m in enumerate(made)], "i int, format string, content binary")
    got = structures.walked(files).select("i", headers.lame_profile(F.col("content"), F.col("pieces"))).collect()
    assert [r[1] for r in sorted(got)] == ["V3", "C128", "C192", "A500", "", "V7", "R128", "R128", None, None]
