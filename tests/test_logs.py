import random
import re

from pyspark.sql import functions as F

from ferrule.operators import grammar, issues, logs
from ferrule.operators.grammar import Grammar, Rule, parsed

ABC = Grammar("a", (Rule("a", "^x", "b", "first"), Rule("a", "^y(.)(.?)", "c", "named"), Rule("b", "^x", "c"), Rule("b", "^z$", "a", "back"), Rule("c", "z", "a", "end"), Rule("c", "^(y)", "c", "again")))


def stepped(lines, g):
    state, out = g.start, []
    for n, line in enumerate(lines, 1):
        for r in g.rules:
            if r.state == state and (m := re.search(r.pattern, line or "")):
                if r.kind:
                    out.append((n, state, r.kind, *[m.group(k) if (m.re.groups >= k) else None for k in (1, 2)]))
                state = r.to
                break
    return out


def test_scan_equals_stepping_through_lines(spark, monkeypatch):
    rng = random.Random(4)
    texts = {k: [rng.choice(["x", "xx", "y1", "y22", "z", "zz", "", "-"]) for _ in range(rng.choice([1, 2, 5, 40, 300]))] for k in range(20)}
    texts[99] = [rng.choice(["x", "y1", "z", "q", None]) for _ in range(5000)]
    df = spark.createDataFrame([(k, n, x) for k, v in texts.items() for n, x in enumerate(v, 1)], "key int, line_no long, line string").repartition(5)
    expected = sorted((k, *x) for k, v in texts.items() for x in stepped(v, ABC))
    for block in (64, 7):  # two and five levels
        monkeypatch.setattr(grammar, "BLOCK", block)
        got = sorted((r["key"], r["line_no"], r["state"], r["kind"], r["a"], r["b"]) for r in parsed(df, ABC, "key").collect())
        assert [tuple(str(v) for v in r) for r in got] == [tuple(str(v) for v in r) for r in expected]
    assert parsed(df.limit(0), ABC, "key").count() == 0


EAC_TOP = """Exact Audio Copy V1.0 beta 3 from 29. August 2011

EAC extraction logfile from 3. June 2015, 3:28

Some Artist / Some Album

Used drive  : PLEXTOR DVDR   PX-716A   Adapter: 1  ID: 0

Read mode               : Secure
Utilize accurate stream : Yes
Defeat audio cache      : Yes
Make use of C2 pointers : No

Read offset correction                      : 30
Fill up missing offset samples with silence : Yes
Delete leading and trailing silent blocks   : No
Null samples used in CRC calculations       : Yes
Used interface                              : Native Win32 interface for Win NT & 2000
Gap handling                                : Appended to previous track

Quality                         : High
Add ID3 tag                     : No

TOC of the extracted CD

     Track |   Start  |  Length  | Start sector | End sector
    ---------------------------------------------------------
        1  |  0:00.00 |  3:05.40 |         0    |    13914
        2  |  3:05.40 |  4:00.00 |     13915    |    31914
"""
EAC_TRACKS = """
Track  1

     Filename C:\\Rips\\01 - One track.wav

     Pre-gap length  0:00:02.00

     Peak level 97.7 %
     Extraction speed 3.1 X
     Track quality 100.0 %
     Test CRC 0BADF00D
     Copy CRC 0BADF00D
     Accurately ripped (confidence 7)  [8A3D4B5E]  (AR v2)
     Copy OK

Track  2

     Filename C:\\Rips\\02 - Two track.wav

     Peak level 0.0 %
     Track quality 99.9 %
     Test CRC DEADBEEF
     Copy CRC DEADBEEF
     Accurately ripped (confidence 4)  [11111111]  (AR v1)
     Copy OK


All tracks accurately ripped

No errors occurred

End of status report
"""
EAC_SERVICE = """
---- CUETools DB Plugin V2.1.3

[CTDB TOCID: abc] found
Submit result: abc has been confirmed
Track | CTDB Status
  1   | (12/13) Accurately ripped
  2   | ( 9/13) Accurately ripped

"""
SEAL = "==== Log checksum " + "AB" * 32 + " ====\n"
XLD_LOG = """X Lossless Decoder version 20121222 (141.0)

XLD extraction logfile from 2013-01-02 10:11:12 -0500

Some Artist / Some Album

Used drive : OPTIARC DVD RW
Media type : Pressed CD
Ripper mode             : XLD Secure Ripper
Disable audio cache     : OK for the drive with a cache less than 2750KiB
Make use of C2 pointers : NO
Read offset correction  : 48
Gap status              : Analyzed, Appended

TOC of the extracted CD
     Track |   Start  |  Length  | Start sector | End sector
        1  | 00:00:00 | 03:05:40 |         0    |    13914
        2  | 03:05:40 | 04:00:00 |     13915    |    31914

AccurateRip Summary
    Track 01 : OK (v1+v2, confidence 5/6)
    Track 02 : OK (v2, confidence 3/6)
        ->All tracks accurately ripped.

Track 01
    Filename : /Rips/01 One.flac
    Pre-gap length : 00:02:00

    CRC32 hash (test run)  : 0BADF00D
    CRC32 hash             : 0BADF00D
    AccurateRip v1 signature : 11111111
        ->Accurately ripped (v1+v2, confidence 5/6)
Track 02
    Filename : /Rips/02 Two.flac
    CRC32 hash (test run)  : DEADBEEF
    CRC32 hash             : DEADBEEF

No errors occurred

End of status report

-----BEGIN XLD SIGNATURE-----
abcDEF0123
-----END XLD SIGNATURE-----
"""


def judged(spark, *texts, warn=0, err=0):
    """(headers, tracks, issues) of logs by place, with levels under the masks."""
    rows = [(k, "XLD" if t.startswith("X Loss") else "EAC", n, x) for k, t in enumerate(texts) for n, x in enumerate(t.split("\n"), 1)]
    lines = spark.createDataFrame(rows, "path int, program string, line_no long, line string")
    found = logs.sections(lines, "path").cache()
    tracks = logs.tracks(found, "path")
    facts = logs.facts(logs.headers(found, lines.select("path", "program").distinct(), "path"), tracks, "path")
    told = issues.from_rules(facts, logs.log_rules(), "path").withColumn("level", issues.effective_level(F.col("base_level"), F.col("tags"), warn, err))
    by = {k: {} for k in range(len(texts))}
    for r in told.collect():
        by[r["path"]][r["message"]] = r["level"]
    return {r["path"]: r for r in facts.collect()}, sorted(tracks.collect(), key=lambda r: (r["path"], r["idx"])), by


def test_a_clean_log_of_the_first_program(spark):
    heads, tracks, told = judged(spark, EAC_TOP + EAC_TRACKS + EAC_SERVICE + SEAL)
    h = heads[0]
    assert (h["version"], h["artist"], h["album"], h["toc_tracks"], h["n_tracks"], h["ar_confidence"], h["ct_confidence"], h["is_signed"]) == ("1.0", "Some Artist", "Some Album", 2, 2, 4, 9, True)
    assert (h["drive"], h["read_offset"], h["interface"], h["gap_handling"]) == ("PLEXTOR DVDR   PX-716A   Adapter: 1  ID: 0", "30", "Native Win32 interface for Win NT & 2000", "Appended to previous track")
    one, two = tracks
    assert (one["number"], one["filename"], one["pregap"], one["peak"], one["speed"], one["quality"], one["test_crc"], one["has_ok"], one["ar_version"], one["ct_confidence"]) == (1, "C:\\Rips\\01 - One track.wav", "0:00:02.00", "97.7 %", "3.1 X", "100.0 %", 0x0BADF00D, True, 2, 12)
    assert (two["copy_crc"], two["ar_version"], two["ar_confidence"]) == (0xDEADBEEF, 1, 4)
    assert max(told[0].values()) == 2 and told[0]["Test/copy CRC-32s match for all tracks."] == 2


#: What is changed in a clean log, the message that it brings, and its level.
FAULTS = [
    (("Copy CRC DEADBEEF", "Copy CRC DEADBEEE"), "Test/copy CRC-32 mismatch.", 5),
    (("     Test CRC DEADBEEF\n", ""), "Test pass incomplete.", 5),
    (("     Copy CRC DEADBEEF\n", ""), "Copy pass incomplete.", 5),
    (("Copy CRC DEADBEEF", "Copy CRC lost"), "Invalid CRC-32.", 5),
    (("Track  2\n", "Track  3\n"), "Gap detected in track numbers.", 5),
    (("Track  2\n", "Track  two\n"), "Invalid track number.", 6),
    (("     Copy OK\n\nTrack", "\nTrack"), "Missing 'Copy OK'.", 5),
    (("     Track quality 99.9 %\n", ""), "Missing 'Track quality'.", 5),
    (("     Peak level 0.0 %", "     Suspicious position 0:01:02\n     Peak level 0.0 %"), "Trouble reading tracks.", 5),
    (("No errors occurred", "There were errors"), "There were errors.", 5),
    (("No errors occurred", ""), "Missing 'errors' line.", 5),
    (("Some Artist / Some Album", " / Some Album"), "Missing artist", 4),
    (("Some Artist / Some Album", "nothing"), "Missing '<artist> / <album>'.", 5),
    (("Used drive  : P", "Drive  : P"), "Missing 'Used drive'.", 5),
    (("Read mode               : Secure", "Read mode               : Burst"), "Nonpreferred drive setting: Read mode: Burst", 4),
    (("Defeat audio cache      : Yes", "Defeat audio cache      : No"), "Missing drive setting: 'Defeat audio cache: Yes'.", 4),
    (("Make use of C2 pointers : No", "Make use of C2 pointers : Yes"), "Missing drive setting: 'Make use of C2 pointers: No'.", 4),
    (("Delete leading and trailing silent blocks   : No", ""), "Missing 'Delete leading and trailing silent blocks: No'.", 4),
    (("calculations       : Yes", "calculations       : No"), "Missing 'Null samples used in CRC calculations: Yes'.", 5),
    (("Quality                         : High", "Quality                         : Low"), "Missing 'Quality: High'.", 3),
    (("Add ID3 tag", "Normalize to : 98 %\nAdd ID3 tag"), "Use of normalization considered harmful.", 4),
    (("        2  |  3:05.40 |  4:00.00 |     13915    |    31914\n", ""), "Found 2 of 1 tracks.", 5),
    (("Accurately ripped (confidence 4)", "Cannot be verified as accurate (confidence 4)"), "AccurateRip verification failed.", 3),
    (("  2   | ( 9/13) Accurately ripped", "  2   | (13/13) Differs in 5 samples"), "CUETools DB verification failed.", 5),
    (("found\nSubmit", "disk not present in database\nSubmit"), "CUETools DB verification: not in the database.", 3),
    (("AB ====\n", "AB ====\nmore"), "Unexpected content at end of file.", 4),
]


def test_each_fault_of_the_first_program(spark):
    text = EAC_TOP + EAC_TRACKS + EAC_SERVICE + SEAL
    assert all(change[0] in text for change, _, _ in FAULTS)
    _, _, told = judged(spark, *(text.replace(*change, 1) for change, _, _ in FAULTS))
    assert [told[k].get(message) for k, (_, message, _) in enumerate(FAULTS)] == [level for _, _, level in FAULTS]


def test_a_range_rip_and_an_unsigned_old_log(spark):
    ranged = EAC_TOP.split("TOC of")[0] + "\nRange status and errors\n\nSelected range\n\n     Filename C:\\Rips\\all.wav\n     Peak level 90.0 %\n     Test CRC 12345678\n     Copy CRC 12345678\n     Copy OK\n\nNo errors occurred\n\nAccurateRip summary\n\nTrack  1  accurately ripped (confidence 3)  [AAAA]\nTrack  2  accurately ripped (confidence 2)  [BBBB]\n\nAll tracks accurately ripped\n\nEnd of status report\n"
    old = "EAC extraction logfile from 3. June 2015, 3:28 for CD\nSome Artist / Some Album\n\nUsed drive  : PIONEER\nRead mode   : Secure with NO C2, accurate stream, disable cache\nRead offset correction : 48\n\n    Delete leading and trailing silent blocks : No\n    Installed external ASPI interface\n" + EAC_TRACKS.replace("     Accurately ripped (confidence 7)  [8A3D4B5E]  (AR v2)\n", "").replace("     Accurately ripped (confidence 4)  [11111111]  (AR v1)\n", "")
    heads, tracks, told = judged(spark, ranged, old)
    assert heads[0]["is_range"] and heads[0]["ar_confidence"] == 2 and told[0]["Range rip detected."] == 3
    assert heads[1]["interface"] == "Installed external ASPI interface" and heads[1]["date"] == "3. June 2015, 3:28" and max(told[1].values()) <= 2
    assert {r["path"] for r in tracks} == {1}


def test_strict_runs_raise_what_is_tagged(spark):
    _, _, told = judged(spark, EAC_TOP + EAC_TRACKS, warn=0x100, err=0x200)
    assert told[0]["CUETools DB verification not attempted."] == 5


def test_logs_of_the_second_program(spark):
    heads, tracks, told = judged(spark, XLD_LOG, XLD_LOG.replace("    Track 02 : OK (v2, confidence 3/6)\n", "    Track 02 : Rip may not be accurate.\n"), XLD_LOG.split("-----BEGIN")[0].replace("    Track 02 : OK (v2, confidence 3/6)\n", ""), XLD_LOG.replace("CRC32 hash             : DEADBEEF", "CRC32 hash             : DEADBEEE"))
    h = heads[0]
    assert (h["version"], h["date"], h["album"], h["drive"], h["media"], h["read_mode"], h["use_c2"], h["n_tracks"], h["toc_tracks"], h["ar_confidence"], h["is_signed"]) == ("X Lossless Decoder version 20121222 (141.0)", "2013-01-02 10:11:12 -0500", "Some Album", "OPTIARC DVD RW", "Pressed CD", "XLD Secure Ripper", "NO", 2, 2, 3, True)
    assert [(t["number"], t["filename"], t["test_crc"], t["copy_crc"], t["ar_confidence"]) for t in tracks[:2]] == [(1, "/Rips/01 One.flac", 0x0BADF00D, 0x0BADF00D, 5), (2, "/Rips/02 Two.flac", 0xDEADBEEF, 0xDEADBEEF, 3)]
    assert told[0] == {"Test/copy CRC-32s match for all tracks.": 2, "AccurateRip confidence 3.": 3}
    assert told[1]["AccurateRip failed."] == 5
    assert told[2]["AccurateRip table mismatch."] == 5 and told[2]["No signature."] == 2
    assert told[3]["Test/copy CRC-32 mismatch."] == 5
