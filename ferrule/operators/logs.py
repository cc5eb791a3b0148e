"""Extraction logs of two programs, read by grammars: settings, tables of contents, tracks, and the two verification services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.operators import folder
from ferrule.operators.grammar import Grammar, parsed
from ferrule.operators.grammar import Rule as Line
from ferrule.operators.rules import Rule
from ferrule.options import Severity, Tag

_SETTING = r"^ *([^ :](?:[^:]*[^ :])?) *:(?: +(.*?))? *$"
_ERRORS = [(r"^\s*No errors occurr?ed\s*$", "no_errors"), (r"^\s*There were errors", "errors")]
_FIELDS = [
    (r"^\s*Pre-gap length +(.*?)\s*$", "pregap"), (r"^\s*Extraction speed +(.*?)\s*$", "speed"), (r"^\s*Test CRC +(.*?)\s*$", "test_crc"), (r"^\s*Copy CRC +(.*?)\s*$", "copy_crc"),
    (r"^\s*Accurately ripped \(confidence (\d+)\)(.*)$", "ar"), (r"^\s*Cannot be verified(.*)$", "ar_failed"), (r"^\s*Track not present", "ar_absent"), (r"^\s*Copy OK\s*$", "copy_ok"),
]
_PEAK, _QUALITY, _FILE = (r"^\s*Peak level +(.*?)\s*$", "peak"), (r"^\s*Track quality +(.*?)\s*$", "quality"), (r"^\s*Filename +(.*?)\s*$", "filename")
_TRACK, _NO_TRACK = (r"^\s*Track +(\d+)\s*$", "track"), (r"^\s*Track(?! quality| not present) +(.*)$", "bad_track")
_END = r"^==== "
_CHECKSUM = (r"^==== Log checksum ([0-9A-Fa-f]{64})", "checksum")

# The lines of logs of the first program.
EAC = Grammar("start", (
    Line("start", r"^Exact Audio Copy V(\S+) ", "start", "version"), Line("start", r"^EAC extraction logfile from (.*?)(?: for CD)?\s*$", "artist", "date"),
    Line("artist", r"^([^/]*)/(.*)$", "settings", "artist"), Line("artist", r"\S", "settings", "no_artist"),
    Line("settings", _TRACK[0], "opened", "track"), Line("settings", r"^TOC of the extracted CD", "toc", "toc"), Line("settings", r"^Range status and errors", "range", "range"), Line("settings", _CHECKSUM[0], "done", "checksum"),
    Line("settings", r"^\s*(Installed external ASPI interface|Native Win32 interface for Win NT & 2000)\s*$", "settings", "interface"), Line("settings", _SETTING, "settings", "setting"),
    Line("toc", r"^ *(\d+) *\|(.{30,})$", "toc", "toc_track"), Line("toc", _TRACK[0], "opened", "track"), Line("toc", r"^Range status and errors", "range", "range"), Line("toc", _CHECKSUM[0], "done", "checksum"),
    *(Line(s, p, "after", k) for s in ("opened", "body", "range") for p, k in _ERRORS),
    *(Line(s, p, to, k) for s in ("opened", "body") for (p, k), to in ((_TRACK, "opened"), (_PEAK, "body"), (_QUALITY, "body"), (_FILE, s), *((f, s if f[1] == "pregap" else "body") for f in _FIELDS))),
    *(Line(s, _NO_TRACK[0], s, _NO_TRACK[1]) for s in ("opened", "body")), *(Line(s, _CHECKSUM[0], "done", "checksum") for s in ("opened", "body", "range", "after")),
    Line("body", r"^\s*All tracks accurately ripped|^\s*Some tracks could not|^\s*No tracks could|accurate", "body"), Line("opened", r"\S", "opened", "trouble"),
    *(Line("range", p, "range", k) for p, k in (_FILE, _PEAK, _QUALITY, *_FIELDS)),
    Line("after", r"^\s*AccurateRip summary", "summary"), Line("after", r"^\s*End of status report", "after", "end"), Line("after", r"^\s*---- CUETools", "service"),
    Line("summary", r"^\s*Track +(\d+) .*ccurately ripped \(confidence (\d+)\)", "summary", "range_ar"), Line("summary", r"^\s*End of status report", "after", "end"), Line("summary", r"^\s*---- CUETools", "service"), Line("summary", _CHECKSUM[0], "done", "checksum"),
    Line("service", r"^\s*\[CTDB.*not present", "after", "ct_absent"), Line("service", r"^\s*\[CTDB.* found", "found"), Line("service", _CHECKSUM[0], "done", "checksum"),
    Line("found", r"^\s*\[[^\]]*\] *\( *(\d+)/.*Accurately ripped", "after", "ct"), Line("found", r"^\s*\[", "after", "ct_failed"), Line("found", r"^\s*Track *\|", "listed"), Line("found", _CHECKSUM[0], "done", "checksum"),
    Line("listed", r"^ *(\d+) *\| *\( *(\d+)/.*Accurately ripped", "listed", "ct_track"), Line("listed", r"^ *(\d+) *\|.*Differs", "listed", "ct_differs"), Line("listed", _CHECKSUM[0], "done", "checksum"), Line("listed", r"\S", "after"),
    Line("done", r"\S", "done", "trailing"),
))

# The lines of logs of the second program.
XLD = Grammar("start", (
    Line("start", r"^\s*(X Lossless Decoder.*?)\s*$", "start", "version"), Line("start", r"^\s*XLD extraction logfile from (.*?)\s*$", "artist", "date"),
    Line("artist", r"^(.*?) / (.*)$", "settings", "artist"), Line("artist", r"\S", "settings", "no_artist"),
    Line("settings", r"^TOC", "toc", "toc"), Line("settings", r"^AccurateRip Summary", "summary"), Line("settings", r"^Track (\d+)\s*$", "body", "track"), Line("settings", r"^No errors occurred", "after", "no_errors"), Line("settings", _SETTING, "settings", "setting"),
    Line("toc", r"^ *(\d+) *\|(.{30,})$", "toc", "toc_track"),
    *(Line(s, p, to, k) for s in ("toc", "summary", "body") for p, to, k in ((r"^AccurateRip Summary", "summary", None), (r"^Track (\d+)\s*$", "body", "track"), (r"^No errors occurred", "after", "no_errors"), (r"^Track (\D.*)$", "body", "bad_track"))),
    Line("summary", r"Disc not found", "body", "disc_absent"), Line("summary", r"^\s*Track (\d\d) *: OK.*confidence (\d+)", "summary", "ar_ok"), Line("summary", r"^\s*Track (\d\d) *: Not Found", "summary", "ar_unknown"), Line("summary", r"^\s*Track (\d\d) *:", "summary", "ar_bad"), Line("summary", r"^\s*->", "body"),
    Line("body", r"^ +Filename *: *(.*?)\s*$", "body", "filename"), Line("body", r"^ +CRC32 hash \(test run\) *: *(.*?)\s*$", "body", "test_crc"), Line("body", r"^ +CRC32 hash *: *(.*?)\s*$", "body", "copy_crc"),
    Line("after", r"^-----BEGIN XLD SIGNATURE-----", "signature"), Line("signature", r"^\s*(\S+)\s*$", "signed", "signature"),
))

# Names of settings in logs, and the columns that they become.
SETTINGS = {
    "Used drive": "drive", "Utilize accurate stream": "accurate_stream", "Defeat audio cache": "defeat_cache", "Disable audio cache": "defeat_cache", "Make use of C2 pointers": "use_c2",
    "Read mode": "read_mode", "Ripper mode": "read_mode", "Media type": "media", "Read offset correction": "read_offset", "Combined read/write offset correction": "read_offset", "Overread into Lead-In and Lead-Out": "overread",
    "Fill up missing offset samples with silence": "fill_silence", "Delete leading and trailing silent blocks": "trim_silence", "Null samples used in CRC calculations": "calc_with_nulls", "Normalize to": "normalize",
    "Used interface": "interface", "Gap handling": "gap_handling", "Gap status": "gap_handling", "Sample format": "sample_format", "Quality": "quality", "Add ID3 tag": "id3_tag",
}


def sections(lines: DataFrame, *keys: str) -> DataFrame:
    """Kinds of lines of logs (keys, line_no, line, program), each by the grammar of its program (EAC or XLD)."""
    out = None
    for program, grammar in (("EAC", EAC), ("XLD", XLD)):
        got = parsed(lines.where(F.col("program") == program), grammar, *keys).withColumn("program", F.lit(program))
        out = got if out is None else out.union(got)
    return out


def _crc(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit("^[0-9A-Fa-f]{1,8}$")), F.conv(text, 16, 10).try_cast("long"))


def tracks(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, idx (from 1), number, filename, pregap, peak, speed, quality, test_crc, copy_crc, has_ok, ar_version, ar_confidence, ct_confidence, trouble and bad_crc of sections.

    A confidence is -1 where the service contradicts and 0 where it does not know the track.
    """
    order = Window.partitionBy(*keys).orderBy("line_no")
    tracked = rows.where("state <> 'range'").withColumn("idx", F.count(F.when(F.col("kind") == "track", 1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = tracked.where("state IN ('settings', 'toc', 'summary', 'opened', 'body') AND idx > 0")

    def told(kind: str, value: str = "a") -> Column:
        return F.min_by(F.when(F.col("kind") == kind, F.col(value)), F.when(F.col("kind") == kind, F.col("line_no")))

    def has(kind: str) -> Column:
        return F.bool_or(F.col("kind") == kind)

    named = [told(k).alias(k) for k in ("filename", "pregap", "peak", "speed", "quality", "trouble")]
    out = own.groupBy(*keys, "idx").agg(
        told("track").try_cast("int").alias("number"), *named, told("test_crc").alias("_test"), told("copy_crc").alias("_copy"), has("copy_ok").alias("has_ok"), has("trouble").alias("has_trouble"),
        told("ar").try_cast("int").alias("_ar"), F.coalesce(told("ar", "b"), told("ar_failed")).alias("_how"), has("ar_failed").alias("_failed"), has("ar_absent").alias("_absent"),
    )
    confidence = F.when(F.col("_ar") > 0, F.col("_ar")).when(F.col("_ar").isNotNull() | F.col("_failed"), -1).when(F.col("_absent") & (F.coalesce("peak", F.lit("")) != "0.0 %"), 0)
    version = F.when(F.col("_how").isNotNull(), F.when(F.contains("_how", F.lit("AR v2")), 2).otherwise(1))
    bad = F.concat_ws(",", F.when(F.col("_test").isNotNull() & _crc(F.col("_test")).isNull(), "test"), F.when(F.col("_copy").isNotNull() & _crc(F.col("_copy")).isNull(), "copy"))
    out = out.withColumns({"test_crc": _crc(F.col("_test")), "copy_crc": _crc(F.col("_copy")), "ar_version": version, "ar_confidence": confidence, "bad_crc": F.when(bad != "", bad)})
    ct = rows.where("kind IN ('ct_track', 'ct_differs')").withColumn("idx", F.row_number().over(order).cast("long"))
    ct = ct.select(*keys, "idx", F.when(F.col("kind") == "ct_track", F.col("b").try_cast("int")).otherwise(-1).alias("ct_confidence"))
    xld = rows.where("kind IN ('ar_ok', 'ar_unknown', 'ar_bad')").select(*keys, F.col("a").try_cast("long").alias("idx"), F.when(F.col("kind") == "ar_ok", F.col("b").try_cast("int")).when(F.col("kind") == "ar_unknown", 0).otherwise(-1).alias("_own"))
    out = out.join(ct, [*keys, "idx"], "left").join(xld, [*keys, "idx"], "left").withColumn("ar_confidence", F.coalesce("ar_confidence", "_own"))
    return out.select(*keys, "idx", "number", "filename", "pregap", "peak", "speed", "quality", "test_crc", "copy_crc", "has_ok", "ar_version", "ar_confidence", "ct_confidence", "trouble", "has_trouble", "bad_crc")


def headers(rows: DataFrame, logs: DataFrame, *keys: str) -> DataFrame:
    """A row for each of logs (keys, program) with what its sections tell: version, date, artist, album, the columns of SETTINGS, toc_tracks, is_range, no_errors, errors, is_signed, has_trailing, and what the services say of the disc."""

    def of(kind: str, value: str = "a") -> Column:
        return F.min_by(F.when(F.col("kind") == kind, F.trim(F.col(value))), F.when(F.col("kind") == kind, F.col("line_no")))

    def has(kind: str) -> Column:
        return F.coalesce(F.bool_or(F.col("kind") == kind), F.lit(False))

    named = {}
    for column in dict.fromkeys(SETTINGS.values()):
        is_it = (F.col("kind") == "setting") & F.col("a").isin([k for k, v in SETTINGS.items() if v == column]) & (F.col("b") != "")
        is_it = is_it | (F.col("kind") == "interface") if column == "interface" else is_it
        value = F.when(is_it, F.when(F.col("kind") == "setting", F.trim("b")).otherwise(F.trim("a")))
        named[column] = F.max_by(value, F.when(is_it, F.col("line_no")))
    found = rows.groupBy(*keys).agg(
        of("version").alias("version"), of("date").alias("date"), of("artist").alias("artist"), of("artist", "b").alias("album"), *(c.alias(n) for n, c in named.items()),
        F.when(has("toc"), F.count_if(F.col("kind") == "toc_track")).alias("toc_tracks"), has("range").alias("is_range"), has("no_errors").alias("no_errors"), has("errors").alias("errors"),
        (has("checksum") | has("signature")).alias("is_signed"), has("trailing").alias("has_trailing"), F.count_if(F.col("kind") == "bad_track").alias("bad_tracks"),
        F.when(has("ct_absent"), 0).when(has("ct_failed"), -1).otherwise(of("ct").try_cast("int")).alias("ct_disc"), F.when(has("disc_absent"), 0).otherwise(F.min(F.when(F.col("kind") == "range_ar", F.col("b").try_cast("int")))).alias("ar_disc"),
        F.count_if(F.col("kind").isin("ar_ok", "ar_unknown", "ar_bad")).alias("ar_items"),
    )
    out = logs.select(*keys, "program").join(found, list(keys), "left")
    return out.na.fill(False, ["is_range", "no_errors", "errors", "is_signed", "has_trailing"]).na.fill(0, ["bad_tracks", "ar_items"])


def facts(heads: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """heads with n_tracks, n_test, n_copy, n_mismatch, n_ok, n_quality, has_gap, n_trouble, ar_confidence and ct_confidence over the tracks found."""
    per = found.groupBy(*keys).agg(
        F.count("*").alias("n_tracks"), F.count("test_crc").alias("n_test"), F.count("copy_crc").alias("n_copy"), F.count_if(F.col("test_crc").isNotNull() & ~F.col("test_crc").eqNullSafe(F.col("copy_crc"))).alias("n_mismatch"),
        F.count_if("has_ok").alias("n_ok"), F.count("quality").alias("n_quality"), F.count_if("has_trouble").alias("n_trouble"), F.count("bad_crc").alias("n_bad_crc"), F.count_if(F.coalesce(F.col("filename"), F.lit("")) == "").alias("n_unnamed"),
        F.min("ar_confidence").alias("_ar"), F.min("ct_confidence").alias("_ct"),
    )
    gaps = folder.number_gap(found, list(keys), "number").select(*keys, (~F.col("is_gapless")).alias("has_gap"))
    out = heads.join(per, list(keys), "left").join(gaps, list(keys), "left").na.fill(0, ["n_tracks", "n_test", "n_copy", "n_mismatch", "n_ok", "n_quality", "n_trouble", "n_bad_crc", "n_unnamed"]).na.fill(False, ["has_gap"])
    return out.withColumns({"ar_confidence": F.least("_ar", "ar_disc"), "ct_confidence": F.least("_ct", "ct_disc")}).drop("_ar", "_ct")


def common_rules() -> list[Rule]:
    """What is wrong with a log of either program; over facts()."""
    n, copy, test = F.col("n_tracks"), F.col("n_copy"), F.col("n_test")
    return [
        Rule(F.col("has_gap"), F.lit("Gap detected in track numbers."), Severity.ERROR, Tag.FAILURE),
        Rule(copy != n, F.lit("Copy pass incomplete."), Severity.ERROR, Tag.FAILURE),
        Rule((copy == n) & (test == 0), F.lit("Test pass not performed."), Severity.NOISE, Tag.STRICT_ERR),
        Rule((copy == n) & (test > 0) & (test != n), F.lit("Test pass incomplete."), Severity.ERROR, Tag.FAILURE),
        Rule((copy == n) & (test > 0) & (test == n) & (F.col("n_mismatch") > 0), F.lit("Test/copy CRC-32 mismatch."), Severity.ERROR, Tag.FAILURE),
        Rule((copy == n) & (test > 0) & (test == n) & (F.col("n_mismatch") == 0), F.lit("Test/copy CRC-32s match for all tracks."), Severity.TRIVIA, Tag.SUCCESS),
        Rule(F.col("artist").isNull() & F.col("album").isNull(), F.lit("Missing '<artist> / <album>'."), Severity.ERROR),
        Rule(F.col("bad_tracks") > 0, F.lit("Invalid track number."), Severity.FATAL, Tag.FAILURE),
        Rule(F.col("n_bad_crc") > 0, F.lit("Invalid CRC-32."), Severity.ERROR, Tag.FAILURE),
    ]


def _unlike(column: str, wanted: str) -> Column:
    """The column has a value, but another one."""
    return F.col(column).isNotNull() & (F.col(column) != wanted)


def _not(column: str, wanted: str) -> Column:
    return F.col(column).isNull() | (F.col(column) != wanted)


# The read mode that says all at once, in both spellings.
_SAFE_MODES = ["Secure with NO C2, accurate stream, disable cache", "Secure with NO C2, accurate stream,  disable cache"]


def eac_rules() -> list[Rule]:
    """What is wrong with a log of the first program, beyond the common rules."""
    plain = F.col("read_mode").isNotNull() & ~F.col("read_mode").isin(_SAFE_MODES)
    whole = ~F.col("is_range")
    short = F.col("toc_tracks") - F.col("n_tracks")
    ar, ct = F.col("ar_confidence"), F.col("ct_confidence")
    counted = F.concat(F.lit("Found "), F.col("n_tracks").cast("string"), F.lit(" of "), F.col("toc_tracks").cast("string"), F.lit(" tracks."))
    return [
        Rule(whole & (F.col("n_ok") < F.col("n_tracks")), F.lit("Missing 'Copy OK'."), Severity.ERROR, Tag.FAILURE),
        Rule(whole & (F.col("n_quality") < F.col("n_tracks")), F.lit("Missing 'Track quality'."), Severity.ERROR, Tag.FAILURE),
        Rule(F.col("n_trouble") > 0, F.lit("Trouble reading tracks."), Severity.ERROR),
        Rule(F.col("n_unnamed") > 0, F.lit("Missing 'Filename'."), Severity.ERROR, Tag.FAILURE),
        Rule(F.col("errors"), F.lit("There were errors."), Severity.ERROR),
        Rule(~F.col("errors") & ~F.col("no_errors"), F.lit("Missing 'errors' line."), Severity.ERROR),
        Rule(F.col("artist") == "", F.lit("Missing artist"), Severity.WARNING, Tag.SUBSTANDARD),
        Rule(F.col("album") == "", F.lit("Missing album"), Severity.WARNING, Tag.SUBSTANDARD),
        Rule(F.col("drive").isNull(), F.lit("Missing 'Used drive'."), Severity.ERROR),
        Rule(F.col("read_mode").isNull(), F.lit("Missing 'Read mode'."), Severity.ERROR),
        Rule(plain & (F.col("read_mode") != "Secure"), F.concat(F.lit("Nonpreferred drive setting: Read mode: "), "read_mode"), Severity.WARNING, Tag.SUBSTANDARD),
        Rule(plain & _not("accurate_stream", "Yes"), F.lit("Missing drive setting: 'Utilize accurate stream: Yes'."), Severity.WARNING, Tag.STRICT_ERR),
        Rule(plain & _not("defeat_cache", "Yes"), F.lit("Missing drive setting: 'Defeat audio cache: Yes'."), Severity.WARNING, Tag.STRICT_ERR),
        Rule(plain & _not("use_c2", "No"), F.lit("Missing drive setting: 'Make use of C2 pointers: No'."), Severity.WARNING, Tag.SUBSTANDARD),
        Rule(F.col("read_offset").isNull(), F.lit("Missing 'Read offset correction'."), Severity.TRIVIA, Tag.STRICT_WARN),
        Rule(_unlike("fill_silence", "Yes"), F.lit("Missing 'Fill up missing offset samples with silence: Yes'."), Severity.TRIVIA, Tag.STRICT_WARN),
        Rule(_unlike("quality", "High"), F.lit("Missing 'Quality: High'."), Severity.ADVISORY, Tag.SUBSTANDARD),
        Rule(_not("trim_silence", "No"), F.lit("Missing 'Delete leading and trailing silent blocks: No'."), Severity.WARNING, Tag.STRICT_ERR),
        Rule(_unlike("calc_with_nulls", "Yes"), F.lit("Missing 'Null samples used in CRC calculations: Yes'."), Severity.ERROR),
        Rule(_unlike("gap_handling", "Appended to previous track"), F.lit("Gap handling preferred setting is 'Appended to previous track'."), Severity.ADVISORY, Tag.STRICT_ERR),
        Rule(F.col("id3_tag") == "Yes", F.lit("Append ID3 tags preferred setting is 'No'."), Severity.NONE, Tag.STRICT_ERR),
        Rule((F.col("read_offset") == "0") & F.contains("drive", F.lit("not found in database")), F.lit("Unknown drive with offset '0'."), Severity.ADVISORY, Tag.STRICT_ERR),
        Rule(F.col("normalize").isNotNull(), F.lit("Use of normalization considered harmful."), Severity.WARNING, Tag.STRICT_ERR),
        Rule(_unlike("sample_format", "44.100 Hz; 16 Bit; Stereo"), F.lit("Missing 'Sample format: 44.100 Hz; 16 Bit; Stereo'."), Severity.WARNING, Tag.SUBSTANDARD),
        Rule(F.col("is_range"), F.lit("Range rip detected."), Severity.ADVISORY, Tag.STRICT_WARN),
        Rule(whole & (short == 1), counted, Severity.ADVISORY),
        Rule(whole & (short != 0) & (short != 1), counted, Severity.ERROR),
        Rule(ar > 0, F.concat(F.lit("AccurateRip verification confidence "), ar.cast("string"), F.lit(".")), Severity.TRIVIA, Tag.SUCCESS),
        Rule(ar == 0, F.lit("AccurateRip verification: not in the database."), Severity.ADVISORY),
        Rule(ar < 0, F.lit("AccurateRip verification failed."), Severity.ADVISORY, Tag.FAILURE),
        Rule(ar.isNull(), F.lit("AccurateRip verification not attempted."), Severity.TRIVIA),
        Rule(ct > 0, F.concat(F.lit("CUETools DB verification confidence "), ct.cast("string"), F.lit(".")), Severity.TRIVIA, Tag.SUCCESS),
        Rule(ct == 0, F.lit("CUETools DB verification: not in the database."), Severity.ADVISORY),
        Rule(ct < 0, F.lit("CUETools DB verification failed."), Severity.ERROR),
        Rule(ct.isNull(), F.lit("CUETools DB verification not attempted."), Severity.TRIVIA, Tag.STRICT_ERR),
        Rule(F.col("has_trailing"), F.lit("Unexpected content at end of file."), Severity.WARNING, Tag.STRICT_ERR),
    ]


def xld_rules() -> list[Rule]:
    """What is wrong with a log of the second program, beyond the common rules."""
    ar, odd = F.col("ar_confidence"), (F.col("ar_items") > 0) & (F.col("ar_items") != F.col("n_tracks"))
    return [
        Rule(odd, F.lit("AccurateRip table mismatch."), Severity.ERROR, Tag.FAILURE),
        Rule(~odd & (ar < 0), F.lit("AccurateRip failed."), Severity.ERROR, Tag.FAILURE),
        Rule(~odd & (ar > 0), F.concat(F.lit("AccurateRip confidence "), ar.cast("string"), F.lit(".")), Severity.ADVISORY, Tag.SUCCESS),
        Rule(~odd & F.coalesce(ar == 0, F.lit(True)), F.lit("AccurateRip: nothing verified."), Severity.ADVISORY),
        Rule(~F.col("is_signed"), F.lit("No signature."), Severity.TRIVIA, Tag.STRICT_ERR),
    ]


def log_rules() -> list[Rule]:
    """All rules of logs, each for its own program."""
    out = common_rules()
    for program, rules in (("EAC", eac_rules()), ("XLD", xld_rules())):
        out += [Rule((F.col("program") == program) & F.coalesce(r.guard, F.lit(False)), r.message, r.level, r.tags, r.repair) for r in rules]
    return out
