"""Files that tell of other files in their folder: digest lists, playlists, cue sheets and extraction logs.

Their lines become entries, an entry's name becomes the path that it means, and entries of all kinds meet the files in one join.
What a folder holds beside them (audio files, other logs) comes from counts by folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.operators import lists, logs, ripping
from ferrule.operators.rules import Rule
from ferrule.options import Severity, Tag
from ferrule.sources import files as source
from ferrule.storage import written

# Digits of the digests by kind of list, and the column that holds them; what a cue sheet of one range refers to.
DIGITS = {"md5": 32, "sha1": 40, "sha1x": 40, "sha256": 64}
DIGESTS = {"md5": "file_md5", "sha1": "file_sha1", "sha1x": "file_sha1", "sha256": "file_sha256"}
KINDS = [*DIGITS, "m3u", "m3u8", "cue", "log"]
RANGE_NAME = "Range.wav"


def resolved(folder: Column, name: Column) -> Column:
    """The path that a name means in a folder: slashes either way, "." and empty parts vanish, ".." goes up.

    A rooted name stands for itself, below the folder's scheme. Null where a name goes up beyond the root.
    """
    slashed = F.replace(name, F.lit("\\"), F.lit("/"))
    scheme = F.regexp_extract(folder, r"^([A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?", 0)
    below = F.when(F.startswith(slashed, F.lit("/")), slashed).otherwise(F.concat(folder.substr(F.length(scheme) + 1, F.length(folder)), F.lit("/"), slashed))
    outside = F.struct(F.lit(True).alias("out"), F.array().cast("array<string>").alias("parts"))
    within = lambda parts: F.struct(F.lit(False).alias("out"), parts.alias("parts"))

    def step(acc: Column, part: Column) -> Column:
        up = F.when(F.size(acc["parts"]) == 0, outside).otherwise(within(F.slice(acc["parts"], 1, F.greatest(F.size(acc["parts"]) - 1, F.lit(0)))))
        return F.when(acc["out"] | part.isin("", "."), acc).when(part == "..", up).otherwise(within(F.concat(acc["parts"], F.array(part))))

    start = within(F.array().cast("array<string>"))
    root = F.when(F.startswith(below, F.lit("/")), "/").otherwise("")
    return F.aggregate(F.split(below, "/"), start, step, lambda a: F.when(~a["out"], F.concat(scheme, root, F.array_join(a["parts"], "/"))))


def texts(files: DataFrame) -> DataFrame:
    """path, dir, kind, program (of logs), line_no and line of the files (path, dir, ext, format, content) that tell of others; format as identified.

    Playlists, cue sheets and short digests are in Windows-1252, the rest in UTF-8, logs in UTF-16 where they begin so. A last
    line feed begins no line.
    """
    kind = F.regexp_extract("format", r"^([a-z0-9]+)", 1)
    rows = files.withColumn("kind", kind).where(F.col("kind").isin(KINDS) & F.col("content").isNotNull())
    content = F.col("content")
    wide = F.startswith(F.hex(F.substring(content, 1, 2)), F.lit("FFFE"))
    text = F.when((F.col("kind") == "log") & wide, source.decoded(F.substring(content, 3, 1 << 30), "utf-16le"))
    text = text.when(F.col("kind").isin("m3u8", "sha1x", "sha256"), source.decoded(content, "utf-8")).otherwise(source.decoded(content))
    body = F.regexp_replace(text, "\r?\n$", "")
    rows = rows.select("path", "dir", "kind", F.regexp_extract("format", r"\((\w+)\)", 1).alias("program"), body.alias("body"))
    return rows.where("body <> ''").select("path", "dir", "kind", "program", F.posexplode(F.split("body", "\r?\n")).alias("p", "line")).select("path", "dir", "kind", "program", (F.col("p") + 1).cast("long").alias("line_no"), "line")


def entries(lines: DataFrame) -> DataFrame:
    """path, dir, kind, idx (from 1), line_no, status (ok, too short, malformed), name, mode, stored and target of lists, playlists and cue sheets."""
    out = None
    for kind, digits in DIGITS.items():
        got = lists.parse_digests(lines.where(F.col("kind") == kind), digits, "path", "dir", "kind")
        got = got.withColumn("status", F.when(F.col("status") == "swapped", "ok").otherwise(F.col("status"))).select("path", "dir", "kind", "line_no", "status", "name", "mode", "stored")
        out = got if out is None else out.unionByName(got)
    played = lines.where("kind IN ('m3u', 'm3u8')").withColumn("name", F.ltrim("line")).where("name <> '' AND name NOT LIKE '#%'").withColumn("status", F.lit("ok"))
    sheet = lines.where("kind = 'cue'").where(F.rlike("line", F.lit(r"^\s*FILE ")))
    quoted = F.regexp_extract("line", r'"([^"]*)"', 1)
    sheet = sheet.withColumn("name", quoted).withColumn("status", F.when(F.rlike("line", F.lit('"[^"]+"')), "ok").otherwise("malformed"))
    none = F.lit(None).cast("string")
    for rows in (played, sheet):
        out = out.unionByName(rows.select("path", "dir", "kind", "line_no", "status", "name", none.alias("mode"), none.alias("stored")))
    rows = out.withColumn("idx", F.row_number().over(Window.partitionBy("path").orderBy("line_no")).cast("long"))
    return rows.withColumn("target", F.when((F.col("status") == "ok") & ~lists.is_url(F.col("name")), resolved(F.col("dir"), F.col("name"))))


def wanted(found: DataFrame) -> DataFrame:
    """path and wanted: the digests of files that entries ask for."""
    whole = F.create_map(*(F.lit(x) for pair in DIGESTS.items() for x in pair))[F.col("kind")]
    named = F.when(F.col("mode") == "Media", "media_sha1").when(F.col("mode") == "Meta", "meta_sha1").otherwise(whole)
    return found.where("stored IS NOT NULL AND target IS NOT NULL").groupBy(F.col("target").alias("path")).agg(F.collect_set(named).alias("wanted"))


def met(found: DataFrame, files: DataFrame) -> DataFrame:
    """entries with is_found, is_supported, actual and is_match, by one join with files (path and digests)."""
    kept = files.select(F.col("path").alias("target"), *sorted({*DIGESTS.values(), "media_sha1", "meta_sha1"}), F.lit(True).alias("_there"))
    both = found.join(kept, "target", "left")
    partial, short = F.col("mode").isin("Media", "Meta"), F.col("kind").isin("sha1", "sha1x")
    whole = None
    for kind, column in DIGESTS.items():
        whole = F.when(F.col("kind") == kind, F.col(column)) if whole is None else whole.when(F.col("kind") == kind, F.col(column))
    actual = F.when(partial & short, F.when(F.col("mode") == "Media", F.col("media_sha1")).otherwise(F.col("meta_sha1"))).when(~partial, whole)
    both = both.withColumns({"is_found": F.col("_there").isNotNull(), "is_supported": ~F.coalesce(partial, F.lit(False)) | short, "actual": actual})
    match = F.when(F.col("is_found") & F.col("is_supported") & F.col("stored").isNotNull(), F.coalesce(F.col("stored") == F.col("actual"), F.lit(False)))
    return both.withColumn("is_match", match).select("path", "dir", "kind", "idx", "line_no", "status", "name", "mode", "stored", "target", "is_found", "is_supported", "actual", "is_match")


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def entry_rules() -> list[Rule]:
    """What is wrong with one entry; over met(). Nothing is checked in a list with a fatal line (has_fatal)."""
    digest, name, line = F.col("kind").isin(list(DIGITS)), F.col("name"), F.col("line_no")
    live = (F.col("status") == "ok") & ~F.col("has_fatal")
    url = live & ~digest & lists.is_url(name)
    there = live & ~url & ~F.col("is_ignored")
    return [
        Rule(digest & (F.col("status") == "too short"), _text("Too short, line ", line, "."), Severity.FATAL),
        Rule(digest & (F.col("status") == "malformed"), _text("Badly formed, line ", line, "."), Severity.FATAL),
        Rule((F.col("kind") == "cue") & (F.col("status") == "malformed"), _text("Malformed FILE, line ", line, "."), Severity.ERROR),
        Rule(url, _text("Ignoring URL '", name, "'."), Severity.TRIVIA),
        Rule(there & F.col("kind").isin("m3u", "m3u8") & lists.is_rooted(name), _text("File is rooted: '", name, "'."), Severity.ERROR),
        Rule(there & ~F.col("is_found"), _text("File '", name, "' not found."), F.when(digest, int(Severity.ERROR)).otherwise(int(Severity.ADVISORY))),
        Rule(there & ~F.col("is_supported"), F.lit("Nonfile hashes not supported for this type."), Severity.ERROR),
        Rule(there & digest & F.coalesce(~F.col("is_match"), F.lit(False)), _text("Mismatch on '", name, "'."), Severity.ERROR),
    ]


def list_rules(repairing: bool) -> list[Rule]:
    """What a whole list, playlist or cue sheet comes to; over a row for each with n_items, n_found, n_matched, n_wrong, n_missing, n_flac and flac_level."""
    n, digest, cue = F.col("n_items"), F.col("kind").isin(list(DIGITS)), F.col("kind") == "cue"
    live, missing = ~F.col("has_fatal"), F.col("n_missing")
    usable = cue & (F.col("n_flac") > 0) & (F.col("flac_level") < int(Severity.ERROR))
    fixable = usable & (F.col("n_flac") == n)
    counts = live & ~digest & ~(usable & ~fixable)
    failed = _text("Existence check of ", n, " file(s) failed with ", missing, " not found.")
    return [
        Rule(live & digest & (F.col("n_wrong") == 0), _text("Validation of ", n, " file(s) successful."), Severity.ADVISORY, Tag.SUCCESS),
        Rule(live & digest & (F.col("n_wrong") > 0), _text("Validation of ", n, " file(s) failed with ", F.col("n_found"), " found and ", F.col("n_matched"), " matched."), Severity.ADVISORY),
        Rule(counts & (missing == 0), _text("Existence check of ", n, " file(s) successful."), Severity.ADVISORY, Tag.SUCCESS),
        Rule(counts & (missing > 0) & ~fixable, failed, Severity.ERROR, Tag.FAILURE),
        Rule(counts & (missing > 0) & fixable, failed, Severity.WARNING if repairing else Severity.ERROR, Tag.FAILURE, "cue references"),
        Rule(live & usable & ~fixable & (n != 1), _text("Folder contains ", F.col("n_flac"), " .flac file(s) yet .cue contains ", n, " file reference(s)."), Severity.ERROR, Tag.FAILURE),
        Rule(F.col("bad_catalog"), F.lit("Invalid CATALOG."), Severity.ERROR),
    ]


def folders(files: DataFrame) -> DataFrame:
    """dir, n_log, n_flac, n_mp3, n_checked_mp3, n_checked_flac, flac_level and mp3_level of folders, from files (dir, format, level, n_checked)."""
    of = lambda kind: F.col("format") == kind
    return files.groupBy("dir").agg(
        *(F.count_if(of(k)).alias(f"n_{k}") for k in ("log", "flac", "mp3")), *(F.count_if(of(k) & (F.col("n_checked") > 0)).alias(f"n_checked_{k}") for k in ("flac", "mp3")),
        *(F.coalesce(F.max(F.when(of(k), F.col("level"))), F.lit(0)).alias(f"{k}_level") for k in ("flac", "mp3")),
    )


def with_encoders(rips: DataFrame, files: DataFrame) -> DataFrame:
    """rips (path, dir, n_tracks, n_log, n_flac, n_mp3) with first_profile, is_mixed and at_fault, of MP3 files (dir, name, format, level, profile).

    They are told only where a folder's only log has as many tracks as there are MP3 files, so a list of files is as long as a
    log, whose size is capped. first_profile: that of the first file by name, null without an encoder's block, and elsewhere.
    is_mixed: another file has another profile, or none. at_fault: places from 1 of the files with errors, or with warnings
    if there are no errors.
    """
    asked = rips.where("n_log = 1 AND n_flac = 0 AND n_mp3 > 0 AND n_mp3 = n_tracks").select("path", "dir")
    tracks = files.where("format = 'mp3'").select("dir", "name", "level", "profile").join(asked, "dir")
    told = tracks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("name", "level", "profile"))).alias("_files"), F.max("level").alias("_worst"))
    first = F.get("_files", 0)["profile"]
    told = told.withColumns({
        "first_profile": first, "is_mixed": first.isNotNull() & F.exists("_files", lambda f: ~f["profile"].eqNullSafe(first)),
        "_least": F.when(F.col("_worst") >= int(Severity.ERROR), int(Severity.ERROR)).when(F.col("_worst") == int(Severity.WARNING), int(Severity.WARNING)),
    })
    places = F.transform("_files", lambda f, i: F.when(f["level"] >= F.col("_least"), i + 1))
    told = told.withColumn("at_fault", F.filter(places, lambda i: i.isNotNull()))
    return rips.join(told.select("path", "first_profile", "is_mixed", "at_fault"), "path", "left").na.fill(False, ["is_mixed"])


def encoder_rules(paired: Column) -> list[Rule]:
    """What the encoders and the faults of a rip's MP3 files come to; over with_encoders()."""
    listed = F.array_join(F.transform("at_fault", lambda i: _text("#", i)), ", ")
    return [
        Rule(paired & F.col("is_mixed"), F.lit("Inconsistent MP3 encoder settings."), Severity.WARNING, Tag.STRICT_ERR),
        Rule(paired & ~F.col("is_mixed") & F.col("first_profile").isNotNull(), _text("MP3 rip profile is ", F.col("first_profile"), "."), Severity.ADVISORY),
        Rule(paired & (F.size("at_fault") > 0), _text("File issues on MP3 ", listed, "."), F.when(F.col("mp3_level") >= int(Severity.ERROR), int(Severity.ERROR)).otherwise(int(Severity.WARNING))),
    ]


def rip_rules() -> list[Rule]:
    """What a log and its folder's audio come to together; over facts of logs with those of folders and log_level."""
    n, flac, mp3 = F.col("n_tracks"), F.col("n_flac"), F.col("n_mp3")
    many, mixed = F.col("n_log") > 1, (flac > 0) & (mp3 > 0)
    alone = ~many & ~mixed
    out = [
        Rule(many, F.lit("Folder contains more than one .log file."), Severity.ERROR, Tag.FAILURE),
        Rule(~many & mixed, F.lit("Folder contains both .flac and .mp3 files."), Severity.ERROR, Tag.FAILURE),
        Rule(alone & (flac == 0) & (mp3 == 0), _text("Folder contains no audio files, log contains ", n, " tracks."), Severity.ERROR),
    ]
    for name, count, level, checked, unchecked in (("FLAC", flac, "flac_level", "n_checked_flac", "FLAC intrinsic CRC checks not performed."), ("MP3", mp3, "mp3_level", "n_checked_mp3", "Track CRC checks not performed.")):
        here, worst = alone & (count > 0), F.greatest(F.col(level), F.col("log_level"))
        paired = here & (count == n)
        short = F.col(checked) < count if name == "FLAC" else (F.col(checked) < count) | F.col("is_mixed")
        missing = F.when(short, int(Severity.WARNING)).otherwise(int(Severity.NONE))
        verdict = F.greatest(worst, missing)
        out += [
            Rule(here & (count != n), _text("Folder contains ", count, f" .{name.lower()} files, log contains ", n, " tracks."), Severity.ERROR),
            Rule(paired & (F.col(checked) < count), F.lit(unchecked), Severity.WARNING, Tag.STRICT_ERR),
            *(encoder_rules(paired) if name == "MP3" else []),
            Rule((here & (count != n)) | (paired & (verdict >= int(Severity.ERROR))), F.lit(f"{name} rip check failed."), F.greatest(verdict, F.lit(int(Severity.ERROR))), Tag.FAILURE),
            Rule(paired & (verdict == int(Severity.WARNING)), F.lit(f"{name} rip check successful with warnings."), Severity.WARNING, Tag.SUCCESS),
            Rule(paired & (verdict < int(Severity.WARNING)), F.lit(f"{name} rip check successful."), Severity.ADVISORY, Tag.SUCCESS),
        ]
    return out


def sheets(found: DataFrame, lines: DataFrame, files: DataFrame, per_folder: DataFrame) -> DataFrame:
    """A row for each list, playlist and cue sheet of files, empty ones too; what list_rules() needs."""
    held = files.where(F.col("format").isin([k for k in KINDS if k != "log"]) & ~F.col("oversized")).select("path", "dir", F.col("format").alias("kind"))
    live = (F.col("status") == "ok") & ~lists.is_url(F.coalesce("name", F.lit("")))
    wrong = ~F.col("is_found") | ~F.col("is_supported") | ~F.coalesce("is_match", F.lit(True))
    sums = found.groupBy("path").agg(
        F.count_if(F.col("status") == "ok").alias("n_items"), F.count_if(live & F.col("is_found")).alias("n_found"), F.count_if("is_match").alias("n_matched"), F.count_if(live & wrong).alias("n_wrong"),
        F.count_if(live & ~F.col("is_found") & ~F.col("is_ignored")).alias("n_missing"), F.bool_or("has_fatal").alias("has_fatal"),
    )
    catalogs = ripping.cue_catalogs(lines.where("kind = 'cue'"), "path").groupBy("path").agg(F.bool_or(~F.col("is_valid")).alias("bad_catalog"))
    out = held.join(sums, "path", "left").join(catalogs, "path", "left").join(per_folder.select("dir", "n_flac", "flac_level"), "dir", "left")
    return out.na.fill(0, ["n_items", "n_found", "n_matched", "n_wrong", "n_missing", "n_flac", "flac_level"]).na.fill(False, ["has_fatal", "bad_catalog"])


def flagged(found: DataFrame) -> DataFrame:
    """Entries of met() with has_fatal (its list has a fatal line) and is_ignored (the only reference of a cue sheet, to a whole range)."""
    by = Window.partitionBy("path")
    bad = F.coalesce(F.bool_or(F.col("kind").isin(list(DIGITS)) & (F.col("status") != "ok")).over(by), F.lit(False))
    alone = (F.col("kind") == "cue") & (F.count("*").over(by) == 1) & (F.col("name") == RANGE_NAME)
    return found.withColumn("has_fatal", bad).withColumn("is_ignored", F.coalesce(alone, F.lit(False)))


def log_facts(lines: DataFrame) -> DataFrame:
    """A row for each log with what its sections tell."""
    mine = lines.where("kind = 'log' AND program IN ('EAC', 'XLD')")
    found = written(logs.sections(mine, "path"), "sections")
    return logs.facts(logs.headers(found, mine.select("path", "dir", "program").distinct().select("path", "program"), "path"), logs.tracks(found, "path"), "path")
