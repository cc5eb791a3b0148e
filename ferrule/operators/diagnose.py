"""The whole run over a folder: scan, identify, walk, judge, roll up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import companions, edits, headers, issues, logs, ranges, registry, repair, structures
from ferrule.operators.rules import Rule
from ferrule.options import Hashes, Options, Severity, Tag
from ferrule.sources import files as source
from ferrule.storage import written

#: Bytes of a side that may be broadcast to the scan of contents.
BROADCAST_BYTES = 16 << 20

# The largest files of these kinds that are read, in bytes.
LIMITS = {"log": 250_000, "m3u": 524_288, "m3u8": 524_288, "cue": 524_288, "gif": 50_000_000, "ico": 50_000_000, "jpg": 50_000_000, "jpeg": 50_000_000, "png": 100_000_000, "mp3": 2_147_483_647}


#: Faults that have a rule and a repair of their own: the first always, the others where the tag's size is at fault.
MENDED = ["phantom ID3v1", "dead bytes dead", "missing audio audio"]


def checked(files: DataFrame, hashes: Hashes = Hashes.NONE) -> DataFrame:
    """files with format, is_misnamed, what their structure says, the watermark verdict, and the digests asked for.

    Digests are made for all files if hashes says so, else where a file's column wanted (an array of names, if there is one)
    has them; a digest that nobody asked for is null.
    """
    if "wanted" not in files.columns:
        files = files.withColumn("wanted", F.lit(None).cast("array<string>"))
    known = registry.identify(source.capped(files, LIMITS))
    first = known.withColumn("format", F.split_part(F.split_part("format", F.lit(" "), F.lit(1)), F.lit("/"), F.lit(1)))
    out = structures.walked(first)
    out = out.withColumns(structures.checks(F.col("pieces"))).withColumn("media", ranges.media(F.col("format"), F.col("pieces"), F.col("content"), F.col("size")))
    out = out.withColumn("watermark", F.when(F.col("valid_size").isNotNull(), repair.watermark(F.col("content"), F.col("valid_size"), F.col("size"))))
    out = out.withColumns({"bloat": edits.padding(F.col("format"), F.col("pieces")), "tag_over": edits.oversized_tag(F.col("format"), F.col("content")), "splices": edits.own_splices()})
    out = out.withColumn("profile", F.when(F.col("format") == "mp3", headers.lame_profile(F.col("content"), F.col("pieces"))))
    mended = F.when(F.col("tag_over"), F.array(*(F.lit(x) for x in MENDED))).otherwise(F.array(F.lit(MENDED[0])))
    out = out.withColumn("is_phantom", F.coalesce(F.array_contains("faults", MENDED[0]), F.lit(False))).withColumn("faults", F.array_except("faults", mended))
    fatal = F.coalesce(F.size("faults") > 0, F.lit(False)) | F.col("oversized")
    parts = ranges.digests(F.col("content"), F.col("media"), F.col("size"))
    sound = F.when(F.col("format") == "wav", ranges.gathered(F.col("content"), F.col("media")))
    digests = [
        (Hashes.FILE_MD5, "file_md5", F.md5("content")), (Hashes.FILE_SHA1, "file_sha1", F.sha1("content")), (Hashes.FILE_SHA256, "file_sha256", F.sha2("content", 256)),
        (Hashes.MEDIA_SHA1, "media_sha1", parts["media_sha1"]), (Hashes.META_SHA1, "meta_sha1", parts["meta_sha1"]),
        (Hashes.PCM_MD5, "pcm_md5", F.md5(sound)), (Hashes.PCM_CRC32, "pcm_crc32", F.crc32(sound)),
    ]
    asked = lambda flag, name: F.lit(bool(hashes & flag)) | F.coalesce(F.array_contains("wanted", name), F.lit(False))
    return out.withColumns({name: F.when(~fatal & asked(flag, name), column) for flag, name, column in digests})


def rules() -> list[Rule]:
    """What is wrong with one file, in the order in which it is reported."""
    return [
        Rule(F.col("oversized"), F.lit("Oversized file"), Severity.FATAL),
        Rule(F.col("format").isNull() & ~F.col("is_hidden"), F.lit("Unknown format"), Severity.TRIVIA),
        Rule(F.col("is_misnamed"), F.concat(F.lit("True file format is "), "format"), Severity.WARNING, repair="rename"),
        Rule(F.col("size") == 0, F.lit("File is empty"), Severity.ERROR),
        Rule(F.exists("faults", lambda f: F.startswith(f, F.lit("truncated"))), F.lit("File truncated or corrupt"), Severity.FATAL),
        Rule(F.exists("faults", lambda f: ~F.startswith(f, F.lit("truncated"))), F.concat(F.lit("Faults: "), F.array_join("faults", ", ")), Severity.ERROR),
        Rule(F.col("n_bad") > 0, F.concat(F.lit("Checksum failed on "), F.col("n_bad").cast("string"), F.lit(" of "), F.col("n_checked").cast("string")), Severity.ERROR, Tag.FAILURE),
        Rule((F.col("n_checked") > 0) & (F.col("n_bad") == 0), F.lit("Checksums hold"), Severity.NOISE, Tag.SUCCESS),
        Rule(F.col("is_phantom"), F.lit("Has phantom ID3v1 tag block."), Severity.WARNING, Tag.HAS_ID3V1, repair="phantom"),
        Rule(F.col("tag_over"), F.lit("ID3v2 tag size over by 1."), Severity.WARNING, Tag.STRICT_ERR, repair="tag size"),
        Rule(F.col("bloat.keep") >= 0, F.concat(F.lit("Artwork+padding consume "), F.col("bloat.total").cast("string"), F.lit(" bytes.")), Severity.TRIVIA, Tag.STRICT_WARN, repair="padding"),
        Rule(F.col("bloat.keep") < 0, F.concat(F.lit("Artwork+padding consume "), F.col("bloat.total").cast("string"), F.lit(" bytes.")), Severity.TRIVIA, Tag.STRICT_ERR),
        Rule(F.col("watermark") == "probable", F.lit("Probable watermark after the end"), Severity.WARNING, repair="trim"),
        Rule(F.col("watermark") == "possible", F.lit("Bytes after the end"), Severity.ADVISORY),
    ]


def _noted(files: DataFrame, found: DataFrame) -> DataFrame:
    """files with wanted: the digests that lists ask for. Few entries are broadcast, by their bytes; with many, the files are shuffled."""
    asked = companions.wanted(found)
    size = asked.agg(F.sum(F.octet_length("path") + 64)).first()[0] or 0
    return files.join(F.broadcast(asked) if size <= BROADCAST_BYTES else asked, "path", "left")


def _audit(files: DataFrame, lines: DataFrame, found: DataFrame, level: Callable[[DataFrame], DataFrame], options: Options) -> DataFrame:
    """Issues of lists, playlists, cue sheets and logs, and of what a folder holds beside them; path and what from_rules() gives."""
    own = issues.per_path(level(issues.from_rules(files, rules(), "path")), "path").select("path", F.col("max_level").alias("level"))
    graded = written(files.select("path", "dir", "name", "format", "n_checked", "oversized", "profile").join(own, "path", "left").na.fill(0, ["level"]), "graded")
    per_folder = companions.folders(graded)
    entries = written(companions.flagged(companions.met(found, files)), "entries")
    sheets = companions.sheets(entries, lines, graded, per_folder)
    flacs = graded.where("format = 'flac'").join(per_folder.where("n_log = 0").select("dir"), "dir", "left_semi")
    alone = [Rule(F.lit(True), F.lit("Found .flac file without .log file in same folder."), Severity.NOISE, Tag.STRICT_WARN)]
    parts = [
        issues.from_rules(entries.withColumnRenamed("idx", "entry"), companions.entry_rules(), "path", "line_no").drop("line_no"),
        issues.from_rules(sheets, companions.list_rules(options.repair), "path"), issues.from_rules(flacs, alone, "path"),
    ]
    if lines.where("kind = 'log'").isEmpty():
        return issues.in_phases(*parts)
    facts = written(companions.log_facts(lines), "logs")
    told = issues.from_rules(facts, logs.log_rules(), "path")
    worst = issues.per_path(level(told), "path").select("path", F.col("max_level").alias("log_level"))
    rips = facts.join(graded.select("path", "dir"), "path").join(per_folder, "dir").join(worst, "path", "left").na.fill(0, ["log_level"])
    rips = companions.with_encoders(rips, graded)
    parts.append(told)
    if options.rip:
        parts.append(issues.from_rules(rips, companions.rip_rules(), "path"))
    return issues.in_phases(*parts)


def diagnose(spark: SparkSession, options: Options) -> dict[str, DataFrame]:
    """files (without their content), issues (with level), rollup by format, and repair plans of a run; stored where they are used again."""
    scanned = source.scan(spark, options.root, options.glob, options.exclude, LIMITS)
    small = source.capped(scanned.where(F.col("ext").isin(companions.KINDS)), LIMITS)
    lines = written(companions.texts(registry.identify(small)), "lines")
    found = written(companions.entries(lines), "found")
    if not options.validations:
        found = found.where("false")
    files = checked(_noted(scanned, found), options.hashes)
    files = written(files.drop("content", "pieces", "wanted"), "files")  # the only pass over contents

    def level(told: DataFrame) -> DataFrame:
        return told.withColumn("level", issues.effective_level(F.col("base_level"), F.col("tags"), int(options.warn), int(options.err)))

    told = issues.in_phases(issues.from_rules(files, rules(), "path"), _audit(files, lines, found, level, options).drop("phase"))
    told = written(level(told), "issues")
    worst = issues.per_path(told, "path")
    each = files.where("NOT is_hidden").select("path", "format", "is_misnamed").join(worst, "path", "left").na.fill(0, ["max_level"])
    sound = files.join(worst.where(F.col("max_level") >= int(Severity.ERROR)).select("path"), "path", "left_anti")  # no repair while there are errors
    rollup = each.groupBy("format").agg(
        F.count("*").alias("total"), F.count_if(F.col("max_level") >= int(Severity.FATAL)).alias("header_errors"),
        F.count_if(F.col("max_level") == int(Severity.ERROR)).alias("data_errors"), F.count_if("is_misnamed").alias("misnamed"),
    )
    fixable = told.where("repair_kind = 'cue references'").select("path").distinct()
    sheets = small.where("ext = 'cue'").select("path", "dir", "content").join(sound.select("path"), "path", "left_semi").join(fixable, "path", "left_semi")
    more = edits.reference_splices(sheets, files.where("format = 'flac'").select("dir", "name"))
    return {"files": files, "issues": told, "rollup": rollup, "plans": repair.plans(sound, more)}
