"""Extraction logs and cue sheets: their lines as rows, and a folder's log against its audio.

Both log grammars are line grammars: a line that names a track begins it, and the lines after, up to the next, tell of it.
So the track number is carried forward by a window, and a track's row is an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.operators import folder, report

# What lines of the two grammars look like; group 1 is the value.
EAC = {"track": r"^\s*Track\s+(\d+)\s*$", "filename": r"^\s*Filename\s+(.*\S)\s*$", "pregap": r"^\s*Pre-gap length\s+(\S+)", "peak": r"^\s*Peak level\s+([0-9.]+) ?%", "quality": r"^\s*Track quality\s+([0-9.]+) ?%", "test_crc": r"^\s*Test CRC\s+([0-9A-F]{8})", "copy_crc": r"^\s*Copy CRC\s+([0-9A-F]{8})", "ar_confidence": r"Accurately ripped \(confidence (\d+)\)"}
XLD = {"track": r"^Track\s+(\d+)\s*$", "filename": r"^\s*Filename\s*:\s*(.*\S)\s*$", "pregap": r"^\s*Pre-gap length\s*:\s*(\S+)", "peak": r"^\s*Peak\s*:\s*([0-9.]+)", "quality": r"^\s*Track quality\s*:\s*([0-9.]+)", "test_crc": r"^\s*CRC32 hash \(test run\)\s*:\s*([0-9A-F]{8})", "copy_crc": r"^\s*CRC32 hash\s*:\s*([0-9A-F]{8})", "ar_confidence": r"Accurately ripped \(v\d+(?:\+v\d+)?, confidence (\d+)"}


def _value(pattern: str) -> Column:
    got = F.regexp_extract("line", pattern, 1)
    return F.when(got != "", got)


def log_tracks(lines: DataFrame, grammar: dict[str, str], key: str) -> DataFrame:
    """(key, idx, number, filename, pregap, peak, quality, test_crc, copy_crc, has_ok, ar_confidence) of logs' lines."""
    order = Window.partitionBy(key).orderBy("line_no")
    rows = lines.withColumn("number", _value(grammar["track"]).cast("int"))
    rows = rows.withColumn("idx", F.count("number").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("idx > 0")
    named = [F.max(_value(p)).alias(n) for n, p in grammar.items() if n != "track"]
    out = rows.groupBy(key, "idx").agg(F.max("number").alias("number"), *named, F.bool_or(F.rlike("line", F.lit(r"^\s*Copy OK"))).alias("has_ok"))
    crc = {n: F.conv(F.col(n), 16, 10).cast("long") for n in ("test_crc", "copy_crc")}
    return out.withColumns(crc).withColumn("ar_confidence", F.col("ar_confidence").cast("int"))


def log_headers(lines: DataFrame, key: str) -> DataFrame:
    """(key, name, value) of "name : value" lines, and artist and album from the line with a slash."""
    pair = r"^ *([^:]*[^: ]) *: +(.*?) *$"
    name, value = F.regexp_extract("line", pair, 1), F.regexp_extract("line", pair, 2)
    return lines.select(key, "line_no", name.alias("name"), F.when(value != "", value).alias("value")).where("name <> ''")


def log_faults(lines: DataFrame, key: str) -> DataFrame:
    """has_errors and is_complete of each log."""
    return lines.groupBy(key).agg(
        (~F.bool_or(F.rlike("line", F.lit("^No errors occurr?ed")))).alias("has_errors"),
        F.bool_or(F.rlike("line", F.lit("^(End of status report|==== Log checksum)"))).alias("is_complete"),
    )


def cue_items(lines: DataFrame, key: str) -> DataFrame:
    """(key, idx, name) of FILE lines; quotes are taken off."""
    name = F.regexp_extract("line", r'^\s*FILE\s+"([^"]*)"', 1)
    rows = lines.withColumn("name", name).where("name <> ''")
    return rows.select(key, F.row_number().over(Window.partitionBy(key).orderBy("line_no")).cast("long").alias("idx"), "name")


def cue_catalogs(lines: DataFrame, key: str) -> DataFrame:
    """(key, catalog, is_valid): a catalog number has 13 characters."""
    got = F.regexp_extract("line", r"^\s*CATALOG\s+(.*\S)\s*$", 1)
    return lines.select(key, got.alias("catalog")).where("catalog <> ''").withColumn("is_valid", F.length("catalog") == 13)


def validate_rip(tracks: DataFrame, audio: DataFrame, key: str) -> DataFrame:
    """Tracks of logs (key, idx, copy_crc) against audio (key, idx, crc): counts, mismatches and a verdict by folder."""
    matched = folder.greedy_match(tracks.select(key, "idx", F.col("copy_crc").alias("crc")), audio.select(key, "idx", "crc"), [key], "crc", "idx")
    n_tracks = tracks.groupBy(key).agg(F.count("*").alias("n_tracks"))
    n_audio = matched.groupBy(key).agg(F.count("*").alias("n_audio"), F.count_if("in_place").alias("n_in_place"))
    both = n_tracks.join(n_audio, key, "full").na.fill(0, ["n_tracks", "n_audio", "n_in_place"])
    level = F.when((F.col("n_tracks") == F.col("n_audio")) & (F.col("n_in_place") < F.col("n_tracks")), 5).otherwise(1)
    return both.withColumn("n_mismatch", F.col("n_tracks") - F.col("n_in_place")).withColumn("verdict", report.verdict(F.col("n_tracks") == F.col("n_audio"), level))


def fixed_cues(items: DataFrame, audio: DataFrame, key: str) -> DataFrame:
    """What each cue reference becomes if a folder has as many audio files: the n-th file for the n-th reference."""
    n_items, n_audio = Window.partitionBy(key), Window.partitionBy(key)
    left = items.withColumn("n", F.count("*").over(n_items))
    right = audio.withColumn("m", F.count("*").over(n_audio)).select(key, "idx", F.col("name").alias("new_name"), "m")
    return left.join(right, [key, "idx"]).where("n = m").select(key, "idx", "name", "new_name")
