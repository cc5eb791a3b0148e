"""Digest lists and playlists: their grammar, and their entries against what is there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the character before a name says about the digest.
MODES = {" ": "Text", "*": "Binary", ":": "Media", "?": "Meta", "!": "Undefined"}


def parse_digests(lines: DataFrame, digits: int, *keys: str) -> DataFrame:
    """Entries of digest lists from lines (keys, line_no, line).

    A line is blank, a comment (";"), "HEX, blank, mode character, name", or "name, blank, HEX". A line too short for a
    digest is fatal and ends its list; any other bad line is fatal and the list goes on. status says which; skipped lines
    and those after the end are left out.
    """
    text = F.col("line")
    skipped = (F.trim(text) == "") | F.startswith(F.ltrim(text), F.lit(";"))
    left = F.regexp_extract(text, rf"^([0-9A-Fa-f]{{{digits}}}) ([ *:?!])(.+)$", 0) != ""
    right = F.regexp_extract(text, rf"^(.+) ([0-9A-Fa-f]{{{digits}}})$", 0) != ""
    status = F.when(F.length(text) < digits + 3, "too short").when(left, "ok").when(right, "swapped").otherwise("malformed")
    hex_left, hex_right = F.substring(text, 1, digits), F.regexp_extract(text, rf" ([0-9A-Fa-f]{{{digits}}})$", 1)
    rows = lines.where(~skipped).withColumn("status", status)
    first_short = rows.where("status = 'too short'").groupBy(*keys).agg(F.min("line_no").alias("last"))  # a row for each list at most
    first_short = first_short.toDF(*(f"_{k}" for k in keys), "last")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    rows = rows.join(first_short, same, "left").where("last is null or line_no <= last")
    is_left, is_right = F.col("status") == "ok", F.col("status") == "swapped"
    mode = F.when(is_left, F.substring(text, digits + 2, 1)).when(is_right, " ")
    return rows.select(
        *keys, "line_no", "status",
        F.lower(F.when(is_left, hex_left).when(is_right, hex_right)).alias("stored"),
        F.element_at(F.create_map(*(F.lit(x) for p in MODES.items() for x in p)), mode).alias("mode"),
        F.when(is_left, F.expr(f"substring(line, {digits + 3})")).when(is_right, F.expr(f"substring(line, 1, length(line) - {digits + 1})")).alias("name"),
    )


def validate_digests(items: DataFrame, files: DataFrame, on: list[str]) -> DataFrame:
    """items (stored) against files (actual): is_found, and is_match, which stays null where nothing was found."""
    found = items.join(files.withColumn("_there", F.lit(True)), on, "left")
    return found.withColumn("is_found", F.col("_there").isNotNull()).withColumn("is_match", F.when(F.col("is_found"), F.col("stored") == F.col("actual"))).drop("_there")


def validate_modes(items: DataFrame, files: DataFrame, on: list[str], whole: str = "file_sha1") -> DataFrame:
    """items (stored, mode) against files (whole, media_sha1, meta_sha1), all modes in one join.

    Text and Binary entries tell of the whole file, Media and Meta entries of a part of it. Only lists of SHA-1 may have the
    latter; elsewhere (whole is another digest) is_match stays null and is_supported is false.
    """
    partial = F.col("mode").isin("Media", "Meta")
    supported = ~partial if whole != "file_sha1" else F.lit(True)
    actual = F.when(~partial, F.col(whole))
    if whole == "file_sha1":
        actual = F.when(F.col("mode") == "Media", F.col("media_sha1")).when(F.col("mode") == "Meta", F.col("meta_sha1")).otherwise(actual)
    found = items.join(files.withColumn("_there", F.lit(True)), on, "left").withColumn("actual", actual)
    made = {"is_found": F.col("_there").isNotNull(), "is_supported": supported, "is_match": F.when(F.col("_there") & supported, F.col("stored") == F.col("actual"))}
    return found.withColumns(made).drop("_there")


def validation_summary(checked: DataFrame, *keys: str) -> DataFrame:
    """n_items, n_found, n_matched and the verdict."""
    out = checked.groupBy(*keys).agg(F.count("*").alias("n_items"), F.count_if("is_found").alias("n_found"), F.count_if(F.coalesce("is_match", F.lit(False))).alias("n_matched"))
    good = (F.col("n_found") == F.col("n_items")) & (F.col("n_matched") == F.col("n_items"))
    return out.withColumn("verdict", F.when(good, "success").when(F.col("n_found") < F.col("n_items"), "missing").otherwise("mismatch"))


def is_url(name: Column) -> Column:
    return F.rlike(F.lower(name), F.lit("^https?:"))


def is_rooted(name: Column) -> Column:
    return F.startswith(name, F.lit("/")) | F.startswith(name, F.lit("\\")) | F.rlike(name, F.lit(r"^[A-Za-z]:\\"))


def existing(items: DataFrame, files: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(entries that are there, entries that are missing)."""
    return items.join(files, on, "left_semi"), items.join(files, on, "left_anti")
