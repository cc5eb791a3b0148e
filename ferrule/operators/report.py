"""Roll-ups, verdicts and the lines of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.operators.folder import report_order
from ferrule.options import Scope, Severity


def rollup(df: DataFrame, key: str, counts: dict[str, Column]) -> DataFrame:
    """total and one count for each condition, by key."""
    return df.groupBy(key).agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in counts.items()))


def verdict(complete: Column, max_level: Column) -> Column:
    """Of a folder: failed if anything is missing or an error, else success, with warnings or without."""
    failed = ~complete | (max_level >= int(Severity.ERROR))
    return F.when(failed, "failed").when(max_level == int(Severity.WARNING), "success with warnings").otherwise("success")


def plural(count: Column, noun: str) -> Column:
    return F.concat(F.lit(noun), F.when(count == 1, "").otherwise("s"))


def count_lines(df: DataFrame, key: str, noun: str) -> DataFrame:
    """Right-aligned lines that say how many rows each key has."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return n.select(F.concat_ws(" ", F.lpad(F.col("n").cast("string"), 8, " "), key, plural(F.col("n"), noun)).alias("line"))


def issue_lines(issues: DataFrame, scope: int = Scope.VERBOSE) -> DataFrame:
    """Text of the issues (level, message, repair_kind) at or above the scope, with its prefix and what can be repaired."""
    level = F.col("level")
    prefix = F.when(level >= int(Severity.ERROR), "* Error: ").when(level == int(Severity.WARNING), "- Warning: ").otherwise("  ")
    open_ = F.when(F.col("repair_kind").isNotNull() & (level < int(Severity.ERROR)), " [repairable]").otherwise("")
    return issues.where(level >= int(scope)).withColumn("line", F.concat(prefix, "message", open_))


def digest_lines(hashes: DataFrame) -> DataFrame:
    """Digests as lines that a digest list can hold: media (:), meta (?) and whole file (*)."""
    kinds = [("media_sha1", ":"), ("meta_sha1", "?"), ("file_sha1", "*")]
    lines = F.array(*(F.when(F.col(c).isNotNull(), F.concat(F.upper(F.col(c)), F.lit(f" {m}"), "name")) for c, m in kinds if c in hashes.columns))
    return hashes.select("path", F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("line"))


#: Labels of a file's digests in reports.
LABELS = {"media_sha1": "Media SHA1= ", "meta_sha1": "Meta SHA1 = ", "file_md5": "File MD5  = ", "file_sha1": "File SHA1 = ", "file_sha256": "File SHA256="}


def header_lines(files: DataFrame, scope: int = Scope.VERBOSE) -> DataFrame:
    """path, turn and line: name, format (below verbose), digests, the range of the media (below verbose) and size of each file."""
    detail = int(scope) <= int(Scope.DETAIL)
    size = F.col("size").cast("string")
    ranged = F.lit("")
    if detail and "media" in files.columns:
        first = F.get("media", F.lit(0))
        hexed = lambda c: F.lpad(F.hex(c), 4, "0")
        ranged = F.when(F.size("media") > 0, F.concat(F.lit(" ("), hexed(first["pos"]), F.lit("-"), hexed(first["pos"] + first["size"] - 1), F.lit(")"))).otherwise("")
    told = [F.when(F.col(c).isNotNull(), F.concat(F.lit(label), F.upper(F.col(c)), ranged if c == "media_sha1" else F.lit(""))) for c, label in LABELS.items() if c in files.columns]
    kind = F.when(F.col("format").isNotNull(), F.concat(F.lit("("), "format", F.lit(")"))) if detail else F.lit(None).cast("string")
    lines = F.array(F.col("path"), kind, *told, F.concat(F.lit("File size = "), size) if detail else F.lit(None).cast("string"))
    return files.select("path", F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("turn", "line"))


def ordered_lines(files: DataFrame, issues: DataFrame, scope: int = Scope.VERBOSE) -> DataFrame:
    """path and line of a report: each file that has something to tell, its header and its issues, in folder order.

    Lines are dealt out by ranges of their order and sorted there, so they are in order over all partitions, and written parts, read
    by name, hold the report; no task has all of it.
    """
    told = issue_lines(issues, scope)
    heads = header_lines(files, scope)
    if int(scope) > int(Scope.DETAIL):
        heads = heads.join(told.select("path").distinct(), "path", "left_semi")
    first = 1 << 20
    lines = heads.select("path", F.col("turn").cast("long"), "line").union(told.select("path", F.lit(first) + F.coalesce("phase", F.lit(0)) * first + F.col("idx"), "line"))
    folder, name = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.regexp_extract("path", r"([^/]*)$", 1)
    last, name = report_order(name)
    keyed = lines.select("path", "line", folder.alias("_f"), last.alias("_l"), name.alias("_n"), F.col("turn").alias("_t"))
    keys = ["_f", "_l", "_n", "_t"]
    return keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("path", "line")


def escaped(data: Column) -> Column:
    """Text of bytes: those from 20 to 7F as they are, all others as a backslash and two hex digits."""
    byte = F.filter(F.split(F.hex(data), "(?<=\\G..)"), lambda x: x != "")
    shown = F.transform(byte, lambda x: F.when((x >= "20") & (x <= "7F"), F.decode(F.unhex(x), "US-ASCII")).otherwise(F.concat(F.lit("\\"), F.lower(x))))
    return F.array_join(shown, "")


def exit_code(issues: DataFrame) -> int:
    """The highest level of a run."""
    return int(issues.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0])
