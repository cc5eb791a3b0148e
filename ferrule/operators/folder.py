"""Checks over the files of a folder: consistency, numbering, and the match of log tracks with audio files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def all_same(value: Column) -> Column:
    """Aggregate, three-valued: true if all values are equal, null if all are null or empty, else false."""
    empty = value.isNull() | (value == "")
    n, blank = F.count("*"), F.count_if(empty)
    return F.when(blank == n, F.lit(None).cast("boolean")).otherwise((blank == 0) & (F.min(value) == F.max(value)))


def joined_values(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The values of each key in order, as one text; values are separated by two backslashes."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(*order, value))), lambda x: x[value])
    return rows.groupBy(*keys).agg(F.array_join(listed, "\\\\").alias("joined"))


def number_gap(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """is_gapless: the distinct numbers of a key run on from 1 or 2."""
    agg = rows.groupBy(*keys).agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count_distinct(number).alias("n"))
    return agg.withColumn("is_gapless", (F.col("first") <= 2) & (F.col("last") - F.col("first") + 1 == F.col("n"))).select(*keys, "n", "is_gapless")


def greedy_match(left: DataFrame, right: DataFrame, keys: list[str], crc: str, position: str) -> DataFrame:
    """Each row of right takes the first row of left with an equal checksum that no earlier one took.

    Equal checksums are taken in order on both sides, so the n-th of one side meets the n-th of the other. in_place says
    whether both have the same position; null checksums match null ones.
    """
    order = Window.partitionBy(*keys, crc).orderBy(position)
    a = left.select(*keys, F.col(crc).alias("crc"), F.col(position).alias("left_pos"), F.row_number().over(order).alias("nth"))
    b = right.select(*keys, F.col(crc).alias("crc_b"), F.col(position).alias("right_pos"), F.row_number().over(order).alias("nth"))
    a = a.toDF(*(f"a_{c}" for c in a.columns))
    same = [F.col(f"a_{k}").eqNullSafe(F.col(k)) for k in keys] + [F.col("a_crc").eqNullSafe(F.col("crc_b")), F.col("a_nth") == F.col("nth")]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    out = b.join(a, cond, "left")
    return out.select(*keys, "right_pos", F.col("a_left_pos").alias("left_pos"), F.coalesce(F.col("a_left_pos") == F.col("right_pos"), F.lit(False)).alias("in_place"))


def run_lengths(rows: DataFrame, keys: list[str], order: list[str], value: str, size: str) -> DataFrame:
    """Runs of equal neighbours: keys, run (from 1), value, n and total of size."""
    by = Window.partitionBy(*keys).orderBy(*order)
    starts = (~F.col(value).eqNullSafe(F.lag(value).over(by)) | (F.row_number().over(by) == 1)).cast("int")
    runs = rows.withColumn("_start", starts).withColumn("run", F.sum("_start").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run", value).agg(F.count("*").alias("n"), F.sum(size).alias("total"))


def folder_flags(files: DataFrame, folder: str, kind: str, log: str = "log") -> DataFrame:
    """Counts of logs and audio kinds in a folder, and whether they rule each other out."""
    out = files.groupBy(folder).agg(F.count_if(F.col(kind) == log).alias("n_logs"), F.count_if(F.col(kind) == "flac").alias("n_flac"), F.count_if(F.col(kind) == "mp3").alias("n_mp3"))
    return out.withColumns({"many_logs": F.col("n_logs") > 1, "mixed": (F.col("n_flac") > 0) & (F.col("n_mp3") > 0), "flac_without_log": (F.col("n_flac") > 0) & (F.col("n_logs") == 0)})


def report_order(name: Column) -> list[Column]:
    """Folder order: names byte by byte, cue sheets after all others, logs last."""
    last = F.when(F.endswith(name, F.lit(".log")), 2).when(F.endswith(name, F.lit(".cue")), 1).otherwise(0)
    return [last, name]
