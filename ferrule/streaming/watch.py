"""A folder, or a stream of issues, watched with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import structures
from ferrule.operators.registry import FORMATS, accepts
from ferrule.sources.files import path_parts

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """Files as they appear under root."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)
    return files.select("path", *(c.alias(n) for n, c in path_parts(F.col("path")).items()), F.col("length").alias("size"), "content", F.col("modificationTime").alias("at"))


def sniffed(files: DataFrame) -> DataFrame:
    """Adds format (first extension of the first format whose marks the content has), without a join, so also on streams."""
    out = F.lit(None).cast("string")
    for names, _, rules in sorted(FORMATS, key=lambda f: "/".join(f[0]), reverse=True):
        for rule in rules:
            marks = F.array(*(F.unhex(F.lit(h)) for _, h in rule))
            out = F.when(accepts(F.substring("content", 1, 64), F.array(*(F.lit(p) for p, _ in rule)), marks), names[0]).otherwise(out)
    return files.withColumn("format", out)


def pieces(files: DataFrame) -> DataFrame:
    """Structure rows of arriving files."""
    return structures.structures(sniffed(files), "path")


def levels_by_window(issues: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Issues by time window and level; windows close once the watermark has passed them."""
    windows = issues.withWatermark(at, late).groupBy(F.window(at, width), "level").agg(F.count("*").alias("n"))
    return windows.select(F.col("window.start").alias("start"), "level", "n")
