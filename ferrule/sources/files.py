"""File scans: folders of binary files as rows, path parts, and lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: The largest file that a row can hold; larger ones are reported, whatever their extension.
LARGEST = 2_147_483_647


def scan(spark: SparkSession, root: str, glob: str | None = None, exclude: list[str] | None = None, limits: dict[str, int] | None = None) -> DataFrame:
    """path, dir, name, ext, size and content of all files under root, or of root itself if it is a file.

    content is read only by plans that use it; a count or a listing prunes it. limits: sizes by extension; what is larger has
    a null content, and its file is not opened: the condition is on the listing's metadata, so the listing itself applies it,
    and the other part's content is pruned. Spark's file scan leaves out empty files.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.load(root)
    over = _over(F.col("_metadata.file_size"), path_parts(F.col("_metadata.file_name"))["ext"], limits or {})
    named = lambda rows, content: rows.select("path", *(c.alias(n) for n, c in path_parts(F.col("path")).items()), F.col("length").alias("size"), content)
    files = named(found.where(~over), F.col("content")).union(named(found.where(over), F.lit(None).cast("binary").alias("content")))
    for part in exclude or []:
        files = files.where(~F.contains("path", F.lit(part)))
    return files


def _over(size: Column, ext: Column, limits: dict[str, int]) -> Column:
    """Whether a size is beyond what its extension may have."""
    if not limits:
        return size > LARGEST
    limit = F.create_map(*(F.lit(x) for name, most in limits.items() for x in (name, min(most, LARGEST))))
    return size > F.coalesce(F.try_element_at(limit, ext), F.lit(LARGEST))


def path_parts(path: Column) -> dict[str, Column]:
    """dir ("." if empty), name and ext (lower-case, after the last dot of the name; null if there is none)."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    return {"dir": F.when(folder == "", ".").otherwise(folder), "name": name, "ext": F.when(ext == "", None).otherwise(ext)}


def capped(files: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Adds oversized, and takes the content away where a file is larger than its extension may be.

    Contents of a table are read all the same; scan() with the same limits leaves files unopened.
    """
    over = F.coalesce(_over(F.col("size"), F.col("ext"), limits), F.lit(False))
    return files.withColumn("oversized", over).withColumn("content", F.when(~over, F.col("content")))


def decoded(content: Column, charset: str = "windows-1252") -> Column:
    """Text of bytes; bytes that the charset lacks become U+FFFD instead of failing."""
    if charset.lower() == "utf-8":
        return F.make_valid_utf8(content.cast("string"))
    if charset.lower() == "utf-16le":
        return F.decode(content, "UTF-16LE")
    return F.decode(content, charset)


def text_lines(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, line_no (from 1) and line; lines end in LF or CRLF."""
    return df.select(*keys, F.posexplode(F.split(text, "\r?\n")).alias("p", "line")).select(*keys, (F.col("p") + 1).cast("long").alias("line_no"), "line")


def playlist_items(lines: DataFrame, *keys: str) -> DataFrame:
    """Entries of playlists: left-trimmed lines that are neither blank nor comments, numbered from 1 in each list."""
    from pyspark.sql.window import Window

    items = lines.withColumn("name", F.ltrim("line")).where("name <> '' and name not like '#%'")
    order = Window.partitionBy(*keys).orderBy("line_no")
    return items.select(*keys, F.row_number().over(order).cast("long").alias("idx"), "name")
