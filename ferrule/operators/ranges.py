"""Byte ranges of files: sets of [pos, pos + size), and digests over what they hold and what they leave out.

Any ranges become a set of disjoint ones by one ordered window over light rows. The set of a file, as an array beside its
content, then gives both parts in one projection, so no content is shuffled for its own sake.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.functions.bytesfn import le_uint


def merged(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, pos and size of the union of ranges (keys, pos, size): in order, disjoint, with gaps between them.

    Empty ranges, and those with a null, vanish; a negative start is cut to 0.
    """
    pos, end = F.greatest("pos", F.lit(0)).cast("long"), (F.col("pos") + F.col("size")).cast("long")
    rows = rows.where("pos IS NOT NULL AND size IS NOT NULL").select(*keys, pos.alias("pos"), end.alias("_end")).where("_end > pos")
    order = Window.partitionBy(*keys).orderBy("pos", "_end")
    before = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce((F.col("pos") > before).cast("int"), F.lit(1)))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_run").agg(F.min("pos").alias("pos"), (F.max("_end") - F.min("pos")).alias("size")).drop("_run")


def collected(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and ranges: the merged ranges of each key as an array, in order."""
    return merged(rows, *keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "size"))).alias("ranges"))


def one(pos: Column, size: Column) -> Column:
    """A set of one range."""
    return F.array(F.struct(pos.cast("long").alias("pos"), size.cast("long").alias("size")))


def clipped(ranges: Column, size: Column) -> Column:
    """What of a set lies within a file of this size."""
    cut = F.transform(ranges, lambda r: F.struct(r["pos"].alias("pos"), F.least(r["size"], size - r["pos"]).cast("long").alias("size")))
    return F.filter(cut, lambda r: r["size"] > 0)


def complement(ranges: Column, size: Column) -> Column:
    """The gaps of a set within a file of this size."""

    def gap(i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(ranges, i - 1)["pos"] + F.get(ranges, i - 1)["size"])
        end = F.when(i == F.size(ranges), size).otherwise(F.get(ranges, i)["pos"])
        return F.struct(start.cast("long").alias("pos"), (end - start).cast("long").alias("size"))

    return F.filter(F.transform(F.sequence(F.lit(0), F.size(ranges)), gap), lambda r: r["size"] > 0)


def gathered(content: Column, ranges: Column) -> Column:
    """The bytes of a set's ranges, one after the other."""
    part = lambda r: F.substring(content, (r["pos"] + 1).cast("int"), r["size"].cast("int"))
    many = F.unhex(F.array_join(F.transform(ranges, lambda r: F.hex(part(r))), ""))
    return F.when(F.size(ranges) == 1, part(F.get(ranges, F.lit(0)))).otherwise(many)


def digests(content: Column, ranges: Column, size: Column) -> dict[str, Column]:
    """media_sha1 of what a set of ranges holds, meta_sha1 of all else; null where there is no content."""
    inside = clipped(ranges, size)
    parts = {"media_sha1": inside, "meta_sha1": complement(inside, size)}
    return {name: F.when(content.isNotNull(), F.sha1(gathered(content, part))) for name, part in parts.items()}


def media(format: Column, pieces: Column, content: Column, size: Column) -> Column:
    """The range that holds a file's media, as a set: by format from its pieces; all of it where the format has no such part.

    PNG: from the first IDAT to the end of the last; WAV: what its data chunk says it holds; FLAC: all after the blocks; MP3: between the
    tags; AIFF: its FORM chunk; FLV: all after its header.
    """

    def of(kind: str) -> Column:
        return F.filter(pieces, lambda p: p["kind"] == kind)

    def end(p: Column) -> Column:
        return p["pos"] + p["size"]

    idat, data, audio, form = (of(k) for k in ("IDAT", "data", "audio", "FORM"))
    first, last = F.get(idat, F.lit(0)), F.element_at(idat, -1)
    at = F.get(data, F.lit(0))["pos"] + 8
    length = le_uint(content, at - 4, 4)
    sound = F.get(audio, F.lit(0))
    chosen = (
        F.when((format == "png") & (F.size(idat) > 0), one(first["pos"], end(last) - first["pos"]))
        .when((format == "wav") & (F.size(data) > 0), one(at, length))
        .when((format == "flac") & (F.size(audio) > 0), one(sound["pos"], size - sound["pos"]))
        .when((format == "mp3") & (F.size(audio) > 0), one(sound["pos"], sound["size"]))
        .when((format == "aif") & (F.size(form) > 0), one(F.lit(0), F.get(form, F.lit(0))["size"]))
        .when((format == "flv") & (size > 9), one(F.lit(9), size - 9))
    )
    return clipped(F.coalesce(chosen, one(F.lit(0), size)), size)
