"""Edit scripts: what a repair cuts from a file and puts in, as rows that compose, and their application in one pass.

A splice (offset, cut, insert) replaces cut bytes at offset. The splices of a file form its script; one whose splices overlap is
refused as a whole. Repairs that follow from a file's own bytes are columns beside its pieces; those that need other files come
from joins of light rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.functions.bytesfn import be_uint, syncsafe

# Artwork and padding that a file may have, and the padding that a repair leaves.
PICTURE_AND_PADDING, KEPT_PADDING = 1 << 20, 4096
SPLICE = "struct<kind:string,offset:bigint,cut:bigint,insert:binary>"


def splice(kind: str, offset: Column, cut: Column | int, insert: Column | None = None) -> Column:
    cut = F.lit(cut) if isinstance(cut, int) else cut
    put = F.lit(bytearray(b"")) if insert is None else insert
    return F.struct(F.lit(kind).alias("kind"), offset.cast("long").alias("offset"), cut.cast("long").alias("cut"), put.alias("insert"))


def _sum_of(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda a, p: a + p["size"] - 4)


def padding(format: Column, pieces: Column, limit: int = PICTURE_AND_PADDING) -> Column:
    """Of a FLAC file with too much artwork and padding: a struct of total (their bytes), pad (the first padding block) and keep (its bytes after a repair; negative: no repair helps); else null."""
    blocks = F.filter(pieces, lambda p: p["kind"].isin("PADDING", "PICTURE"))
    pads = F.filter(pieces, lambda p: p["kind"] == "PADDING")
    total, pad = _sum_of(blocks), F.get(pads, F.lit(0))
    rest = F.coalesce(pad["size"] - 4, F.lit(0)) - (total - limit)
    return F.when((format == "flac") & (total > limit), F.struct(total.alias("total"), pad.alias("pad"), F.least(rest, F.lit(KEPT_PADDING)).cast("long").alias("keep")))


def oversized_tag(format: Column, content: Column) -> Column:
    """Whether an MP3 file's ID3v2.3 tag says one byte more than it has: the audio's sync begins on its last byte."""
    size = syncsafe(be_uint(content, 6, 4))
    sync = (be_uint(content, size + 9, 1) == 0xFF) & (be_uint(content, size + 10, 1).bitwiseAND(F.lit(0xFE)) == 0xFA)
    return F.coalesce((format == "mp3") & (F.substring(content, 1, 4) == F.lit(bytearray(b"ID3\x03"))) & sync, F.lit(False))


def own_splices(limit: int = PICTURE_AND_PADDING) -> Column:
    """Splices that files (format, pieces, content, size, valid_size, watermark, faults) need for themselves, as an array."""
    format, pieces, content = F.col("format"), F.col("pieces"), F.col("content")
    trim = F.when(F.col("watermark") == "probable", splice("trim", F.col("valid_size"), F.col("size") - F.col("valid_size")))
    fat = padding(format, pieces, limit)
    start, old, keep = fat["pad"]["pos"], fat["pad"]["size"] - 4, fat["keep"]
    number = F.unhex(F.lpad(F.hex(keep), 6, "0"))
    pad = F.when(keep >= 0, F.array(splice("padding", start + 1, 3, number), splice("padding", start + 4 + keep, old - keep)))
    size = syncsafe(be_uint(content, 6, 4)) - 1
    low = F.unhex(F.lpad(F.hex(F.shiftright(size, 7).bitwiseAND(F.lit(0x7F)) * 256 + size.bitwiseAND(F.lit(0x7F))), 4, "0"))
    tag = F.when(oversized_tag(format, content), splice("tag size", F.lit(8), 2, low))
    twice = F.exists(F.coalesce(F.col("faults"), F.array().cast("array<string>")), lambda f: f == "phantom ID3v1")
    ghost = F.when((format == "mp3") & twice, splice("phantom", F.col("size") - 128, 128))
    single = F.filter(F.array(trim, tag, ghost), lambda x: x.isNotNull())
    return F.concat(single.cast(f"array<{SPLICE}>"), F.coalesce(pad, F.array()).cast(f"array<{SPLICE}>"))


def reference_splices(sheets: DataFrame, audio: DataFrame) -> DataFrame:
    """path and splices that give the references of cue sheets (path, dir, content) the names of the audio (dir, name) of their folder, in order.

    Only where there are as many references as audio files, and where their names can be written in Windows-1252.
    """
    text = F.decode("content", "windows-1252")  # one character a byte, so places in the text are places in the file
    lines = sheets.select("path", "dir", F.posexplode(F.split(text, "\n")).alias("i", "line"))
    before = Window.partitionBy("path").orderBy("i")
    lines = lines.withColumn("start", F.sum(F.length("line") + 1).over(before) - F.length("line") - 1)
    named = lines.where(F.rlike("line", F.lit(r'^\s*FILE [^"]*"[^"]+"'))).withColumn("old", F.regexp_extract("line", r'"([^"]+)"', 1))
    named = named.select("path", "dir", (F.col("start") + F.instr("line", '"')).alias("offset"), "old", F.row_number().over(before).alias("n"), F.count("*").over(Window.partitionBy("path")).alias("of"))
    order = Window.partitionBy("dir").orderBy("name")
    tracks = audio.select("dir", F.col("name").alias("new"), F.row_number().over(order).alias("n"), F.count("*").over(Window.partitionBy("dir")).alias("of"))
    both = named.join(tracks, ["dir", "n", "of"])
    written = F.encode("new", "windows-1252")
    both = both.withColumn("clean", F.decode(written, "windows-1252") == F.col("new"))
    made = both.groupBy("path").agg(F.bool_and("clean").alias("clean"), F.collect_list(splice("cue references", F.col("offset"), F.length("old"), written)).alias("splices"))
    return made.where("clean").select("path", "splices")


def overlaps(splices: Column) -> Column:
    """Whether any two splices of a script touch the same bytes."""
    ordered = F.sort_array(F.transform(splices, lambda s: F.struct(s["offset"].alias("at"), (s["offset"] + s["cut"]).alias("end"))))
    ends = F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0)))
    starts = F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0)))
    return F.exists(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda x: (x["a"]["end"] > x["b"]["at"]) | (x["a"]["at"] == x["b"]["at"]))


def applied(content: Column, splices: Column) -> Column:
    """The content after its script; null if splices overlap or lie beyond the end."""
    ordered = F.sort_array(F.transform(splices, lambda s: F.struct(s["offset"].alias("at"), s["cut"].alias("cut"), s["insert"].alias("put"))))
    size = F.length(content)

    def kept(i: Column) -> Column:
        """What stands between splice i - 1 and splice i, and what splice i puts in."""
        last, here = F.get(ordered, i - 1), F.get(ordered, i)
        start = F.when(i == 0, F.lit(0)).otherwise(last["at"] + last["cut"])
        end = F.coalesce(here["at"], size.cast("long"))
        part = F.substring(content, (start + 1).cast("int"), (end - start).cast("int"))
        return F.concat(F.hex(part), F.coalesce(F.hex(here["put"]), F.lit("")))

    beyond = F.exists(ordered, lambda s: (s["at"] < 0) | (s["at"] + s["cut"] > size))
    whole = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.size(ordered)), kept), ""))
    return F.when(~overlaps(splices) & ~beyond, whole)


def scripts(plan: DataFrame) -> DataFrame:
    """path, splices and new_name of a plan's rows (path, kind, offset, cut, insert, new_name)."""
    one = F.when(F.col("offset").isNotNull(), F.struct("kind", "offset", "cut", F.coalesce("insert", F.lit(bytearray(b""))).alias("insert")))
    return plan.groupBy("path").agg(F.collect_list(one).alias("splices"), F.max("new_name").alias("new_name"))

