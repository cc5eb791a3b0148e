"""Layouts of files as text: their sections in order with sizes, runs of equal ones as one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What sections of MP3 files are called where the walker's name is another.
LABELS = {"dead": "Dead", "audio": "Audio", "APEv2": "APE"}


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often the lambdas of f use it."""
    return F.get(F.transform(F.array(value), f), 0)


def runs(pieces: Column) -> Column:
    """An array of (kind, n, size): neighbours of one kind in an array of pieces become one, with their sizes' sum. Linear in the pieces; null of null."""
    return _bound(pieces, _runs)


def _runs(pieces: Column) -> Column:
    at = lambda i: F.get(pieces, i.cast("int"))
    places = F.when(F.size(pieces) > 0, F.sequence(F.lit(0), F.size(pieces) - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | ~at(i)["kind"].eqNullSafe(at(i - 1)["kind"]))
    ends = F.when(F.size(starts) > 0, F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(pieces)))).otherwise(starts)
    total = lambda s, e: F.aggregate(F.slice(pieces, s + 1, e - s), F.lit(0).cast("long"), lambda a, p: a + p["size"])
    paired = F.zip_with(starts, ends, lambda s, e: F.struct(at(s)["kind"].alias("kind"), (e - s).alias("n"), total(s, e).alias("size")))
    return F.when(pieces.isNotNull(), paired)


def _sections(rows: Column, label, sized=lambda r: r["size"]) -> Column:
    """" name (size) |" of each."""
    return F.array_join(F.transform(rows, lambda r: F.concat(F.lit(" "), label(r), F.lit(" ("), sized(r).cast("string"), F.lit(") |"))), "")


def layout(format: Column, pieces: Column) -> Column:
    """The layout of a walked file ("| ID3v2.3 (20) | Audio (417) |"); null for formats that have none, and without pieces.

    flac: blocks with the sizes of their bodies, then the audio. mkv: what the segment holds, runs of one kind as "kind*n"
    with the whole sizes' sum. mp3: tags, dead bytes and audio. wav: Audio, and Tags if there is a chunk that is no audio.
    """
    top = F.filter(pieces, lambda p: p["depth"] == 0)
    segment = F.array_max(F.transform(top, lambda p: p["pos"]))
    inside = _bound(segment, lambda start: F.filter(pieces, lambda p: (p["depth"] == 1) & (p["pos"] > start)))
    many = lambda r: F.concat(r["kind"], F.when(r["n"] > 1, F.concat(F.lit("*"), r["n"].cast("string"))).otherwise(""))
    major = lambda p: F.regexp_extract(F.coalesce(p["note"], F.lit("")), r"^2\.(\d+)", 1)
    named = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    tag = lambda p: F.when(p["kind"] == "ID3v2", F.concat(F.lit("ID3v2."), major(p))).otherwise(F.coalesce(F.try_element_at(named, p["kind"]), p["kind"]))
    block = lambda p: F.when(p["kind"] == "audio", "Audio").otherwise(p["kind"])
    body = lambda p: F.when(p["kind"] == "audio", p["size"]).otherwise(p["size"] - 4)
    extra = F.exists(pieces, lambda p: (p["depth"] == 1) & ~p["kind"].isin("fmt ", "data", "fact"))
    text = (
        F.when(format == "flac", _sections(top, block, body)).when(format == "mkv", _sections(runs(inside), many)).when(format == "mp3", _sections(top, tag))
        .when(format == "wav", F.when(extra, " Audio | Tags |").otherwise(" Audio |"))
    )
    return F.concat(F.lit("|"), text)
