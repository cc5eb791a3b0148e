"""The formats that are known, and the resolution of a file's true format from its name and its first bytes.

Pass 1 takes the first format, in registry order, that has the file's extension and accepts its head. Where the extension
is known and no such format accepts, pass 2 takes the first of the others that does: the file is misnamed. The registry is
of fixed size, so both passes are one expression over the head, and no content is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.operators import structures

#: Bytes of a file that decide its format.
HEADER = 44

# Extensions, sub-name, and rules on the head. A rule is a list of (place, bytes in hex) that must all be
# there; a format accepts if any of its rules holds. No rule: the name alone decides.
FORMATS: list[tuple[list[str], str, list[list[tuple[int, str]]]]] = [
    (["aif", "aiff", "aifc"], "", [[(0, "464F524D"), (8, "41494646")], [(0, "464F524D"), (8, "41494643")]]),
    (["ape"], "", [[(0, "4D414320")]]),
    (["asf", "wmv", "wma"], "", [[(0, "3026B2758E66CF11A6D900AA0062CE6C")]]),
    (["avi", "divx"], "", [[(0, "52494646"), (8, "41564920")]]),
    (["cue"], "", []),
    (["db"], "*hidden*", []),
    (["db"], "Thumbs", []),
    (["flac"], "", [[(0, "664C614300")]]),
    (["flv"], "", [[(0, "464C5601")]]),
    (["gif"], "", [[(0, "474946383761")], [(0, "474946383961")]]),
    (["ico"], "", [[(0, "00000100")]]),
    (["jpg", "jpeg"], "", [[(0, "FFD8FF")]]),
    (["log"], "EAC", [[(0, "45414320")], [(0, "457861637420417564696F20436F7079205630")], [(0, "FFFE45007800610063007400200041007500640069006F00200043006F0070007900")]]),
    (["log"], "XLD", [[(0, "58204C6F73736C657373204465636F6465722076657273696F6E20")]]),
    (["m3u"], "", []),
    (["m3u8"], "", []),
    (["m4a"], "", [[(4, "667479704D344120")]]),
    (["md5"], "", []),
    (["mkv", "mka", "webm"], "", [[(0, "1A45DFA3")]]),
    (["mov", "qt"], "", [[(4, "6D6F6F76")], [(4, "6674797071742020")]]),
    (["mp3"], "", [[(0, "494433")], [(0, "FFE2")]]),
    (["mp4"], "", [[(4, "6674797069736F6D")], [(4, "667479706D703432")]]),
    (["mpg", "mpeg", "vob"], "", [[(0, "000001B3")], [(0, "000001BA")]]),
    (["ogg", "ogm", "ogv"], "", [[(0, "4F67675300")]]),
    (["png"], "", [[(0, "89504E470D0A1A0A")]]),
    (["sha1"], "", []),
    (["sha1x"], "", []),
    (["sha256"], "", []),
    (["wav"], "", [[(0, "52494646"), (8, "57415645")]]),
]


#: Fixed value: the rule that is a mask of bits.
SYNC = [(0, "FFE2")]
#: Fixed value: formats that only files of one name have.
NAMES = {"db (Thumbs)": "thumbs.db"}


def file_format(names: list[str], magic: tuple[str, ...] = (), rules: tuple[list[tuple[int, str]], ...] = (), sub: str = "") -> Callable[[structures.Walker], structures.Walker]:
    """Registers a format: its extensions, the bytes (hex) with which its files may begin, further rules, a sub-name.

    A sub-name that begins with "*" hides files of these extensions that no other format takes: they are of no format, and that is
    no fault. As a decorator it registers the format's walker as well.
    """
    FORMATS.append((list(names), sub, [*rules, *([(0, m)] for m in magic)]))
    return structures.walker(names[0])


def long_name(names: list[str], sub: str) -> str:
    return "/".join(names) + (f" ({sub})" if sub else "")


def accepts(head: Column, places: Column, marks: Column) -> Column:
    """Whether all marks stand at their places, both given as columns; the MPEG audio sync is a mask of bits instead of bytes."""
    sync = (F.size(marks) == 1) & (F.hex(F.get(marks, F.lit(0))) == "FFE2")
    plain = F.forall(F.arrays_zip(places.alias("p"), marks.alias("m")), lambda x: F.substring(head, x["p"] + 1, F.length(x["m"])) == x["m"])
    return F.when(sync, _fits(head, SYNC)).otherwise(plain)


def _fits(head: Column, rule: list[tuple[int, str]]) -> Column:
    """Whether all marks of a rule stand at their places; the MPEG audio sync is a mask of bits instead of bytes."""
    if rule == SYNC:
        byte = lambda i: F.conv(F.hex(F.substring(head, i, 1)), 16, 10).cast("int")
        return F.coalesce((byte(1) == 0xFF) & (byte(2).bitwiseAND(F.lit(0xE6)) == 0xE2), F.lit(False))
    return reduce(lambda a, b: a & b, (F.substring(head, p + 1, len(h) // 2) == F.lit(bytearray.fromhex(h)) for p, h in rule))


def _least(hits: list[Column]) -> Column:
    return F.least(*hits) if len(hits) > 1 else hits[0]


def identify(files: DataFrame) -> DataFrame:
    """Adds format, is_misnamed and is_hidden to files (path, ext, content); format is null where nothing fits.

    The rules that begin with a first byte are tried on files with this byte alone, so a file meets few of them however many
    formats are registered.
    """
    head, name, ext = F.substring("content", 1, HEADER), F.lower(F.regexp_extract("path", r"([^/]*)$", 1)), F.col("ext")
    always, by_byte = [], {}
    shown = [f for f in FORMATS if not f[1].startswith("*")]
    for rank, (names, sub, rules) in enumerate(sorted(shown, key=lambda f: long_name(f[0], f[1]))):
        title = long_name(names, sub)
        named = F.coalesce(ext.isin(*names), F.lit(False))
        hit = F.struct((~named).cast("int").alias("late"), F.lit(rank).alias("rank"), F.lit(title).alias("format"))
        if not rules:
            always.append(F.when(named & (name == NAMES[title] if title in NAMES else F.lit(True)), hit))
        for rule in rules:
            fits = F.when(_fits(head, rule), hit)
            first = dict(rule).get(0)
            (by_byte.setdefault(first[:2], []) if first else always).append(fits)
    byte, branch = F.hex(F.substring(head, 1, 1)), None
    for key, hits in sorted(by_byte.items()):
        branch = F.when(byte == key, _least(hits)) if branch is None else branch.when(byte == key, _least(hits))
    out = files.withColumn("best", _least([*always, branch]))
    known = F.array_contains(F.lit(sorted({n for f in FORMATS for n in f[0]})), ext)
    hidden = F.coalesce(ext.isin([n for f in FORMATS if f[1].startswith("*") for n in f[0]]), F.lit(False))
    usable = F.coalesce((F.col("best.late") == 0) | (known & ~hidden & F.col("best").isNotNull()), F.lit(False))
    made = {"format": F.when(usable, F.col("best.format")), "is_misnamed": F.coalesce(usable & (F.col("best.late") == 1), F.lit(False)), "is_hidden": hidden & ~usable}
    return out.withColumns(made).drop("best")


def first_prefix(head: Column, marks: list[tuple[str, str]]) -> Column:
    """Name of the first mark that head starts with, else unknown."""
    out = F.lit("unknown")
    for name, mark in reversed(marks):
        out = F.when(F.startswith(head, F.lit(mark)), name).otherwise(out)
    return out


def resolve(kinds: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Both passes over rows with ext and magic against a small table of rank, name and magic."""
    hits = kinds.join(F.broadcast(table.withColumnRenamed("magic", "_magic")), F.col("magic") == F.col("_magic"), "left")
    late = (F.col("name") != F.col("ext")).cast("int")
    best = Window.partitionBy(*keys).orderBy(late.asc_nulls_last(), "rank")
    first = hits.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return first.select(*keys, F.col("name").alias("format"), F.coalesce(F.col("name") != F.col("ext"), F.lit(False)).alias("is_misnamed"))


def renamed(name: Column, extension: Column) -> Column:
    """The name with another extension."""
    return F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("."), extension)
