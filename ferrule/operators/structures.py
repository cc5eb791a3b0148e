"""Structure walkers: the chunks, boxes, pages, blocks and tags of binary files as rows.

Walking is the one step that columns cannot express, since each place depends on the size before it. A walker is a small
generator over one file's bytes; Spark deals out the files, and everything after (checksums, counts, rules, tails) is SQL
over the rows. A row has idx, depth, kind, pos and size (of the whole piece), stored and actual checksums where the format
has them, and note (a value, or a fault that begins with "!").
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.bytesfn import read_varint, read_vint
from ferrule.functions.checksums import CRCS, crc

Piece = tuple[int, str, int, int, int | None, int | None, str | None]
Walker = Callable[[bytes], Iterator[Piece]]
WALKERS: dict[str, Walker] = {}
SCHEMA = "idx int, depth int, kind string, pos long, size long, stored long, actual long, note string"
CUT = "!truncated"


def walker(*formats: str) -> Callable[[Walker], Walker]:
    """Registers a walker for formats, named by their first extension; new formats register the same way."""

    def register(f: Walker) -> Walker:
        for name in formats:
            WALKERS[name] = f
        return f

    return register


def _name(raw: bytes) -> str:
    return raw.decode("latin-1")


def piece(kind: str, pos: int, size: int, depth: int = 0, stored: int | None = None, actual: int | None = None, note: str | None = None) -> Piece:
    return depth, kind, pos, size, stored, actual, note


def _tagged(data: bytes, at: int, end: int, order: str) -> Iterator[Piece]:
    """Chunks of a four-letter name and a 32-bit size, padded to even lengths."""
    while at + 8 <= end:
        (size,) = struct.unpack_from(order + "I", data, at + 4)
        fault = CUT if at + 8 + size > end else None
        yield piece(_name(data[at : at + 4]), at, min(8 + size + size % 2, end - at), 1, note=fault)
        at += 8 + size + size % 2


@walker("wav", "avi")
def riff(data: bytes) -> Iterator[Piece]:
    at = 0
    while data[at : at + 4] == b"RIFF" and at + 12 <= len(data):
        (size,) = struct.unpack_from("<I", data, at + 4)
        end = min(at + 8 + size, len(data))
        yield piece("RIFF", at, end - at, note=CUT if at + 8 + size > len(data) else _name(data[at + 8 : at + 12]))
        yield from _tagged(data, at + 12, end, "<")
        at = end + size % 2


@walker("aif")
def aiff(data: bytes) -> Iterator[Piece]:
    if len(data) < 12:
        yield piece("FORM", 0, len(data), note=CUT)
        return
    (size,) = struct.unpack_from(">I", data, 4)
    end = min(8 + size, len(data))
    yield piece("FORM", 0, end, note=CUT if 8 + size > len(data) else _name(data[8:12]))
    yield from _tagged(data, 12, end, ">")


@walker("png")
def png(data: bytes) -> Iterator[Piece]:
    at = 8
    while at + 12 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind = data[at + 4 : at + 8]
        if at + 12 + size > len(data):
            yield piece(_name(kind), at, len(data) - at, note=CUT)
            return
        (stored,) = struct.unpack_from(">I", data, at + 8 + size)
        yield piece(_name(kind), at, 12 + size, stored=stored, actual=zlib.crc32(data[at + 4 : at + 8 + size]))
        at += 12 + size
        if kind == b"IEND":
            return
    yield piece("IEND", at, 0, note="!missing")


@walker("mp4", "m4a", "mov")
def boxes(data: bytes) -> Iterator[Piece]:
    at = 0
    while at + 8 <= len(data):
        size, head = int.from_bytes(data[at : at + 4], "big"), 8
        if size == 1 and at + 16 <= len(data):
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = len(data) - at
        fault = "!bad size" if size < head else CUT if at + size > len(data) else "wide" if head == 16 else None
        yield piece(_name(data[at + 4 : at + 8]), at, min(max(size, 8), len(data) - at), note=fault)
        if fault and fault[0] == "!":
            return
        at += size


_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """CRC-32 of polynomial 04C11DB7, not reflected, from 0: zlib's over mirrored bytes, mirrored back."""
    got = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(got.to_bytes(4, "little").translate(_MIRROR), "big")


@walker("ogg")
def ogg(data: bytes) -> Iterator[Piece]:
    at = 0
    while data[at : at + 4] == b"OggS" and at + 27 <= len(data):
        count = data[at + 26]
        size = 27 + count + sum(data[at + 27 : at + 27 + count])
        if at + size > len(data):
            yield piece("page", at, len(data) - at, note=CUT)
            return
        page = data[at : at + size]
        yield piece("page", at, size, stored=int.from_bytes(page[22:26], "little"), actual=page_crc(page[:22] + b"\0\0\0\0" + page[26:]), note=str(int.from_bytes(page[14:18], "little")))
        at += size


# Names of the metadata blocks by type.
FLAC_BLOCKS = ["STREAMINFO", "PADDING", "APPLICATION", "SEEKTABLE", "VORBIS_COMMENT", "CUESHEET", "PICTURE"]


@walker("flac")
def flac(data: bytes) -> Iterator[Piece]:
    at, last = 4, False
    while not last:
        if at + 4 > len(data):
            yield piece("block", at, len(data) - at, note=CUT)
            return
        last, kind, size = bool(data[at] & 128), data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        name = FLAC_BLOCKS[kind] if kind < len(FLAC_BLOCKS) else f"reserved {kind}"
        body = data[at + 4 : at + 4 + size]
        cut = len(body) < size
        yield piece(name, at, 4 + len(body), note=CUT if cut else None)
        if cut:
            return
        if kind == 4:
            yield from _comments(body, at + 4)
        at += 4 + size
    if at < len(data):
        yield from _flac_audio(data, at)


def _flac_audio(data: bytes, at: int) -> Iterator[Piece]:
    """The first frame's header with its CRC-8, and all frames with the last CRC-16.

    A frame ends in its own CRC-16, which brings the remainder back to 0, so one pass over all frames checks the last.
    """
    if len(data) - at < 10 or data[at] != 0xFF or data[at + 1] & 0xFC != 0xF8:
        yield piece("audio", at, len(data) - at, note="!audio data not found")
        return
    number, size = read_varint(data, at + 4)
    block, rate = data[at + 2] >> 4, data[at + 2] & 15
    end = at + 4 + size + {6: 1, 7: 2}.get(block, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if number is None or end >= len(data):
        yield piece("audio", at, len(data) - at, note="!badly formed frame number")
        return
    yield piece("frame", at, end + 1 - at, 1, data[end], crc(data[at:end], *CRCS["crc8"]), str(number))
    yield piece("audio", at, len(data) - at, stored=int.from_bytes(data[-2:], "big"), actual=crc(data[at:-2], *CRCS["crc16n"]))


def _comments(body: bytes, start: int) -> Iterator[Piece]:
    """KEY=value lines of a comment block; duplicates and order count."""
    at = 4 + int.from_bytes(body[:4], "little")
    count = int.from_bytes(body[at : at + 4], "little")
    at += 4
    for _ in range(count):
        size = int.from_bytes(body[at : at + 4], "little")
        if at + 4 + size > len(body) or at + 4 > len(body):
            yield piece("tag", start + at, 0, 1, note="!stored tag count wrong")
            return
        yield piece("tag", start + at, 4 + size, 1, note=body[at + 4 : at + 4 + size].decode("utf-8", "replace"))
        at += 4 + size
    if at != len(body):
        yield piece("tag", start + at, 0, 1, note="!stored tag count wrong")


# EBML ids of the elements that are named in reports; masters are walked into.
EBML_MASTERS = {0x1A45DFA3: "EBML", 0x18538067: "Segment", 0x114D9B74: "SeekHead", 0x1549A966: "Info", 0x1654AE6B: "Tracks", 0xAE: "TrackEntry", 0xE0: "Video", 0xE1: "Audio", 0x1C53BB6B: "Cues", 0x1254C367: "Tags", 0x7373: "Tag", 0x1043A770: "Chapters", 0x1941A469: "Attachments"}
EBML_LEAVES = {0xBF: "CRC-32", 0xEC: "Void", 0x4282: "DocType", 0x86: "CodecID", 0xD7: "TrackNumber", 0x2AD7B1: "TimestampScale", 0x4D80: "MuxingApp", 0x5741: "WritingApp", 0xB0: "PixelWidth", 0xBA: "PixelHeight", 0x1F43B675: "Cluster"}


@walker("mkv")
def ebml(data: bytes) -> Iterator[Piece]:
    stack = [(0, len(data), 0)]
    while stack:
        at, end, depth = stack.pop()
        if at >= end:
            continue
        key, a = read_vint(data, at, marker=True)
        size, b = read_vint(data, at + a) if key is not None else (None, 0)
        if key is None or size is None:
            yield piece("?", at, end - at, depth, note=CUT)
            continue
        start, unknown = at + a + b, size == (1 << 7 * b) - 1
        stop = end if unknown else start + size
        name = EBML_MASTERS.get(key) or EBML_LEAVES.get(key) or f"{key:X}"
        if stop > end:
            yield piece(name, at, end - at, depth, note=CUT)
            continue
        stored = actual = note = None
        if name == "CRC-32":
            stored, actual = int.from_bytes(data[start:stop], "little"), zlib.crc32(data[stop:end])
        elif name in ("DocType", "CodecID", "MuxingApp", "WritingApp"):
            note = data[start:stop].rstrip(b"\0").decode("latin-1")
        yield piece(name, at, stop - at, depth, stored, actual, note)
        stack.append((stop, end, depth))
        if key in EBML_MASTERS:
            stack.append((start, stop, depth + 1))


@walker("flv")
def flv(data: bytes) -> Iterator[Piece]:
    """Packets; stored is the size that the packet after names, actual the size that it should name."""
    at = 9
    yield piece("header", 0, 9, note=str(data[4]) if len(data) > 4 else CUT)
    before = 0
    while at + 4 <= len(data):
        stored = int.from_bytes(data[at : at + 4], "big")
        yield piece("back", at, 4, stored=stored, actual=before)
        at += 4
        if at + 11 > len(data):
            break
        size = 11 + int.from_bytes(data[at + 1 : at + 4], "big")
        yield piece(str(data[at]), at, min(size, len(data) - at), note=CUT if at + size > len(data) else None)
        at, before = at + size, size


@walker("jpg")
def jpeg(data: bytes) -> Iterator[Piece]:
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark, size = data[at + 1], 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        fault = CUT if at + size > len(data) else None
        yield piece(f"{mark:02X}", at, min(size, len(data) - at), note=fault)
        at += size
        if mark == 0xDA:
            end = data.find(b"\xff\xd9", at)
            yield piece("scan", at, (end if end >= 0 else len(data)) - at, note=None if end >= 0 else "!missing end marker")
            if end >= 0:
                yield piece("D9", end, 2)
            return
    yield piece("DA", at, 0, note="!missing")


@walker("ico")
def ico(data: bytes) -> Iterator[Piece]:
    """Images; stored is the offset of the directory, actual the end of the image before."""
    count = int.from_bytes(data[4:6], "little")
    expected = 6 + 16 * count
    yield piece("directory", 0, min(expected, len(data)), note=CUT if expected > len(data) else None)
    for i in range(count):
        entry = data[6 + 16 * i : 22 + 16 * i]
        if len(entry) < 16:
            return
        size, offset = struct.unpack_from("<II", entry, 8)
        kind = "png" if data[offset : offset + 4] == b"\x89PNG" else "bmp"
        fault = CUT if offset + size > len(data) else None
        yield piece(kind, offset, size, 1, offset, expected, fault or f"{entry[0] or 256}x{entry[1] or 256}")
        expected = offset + size


@walker("mp3")
def mp3(data: bytes) -> Iterator[Piece]:
    """Sections: ID3v2, audio, and the trailers found from the end backwards."""
    start, end = 0, len(data)
    if data[:3] == b"ID3" and len(data) >= 10:
        parts = data[6:10]
        size = 10 + (parts[0] << 21 | parts[1] << 14 | parts[2] << 7 | parts[3])
        fault = "!bad size" if any(b & 128 for b in parts) else CUT if size > end else None
        start = min(size, end)
        yield piece("ID3v2", 0, start, note=fault or f"2.{data[3]}.{data[4]}")
    tail = []
    while end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        tail.append(piece("ID3v1", end - 128, 128, note="!phantom" if tail else None))
        end -= 128
    if data[end - 9 : end] == b"LYRICS200" and data[end - 15 : end - 9].isdigit():
        size = int(data[end - 15 : end - 9]) + 15
        tail.append(piece("Lyrics3v2", end - size, size))
        end -= size
    if data[end - 32 : end - 24] == b"APETAGEX":
        size = int.from_bytes(data[end - 20 : end - 16], "little")
        size += 32 if data[end - 9] & 128 else 0
        tail.append(piece("APEv2", end - size, size))
        end -= size
    sync = start
    while sync + 1 < end and not (data[sync] == 0xFF and data[sync + 1] & 0xE6 == 0xE2):
        sync += 1
    if sync > start:
        yield piece("dead", start, sync - start, note="!dead bytes")
    yield piece("audio", sync, end - sync, note="!missing audio" if sync + 1 >= end else data[sync : sync + 4].hex())
    yield from _lame(data, sync, end)
    yield from reversed(tail)


def _lame(data: bytes, sync: int, end: int) -> Iterator[Piece]:
    """The encoder's block in the first frame, and the two CRC-16s that it stores: of itself, and of the audio after it."""
    if sync + 4 > end:
        return
    mono, first = data[sync + 3] >> 6 == 3, data[sync + 1] & 8
    at = sync + (21 if mono else 36) if first else sync + (13 if mono else 21)
    if data[at : at + 4] not in (b"Xing", b"Info"):
        return
    version = data[at + 120 : at + 129].rstrip(b"\0 ").decode("latin-1")
    yield piece("Xing" if data[at : at + 4] == b"Xing" else "Info", at, min(120, end - at), 1, note=version or None)
    if data[at + 120 : at + 124] == b"LAME" and at + 156 <= end:
        stored = [int.from_bytes(data[at + k : at + k + 2], "big") for k in (154, 152)]
        yield piece("LAME header", at + 120, 36, 1, stored[0], crc(data[sync : at + 154], *CRCS["crc16r"]))
        yield piece("LAME data", at + 156, end - at - 156, 1, stored[1], crc(data[at + 156 : end], *CRCS["crc16r"]))


@walker("gif")
def gif(data: bytes) -> Iterator[Piece]:
    """The header, then extensions and images up to the trailer; a file whose blocks break off is taken as it is."""
    if len(data) < 13:
        yield piece("header", 0, len(data), note=CUT)
        return
    colours = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    at = 13 + colours(data[10])
    yield piece("header", 0, min(at, len(data)), note=f"{int.from_bytes(data[6:8], 'little')}x{int.from_bytes(data[8:10], 'little')}")
    while at < len(data) and data[at] in (0x21, 0x2C):
        start, image = at, data[at] == 0x2C
        at += 11 + colours(data[at + 9]) if image and at + 9 < len(data) else 2
        while at < len(data) and data[at]:
            at += 1 + data[at]
        at += 1
        yield piece("image" if image else "extension", start, min(at, len(data)) - start)
    if at < len(data):
        yield piece("trailer", at, 1) if data[at] == 0x3B else piece("unknown", at, len(data) - at)


@walker("mpg")
def mpeg(data: bytes) -> Iterator[Piece]:
    """The program stream up to its end code, which stands in the last 36 bytes."""
    end = data.rfind(b"\0\0\1\xb9", max(0, len(data) - 36))
    yield piece("stream", 0, len(data) if end < 0 else end + 4, note="!missing trailer" if end < 0 else None)


def walked(files: DataFrame) -> DataFrame:
    """files (format, content ...) with pieces: an array of what the walker of their format finds, null without walker or content.

    One row stays one row, so what follows from the pieces and the content of a file needs no join.
    """
    fields = [f.split(" ") for f in SCHEMA.split(", ")]
    arrow = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    kind = pa.list_(pa.struct([(n, arrow[t]) for n, t in fields]))
    names = [n for n, _ in fields]
    columns = list(files.columns)
    where = [columns.index(c) for c in ("format", "content")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for form, data in zip(*(batch.column(i).to_pylist() for i in where), strict=True):
                known = data is not None and form in WALKERS
                made.append([dict(zip(names, (n, *p), strict=True)) for n, p in enumerate(WALKERS[form](data))] if known else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], [*columns, "pieces"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{own}, pieces array<struct<{', '.join(f'{n}: {t}' for n, t in fields)}>>".replace(": long", ": bigint"))


def structures(files: DataFrame, *keys: str) -> DataFrame:
    """Rows of the pieces of files (keys, format, content); files without a walker or content have none."""
    return walked(files.select(*keys, "format", "content")).select(*keys, F.inline("pieces"))


def checks(pieces: Column) -> dict[str, Column]:
    """n_pieces, n_checked and n_bad (checksums), valid_size (end of the last piece) and faults of an array of pieces, as summary()."""
    both = lambda p: p["stored"].isNotNull() & p["actual"].isNotNull()
    faulty = F.filter(pieces, lambda p: F.startswith(p["note"], F.lit("!")))
    told = F.transform(faulty, lambda p: F.concat(p["note"].substr(F.lit(2), F.length(p["note"])), F.lit(" "), p["kind"]))
    return {
        "n_pieces": F.when(pieces.isNotNull(), F.size(pieces)).cast("long"),
        "n_checked": F.when(pieces.isNotNull(), F.size(F.filter(pieces, both))).cast("long"),
        "n_bad": F.when(pieces.isNotNull(), F.size(F.filter(pieces, lambda p: both(p) & (p["stored"] != p["actual"])))).cast("long"),
        "valid_size": F.array_max(F.transform(pieces, lambda p: p["pos"] + p["size"])),
        "faults": F.sort_array(F.array_distinct(told)),
    }


def summary(pieces: DataFrame, *keys: str) -> DataFrame:
    """By file: n_pieces, n_checked and n_bad (checksums), valid_size (end of the last piece), and faults."""
    bad = F.col("stored").isNotNull() & F.col("actual").isNotNull() & (F.col("stored") != F.col("actual"))
    return pieces.groupBy(*keys).agg(
        F.count("*").alias("n_pieces"),
        F.count(F.when(F.col("stored").isNotNull() & F.col("actual").isNotNull(), 1)).alias("n_checked"),
        F.count_if(bad).alias("n_bad"),
        F.max(F.col("pos") + F.col("size")).alias("valid_size"),
        F.sort_array(F.collect_set(F.when(F.startswith("note", F.lit("!")), F.concat(F.expr("substring(note, 2)"), F.lit(" "), "kind")))).alias("faults"),
    )
