"""Ogg media columns: write, verify, demultiplex and time-stamp Ogg streams that sit in a binary column.

Every page's checksum is verified, packets are reassembled from lacing values (also across pages), logical streams are
told apart by serial number, and the granule position of a page dates the last packet that ends there; earlier packets of
the page are dated backwards by their sample counts.

Defined results: a null text is empty; an empty text still has a payload of 64 zero bytes; equal texts give equal values;
an empty table gives no rows; other columns of the input are ignored. In read_ogg a null content has no packets, a page
with a wrong checksum gives one row with ok = false and its packets are lost, and a cut page ends the reading.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 8000
PACKET = 4096
BLOCK = 64
#: Serial numbers of the two logical streams: samples, and the note that says how many of them are payload.
SAMPLES, NOTE = 0x50434D38, 0x4E4F5445
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")


class Packet(NamedTuple):
    serial: int
    index: int
    granule: int
    data: bytes


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 04C11DB7, initial value 0, not reflected: zlib's CRC over mirrored bytes, mirrored back."""
    got = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(got.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing))
    page = head + lacing + body
    return page[:22] + struct.pack("<I", page_checksum(page)) + page[26:]


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream of (packet, granule position); a page holds at most 255 lacing values."""
    pages: list[bytes] = []
    lacing, body, granule, carried = bytearray(), bytearray(), -1, False

    def flush(last: bool, open_packet: bool) -> None:
        nonlocal lacing, body, granule, carried
        kind = carried | (not pages) << 1 | last << 2
        pages.append(_page(kind, granule, serial, len(pages), bytes(lacing), bytes(body)))
        lacing, body, granule, carried = bytearray(), bytearray(), -1, open_packet

    for k, (data, at) in enumerate(packets):
        values = bytes([255]) * (len(data) // 255) + bytes([len(data) % 255])
        done = taken = 0
        while done < len(values):
            if len(lacing) == 255:
                flush(False, done > 0)
            part = values[done : done + 255 - len(lacing)]
            lacing += part
            body += data[taken : taken + sum(part)]
            done, taken = done + len(part), taken + sum(part)
        granule = at
        if k == 0 or k == len(packets) - 1:  # a header packet has a page of its own
            flush(k == len(packets) - 1, False)
    return pages


def write_ogg(payload: bytes, n_bytes: int) -> bytes:
    """The payload as 8-bit samples in one logical stream, and n_bytes in a second one, pages interleaved."""
    cuts = range(0, len(payload), PACKET)
    sound = [(b"PCM8" + struct.pack("<I", RATE), 0)] + [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in cuts]
    note = [(b"NOTE", 0), (struct.pack("<Q", n_bytes), 1)]
    a, b = stream_pages(SAMPLES, sound), stream_pages(NOTE, note)
    return b"".join([a[0], b[0], b[1], *a[1:]])


def pages_of(media: bytes) -> Iterator[tuple[bool, int, int, int, int, bytes, int]]:
    """(checksum holds, kind, granule, serial, number, lacing values, start of the body); bytes between pages are skipped."""
    at = media.find(b"OggS")
    while 0 <= at <= len(media) - 27:
        _, _, kind, granule, serial, number, stored, n = _HEAD.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(media):
            yield False, kind, granule, serial, number, b"", at
            return
        whole = media[at:end] if at or end < len(media) else media
        good = page_checksum(whole[:22] + b"\0\0\0\0" + whole[26:]) == stored
        yield good, kind, granule, serial, number, lacing, at + 27 + n
        at = media.find(b"OggS", end if good else at + 4)


def packets_of(media: bytes) -> tuple[list[Packet], int]:
    """All whole packets by stream, and the number of bad pages and of gaps in page numbers. A packet that lost a page is dropped.

    A page dates the last packet that ends on it. Earlier ones are dated, by their length, in streams of 8-bit samples
    alone; in others they have no time (-1).
    """
    parts: dict[int, list[bytes] | None] = {}
    counts: dict[int, int] = {}
    out: list[Packet] = []
    bad = 0
    awaited: dict[int, int] = {}
    samples: set[int] = set()
    for good, kind, granule, serial, number, lacing, at in pages_of(media):
        if not good:
            bad += 1
            parts[serial] = None
            awaited.pop(serial, None)
            continue
        if awaited.get(serial, number) != number and not kind & 2:
            bad += 1
            parts[serial] = None
        awaited[serial] = (number + 1) % 2**32
        if kind & 2 and media[at : at + 4] == b"PCM8":
            samples.add(serial)
        if not kind & 1:
            parts[serial] = []
        part, ended = parts.get(serial), []
        for value in lacing:
            if part is not None:
                part.append(media[at : at + value])
            at += value
            if value < 255:
                if part is not None:
                    ended.append(b"".join(part))
                part = []
        parts[serial] = part
        later = 0  # samples of the packets after, on this page
        dated = []
        for data in reversed(ended):
            dated.append((data, granule - later if granule >= 0 and (serial in samples or not later) else -1))
            later += len(data) if serial in samples else 1
        for data, when in reversed(dated):
            index = counts.get(serial, 0)
            counts[serial] = index + 1
            out.append(Packet(serial, index, when, data))
    return out, bad


def read_ogg(df: DataFrame, content: str = "content", key: str = "doc_id", rate: int = RATE) -> DataFrame:
    """One row per packet: key, serial, packet, granule, seconds, data, ok; one row with ok = false per bad file part."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packets, bad = packets_of(media or b"")
                rows += [(k, p.serial, p.index, p.granule, p.granule / rate if p.granule >= 0 else None, p.data, True) for p in packets]
                rows += [(k, None, None, None, None, None, False)] * bad
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.bool_()))], ["key", "serial", "packet", "granule", "seconds", "data", "ok"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(content)).mapInArrow(read, f"key {kind}, serial long, packet long, granule long, seconds double, data binary, ok boolean").withColumnRenamed("key", key)


def _feature(samples: np.ndarray, packets: list[Packet], bad: int) -> str:
    wave = samples.astype(np.float32) - 128
    crossings = int(np.count_nonzero(np.diff(np.signbit(wave))))
    last = packets[-1].granule
    return (
        f"packets={len(packets)};bad_pages={bad};seconds={last / RATE:.6f};peak={int(np.abs(wave).max())};"
        f"sum={int(samples.sum(dtype=np.int64))};crossings={crossings};"
        f"levels={','.join(map(str, np.bincount(samples >> 5, minlength=8)))}"
    )


def text_media(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Store each text as Ogg, read the stored bytes back and describe them; nothing is shuffled."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(1):
                raw = raw.as_py()
                media = write_ogg(raw + b"\0" * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw)), len(raw))
                packets, bad = packets_of(media)
                sound = [p for p in packets if p.serial == SAMPLES][1:]
                (n_bytes,) = struct.unpack("<Q", [p for p in packets if p.serial == NOTE][1].data)
                payload = b"".join(p.data for p in sound)
                feature = _feature(np.frombuffer(payload, np.uint8), sound, bad)
                rows.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], ["key", *names])

    kind = df.schema[key].dataType.simpleString()
    texts = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    schema = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return texts.mapInArrow(digest, schema).withColumnRenamed("key", key)
