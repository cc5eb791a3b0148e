import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from ferrule.functions import bytesfn
from ferrule.operators import headers, registry, repair, structures


def chunk(name, body, order="<"):
    return name + struct.pack(order + "I", len(body)) + body + b"\0" * (len(body) % 2)


def riff(form, *chunks):
    body = form + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def png_chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def box(name, body):
    return struct.pack(">I", 8 + len(body)) + name + body


def element(key, body):
    return key + bytes([0x80 | len(body)]) + body


def comments(*lines):
    return struct.pack("<I", 3) + b"lib" + struct.pack("<I", len(lines)) + b"".join(struct.pack("<I", len(x)) + x for x in lines)


def ogg_page(body, number=0):
    lacing = bytes([255] * (len(body) // 255) + [len(body) % 255])
    page = b"OggS\0\2" + struct.pack("<qIII", 0, 77, number, 0) + bytes([len(lacing)]) + lacing + body
    return page[:22] + struct.pack("<I", structures.page_crc(page)) + page[26:]


INFO = struct.pack(">HH", 4096, 4096) + b"\0" * 6 + ((44100 << 44) | (1 << 41) | (15 << 36) | 123456).to_bytes(8, "big") + b"\xab" * 16
CRC_BODY = element(b"\x42\x82", b"webm")
FRAME = b"\xff\xf8\xc9\x18\x00"
FRAME += bytes([bytesfn.crc(FRAME, *bytesfn.CRCS["crc8"])]) + b"samples"
FRAME += bytesfn.crc(FRAME, *bytesfn.CRCS["crc16n"]).to_bytes(2, "big")
XING = b"Xing" + struct.pack(">III", 15, 10, 4000) + bytes(range(100)) + struct.pack(">I", 78) + b"LAME3.100" + b"\x04" + b"\0" * 10 + b"\xc0" + b"\0" * 5 + struct.pack(">H", 500) + b"\0" * 4
LAME_DATA = b"audio" * 40
LAME = b"\xff\xfb\x90\x64" + b"\0" * 32 + XING + bytesfn.crc(LAME_DATA, *bytesfn.CRCS["crc16r"]).to_bytes(2, "big")
LAME += bytesfn.crc(LAME, *bytesfn.CRCS["crc16r"]).to_bytes(2, "big") + LAME_DATA
FILES = {
    "lame.mp3": LAME,
    "tone.wav": riff(b"WAVE", chunk(b"fmt ", struct.pack("<HHIIHH", 1, 2, 44100, 176400, 4, 16)), chunk(b"data", b"\1" * 9)),
    "clip.avi": riff(b"AVI ", chunk(b"LIST", b"x" * 300)),
    "tone.aif": b"FORM" + struct.pack(">I", 4 + 26) + b"AIFF" + chunk(b"COMM", b"c" * 18, ">"),
    "tile.png": b"\x89PNG\r\n\x1a\n" + png_chunk(b"IHDR", struct.pack(">IIBBBBB", 19, 21, 8, 3, 0, 0, 1)) + png_chunk(b"IDAT", b"zz") + png_chunk(b"IEND", b""),
    "film.mp4": box(b"ftyp", b"isom0000") + box(b"moov", b"m" * 20) + box(b"mdat", b"d" * 40),
    "song.ogg": ogg_page(b"a" * 300) + ogg_page(b"b" * 255, 1),
    "song.flac": b"fLaC\0" + len(INFO).to_bytes(3, "big") + INFO + b"\x84" + len(comments(b"A=1", b"B=x")).to_bytes(3, "big") + comments(b"A=1", b"B=x") + FRAME * 3,
    "film.mkv": element(b"\x1a\x45\xdf\xa3", element(b"\xbf", struct.pack("<I", zlib.crc32(CRC_BODY))) + CRC_BODY) + element(b"\x18\x53\x80\x67", element(b"\xec", b"")),
    "film.flv": b"FLV\1\5\0\0\0\x09" + struct.pack(">I", 0) + b"\x09\0\0\4" + b"\0" * 7 + b"data" + struct.pack(">I", 15),
    "face.jpg": b"\xff\xd8\xff\xe0" + struct.pack(">H", 6) + b"JFIF" + b"\xff\xda" + struct.pack(">H", 4) + b"ab" + b"scan\xff\xd9",
    "icon.ico": b"\0\0\1\0\1\0" + struct.pack("<BBBBHHII", 16, 16, 0, 0, 1, 32, 4, 22) + b"bmp!",
    "song.mp3": b"ID3\4\0\0\0\0\0\5hello" + b"\xff\xfb\x90\x64" + b"\0" * 60 + b"TAG" + b"t" * 125,
    "pic.gif": b"GIF89a" + struct.pack("<HH", 300, 301) + b"\x80\0\0" + b"\0\0\0\xff\xff\xff" + b"\x21\xfe\x02hi\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0" + b"\x3b",
    "disc.mpg": b"\0\0\1\xba" + b"x" * 50 + b"\0\0\1\xb9",
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(n, n.split(".")[1], bytearray(b)) for n, b in FILES.items()]
    return spark.createDataFrame(rows, "path string, ext string, content binary").withColumn("size", F.length("content"))


def test_every_format_is_walked_whole(files):
    known = registry.identify(files)
    assert known.where("format is null or is_misnamed").count() == 0
    first = known.withColumn("format", F.split_part("format", F.lit("/"), F.lit(1)))
    got = {x.path: x for x in structures.summary(structures.structures(first, "path"), "path").collect()}
    assert set(got) == set(FILES)
    for name, x in got.items():
        assert (x.n_bad, x.faults) == (0, []), x
        assert x.valid_size == len(FILES[name]), x


def test_cut_files_are_reported(spark):
    rows = [(n, n.split(".")[1], bytearray(b[:-3])) for n, b in FILES.items() if n not in ("pic.gif", "song.mp3")]  # a GIF that breaks off is taken as it is
    df = spark.createDataFrame(rows, "path string, format string, content binary")
    got = {x.path: x for x in structures.summary(structures.structures(df, "path"), "path").collect()}
    for name, *_ in rows:
        x = got[name]
        assert x.faults or x.n_bad or x.valid_size < len(FILES[name]), name


def test_flipped_bytes_fail_their_checksum(spark):
    rows = []
    for name, at in (("tile.png", 18), ("song.ogg", 100), ("film.mkv", 15), ("film.flv", 12), ("lame.mp3", len(LAME) - 9), ("song.flac", len(FILES["song.flac"]) - 5)):
        data = bytearray(FILES[name])
        data[at] ^= 1
        rows.append((name, name.split(".")[1], data))
    df = spark.createDataFrame(rows, "path string, format string, content binary")
    assert {x.path: x.n_bad for x in structures.summary(structures.structures(df, "path"), "path").collect()} == {n: 1 for n, *_ in rows}


def test_random_bytes_never_break_a_walker():
    rng = random.Random(0)
    for name, data in FILES.items():
        walk = structures.WALKERS[name.split(".")[1]]
        for _ in range(200):
            bad = bytearray(data)
            for _ in range(rng.randrange(1, 8)):
                bad[rng.randrange(len(bad))] = rng.randrange(256)
            list(walk(bytes(bad[: rng.randrange(len(bad) + 1)])))


def test_tags_keep_order_and_duplicates(spark):
    data = b"fLaC\x84" + len(comments(b"B=2", b"A=1", b"B=2")).to_bytes(3, "big") + comments(b"B=2", b"A=1", b"B=2")
    df = spark.createDataFrame([("x", "flac", bytearray(data))], "path string, format string, content binary")
    assert [x.note for x in structures.structures(df, "path").where("kind = 'tag'").orderBy("idx").collect()] == ["B=2", "A=1", "B=2"]


def test_headers(files):
    def field(name, struct_of):
        return files.where(F.col("path") == name).select(struct_of(F.col("content")).alias("h")).first().h.asDict()

    assert field("tone.wav", headers.wav) == {"format_tag": 1, "channels": 2, "rate": 44100, "bytes_per_second": 176400, "block": 4, "bits": 16}
    assert field("pic.gif", headers.gif) == {"version": "89a", "width": 300, "height": 301}
    assert field("tile.png", headers.png) == {"width": 19, "height": 21, "depth": 8, "color": 3, "interlace": 1}
    flac = field("song.flac", headers.flac)
    assert (flac["rate"], flac["channels"], flac["bits"], flac["samples"], flac["min_block"]) == (44100, 2, 16, 123456, 4096)
    head = files.where("path = 'song.mp3'").select(headers.mpeg_audio(bytesfn.be_uint(F.col("content"), 15, 4)).alias("h")).first().h
    lame = files.where("path = 'lame.mp3'").select(headers.xing(F.expr("substring(content, 37)")).alias("h")).first().h
    assert (lame.frames, lame.bytes, lame.toc_rises, lame.quality, lame.encoder, lame.method, lame.preset, lame.profile) == (10, 4000, True, 78, "LAME3.100", "VBR", 500, "V2")
    common = files.where("path = 'tone.wav'").select(headers.aiff(F.unhex(F.lit("000200000064001040" + "0EAC44000000000000"))).alias("h")).first().h
    assert (common.channels, common.frames, common.bits, common.rate) == (2, 100, 16, 44100.0)
    assert (head.version, head.layer, head.kbps, head.rate, head.mode) == ("1", 3, 128, 44100, "Joint stereo")


def test_misnamed_and_unknown(spark):
    rows = [("a.png", "png", FILES["icon.ico"]), ("b.xyz", "xyz", FILES["pic.gif"]), ("c.png", "png", b"nothing"), ("d.cue", "cue", b"FILE"), ("e.MP3", "mp3", FILES["song.mp3"])]
    df = spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in rows], "path string, ext string, content binary")
    got = {x.path: (x.format, x.is_misnamed) for x in registry.identify(df).collect()}
    assert got == {"a.png": ("ico", True), "b.xyz": (None, False), "c.png": (None, False), "d.cue": ("cue", False), "e.MP3": ("mp3", False)}


def test_repairs_are_plans(spark, tmp_path):
    good = FILES["film.mp4"]
    rows = [("/x/a.mp4", "a.mp4", "mp4", good + b"mark!", len(good), "mp4", False), ("/x/b.png", "b.png", "png", FILES["icon.ico"], len(FILES["icon.ico"]), "ico", True), ("/x/c.mp4", "c.mp4", "mp4", good + b"\1\2", len(good), "mp4", False)]
    df = spark.createDataFrame([(*r[:3], bytearray(r[3]), *r[4:]) for r in rows], "path string, name string, ext string, content binary, valid_size long, format string, is_misnamed boolean").withColumn("size", F.length("content").cast("long"))
    plan = repair.plans(df)
    assert sorted((x.path, x.kind, x.offset, x.cut, x.new_name) for x in plan.collect()) == [("/x/a.mp4", "trim", len(good), 5, None), ("/x/b.png", "rename", None, None, "b.ico")]
    assert {x.name: bytes(x.content) for x in repair.repaired(df, plan).collect()} == {"a.mp4": good, "b.ico": FILES["icon.ico"]}
    assert not repair.write_copies(df, plan, str(tmp_path)).where("ok").count()
    assert not list(tmp_path.iterdir())
    assert repair.write_copies(df, plan, str(tmp_path), confirmed=True).where("ok").count() == 2
    assert {p.read_bytes() for p in tmp_path.iterdir()} == {good, FILES["icon.ico"]}
