import hashlib
import random
import struct
import zlib

from pyspark.sql import functions as F

from ferrule.operators import lists, ranges, structures, trees

sha = lambda b: hashlib.sha1(b).hexdigest()


def test_merged_ranges_and_their_complement(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for key in range(12):
        size = rng.randrange(0, 60)
        held = [(rng.randrange(-3, 60), rng.randrange(0, 9)) for _ in range(rng.randrange(0, 14))]
        rows += [(key, size, p, n) for p, n in held] or [(key, size, None, None)]
        inside = {b for p, n in held for b in range(p, p + n) if 0 <= b < size}
        data = bytes((key * 7 + b) % 256 for b in range(size))
        expected[key] = (sha(bytes(data[b] for b in sorted(inside))), sha(bytes(data[b] for b in range(size) if b not in inside)))
    df = spark.createDataFrame(rows, "key int, whole int, pos long, size long")
    sets = ranges.collected(df, "key")
    files = spark.createDataFrame([(k, bytearray((k * 7 + b) % 256 for b in range(n))) for k, n in {(r[0], r[1]) for r in rows}], "key int, content binary")
    both = files.join(sets, "key", "left").withColumn("ranges", F.coalesce("ranges", F.array().cast("array<struct<pos:bigint,size:bigint>>")))
    got = {r["key"]: (r["media_sha1"], r["meta_sha1"]) for r in both.select("key", *(c.alias(n) for n, c in ranges.digests(F.col("content"), F.col("ranges"), F.length("content")).items())).collect()}
    assert got == expected
    merged = ranges.merged(df.where("key = 3"), "key").orderBy("pos").collect()
    assert all(a["pos"] + a["size"] < b["pos"] for a, b in zip(merged, merged[1:], strict=False))


def png(*bodies):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    head, tail = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)), chunk(b"tEXt", b"k\0v") + chunk(b"IEND", b"")
    data = b"".join(chunk(b"IDAT", b) for b in bodies)
    return head + data + tail, data, head + tail


def wav(samples):
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 44100, 176400, 4, 16)
    head, tail = b"WAVE" + fmt + b"data" + struct.pack("<I", len(samples)), b"\0" * (len(samples) % 2) + b"LIST" + struct.pack("<I", 4) + b"INFO"
    head = b"RIFF" + struct.pack("<I", len(head + samples + tail)) + head
    return head + samples + tail, samples, head + tail


def flac(audio):
    head = b"fLaC\0" + (34).to_bytes(3, "big") + bytes(34) + b"\x81\0\0\0"
    return head + audio, audio, head


def mp3(audio):
    head, tail = b"ID3\3\0\0\0\0\0\5" + bytes(5), b"TAG" + bytes(125)
    return head + audio + tail, audio, head + tail


def test_media_and_meta_of_real_formats(spark):
    made = {"png": png(b"abc" * 40, b"", b"more"), "wav": wav(b"sample" * 7 + b"x"), "flac": flac(b"\xff\xf8\x69\x18\0\0" + bytes(40)), "mp3": mp3(b"\xff\xfb\x90\x00" + b"a" * 400), "gif": (b"GIF89a" + bytes(30), b"GIF89a" + bytes(30), b"")}
    made["aif"] = (b"FORM" + struct.pack(">I", 4) + b"AIFF" + b"junk", b"FORM" + struct.pack(">I", 4) + b"AIFF", b"junk")
    made["flv"] = (b"FLV\1\5\0\0\0\x09" + bytes(4), bytes(4), b"FLV\1\5\0\0\0\x09")
    df = spark.createDataFrame([(n, bytearray(b), len(b)) for n, (b, _, _) in made.items()] + [("png", bytearray(b""), 0), ("txt", bytearray(b"plain"), 5), ("cue", None, 0)], "format string, content binary, size long")
    walked = structures.walked(df)
    media = ranges.media(F.col("format"), F.col("pieces"), F.col("content"), F.col("size"))
    rows = walked.withColumn("media", media)
    got = {(r["format"], r["size"]): (r["media_sha1"], r["meta_sha1"]) for r in rows.select("format", "size", *(c.alias(n) for n, c in ranges.digests(F.col("content"), F.col("media"), F.col("size")).items())).collect()}
    assert got == {(n, len(b)): (sha(a), sha(m)) for n, (b, a, m) in made.items()} | {("png", 0): (sha(b""), sha(b"")), ("txt", 5): (sha(b"plain"), sha(b"")), ("cue", 0): (None, None)}
    checks = {r["format"]: r for r in walked.where("size > 5").withColumns(structures.checks(F.col("pieces"))).collect()}
    assert (checks["png"]["n_checked"], checks["png"]["n_bad"], checks["wav"]["valid_size"]) == (6, 0, len(made["wav"][0]))


def test_entries_of_all_modes_in_one_join(spark):
    files = spark.createDataFrame([("a", sha(b"a"), sha(b"m"), sha(b"t"))], "name string, file_sha1 string, media_sha1 string, meta_sha1 string")
    items = [("a", "Binary", sha(b"a")), ("a", "Text", sha(b"x")), ("a", "Media", sha(b"m")), ("a", "Meta", sha(b"m")), ("gone", "Media", sha(b"m"))]
    df = spark.createDataFrame(items, "name string, mode string, stored string")
    got = {(r["name"], r["mode"]): (r["is_found"], r["is_match"]) for r in lists.validate_modes(df, files, ["name"]).collect()}
    assert got == {("a", "Binary"): (True, True), ("a", "Text"): (True, False), ("a", "Media"): (True, True), ("a", "Meta"): (True, False), ("gone", "Media"): (False, None)}
    other = files.withColumn("file_md5", F.col("file_sha1"))
    got = {(r["mode"], r["is_supported"], r["is_match"]) for r in lists.validate_modes(df.where("name = 'a'"), other, ["name"], "file_md5").collect()}
    assert got == {("Binary", True, True), ("Text", True, False), ("Media", False, None), ("Meta", False, None)}


def grown(rng, at, size, depth, out, parent, level):
    idx = len(out)
    out.append((idx, at, size, level, parent))
    left = at
    while depth and left < at + size and rng.random() < 0.8:
        n = rng.randrange(0, at + size - left + 1)
        if rng.random() < 0.15:
            n = 0
        left = grown(rng, left, n, depth - 1 if n else 0, out, idx, level + 1)
        left += rng.randrange(0, 3)
    return at + size


def test_depth_and_parent_of_random_trees(spark):
    rng, rows, expected = random.Random(8), [], {}
    for f in range(30):
        nodes, at = [], 0
        for _ in range(rng.randrange(1, 4)):
            at = grown(rng, at, rng.randrange(1, 80), 4, nodes, None, 0)
        seen = [n for n in nodes if n[2] or n[1] < max(m[1] + m[2] for m in nodes if m[4] == n[4] or m[0] == n[4])]
        rows += [(f"f{f}", i, p, s) for i, p, s, _, _ in nodes]
        expected[f"f{f}"] = {i: (d, par, s) for i, _, s, d, par in nodes}
        assert seen
    got = trees.nested(spark.createDataFrame(rows, "file string, idx int, pos long, size long").repartition(3), "file").collect()
    assert len(got) == len(rows)
    for r in got:
        d, parent, size = expected[r["file"]][r["idx"]]
        if size:  # where an empty one between two others belongs is a matter of order
            assert (r["depth"], r["parent"]) == (d, parent)


def element(ident, body):
    return ident + bytes([0x40 | len(body) >> 8, len(body) & 255]) + body


def test_elements_of_a_matroska_file(spark):
    track = lambda n, codec: element(b"\xae", element(b"\xd7", bytes([n])) + element(b"\x86", codec))
    data = element(b"\x1a\x45\xdf\xa3", element(b"\x42\x82", b"matroska\0")) + element(b"\x18\x53\x80\x67", element(b"\x16\x54\xae\x6b", track(1, b"V_AV1") + track(2, b"A_FLAC") + element(b"\xd7", b"\x01\x02")))
    df = spark.createDataFrame([("a", "mkv", bytearray(data))], "path string, format string, content binary")
    nodes = trees.nested(structures.structures(df, "path").drop("depth"), "path")
    assert sorted((r["kind"], r["depth"]) for r in nodes.collect())[0] == ("CodecID", 3)
    traces = trees.traces(nodes.withColumnRenamed("kind", "name"), nodes.withColumnRenamed("kind", "name").where("name = 'CodecID'"), "name", "path")
    assert [r["trace"] for r in traces.collect()] == [["Segment", "Tracks", "TrackEntry", "CodecID"]] * 2
    first = trees.first_of(nodes, "kind", "TrackNumber", "path").join(df, "path")
    payload = trees.ebml_payload(F.col("content"), F.col("node.pos"), F.col("node.size"))
    assert [r[0] for r in first.select(trees.unsigned(payload)).collect()] == ["1"]
    all_ = nodes.where("kind in ('CodecID', 'DocType', 'TrackNumber')").join(df, "path").orderBy("pos")
    payload = trees.ebml_payload(F.col("content"), F.col("pos"), F.col("size"))
    got = [(r["kind"], r["u"] if r["kind"] == "TrackNumber" else r["s"]) for r in all_.select("kind", trees.unsigned(payload).alias("u"), trees.ascii_text(payload).alias("s")).collect()]
    assert got == [("DocType", "matroska"), ("TrackNumber", "1"), ("CodecID", "V_AV1"), ("TrackNumber", "2"), ("CodecID", "A_FLAC"), ("TrackNumber", "258")]
    assert trees.nested(nodes.drop("depth", "parent").limit(0), "path").count() == 0
