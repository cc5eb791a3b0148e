import hashlib
import random
import zlib

from ferrule.llm import media


def slow_checksum(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc >> 31 else crc << 1
    return crc


def test_checksum():
    rng = random.Random(0)
    for n in (0, 1, 5, 300):
        data = rng.randbytes(n)
        assert media.page_checksum(data) == slow_checksum(data)
    assert media.page_checksum(b"123456789") == 0x89A1897F


def test_round_trip_over_many_pages():
    rng = random.Random(1)
    for n in (64, 255 * 64, 4096, 70_016, 600_000 // 64 * 64):
        payload = rng.randbytes(n)
        packets, bad = media.packets_of(media.write_ogg(payload, n))
        sound = [p for p in packets if p.serial == media.SAMPLES]
        assert not bad
        assert b"".join(p.data for p in sound[1:]) == payload
        at = 0
        for p in sound[1:]:
            at += len(p.data)
            assert p.granule == at


def test_packets_longer_than_a_page_and_multiples_of_255():
    rng = random.Random(2)
    data = [rng.randbytes(n) for n in (0, 255, 510, 70_000, 65_025, 3)]
    pages = media.stream_pages(7, [(d, i) for i, d in enumerate(data)])
    packets, bad = media.packets_of(b"junk" + b"".join(pages) + b"tail")
    assert [p.data for p in packets] == data
    assert not bad


def test_damage_is_found():
    payload = bytes(range(256)) * 512
    good = bytearray(media.write_ogg(payload, len(payload)))
    good[len(good) // 2] ^= 1
    packets, bad = media.packets_of(bytes(good))
    assert bad == 1
    assert len(packets) < len(media.packets_of(media.write_ogg(payload, len(payload)))[0])
    assert media.packets_of(bytes(good[:100]))[1] <= 1
    assert media.packets_of(b"") == ([], 0)


def test_a_page_that_is_missing_is_found():
    data = [bytes([i]) * n for i, n in enumerate((300, 75_000, 40_000, 70_000, 500))]
    pages = media.stream_pages(7, [(d, i) for i, d in enumerate(data)])
    assert len(pages) >= 3
    for lost in range(1, len(pages)):
        packets, bad = media.packets_of(b"".join(pages[:lost] + pages[lost + 1 :]))
        assert all(p.data in data for p in packets), lost  # none is glued from two
        assert bad == (lost < len(pages) - 1)


def test_only_samples_are_dated_by_length():
    pages = media.stream_pages(7, [(b"x" * 10, 100), (b"y" * 20, 300)])
    packets, _ = media.packets_of(b"".join(pages))
    assert [p.granule for p in packets] in ([-1, 300], [100, 300])


def test_texts(docs, rows, no_docs):
    got = media.text_media(docs).collect()
    texts = {}
    for r in rows:
        texts.setdefault(r[0], set()).add(r[1] or "")
    for x in got:
        options = []
        for t in texts[x.doc_id]:
            raw = t.encode()
            padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
            options.append((len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) in options
    assert len(got) == len(rows)
    same = {}
    for x in got:
        assert same.setdefault(x.payload_sha256 + str(x.n_bytes), (x.media_sha256, x.feature)) == (x.media_sha256, x.feature)
    assert media.text_media(no_docs).count() == 0


def test_packet_table(spark):
    media_bytes = media.write_ogg(b"a" * 128, 100)
    df = spark.createDataFrame([(1, bytearray(media_bytes)), (2, None), (3, bytearray(media_bytes[:-5]))], "doc_id long, content binary")
    got = media.read_ogg(df).collect()
    assert sorted((x.serial, x.packet, x.seconds) for x in got if x.doc_id == 1 and x.serial == media.SAMPLES) == [(media.SAMPLES, 0, 0.0), (media.SAMPLES, 1, 128 / 8000)]
    assert not [x for x in got if x.doc_id == 2]
    assert [x.ok for x in got if x.doc_id == 3].count(False) == 1
