"""Header fields at fixed places, as columns: WAV, AVI, GIF, PNG, FLAC and MPEG audio."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrule.functions.bytesfn import be_uint, bit_field, le_uint, table_lookup

# Tables of MPEG audio headers. Versions by index: 2.5, reserved, 2, 1; layers by index: reserved, III, II, I.
MPEG_VERSIONS = ["2.5", None, "2", "1"]
MPEG_RATES = [44100, 48000, 32000]
MPEG1_LAYER3_KBPS = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, None]
MPEG2_LAYER3_KBPS = [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, None]
MPEG_MODES = ["Stereo", "Joint stereo", "Dual channel", "Mono"]


def wav(data: Column) -> Column:
    return F.struct(
        le_uint(data, 20, 2).alias("format_tag"), le_uint(data, 22, 2).alias("channels"), le_uint(data, 24, 4).alias("rate"),
        le_uint(data, 28, 4).alias("bytes_per_second"), le_uint(data, 32, 2).alias("block"), le_uint(data, 34, 2).alias("bits"),
    )


def avi(data: Column) -> Column:
    return F.struct(le_uint(data, 0x38, 4).alias("streams"), le_uint(data, 0x40, 4).alias("width"), le_uint(data, 0x44, 4).alias("height"), F.substring(data, 0xBD, 4).cast("string").alias("codec"))


def gif(data: Column) -> Column:
    return F.struct(F.substring(data, 4, 3).cast("string").alias("version"), le_uint(data, 6, 2).alias("width"), le_uint(data, 8, 2).alias("height"))


def png(data: Column) -> Column:
    return F.struct(be_uint(data, 16, 4).alias("width"), be_uint(data, 20, 4).alias("height"), be_uint(data, 24, 1).alias("depth"), be_uint(data, 25, 1).alias("color"), be_uint(data, 28, 1).alias("interlace"))


def flac(data: Column) -> Column:
    """Stream information; rates, channels and the 36-bit sample count share eight bytes."""
    mixed = be_uint(data, 18, 7)
    return F.struct(
        be_uint(data, 8, 2).alias("min_block"), be_uint(data, 10, 2).alias("max_block"), bit_field(mixed, 36, 20).alias("rate"),
        (bit_field(mixed, 33, 3) + 1).alias("channels"), (bit_field(mixed, 28, 5) + 1).alias("bits"),
        (bit_field(mixed, 0, 28) * 256 + be_uint(data, 25, 1)).alias("samples"), F.lower(F.hex(F.substring(data, 27, 16))).alias("pcm_md5"),
    )


def mpeg_audio(head: Column) -> Column:
    """Fields of a 32-bit MPEG audio header."""
    version, rate = bit_field(head, 19, 2), bit_field(head, 10, 2)
    kbps = F.when(version == 3, table_lookup(bit_field(head, 12, 4).cast("int"), MPEG1_LAYER3_KBPS)).otherwise(table_lookup(bit_field(head, 12, 4).cast("int"), MPEG2_LAYER3_KBPS))
    divided = F.when(version == 3, 1).when(version == 2, 2).otherwise(4)
    return F.struct(
        table_lookup(version.cast("int"), MPEG_VERSIONS).alias("version"), (4 - bit_field(head, 17, 2)).cast("int").alias("layer"), (bit_field(head, 16, 1) == 0).alias("has_crc"),
        kbps.alias("kbps"), F.floor(table_lookup(rate.cast("int"), MPEG_RATES) / divided).alias("rate"), table_lookup(bit_field(head, 6, 2).cast("int"), MPEG_MODES).alias("mode"),
    )


# The method nibble of the encoder's block.
LAME_METHODS = [None, "CBR", "ABR", "VBR", "VBR", "VBR", "VBR", None, "CBR", "ABR"]


def xing(block: Column) -> Column:
    """Fields of an MPEG audio file's Xing block, from its first byte; frames, bytes and so on follow four flags."""
    flags = be_uint(block, 4, 4)
    has = [flags.bitwiseAND(F.lit(1 << i)) != 0 for i in range(4)]
    sizes = [F.when(h, n).otherwise(0) for h, n in zip(has, (4, 4, 100, 4), strict=True)]
    places = [F.lit(8), F.lit(8) + sizes[0], F.lit(8) + sizes[0] + sizes[1], F.lit(8) + sizes[0] + sizes[1] + sizes[2]]
    toc = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: be_uint(block, places[2] + i, 1))
    falls = F.exists(F.sequence(F.lit(1), F.lit(99)), lambda i: F.get(toc, i) < F.get(toc, i - 1))
    quality = F.when(has[3], be_uint(block, places[3], 4))
    method = table_lookup(bit_field(be_uint(block, 129, 1), 0, 4).cast("int"), LAME_METHODS)
    preset = bit_field(be_uint(block, 146, 2), 0, 11)
    return F.struct(
        F.when(has[0], be_uint(block, places[0], 4)).alias("frames"), F.when(has[1], be_uint(block, places[1], 4)).alias("bytes"), F.when(has[2], ~falls).alias("toc_rises"), quality.alias("quality"),
        F.rtrim(F.substring(block, 121, 9).cast("string")).alias("encoder"), method.alias("method"), be_uint(block, 140, 1).alias("kbps"), preset.alias("preset"),
        F.when(method == "VBR", F.concat(F.lit("V"), (10 - F.ceil(quality / 10)).cast("string"))).when(method == "CBR", F.concat(F.lit("C"), be_uint(block, 140, 1).cast("string"))).when(method == "ABR", F.concat(F.lit("A"), preset.cast("string"))).alias("profile"),
    )


# Profiles of variable rates by the first frame's sample rate, where it is not 44,100.
VBR_PROFILES = {32000: "V7", 24000: "V8", 22050: "V9"}


def lame_profile(content: Column, pieces: Column) -> Column:
    """The encoder's profile of a walked MP3 file; empty if its method is unknown, null if there is no encoder's block.

    Constant and average rates are C and A with the first frame's rate or the preset. Variable ones are V with the quality's
    tens (40 to 100) taken from 10 at 44,100 Hz, a fixed profile at three lower rates, else R with the first frame's rate.
    The tens are cut off, while xing() rounds them up: a quality of 78 is V3 here and V2 there.
    """
    first = lambda *kinds: F.get(F.filter(pieces, lambda p: p["kind"].isin(*kinds)), 0)
    frame = mpeg_audio(F.conv(first("audio")["note"], 16, 10).cast("long"))
    block = F.substring(content, (first("Xing", "Info")["pos"] + 1).cast("int"), F.lit(156))
    method, quality, rate, kbps = bit_field(be_uint(block, 129, 1), 0, 4), xing(block)["quality"], frame["rate"], frame["kbps"].cast("string")
    level = F.when(rate == 44100, F.concat(F.lit("V"), (10 - F.floor(quality / 10)).cast("string")))
    for hertz, name in VBR_PROFILES.items():
        level = level.when(rate == hertz, name)
    variable = F.coalesce(F.when(quality.between(40, 100), level), F.concat(F.lit("R"), kbps))
    told = F.when(method.between(3, 7), variable).when(method.isin(1, 8), F.concat(F.lit("C"), kbps)).when((method == 2) | method.between(9, 14), F.concat(F.lit("A"), xing(block)["preset"].cast("string")))
    return F.when(F.exists(pieces, lambda p: p["kind"] == "LAME header"), F.coalesce(told, F.lit("")))


def aiff(common: Column) -> Column:
    """Fields of a COMM chunk's body; the rate is an 80-bit float."""
    exponent, mantissa = be_uint(common, 8, 2).bitwiseAND(F.lit(0x7FFF)), be_uint(common, 10, 4).cast("double")
    return F.struct(be_uint(common, 0, 2).alias("channels"), be_uint(common, 2, 4).alias("frames"), be_uint(common, 6, 2).alias("bits"), (mantissa * F.pow(F.lit(2.0), exponent - 16383 - 31)).alias("rate"))
