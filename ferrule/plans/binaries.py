"""Binary files made of the tables' rows by Spark, and walked again: every structure walker over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.functions import checksums
from ferrule.operators import headers, layouts, ordering, registry, repair, structures
from ferrule.plans.catalog import big, crc_sql, crc_tables_sql, query


def _hex(text: str) -> Column:
    return F.unhex(F.lit(text))


def _be(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def _le(value: Column, size: int) -> Column:
    return F.concat(*(_be(F.shiftright(value.cast("long"), 8 * i).bitwiseAND(F.lit(255).cast("long")), 1) for i in range(size)))


def _files(t, form: str, content: Column) -> DataFrame:
    return t.documents.select("doc_id", F.lit(form).alias("format"), content.alias("content"))


def _text() -> Column:
    return F.col("text").cast("binary")


def _walk(files: DataFrame) -> DataFrame:
    return structures.summary(structures.structures(files, "doc_id"), "doc_id")


def _counts(files: DataFrame) -> DataFrame:
    got = _walk(files)
    return got.select("doc_id", "n_pieces", "n_checked", "n_bad", "valid_size", F.size("faults").cast("long").alias("n_faults"))


def _spoiled(crc: Column) -> Column:
    return F.when(F.col("doc_id") % 10 == 3, crc.bitwiseXOR(F.lit(1).cast("long"))).otherwise(crc)


_BAD = "CASE WHEN doc_id % 10 = 3 THEN 1 ELSE 0 END::BIGINT"


@query(f"SELECT doc_id, 3::BIGINT AS n_pieces, 3::BIGINT AS n_checked, {_BAD} AS n_bad, (8 + 25 + 12 + strlen(text) + 12)::BIGINT AS valid_size, 0::BIGINT AS n_faults FROM documents")
def q_png_chunks(t):
    def part(kind: str, body: Column, spoil: bool = False) -> Column:
        named = F.concat(F.lit(kind).cast("binary"), body)
        crc = F.crc32(named)
        return F.concat(_be(F.length(body), 4), named, _be(_spoiled(crc) if spoil else crc, 4))

    head = F.concat(_be(F.lit(19), 4), _be(F.lit(19), 4), _hex("0803000001"))
    return _counts(_files(t, "png", F.concat(_hex("89504E470D0A1A0A"), part("IHDR", head), part("IDAT", _text(), True), part("IEND", _hex("")))))


_EVEN = "(strlen(text) + strlen(text) % 2)"


@query(f"SELECT doc_id, 3::BIGINT AS n_pieces, 0::BIGINT AS n_checked, 0::BIGINT AS n_bad, (12 + 24 + 8 + {_EVEN})::BIGINT AS valid_size, 0::BIGINT AS n_faults FROM documents")
def q_riff_chunks(t):
    return _counts(_files(t, "wav", _wav()))


def _wav() -> Column:
    body = F.concat(_text(), F.when(F.octet_length("text") % 2 == 1, _hex("00")).otherwise(_hex("")))
    fmt = F.concat(F.lit("fmt ").cast("binary"), _le(F.lit(16), 4), _le(F.lit(1), 2), _le(F.col("doc_id") % 2 + 1, 2), _le(F.lit(44100), 4), _le(F.lit(176400), 4), _le(F.lit(4), 2), _le(F.lit(16), 2))
    inner = F.concat(F.lit("WAVE").cast("binary"), fmt, F.lit("data").cast("binary"), _le(F.octet_length("text"), 4), body)
    return F.concat(F.lit("RIFF").cast("binary"), _le(F.length(inner), 4), inner)


@query("SELECT doc_id, (doc_id % 2 + 1)::BIGINT AS channels, 44100::BIGINT AS rate, 16::BIGINT AS bits FROM documents")
def q_wav_header(t):
    got = _files(t, "wav", _wav()).select("doc_id", headers.wav(F.col("content")).alias("h"))
    return got.select("doc_id", big("h.channels", "channels"), big("h.rate", "rate"), big("h.bits", "bits"))


@query("SELECT doc_id, (8 + strlen(text))::BIGINT AS mdat, 16::BIGINT AS ftyp, 1::BIGINT AS n_free FROM documents")
def q_mp4_boxes(t):
    def box(kind: str, body: Column) -> Column:
        return F.concat(_be(F.length(body) + 8, 4), F.lit(kind).cast("binary"), body)

    file = F.concat(box("ftyp", _hex("69736F6D00000000")), box("free", _hex("")), box("mdat", _text()))
    got = structures.structures(_files(t, "mp4", file), "doc_id")
    size = lambda k: F.sum(F.when(F.col("kind") == k, F.col("size")))
    return got.groupBy("doc_id").agg(size("mdat").alias("mdat"), size("ftyp").alias("ftyp"), F.count_if(F.col("kind") == "free").alias("n_free"))


@query("SELECT doc_id, n::BIGINT AS idx, 'L' || n || '=' || line AS note FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)")
def q_flac_tags(t):
    lines = F.split("text", "\n")
    one = F.transform(lines, lambda x, i: F.concat(F.lit("L"), (i + 1).cast("string"), F.lit("="), x))
    tags = F.aggregate(one, _hex(""), lambda acc, x: F.concat(acc, _le(F.octet_length(x), 4), x.cast("binary")))
    body = F.concat(_le(F.lit(0), 4), _le(F.size(lines), 4), tags)
    got = structures.structures(_files(t, "flac", F.concat(F.lit("fLaC").cast("binary"), _hex("84"), _be(F.length(body), 3), body)), "doc_id")
    return got.where("kind = 'tag'").select("doc_id", big("idx"), "note")


@query("SELECT doc_id, 1::BIGINT AS n_checked, CASE WHEN doc_id % 10 = 3 THEN 1 ELSE 0 END::BIGINT AS n_bad, strlen(text)::BIGINT AS void_size FROM documents")
def q_ebml_nodes(t):
    def element(key: str, body: Column) -> Column:
        return F.concat(_hex(key), _be(F.length(body) + F.lit(1 << 28), 4), body)

    inner = element("EC", _text())
    crc = F.concat(_hex("BF84"), _le(_spoiled(F.crc32(inner)), 4))
    got = structures.structures(_files(t, "mkv", F.concat(element("1A45DFA3", element("4282", F.lit("webm").cast("binary"))), element("18538067", F.concat(crc, inner)))), "doc_id")
    known = F.col("stored").isNotNull()
    return got.groupBy("doc_id").agg(F.count_if(known).alias("n_checked"), F.count_if(known & (F.col("stored") != F.col("actual"))).alias("n_bad"), F.sum(F.when(F.col("kind") == "Void", F.col("size") - 5)).alias("void_size"))


@query(f"SELECT doc_id, 2::BIGINT AS n_checked, {_BAD} AS n_bad FROM documents")
def q_flv_packets(t):
    size = F.octet_length("text")
    back = F.when(F.col("doc_id") % 10 == 3, size).otherwise(size + 11)
    got = _walk(_files(t, "flv", F.concat(_hex("464C56010500000009"), _be(F.lit(0), 4), _hex("09"), _be(size, 3), _hex("00000000000000"), _text(), _be(back, 4))))
    return got.select("doc_id", "n_checked", "n_bad")


@query()
def q_ogg_pages(t):
    """Pages of at most 255 lacing values hold up to 65,024 bytes, so longer texts take several."""
    parts = F.expr("transform(sequence(0, octet_length(text) div 60000), i -> substring(cast(text as binary), i * 60000 + 1, 60000))")
    rows = t.documents.select("doc_id", F.posexplode(parts).alias("n", "body"))
    lacing = F.concat(F.expr("unhex(repeat('FF', cast(length(body) div 255 as int)))"), _be(F.length("body") % 255, 1))
    head = F.concat(F.lit("OggS").cast("binary"), _hex("0000"), _hex("0000000000000000"), _le(F.lit(7), 4), _le(F.col("n"), 4))
    tail = F.concat(_be(F.length(lacing), 1), lacing, F.col("body"))
    crc = checksums.crc_column("crc32n0", F.concat(head, _hex("00000000"), tail))
    pages = rows.select("doc_id", "n", F.lit("ogg").alias("format"), F.concat(head, _le(crc, 4), tail).alias("content"))
    got = structures.summary(structures.structures(pages, "doc_id", "n"), "doc_id", "n")
    return got.groupBy("doc_id").agg(F.sum("n_checked").alias("n_checked"), F.sum("n_bad").alias("n_bad"), F.sum("valid_size").alias("size"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'gif' WHEN 2 THEN 'ogg/ogm/ogv' END AS format, doc_id % 4 = 1 AND doc_id % 8 = 1 AS is_misnamed FROM documents""")
def q_identify(t):
    rest = F.col("doc_id") % 4
    magic = F.when(rest == 0, _hex("89504E470D0A1A0A")).when(rest == 1, F.lit("GIF89a").cast("binary")).when(rest == 2, _hex("4F67675300")).otherwise(F.lit("?").cast("binary"))
    ext = F.when(rest == 0, "png").when(F.col("doc_id") % 8 == 1, "png").when(rest == 1, "gif").when(rest == 2, "ogg").otherwise("txt")
    docs = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("path"), ext.alias("ext"), F.concat(magic, _text()).alias("content"))
    return registry.identify(docs).select("doc_id", "format", "is_misnamed")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'none' WHEN doc_id % 3 = 1 AND strlen(text) <= 1000 AND regexp_matches(text, '^[ -~\\n\\r\\t\\x00]+$') THEN 'probable' ELSE 'possible' END AS mark FROM documents WHERE text <> ''""")
def q_watermark(t):
    docs = t.documents.where("text <> ''").select("doc_id", F.concat(_hex("00000000"), F.when(F.col("doc_id") % 3 == 2, F.concat(_hex("01"), _text())).when(F.col("doc_id") % 3 == 1, _text()).otherwise(_hex(""))).alias("content"))
    return docs.select("doc_id", repair.watermark(F.col("content"), F.lit(4).cast("long"), F.length("content").cast("long")).alias("mark"))


@query("""WITH h AS (SELECT p_partkey, 4294639616 + (p_size % 14 + 1) * 4096 + (p_partkey % 3) * 1024 + (p_partkey % 4) * 64 AS v, p_size % 14 + 1 AS i FROM part)
SELECT p_partkey, '1' AS version, 3::BIGINT AS layer, ([0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320][i + 1])::BIGINT AS kbps, ([44100, 48000, 32000][p_partkey % 3 + 1])::BIGINT AS rate,
  ['Stereo', 'Joint stereo', 'Dual channel', 'Mono'][p_partkey % 4 + 1] AS mode FROM h""")
def q_mpeg_header(t):
    head = F.lit(0xFFFB0000).cast("long") + (F.col("p_size") % 14 + 1) * 4096 + F.col("p_partkey") % 3 * 1024 + F.col("p_partkey") % 4 * 64
    got = t.part.select("p_partkey", headers.mpeg_audio(head).alias("h"))
    return got.select("p_partkey", "h.version", big("h.layer", "layer"), big("h.kbps", "kbps"), big("h.rate", "rate"), "h.mode")


_WIDTHS = [checksums.CRCS[k] for k in ("crc8", "crc16n", "crc16r")]


@query(f"""SELECT doc_id, {", ".join(f"{crc_sql('encode(text)', *checksums.CRCS[k])} AS {k}" for k in ("crc8", "crc16n", "crc16r"))} FROM documents, {crc_tables_sql(*_WIDTHS)}""")
def q_crcs(t):
    return t.documents.select("doc_id", *(checksums.crc_column(k, _text()).alias(k) for k in ("crc8", "crc16n", "crc16r")))


def _lines_as_pieces(t) -> DataFrame:
    """Each text as rows of one line with its line feed, by the bytes that they hold; the line number is no part of it."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"), F.size(F.split("text", "\n")).alias("n"))
    piece = F.when(F.col("i") + 1 < F.col("n"), F.concat("line", F.lit("\n"))).otherwise(F.col("line")).cast("binary")
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.select("doc_id", "i", piece.alias("piece"), F.length(piece).cast("long").alias("size"))
    return rows.withColumn("pos", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")))


@query(f"""SELECT doc_id, strlen(text)::BIGINT AS size, 0::BIGINT AS n_missing, xor({crc_sql("encode(text)", *checksums.MERGED["crc32"], start=4294967295)}, 4294967295) AS crc
FROM documents, {crc_tables_sql(checksums.MERGED["crc32"])} WHERE text IS NOT NULL""")
def q_crc32_merged(t):
    pieces = _lines_as_pieces(t).select("doc_id", "pos", "size", F.crc32("piece").alias("crc"))
    return checksums.merged(pieces, "crc32", "doc_id")


@query(f"""SELECT source, sum(strlen(text))::BIGINT AS size, 0::BIGINT AS n_missing, {crc_sql("encode(string_agg(text, '' ORDER BY doc_id))", *checksums.CRCS["crc16n"])} AS crc
FROM (SELECT source, text, doc_id FROM documents WHERE text IS NOT NULL), {crc_tables_sql(checksums.CRCS["crc16n"])} GROUP BY source, t{checksums.CRCS["crc16n"][1]}""")
def q_crc16_merged(t):
    """One checksum of all texts of a source, as if they were one file: places by prefix sums, pieces in any order."""
    told = t.documents.where("text is not null").select("source", "doc_id", F.octet_length("text").cast("long").alias("size"), checksums.crc_column("crc16n", _text()).alias("crc"))
    return checksums.merged(ordering.summed(told, ["source"], ["doc_id"], "size", "pos"), "crc16n", "source")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
g AS (SELECT doc_id, i, strlen(line) % 2 AS k, strlen(line) + CASE strlen(line) % 2 WHEN 1 THEN 8 ELSE 5 END AS size, i - row_number() OVER (PARTITION BY doc_id, strlen(line) % 2 ORDER BY i) AS run FROM l),
r AS (SELECT doc_id, k, min(i) AS first, count(*) AS n, sum(size) AS size FROM g GROUP BY doc_id, k, run)
SELECT doc_id, '|' || string_agg(' ' || CASE k WHEN 1 THEN 'Cluster' ELSE 'Void' END || CASE WHEN n > 1 THEN '*' || n ELSE '' END || ' (' || size || ') |', '' ORDER BY first) AS layout FROM r GROUP BY doc_id""")
def q_layout(t):
    """A Matroska file of each text: lines of odd length are clusters, others void elements."""
    sized = lambda n: F.lpad(F.hex(n + F.lit(1 << 28)), 8, "0")
    element = lambda line: F.concat(F.when(F.octet_length(line) % 2 == 1, "1F43B675").otherwise("EC"), sized(F.octet_length(line)), F.hex(line))
    inner = F.array_join(F.transform(F.split("text", "\n"), element), "")
    file = F.concat(_hex("1A45DFA3" "10000007" "4282" "84" "7765626D"), _hex("18538067"), F.unhex(sized((F.length(inner) / 2).cast("int"))), F.unhex(inner))
    made = _files(t, "mkv", file).where("content is not null")
    return structures.walked(made).select("doc_id", layouts.layout(F.col("format"), F.col("pieces")).alias("layout"))
