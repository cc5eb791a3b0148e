"""Scalar functions over columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import bytesfn as b
from ferrule.plans.catalog import big, query


@query("SELECT doc_id, hex(text) AS h FROM documents")
def q_hex(t):
    return t.documents.select("doc_id", F.hex("text").alias("h"))


@query("""SELECT doc_id, regexp_extract(text, '[0-9a-f]{40}') AS token, CASE WHEN doc_id % 2 = 0 THEN 20 END::BIGINT AS n FROM documents WHERE regexp_matches(text, '[0-9a-f]{40}')""")
def q_unhex(t):
    token = F.regexp_extract("text", "[0-9a-f]{40}", 0)
    spoiled = F.when(F.col("doc_id") % 2 == 0, token).otherwise(F.concat(token, F.lit("x")))
    rows = t.documents.where(F.rlike("text", F.lit("[0-9a-f]{40}")))
    return rows.select("doc_id", token.alias("token"), F.length(F.try_to_binary(spoiled, F.lit("hex"))).cast("long").alias("n"))


@query("SELECT doc_id, ('0x' || substr(md5(text), 1, 4))::BIGINT AS value, CASE WHEN ('0x' || substr(md5(text), 1, 4))::BIGINT >= 32768 THEN ('0x' || substr(md5(text), 1, 4))::BIGINT - 65536 ELSE ('0x' || substr(md5(text), 1, 4))::BIGINT END AS as_signed FROM documents")
def q_be_int(t):
    value = b.be_uint(F.unhex(F.md5("text")), 0, 2)
    return t.documents.select("doc_id", value.alias("value"), b.signed(value, 16).alias("as_signed"))


@query("SELECT doc_id, ('0x' || substr(md5(text), 3, 2) || substr(md5(text), 1, 2))::BIGINT AS value FROM documents")
def q_le_int(t):
    return t.documents.select("doc_id", b.le_uint(F.unhex(F.md5("text")), 0, 2).alias("value"))


@query("SELECT o_orderkey, regexp_extract(o_orderpriority, '^[0-9]+')::BIGINT AS n FROM orders")
def q_leading_int(t):
    return t.orders.select("o_orderkey", b.leading_int(F.concat(F.lit("  "), "o_orderpriority")).alias("n"))


@query("SELECT doc_id, length(regexp_extract(text, '^[ -~]*'))::BIGINT AS n FROM documents")
def q_ascii_prefix(t):
    return t.documents.select("doc_id", F.length(b.ascii_prefix(F.col("text"))).cast("long").alias("n"))


@query("""WITH x AS (SELECT p_partkey, lpad(bin(p_size), 10, '0') AS s FROM part) SELECT p_partkey, substr(s, 1, 2) || ' ' || substr(s, 3, 4) || ' ' || substr(s, 7, 4) AS bits FROM x""")
def q_bitstring(t):
    return t.part.select("p_partkey", b.bit_string(F.col("p_size").cast("long"), 10).alias("bits"))


@query("SELECT p_partkey, ((v >> 24) & 127) * 2097152 + ((v >> 16) & 127) * 16384 + ((v >> 8) & 127) * 128 + (v & 127) AS n FROM (SELECT p_partkey, (p_partkey * 65793) & 2139062143 AS v FROM part)")
def q_syncsafe(t):
    value = (F.col("p_partkey") * 65793).bitwiseAND(F.lit(0x7F7F7F7F).cast("long"))
    return t.part.select("p_partkey", b.syncsafe(value).alias("n"))


@query("SELECT p_partkey, (p_partkey >> 2) & 7 AS low, (p_partkey >> 5) & 15 AS high FROM part")
def q_bitfield(t):
    return t.part.select("p_partkey", b.bit_field(F.col("p_partkey"), 2, 3).alias("low"), b.bit_field(F.col("p_partkey"), 5, 4).alias("high"))


# Bit rates of MPEG-1 layer III in kbit/s by their index in a header.
RATES = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]


@query(f"SELECT p_partkey, ({RATES}[p_size % 16 + 1])::BIGINT AS rate FROM part")
def q_table_lookup(t):
    return t.part.select("p_partkey", b.table_lookup(F.col("p_size") % 16, RATES).cast("long").alias("rate"))


@query("SELECT p_partkey, trim('  ' || p_name || ' ') AS trimmed, substr(p_name, 1, 3) AS head, strpos(p_name, ' ')::BIGINT AS blank, starts_with(p_name, 'red') AS is_red, ends_with(p_name, 'ring') AS is_ring, contains(p_name, 'o') AS has_o, upper(p_type) AS kind FROM part")
def q_string_funcs(t):
    name = F.col("p_name")
    return t.part.select(
        "p_partkey", F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"), F.substring(name, 1, 3).alias("head"), F.instr(name, " ").cast("long").alias("blank"),
        F.startswith(name, F.lit("red")).alias("is_red"), F.endswith(name, F.lit("ring")).alias("is_ring"), F.contains(name, F.lit("o")).alias("has_o"), F.upper("p_type").alias("kind"),
    )


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS artist, split_part(p_name, ' ', 2) AS album FROM part")
def q_split_part(t):
    return t.part.select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("artist"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("album"))


@query("SELECT p_partkey, floor(p_size / 39.3701 + 0.5)::BIGINT AS dpi FROM part")
def q_unit_convert(t):
    return t.part.select("p_partkey", F.floor(F.col("p_size").cast("double") / F.lit(39.3701).cast("double") + F.lit(0.5).cast("double")).alias("dpi"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, floor(l_extendedprice)::BIGINT AS size, ((floor(l_extendedprice)::BIGINT + 2047) // 2048) * 2048 AS padded FROM lineitem")
def q_round_up(t):
    size = F.floor("l_extendedprice")
    return t.lineitem.select("l_orderkey", big("l_linenumber"), size.alias("size"), (F.floor((size + 2047) / 2048) * 2048).alias("padded"))


@query("""SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'V' || (10 - p_size) WHEN p_size <= 30 THEN 'C' || p_size * 8 WHEN p_size <= 40 THEN 'A' || p_size ELSE 'R' END AS profile FROM part""")
def q_case_profile(t):
    size = F.col("p_size")
    text = lambda c: c.cast("string")
    profile = F.when(size <= 10, F.concat(F.lit("V"), text(10 - size))).when(size <= 30, F.concat(F.lit("C"), text(size * 8))).when(size <= 40, F.concat(F.lit("A"), text(size))).otherwise("R")
    return t.part.select("p_partkey", profile.alias("profile"))
