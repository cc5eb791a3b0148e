"""Scans, sniffing, digests and lists, with documents as files and pages as paths."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.functions import checksums
from ferrule.operators import lists, registry
from ferrule.operators.ordering import numbered
from ferrule.plans.catalog import crc_sql, crc_tables_sql, query
from ferrule.sources import files

_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query(f"SELECT {_HOST} || '/' || regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]*)', 1) AS dir, count(*)::BIGINT AS n FROM pages GROUP BY 1")
def q_scan_dirs(t):
    host, first = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.regexp_extract("url", "^[a-z]+://[^/?#]*/([^/?#]*)", 1)
    return t.pages.groupBy(F.concat(host, F.lit("/"), first).alias("dir")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'blue%'")
def q_filter_glob(t):
    return t.part.where(F.col("p_name").like("blue%")).select("p_partkey", "p_name")


@query("SELECT count(*)::BIGINT AS n FROM lineitem")
def q_count(t):
    return t.lineitem.agg(F.count("*").alias("n"))


@query("SELECT page_id, url FROM pages WHERE NOT contains(url, 'utm_')")
def q_exclude(t):
    return t.pages.where(~F.contains("url", F.lit("utm_"))).select("page_id", "url")


@query("""
WITH c AS (SELECT 'page' AS kind, page_id AS id, html AS content FROM pages UNION ALL SELECT 'doc', doc_id, text FROM documents),
s AS (SELECT kind, id, substr(content, 1, 44) AS head FROM c)
SELECT kind, CASE WHEN starts_with(head, '<!DOCTYPE html') THEN 'html' WHEN starts_with(head, '#EXTM3U') THEN 'm3u'
  WHEN starts_with(head, 'EAC ') THEN 'log' WHEN starts_with(head, 'The ') THEN 'the' ELSE 'unknown' END AS format, count(*)::BIGINT AS n
FROM s GROUP BY ALL""")
def q_magic_sniff(t):
    both = t.pages.select(F.lit("page").alias("kind"), F.col("html").alias("content")).union(t.documents.select(F.lit("doc"), "text"))
    marks = [("html", "<!DOCTYPE html"), ("m3u", "#EXTM3U"), ("log", "EAC "), ("the", "The ")]
    head = F.substring("content", 1, registry.HEADER)
    return both.select("kind", registry.first_prefix(head, marks).alias("format")).groupBy("kind", "format").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 6::BIGINT AS level FROM documents WHERE strlen(text) > 8192")
def q_size_cap(t):
    docs = t.documents.select("doc_id", F.lit("txt").alias("ext"), F.octet_length("text").alias("size"), F.lit(None).alias("content"))
    return files.capped(docs, {"txt": 8192}).where("oversized").select("doc_id", F.lit(6).cast("long").alias("level"))


@query("SELECT doc_id, nth::BIGINT AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM documents)")
def q_line_explode(t):
    return files.text_lines(t.documents, "text", "doc_id")


_MARKED = """(SELECT doc_id, nth::BIGINT AS line_no, CASE WHEN nth % 5 = 0 THEN '#' || line ELSE line END AS line FROM
  (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM documents))"""


@query(f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS idx, ltrim(line) AS name FROM {_MARKED}
WHERE ltrim(line) <> '' AND NOT starts_with(ltrim(line), '#')""")
def q_playlist_parse(t):
    lines = files.text_lines(t.documents, "text", "doc_id")
    lines = lines.withColumn("line", F.when(F.col("line_no") % 5 == 0, F.concat(F.lit("#"), "line")).otherwise(F.col("line")))
    return files.playlist_items(lines, "doc_id")


@query("SELECT p_partkey, length(trim(p_type))::BIGINT AS n, 5::BIGINT AS level FROM part WHERE length(trim(p_type)) <> 7")
def q_catalog_len(t):
    n = F.length(F.trim("p_type"))
    return t.part.where(n != 7).select("p_partkey", n.cast("long").alias("n"), F.lit(5).cast("long").alias("level"))


_MANIFEST = """(SELECT source AS list, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS line_no,
  CASE doc_id % 10 WHEN 9 THEN '; comment' WHEN 7 THEN 'd' || doc_id || '.txt ' || md5(text) WHEN 4 THEN md5(text) || '#d' || doc_id || '.txt'
  WHEN 3 THEN CASE WHEN doc_id % 50 = 43 THEN 'short' ELSE md5(text) || ' *d' || doc_id || '.txt' END
  ELSE upper(md5(text)) || ' *d' || doc_id || '.txt' END AS line FROM documents)"""
_PARSED = f"""
WITH m AS (SELECT *, CASE WHEN length(line) < 35 THEN 'too short' WHEN regexp_matches(line, '^[0-9A-Fa-f]{{32}} [ *:?!].+$') THEN 'ok'
  WHEN regexp_matches(line, '^.+ [0-9A-Fa-f]{{32}}$') THEN 'swapped' ELSE 'malformed' END AS status FROM {_MANIFEST} WHERE NOT starts_with(line, ';')),
l AS (SELECT *, min(CASE WHEN status = 'too short' THEN line_no END) OVER (PARTITION BY list) AS last FROM m)
SELECT list, line_no, status, lower(CASE status WHEN 'ok' THEN substr(line, 1, 32) WHEN 'swapped' THEN right(line, 32) END) AS stored,
  CASE status WHEN 'ok' THEN 'Binary' WHEN 'swapped' THEN 'Text' END AS mode,
  CASE status WHEN 'ok' THEN substr(line, 35) WHEN 'swapped' THEN substr(line, 1, length(line) - 33) END AS name
FROM l WHERE last IS NULL OR line_no <= last"""


def _manifest(t):
    digest, name = F.md5("text"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt"))
    rest = F.col("doc_id") % 10
    good = F.concat(digest, F.lit(" *"), name)
    line = (
        F.when(rest == 9, "; comment").when(rest == 7, F.concat(name, F.lit(" "), digest)).when(rest == 4, F.concat(digest, F.lit("#"), name))
        .when(rest == 3, F.when(F.col("doc_id") % 50 == 43, "short").otherwise(good)).otherwise(F.concat(F.upper(digest), F.lit(" *"), name))
    )
    rows = numbered(t.documents.select("source", "doc_id", line.alias("line")), ["source"], ["doc_id"])
    return rows.select(F.col("source").alias("list"), (F.col("number") + 1).alias("line_no"), "line")


@query(_PARSED)
def q_manifest_parse(t):
    return lists.parse_digests(_manifest(t), 32, "list")


_STORED = "(SELECT CASE WHEN doc_id % 10 = 5 THEN doc_id + 10000000 ELSE doc_id END AS id, CASE WHEN doc_id % 10 = 2 THEN md5(text || 'x') ELSE md5(text) END AS stored, source FROM documents)"


def _checked(t):
    bad, away = F.col("doc_id") % 10 == 2, F.col("doc_id") % 10 == 5
    items = t.documents.select(F.when(away, F.col("doc_id") + 10000000).otherwise(F.col("doc_id")).alias("id"), F.when(bad, F.md5(F.concat("text", F.lit("x")))).otherwise(F.md5("text")).alias("stored"), "source")
    there = t.documents.select(F.col("doc_id").alias("id"), F.md5("text").alias("actual"))
    return lists.validate_digests(items, there, ["id"])


@query(f"SELECT s.id, stored, md5(d.text) AS actual, d.doc_id IS NOT NULL AS is_found, CASE WHEN d.doc_id IS NOT NULL THEN stored = md5(d.text) END AS is_match FROM {_STORED} s LEFT JOIN documents d ON d.doc_id = s.id")
def q_manifest_validate(t):
    return _checked(t).select("id", "stored", "actual", "is_found", "is_match")


@query(f"""SELECT s.source, count(*)::BIGINT AS n_items, count(d.doc_id)::BIGINT AS n_found, count(*) FILTER (d.doc_id IS NOT NULL AND stored = md5(d.text))::BIGINT AS n_matched,
  CASE WHEN count(d.doc_id) = count(*) AND count(*) FILTER (d.doc_id IS NOT NULL AND stored = md5(d.text)) = count(*) THEN 'success' WHEN count(d.doc_id) < count(*) THEN 'missing' ELSE 'mismatch' END AS verdict
  FROM {_STORED} s LEFT JOIN documents d ON d.doc_id = s.id GROUP BY s.source""")
def q_manifest_summary(t):
    return lists.validation_summary(_checked(t), "source")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def q_exists_semi(t):
    return lists.existing(t.documents, t.labels, ["doc_id"])[0].select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q_exists_anti(t):
    return lists.existing(t.documents, t.labels, ["doc_id"])[1].select("doc_id", "lang")


@query("""SELECT source, count(*)::BIGINT AS n, count(*) FILTER (l.doc_id IS NULL)::BIGINT AS n_missing,
  CASE WHEN count(*) FILTER (l.doc_id IS NULL) = 0 THEN 'success' ELSE 'failure' END AS verdict FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source""")
def q_missing_count(t):
    there = t.documents.join(t.labels.select("doc_id", F.lit(1).alias("there")), "doc_id", "left")
    missing = F.count_if(F.col("there").isNull())
    return there.groupBy("source").agg(F.count("*").alias("n"), missing.alias("n_missing"), F.when(missing == 0, "success").otherwise("failure").alias("verdict"))


@query("SELECT CASE WHEN starts_with(lower(url), 'http:') THEN 'http' WHEN starts_with(lower(url), 'https:') THEN 'https' ELSE 'check' END AS kind, count(*)::BIGINT AS n FROM pages GROUP BY 1")
def q_url_ignore(t):
    kind = F.when(lists.is_url(F.col("url")), F.regexp_extract(F.lower("url"), "^([a-z]+):", 1)).otherwise("check")
    return t.pages.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"SELECT page_id, {_PATH} AS path, starts_with({_PATH}, '/') AS is_rooted FROM pages")
def q_rooted(t):
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1)
    return t.pages.select("page_id", path.alias("path"), lists.is_rooted(path).alias("is_rooted"))


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING NOT (count(*) = 1 AND min(l_returnflag) = 'N')")
def q_ignored_single(t):
    one = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_returnflag").alias("flag"))
    return one.where(~((F.col("n") == 1) & (F.col("flag") == "N"))).select("l_orderkey")


@query("SELECT string_agg(lang, ', ' ORDER BY lang) AS formats, count(*)::BIGINT AS n FROM (SELECT DISTINCT lang FROM documents)")
def q_format_list(t):
    return t.documents.select("lang").distinct().agg(F.array_join(F.sort_array(F.collect_list("lang")), ", ").alias("formats"), F.count("*").alias("n"))


@query(f"SELECT page_id, lower(regexp_extract({_HOST}, '\\.([^./]+)$', 1)) AS ext FROM pages")
def q_ext_extract(t):
    return t.pages.select("page_id", files.path_parts(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))["ext"].alias("ext"))


@query("SELECT doc_id, lang FROM documents WHERE lang <> 'fr'")
def q_anti_hidden(t):
    hidden = t.spark.createDataFrame([("fr",)], "lang string")
    return t.documents.join(F.broadcast(hidden), "lang", "left_anti").select("doc_id", "lang")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
def q_unknown_ext(t):
    known = t.spark.createDataFrame([("O",), ("F",)], "o_orderstatus string")
    return t.orders.join(F.broadcast(known), "o_orderstatus", "left_anti").select("o_orderkey", "o_orderstatus")


@query("""WITH x AS (SELECT l_returnflag AS ext, l_linestatus AS magic FROM lineitem)
SELECT ext, magic, CASE WHEN (ext, magic) IN (('N','O'),('A','F'),('R','F')) THEN ext WHEN magic = 'O' THEN 'N' WHEN magic = 'F' THEN 'A' END AS format,
  (ext, magic) NOT IN (('N','O'),('A','F'),('R','F')) AS is_misnamed, count(*)::BIGINT AS n FROM x GROUP BY ALL""")
def q_misnamed(t):
    formats = t.spark.createDataFrame([(1, "N", "O"), (2, "A", "F"), (3, "R", "F")], "rank int, name string, magic string")
    kinds = t.lineitem.groupBy(F.col("l_returnflag").alias("ext"), F.col("l_linestatus").alias("magic")).agg(F.count("*").alias("n"))
    return registry.resolve(kinds, formats, ["ext", "magic", "n"]).select("ext", "magic", "format", "is_misnamed", "n")


def _digest(name, spark_hash, sql):
    def run(t):
        return t.documents.select("doc_id", spark_hash(F.col("text")).alias("digest"))

    run.__name__ = name
    query(f"SELECT doc_id, {sql}(text) AS digest FROM documents")(run)


_digest("q_md5", F.md5, "md5")
_digest("q_sha1", F.sha1, "sha1")
_digest("q_sha256", lambda c: F.sha2(c, 256), "sha256")


@query(f"SELECT doc_id, xor({crc_sql('encode(text)', *checksums.MERGED['crc32'], start=4294967295)}, 4294967295) AS crc FROM documents, {crc_tables_sql(checksums.MERGED['crc32'])}")
def q_crc32(t):
    return t.documents.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


@query("SELECT doc_id, CASE WHEN n_chars <= 8192 THEN md5(text) END AS digest FROM documents")
def q_hash_skip_fatal(t):
    return t.documents.select("doc_id", F.when(F.col("n_chars") <= 8192, F.md5("text")).alias("digest"))


@query(f"SELECT page_id, {_HOST} AS host, CASE WHEN regexp_extract({_PATH}, '^(.*)/[^/]*$', 1) = '' THEN '.' ELSE regexp_extract({_PATH}, '^(.*)/[^/]*$', 1) END AS dir, regexp_extract({_PATH}, '([^/]*)$', 1) AS name FROM pages")
def q_path_parts(t):
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1)
    parts = files.path_parts(path)
    return t.pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), parts["dir"].alias("dir"), parts["name"].alias("name"))


@query("""SELECT page_id, split_part(kv, '=', 1) AS key, substr(kv, strpos(kv, '=') + 1) AS value FROM
  (SELECT page_id, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) AS kv FROM pages WHERE contains(url, '?')) WHERE contains(kv, '=')""")
def q_kv_parse(t):
    kv = t.pages.select("page_id", F.explode(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&")).alias("kv")).where(F.contains("kv", F.lit("=")))
    return kv.select("page_id", F.substring_index("kv", "=", 1).alias("key"), F.expr("substring(kv, instr(kv, '=') + 1)").alias("value"))


@query("SELECT page_id, regexp_extract(url, '([^/?#]*)([?#].*)?$', 1) AS name, regexp_replace(regexp_extract(url, '([^/?#]*)([?#].*)?$', 1), '\\.[^.]*$', '') || '.html' AS new_name FROM pages")
def q_rename_plan(t):
    name = F.regexp_extract("url", "([^/?#]*)([?#].*)?$", 1)
    return t.pages.select("page_id", name.alias("name"), registry.renamed(name, F.lit("html")).alias("new_name"))


@query("""SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'fr' THEN 2 WHEN 'de' THEN 1 ELSE 0 END, doc_id)::BIGINT AS place FROM documents""")
def q_folder_order(t):
    last = F.when(F.col("lang") == "fr", 2).when(F.col("lang") == "de", 1).otherwise(0)
    rows = numbered(t.documents.select("doc_id", "source", last.alias("turn")), ["source"], ["turn", "doc_id"])
    return rows.select("doc_id", "source", (F.col("number") + 1).alias("place"))


@query("SELECT md5(text) AS digest, min(doc_id)::BIGINT AS first_doc FROM documents GROUP BY 1")
def q_first_value(t):
    return t.documents.groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("first_doc"))


@query("SELECT doc_id, n::BIGINT AS copy_no FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n > 1")
def q_duplicates(t):
    n = F.row_number().over(Window.partitionBy("digest").orderBy("doc_id")).cast("long")
    return t.documents.select("doc_id", F.md5("text").alias("digest")).select("doc_id", n.alias("copy_no")).where("copy_no > 1")
