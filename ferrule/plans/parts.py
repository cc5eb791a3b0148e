"""Parts of files and trees of intervals: lines as byte ranges, and blocks of numbers as nested intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.operators import companions, edits, lists, ranges, report, structures, trees
from ferrule.operators.grammar import Grammar, Rule, parsed
from ferrule.plans.binaries import _files, _wav
from ferrule.plans.catalog import query
from ferrule.sources import files

_HALVES = """(SELECT doc_id, text, array_to_string([x || CASE WHEN i < n THEN chr(10) ELSE '' END FOR x, i IN lines IF i % 2 = 1], '') AS odd,
  array_to_string([x || CASE WHEN i < n THEN chr(10) ELSE '' END FOR x, i IN lines IF i % 2 = 0], '') AS even
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS lines, len(string_split(text, chr(10))) AS n FROM documents))"""


def _line_ranges(t) -> DataFrame:
    """Byte ranges of the odd lines with their line feeds, each as two that overlap."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"), F.octet_length("text").alias("whole"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    pos = F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0))
    rows = lines.withColumn("pos", pos).where("i % 2 = 0").select("doc_id", "pos", F.least(F.octet_length("line") + 1, F.col("whole") - F.col("pos")).alias("size"))
    half = F.col("size") / 2
    return rows.select("doc_id", "pos", F.ceil(half).alias("size")).union(rows.select("doc_id", F.col("pos") + F.floor(half), F.col("size") - F.floor(half)))


def _digested(t) -> DataFrame:
    """doc_id, file_sha1, media_sha1 of the odd lines and meta_sha1 of the even ones."""
    content = F.col("text").cast("binary")
    sets = ranges.collected(_line_ranges(t), "doc_id")
    held = F.coalesce("ranges", F.array().cast("array<struct<pos:bigint,size:bigint>>"))
    return t.documents.join(sets, "doc_id", "left").select("doc_id", F.sha1("text").alias("file_sha1"), *(c.alias(n) for n, c in ranges.digests(content, held, F.octet_length("text")).items()))


@query(f"SELECT doc_id, sha1(odd) AS digest FROM {_HALVES}")
def q_media_sha1(t):
    return _digested(t).select("doc_id", F.col("media_sha1").alias("digest"))


@query(f"SELECT doc_id, sha1(even) AS digest FROM {_HALVES}")
def q_meta_sha1(t):
    return _digested(t).select("doc_id", F.col("meta_sha1").alias("digest"))


@query(f"""WITH d AS (SELECT doc_id, doc_id % 5 AS k, sha1(text) AS f, sha1(odd) AS o, sha1(even) AS e FROM {_HALVES}),
i AS (SELECT CASE WHEN doc_id % 7 = 3 THEN doc_id + 10000000 ELSE doc_id END AS id, CASE k WHEN 0 THEN 'Media' WHEN 1 THEN 'Meta' ELSE 'Binary' END AS mode,
  CASE WHEN doc_id % 11 = 4 THEN sha1('x') WHEN k = 0 THEN o WHEN k = 1 THEN e ELSE f END AS stored FROM d)
SELECT id, mode, stored, CASE mode WHEN 'Media' THEN o WHEN 'Meta' THEN e ELSE f END AS actual, d.doc_id IS NOT NULL AS is_found,
  CASE WHEN d.doc_id IS NOT NULL THEN stored = CASE mode WHEN 'Media' THEN o WHEN 'Meta' THEN e ELSE f END END AS is_match FROM i LEFT JOIN d ON d.doc_id = i.id""")
def q_manifest_modes(t):
    there = _digested(t)
    kind = F.col("doc_id") % 5
    mode = F.when(kind == 0, "Media").when(kind == 1, "Meta").otherwise("Binary")
    stored = F.when(F.col("doc_id") % 11 == 4, F.sha1(F.lit("x"))).when(kind == 0, F.col("media_sha1")).when(kind == 1, F.col("meta_sha1")).otherwise(F.col("file_sha1"))
    away = F.when(F.col("doc_id") % 7 == 3, F.col("doc_id") + 10000000).otherwise(F.col("doc_id"))
    items = there.select(away.alias("id"), mode.alias("mode"), stored.alias("stored"))
    return lists.validate_modes(items, there.withColumnRenamed("doc_id", "id"), ["id"]).select("id", "mode", "stored", "actual", "is_found", "is_match")


@query("SELECT doc_id, md5(text) AS pcm_md5, sha1(text) AS media_sha1, strlen(text)::BIGINT AS n FROM documents")
def q_wav_samples(t):
    walked = structures.walked(_files(t, "wav", _wav()).withColumn("size", F.length("content")))
    media: Column = ranges.media(F.col("format"), F.col("pieces"), F.col("content"), F.col("size").cast("long"))
    rows = walked.select("doc_id", "content", "size", media.alias("media"))
    inside = ranges.gathered(F.col("content"), F.col("media"))
    return rows.select("doc_id", F.md5(inside).alias("pcm_md5"), ranges.digests(F.col("content"), F.col("media"), F.col("size"))["media_sha1"].alias("media_sha1"), F.length(inside).cast("long").alias("n"))


_BLOCKS = """(SELECT DISTINCT o_orderkey // 4096 AS file, j, (o_orderkey // pow(8, j)::BIGINT) * pow(8, j)::BIGINT AS pos, pow(8, j)::BIGINT AS size,
  (o_orderkey // pow(8, j)::BIGINT) * 8 + j AS idx, 'L' || j AS name FROM orders, (VALUES (0), (1), (2), (3), (4)) AS levels(j))"""
_TREE = f"""WITH RECURSIVE n AS (SELECT * FROM {_BLOCKS}),
tree AS (SELECT file, idx, j, pos, size, name, 0 AS depth, NULL::BIGINT AS parent, name AS trace FROM n WHERE j = 4
  UNION ALL SELECT c.file, c.idx, c.j, c.pos, c.size, c.name, p.depth + 1, p.idx, p.trace || '/' || c.name || ':' || c.pos FROM tree p JOIN n c ON c.file = p.file AND c.pos >= p.pos AND c.pos + c.size <= p.pos + p.size AND c.j = p.j - 1)"""


def _blocks(t) -> DataFrame:
    """Blocks of 1, 8, 64, 512 and 4096 order keys, as intervals in a file of 4096 keys."""
    rows = t.orders.select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j"))
    size = F.pow(F.lit(8), F.col("j")).cast("long")
    at = F.expr("o_orderkey div cast(pow(8, j) as bigint)")
    name = F.when(F.col("j") == 4, "L4").otherwise(F.concat(F.lit("L"), F.col("j").cast("string"), F.lit(":"), (at * size).cast("string")))
    return rows.select(F.expr("o_orderkey div 4096").alias("file"), (at * 8 + F.col("j")).alias("idx"), (at * size).alias("pos"), size.alias("size"), name.alias("name")).distinct()


@query(f"{_TREE} SELECT file, idx, depth, parent FROM tree")
def q_tree_parents(t):
    return trees.nested(_blocks(t), "file").select("file", "idx", "depth", "parent")


@query(f"{_TREE} SELECT file, idx, depth AS steps, trace FROM tree WHERE j <= 1")
def q_tree_traces(t):
    nodes = trees.nested(_blocks(t), "file")
    return trees.traces(nodes, nodes.where("size <= 8"), "name", "file").select("file", "idx", "steps", F.array_join("trace", "/").alias("trace"))


@query(f"""WITH n AS (SELECT * FROM {_BLOCKS}) SELECT file, j, min_by(idx, pos) AS idx, min(pos) AS pos FROM n GROUP BY file, j""")
def q_tree_first(t):
    nodes = _blocks(t).withColumn("j", F.expr("cast(substring(name, 2, 1) as int)"))
    out = None
    for j in range(5):
        one = trees.first_of(nodes, "j", j, "file").select("file", F.lit(j).alias("j"), F.col("node.idx").alias("idx"), F.col("node.pos").alias("pos"))
        out = one if out is None else out.union(one)
    return out


#: A grammar over lines of prose: paragraphs of short and long lines, and lists between them.
PROSE = Grammar("start", (
    Rule("start", r"^\s*$", "start"), Rule("start", "[:;]$", "list", "heading"), Rule("start", r"^.{80,}$", "long", "opening"), Rule("start", ".", "short", "line"),
    Rule("short", r"^\s*$", "start"), Rule("short", r"^.{80,}$", "long", "grown"), Rule("long", r"^\s*$", "start", "end"), Rule("long", r"^(\S{1,9}) ", "long", "word"), Rule("long", "[.!?]$", "short", "close"),
    Rule("list", r"^\s*$", "list"), Rule("list", r"^(.{1,40})$", "list", "item"), Rule("list", ".", "start", "over"),
))


def _cases(value: str) -> str:
    """The rules as branches of a CASE over state and line."""
    quoted = lambda x: f"'{x}'" if x else "NULL"
    return " ".join(f"WHEN state = '{r.state}' AND regexp_matches(line, '{r.pattern}') THEN {quoted(getattr(r, value))}" for r in PROSE.rules)


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
s AS (SELECT doc_id, line_no, line, 'start' AS state FROM l WHERE line_no = 1
  UNION ALL SELECT l.doc_id, l.line_no, l.line, s.next FROM (SELECT *, CASE {_cases("to")} ELSE state END AS next FROM s) s JOIN l ON l.doc_id = s.doc_id AND l.line_no = s.line_no + 1)
SELECT * FROM (SELECT doc_id, line_no, state, CASE {_cases("kind")} END AS kind FROM s) WHERE kind IS NOT NULL""")
def q_line_grammar(t):
    return parsed(files.text_lines(t.documents, "text", "doc_id"), PROSE, "doc_id").select("doc_id", "line_no", "state", "kind")


_NAMED = """(SELECT page_id, 'file:' || regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, CASE page_id % 6 WHEN 0 THEN name WHEN 1 THEN '..\\' || name WHEN 2 THEN './x/../' || name
  WHEN 3 THEN '..\\..\\.\\..\\..\\' || name WHEN 4 THEN '/top//' || name ELSE 'sub\\.\\' || name || '/..' END AS name
  FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1) AS name FROM pages))"""


@query(f"""WITH n AS (SELECT page_id, dir, replace(name, '\\', '/') AS name FROM {_NAMED}),
p AS (SELECT page_id, dir, name, CASE WHEN starts_with(name, '/') THEN name ELSE substr(dir, 6) || '/' || name END AS below FROM n),
f AS (SELECT page_id, below, list_reduce(list_concat([CAST([] AS VARCHAR[])], list_transform(string_split(below, '/'), lambda x: [x])), lambda a, x: CASE WHEN a = ['?out'] THEN a WHEN x[1] IN ('', '.') THEN a
  WHEN x[1] = '..' THEN CASE WHEN len(a) = 0 THEN ['?out'] ELSE a[1:len(a) - 1] END ELSE list_concat(a, x) END) AS parts FROM p)
SELECT page_id, CASE WHEN parts = ['?out'] THEN NULL ELSE 'file:' || CASE WHEN starts_with(below, '/') THEN '/' ELSE '' END || array_to_string(parts, '/') END AS target FROM f""")
def q_path_resolve(t):
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1)
    last, kind = F.regexp_extract(path, "([^/]*)$", 1), F.col("page_id") % 6
    name = (
        F.when(kind == 0, last).when(kind == 1, F.concat(F.lit("..\\"), last)).when(kind == 2, F.concat(F.lit("./x/../"), last))
        .when(kind == 3, F.concat(F.lit("..\\..\\.\\..\\..\\"), last)).when(kind == 4, F.concat(F.lit("/top//"), last)).otherwise(F.concat(F.lit("sub\\.\\"), last, F.lit("/..")))
    )
    folder = F.concat(F.lit("file:"), F.regexp_extract(path, "^(.*)/[^/]*$", 1))
    return t.pages.select("page_id", companions.resolved(folder, name).alias("target"))


@query(f"""SELECT doc_id, sha1(array_to_string([CASE WHEN i % 2 = 0 THEN x || CASE WHEN i < n THEN chr(10) ELSE '' END WHEN i < n OR x <> '' THEN '-' ELSE '' END FOR x, i IN lines], '')) AS digest
FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, len(string_split(text, chr(10))) AS n FROM documents)""")
def q_edit_scripts(t):
    """Every odd line cut out, with a dash in its place, as the script of its document."""
    cuts = ranges.merged(_line_ranges(t), "doc_id")
    plan = cuts.groupBy("doc_id").agg(F.collect_list(edits.splice("cut", F.col("pos"), F.col("size"), F.lit(bytearray(b"-")))).alias("splices"))
    held = F.coalesce("splices", F.array().cast(f"array<{edits.SPLICE}>"))
    return t.documents.join(plan, "doc_id", "left").select("doc_id", F.sha1(edits.applied(F.col("text").cast("binary"), held)).alias("digest"))


@query("""SELECT doc_id, array_to_string([CASE WHEN h BETWEEN '20' AND '7F' THEN decode(unhex(h)) ELSE chr(92) || lower(h) END FOR h IN regexp_extract_all(hex(encode(text)), '..')], '') AS escaped FROM documents""")
def q_escaped(t):
    return t.documents.select("doc_id", report.escaped(F.col("text").cast("binary")).alias("escaped"))
