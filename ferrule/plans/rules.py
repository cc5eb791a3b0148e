"""The issue algebra and rules, with events as issues and orders, parts and lines as things to judge."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.operators import issues as iss
from ferrule.operators import rules
from ferrule.options import Severity, Tag
from ferrule.plans.catalog import ISSUES_SQL, big, issues, query
from ferrule.sources import files

WARN, ERR = 3, 12
_LEVEL = f"CASE WHEN base_level <= 4 AND tags & {ERR} <> 0 THEN 5 WHEN base_level < 4 AND tags & {WARN} <> 0 THEN 4 ELSE base_level END"
_ISSUES = f"(SELECT *, {_LEVEL} AS level FROM {ISSUES_SQL})"


def _leveled(t, warn=WARN, err=ERR):
    return issues(t).withColumn("level", iss.effective_level(F.col("base_level"), F.col("tags"), warn, err))


@query(f"SELECT path, idx, (CASE WHEN repair_kind IS NOT NULL THEN greatest(base_level, 4) ELSE base_level END)::BIGINT AS level FROM {ISSUES_SQL}")
def q_issue_min_level(t):
    return issues(t).select("path", "idx", iss.raised_level(F.col("base_level"), F.col("repair_kind")).cast("long").alias("level"))


@query(f"SELECT path, idx, base_level::BIGINT AS base_level, level::BIGINT AS level, (max(level) OVER (PARTITION BY path))::BIGINT AS max_level FROM {_ISSUES}")
def q_escalate(t):
    top = F.max("level").over(Window.partitionBy("path"))
    return _leveled(t).select("path", "idx", big("base_level"), big("level"), top.cast("long").alias("max_level"))


@query(f"""SELECT path, max(CASE WHEN base_level <= 4 AND tags & 64 <> 0 THEN 5 WHEN base_level < 4 AND tags & 32 <> 0 THEN 4 ELSE base_level END)::BIGINT AS strict_level,
  max(base_level)::BIGINT AS plain_level FROM {ISSUES_SQL} GROUP BY path""")
def q_strict(t):
    strict = iss.effective_level(F.col("base_level"), F.col("tags"), int(Tag.BAD_TAG), 64)
    return issues(t).groupBy("path").agg(F.max(strict).cast("long").alias("strict_level"), F.max("base_level").cast("long").alias("plain_level"))


@query(f"SELECT path, max(level)::BIGINT AS max_level FROM {_ISSUES} GROUP BY path HAVING max(level) >= 5")
def q_has_error(t):
    return _leveled(t).groupBy("path").agg(F.max("level").cast("long").alias("max_level")).where(F.col("max_level") >= int(Severity.ERROR))


@query(f"SELECT path, idx, level::BIGINT AS level FROM {_ISSUES} WHERE level >= 3")
def q_reportable(t):
    return _leveled(t).where("level >= 3").select("path", "idx", big("level"))


@query(f"SELECT path, count(*) FILTER (repair_kind IS NOT NULL AND level < 5)::BIGINT AS n_repairable, count(*)::BIGINT AS n_issues, max(level)::BIGINT AS max_level FROM {_ISSUES} GROUP BY path")
def q_repairable(t):
    return iss.per_path(_leveled(t), "path").select("path", "n_repairable", "n_issues", big("max_level"))


@query(f"SELECT count(*) FILTER (tags & 1 <> 0)::BIGINT AS n1, count(*) FILTER (tags & 2 <> 0)::BIGINT AS n2, count(*) FILTER (tags & 4 <> 0)::BIGINT AS n4, bit_or(tags)::BIGINT AS every FROM {ISSUES_SQL}")
def q_tag_bits(t):
    tags = F.col("tags")
    return issues(t).agg(*(F.count_if(iss.has_tag(tags, m)).alias(f"n{m}") for m in (1, 2, 4)), F.bit_or(tags).cast("long").alias("every"))


_PRIORITY = "(SELECT o_orderkey, CASE o_orderkey % 10 WHEN 3 THEN NULL WHEN 4 THEN 'x' || o_orderpriority ELSE o_orderpriority END AS v FROM orders)"


@query(f"SELECT o_orderkey, CASE WHEN v IS NULL OR v = '' THEN 'tag is missing' WHEN NOT regexp_matches(v, '^[0-9]') THEN 'tag is not a number' END AS issue FROM {_PRIORITY}")
def q_tag_number(t):
    rest = F.col("o_orderkey") % 10
    v = F.when(rest == 3, None).when(rest == 4, F.concat(F.lit("x"), "o_orderpriority")).otherwise(F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", rules.tag_number(v).alias("issue"))


_DATE = "(SELECT o_orderkey, CASE o_orderkey % 10 WHEN 1 THEN strftime(o_orderdate, '%Y') WHEN 2 THEN '31' || strftime(o_orderdate, '%Y') WHEN 3 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS v FROM orders)"


@query(f"""SELECT o_orderkey, v, CASE WHEN v = '' THEN 'tag is missing' WHEN NOT ((length(v) = 4 OR length(v) = 10) AND regexp_matches(v, '^(19|20)[0-9][0-9]')) THEN 'tag is not a date' END AS issue FROM {_DATE}""")
def q_tag_date(t):
    rest, year = F.col("o_orderkey") % 10, F.date_format("o_orderdate", "yyyy")
    v = F.when(rest == 1, year).when(rest == 2, F.concat(F.lit("31"), year)).when(rest == 3, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", v.alias("v"), rules.tag_date(v).alias("issue"))


_NAME = "(SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN ' ' || p_name WHEN 2 THEN p_name || ' ' WHEN 3 THEN ' ' || replace(p_name, ' ', '  ') || ' ' ELSE p_name END AS v FROM part)"


@query(f"""SELECT p_partkey, concat_ws(',', CASE WHEN starts_with(v, ' ') THEN 'leading' END, CASE WHEN ends_with(v, ' ') THEN 'trailing' END, CASE WHEN contains(v, '  ') THEN 'adjacent' END) AS reasons FROM {_NAME}""")
def q_tag_text(t):
    rest, name = F.col("p_partkey") % 5, F.col("p_name")
    sp = F.lit(" ")
    v = F.when(rest == 1, F.concat(sp, name)).when(rest == 2, F.concat(name, sp)).when(rest == 3, F.concat(sp, F.replace(name, sp, F.lit("  ")), sp)).otherwise(name)
    return t.part.select("p_partkey", rules.tag_text(v).alias("reasons"))


@query("""WITH k(key, is_optional) AS (VALUES ('quality', false), ('toxic', false), ('reviewer', true)),
v AS (SELECT doc_id, 'quality' AS key, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)
SELECT d.doc_id, k.key FROM documents d CROSS JOIN k LEFT JOIN v ON v.doc_id = d.doc_id AND v.key = k.key WHERE v.value IS NULL AND NOT k.is_optional""")
def q_required_keys(t):
    keys = t.spark.createDataFrame([("quality", False), ("toxic", False), ("reviewer", True)], "key string, is_optional boolean")
    values = t.labels.select("doc_id", F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("key", "value"))
    return rules.missing_keys(t.documents.select("doc_id"), values, keys, "doc_id")


@query("SELECT doc_id, contains(text, chr(65533)) AS has_bad, regexp_matches(text, '[^\\x00-\\x7F]') AS has_wide FROM documents")
def q_bad_utf8(t):
    return t.documents.select("doc_id", F.contains("text", F.lit("�")).alias("has_bad"), F.rlike("text", F.lit("[^\\x00-\\x7F]")).alias("has_wide"))


@query("SELECT doc_id, count(*) FILTER (NOT contains(line, '='))::BIGINT AS n_without, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def q_no_equals(t):
    lines = files.text_lines(t.documents, "text", "doc_id")
    return lines.groupBy("doc_id").agg(F.count_if(~F.contains("line", F.lit("="))).alias("n_without"), F.count("*").alias("n"))


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#5', 'Brand#8')")
def q_semi_blessed(t):
    blessed = t.spark.createDataFrame([(f"Brand#{i}",) for i in (1, 2, 3, 5, 8)], "p_brand string")
    return t.part.join(F.broadcast(blessed), "p_brand", "left_semi").select("p_partkey", "p_brand")


@query("""SELECT l_orderkey, sum(l_quantity) AS total, greatest(sum(l_quantity) - 150, 0) AS excess, least(4096, greatest(sum(l_quantity) - 150, 0)) AS keep FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150""")
def q_bloat(t):
    total = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total"))
    return rules.bloat(total, "total", 150, 4096).where("excess > 0")


@query("SELECT conv_id, NOT bool_or(n < coalesce(before, n)) AS is_monotonic FROM (SELECT conv_id, length(text) AS n, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY conv_id")
def q_monotonic(t):
    n = F.length("text")
    steps = t.conversations.select("conv_id", (n < F.lag(n, 1).over(Window.partitionBy("conv_id").orderBy("turn"))).alias("falls"))
    return steps.groupBy("conv_id").agg((~F.bool_or(F.coalesce("falls", F.lit(False)))).alias("is_monotonic"))


@query("SELECT p_partkey, p_size::BIGINT AS p_size, p_size NOT BETWEEN 1 AND 40 AS out_of_range, p_size NOT IN (1, 2, 4, 8, 16, 32) AS no_power FROM part")
def q_range_enum(t):
    return t.part.select("p_partkey", big("p_size"), (~F.col("p_size").between(1, 40)).alias("out_of_range"), (~F.col("p_size").isin(1, 2, 4, 8, 16, 32)).alias("no_power"))


_RULES = [
    ("1-URGENT", "P", 5, "urgent order is pending"),
    ("5-LOW", "F", 2, "low order is finished"),
]
_RULE_SQL = " UNION ALL ".join(
    f"SELECT o_orderkey, {i}::BIGINT AS rule, '{m}' AS message, {n}::BIGINT AS base_level FROM orders WHERE o_orderpriority = '{p}' AND o_orderstatus = '{s}'" for i, (p, s, n, m) in enumerate(_RULES)
)


@query(f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY rule)::BIGINT AS idx, message, base_level FROM ({_RULE_SQL} UNION ALL SELECT o_orderkey, 9, 'total of ' || CAST(floor(o_totalprice) AS BIGINT), 4 FROM orders WHERE o_totalprice > 400000)")
def q_kv_rules(t):
    made = [rules.Rule((F.col("o_orderpriority") == p) & (F.col("o_orderstatus") == s), F.lit(m), n) for p, s, n, m in _RULES]
    made.append(rules.Rule(F.col("o_totalprice") > 400000, F.concat(F.lit("total of "), F.floor("o_totalprice").cast("string")), 1, repair="split"))
    return iss.from_rules(t.orders, made, "o_orderkey").select("o_orderkey", "idx", "message", big("base_level"))


@query(f"SELECT path, max(level)::BIGINT AS max_level FROM {_ISSUES} GROUP BY path")
def q_max_severity(t):
    return _leveled(t).groupBy("path").agg(F.max("level").cast("long").alias("max_level"))


@query(f"SELECT path, coalesce(max(level) FILTER (tags & 6 <> 0), 0)::BIGINT AS max_level FROM {_ISSUES} GROUP BY path")
def q_max_where_tag(t):
    return _leveled(t).groupBy("path").agg(iss.max_level_where(6).cast("long").alias("max_level"))


@query(f"SELECT max(level)::BIGINT AS verdict FROM {_ISSUES}")
def q_run_verdict(t):
    return _leveled(t).agg(F.max("level").cast("long").alias("verdict"))


@query(f"SELECT event_type, max(level)::BIGINT AS max_level, count(*) FILTER (level >= 5)::BIGINT AS n_errors, min(idx) FILTER (level >= 5)::BIGINT AS first_error, max(idx) FILTER (level >= 5)::BIGINT AS last_error FROM {_ISSUES} GROUP BY event_type")
def q_tab_stats(t):
    error = F.when(F.col("level") >= 5, F.col("idx"))
    return _leveled(t).groupBy("event_type").agg(F.max("level").cast("long").alias("max_level"), F.count(error).alias("n_errors"), F.min(error).alias("first_error"), F.max(error).alias("last_error"))


@query(f"SELECT path, idx, min(CASE WHEN level >= 5 THEN idx END) OVER (PARTITION BY path ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)::BIGINT AS next_error FROM {_ISSUES}")
def q_nav_next_error(t):
    later = Window.partitionBy("path").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    return _leveled(t).select("path", "idx", F.min(F.when(F.col("level") >= 5, F.col("idx"))).over(later).alias("next_error"))


@query(f"""WITH u AS (SELECT path, 1 AS phase, idx AS n FROM {_ISSUES} WHERE level >= 5 UNION ALL SELECT path, 2, idx FROM {_ISSUES} WHERE repair_kind IS NOT NULL UNION ALL SELECT path, 3, count(*) FROM {_ISSUES} GROUP BY path)
SELECT path, phase::BIGINT AS phase, n::BIGINT AS n, row_number() OVER (PARTITION BY path ORDER BY phase, n)::BIGINT AS running FROM u""")
def q_union_issues(t):
    rows = _leveled(t)
    every = iss.in_phases(rows.where("level >= 5").select("path", F.col("idx").alias("n")), rows.where("repair_kind is not null").select("path", F.col("idx").alias("n")), rows.groupBy("path").agg(F.count("*").alias("n")))
    return every.select("path", big("phase"), "n", F.row_number().over(Window.partitionBy("path").orderBy("phase", "n")).cast("long").alias("running"))
