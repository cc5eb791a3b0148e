"""Joins, aggregates and ordered checks, with orders as folders and their lines as tracks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.operators import folder, report
from ferrule.operators.ordering import numbered
from ferrule.plans.catalog import big, query

_TIE = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
TIE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


@query("SELECT o_orderkey, coalesce(n, 0)::BIGINT AS n, coalesce(declared, 0)::BIGINT AS declared, coalesce(n, 0) = coalesce(declared, 0) AS is_equal FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS declared FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def q_count_compare(t):
    there = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.max("l_linenumber").cast("long").alias("declared"))
    both = t.orders.select("o_orderkey").join(there, "o_orderkey", "left").na.fill(0, ["n", "declared"])
    return both.select("o_orderkey", "n", "declared", (F.col("n") == F.col("declared")).alias("is_equal"))


@query("""WITH s AS (SELECT source, doc_id, CASE WHEN doc_id % 11 <> 0 THEN substr(md5(text), 1, 1) END AS crc, doc_id % 2 AS half FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source, half ORDER BY doc_id) AS pos FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY source, half, crc ORDER BY pos) AS nth FROM p)
SELECT b.source, b.pos::BIGINT AS right_pos, a.pos::BIGINT AS left_pos, coalesce(a.pos = b.pos, false) AS in_place
FROM (SELECT * FROM n WHERE half = 1) b LEFT JOIN (SELECT * FROM n WHERE half = 0) a ON a.source = b.source AND a.crc IS NOT DISTINCT FROM b.crc AND a.nth = b.nth""")
def q_greedy_match(t):
    crc = F.when(F.col("doc_id") % 11 != 0, F.substring(F.md5("text"), 1, 1))
    rows = t.documents.select("source", "doc_id", crc.alias("crc"), (F.col("doc_id") % 2).alias("half"))
    rows = numbered(rows, ["source", "half"], ["doc_id"]).withColumn("pos", F.col("number") + 1)
    return folder.greedy_match(rows.where("half = 0"), rows.where("half = 1"), ["source"], "crc", "pos")


_BAD = "CASE WHEN l_discount > 0.08 THEN 5 WHEN l_discount > 0.06 THEN 4 ELSE 1 END"


@query(f"""SELECT l_orderkey, count(*)::BIGINT AS n, max(l_linenumber)::BIGINT AS declared, max({_BAD})::BIGINT AS max_level,
  CASE WHEN count(*) <> max(l_linenumber) OR max({_BAD}) >= 5 THEN 'failed' WHEN max({_BAD}) = 4 THEN 'success with warnings' ELSE 'success' END AS verdict FROM lineitem GROUP BY l_orderkey""")
def q_rip_verdict(t):
    level = F.when(F.col("l_discount") > 0.08, 5).when(F.col("l_discount") > 0.06, 4).otherwise(1)
    agg = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").cast("long").alias("declared"), F.max(level).cast("long").alias("max_level"))
    return agg.withColumn("verdict", report.verdict(F.col("n") == F.col("declared"), F.col("max_level")))


@query("SELECT source, count(*) FILTER (lang = 'de')::BIGINT AS n_logs, count(*) FILTER (lang = 'en')::BIGINT AS n_flac, count(*) FILTER (lang = 'fr')::BIGINT AS n_mp3, count(*) FILTER (lang = 'de') > 1 AS many_logs, count(*) FILTER (lang = 'en') > 0 AND count(*) FILTER (lang = 'fr') > 0 AS mixed, count(*) FILTER (lang = 'en') > 0 AND count(*) FILTER (lang = 'de') = 0 AS flac_without_log FROM documents GROUP BY source")
def q_folder_flags(t):
    kind = F.when(F.col("lang") == "de", "log").when(F.col("lang") == "en", "flac").when(F.col("lang") == "fr", "mp3")
    return folder.folder_flags(t.documents.withColumn("kind", kind), "source", "kind")


_FLAG = "CASE WHEN l_orderkey % 7 = 0 THEN '' WHEN l_orderkey % 7 = 1 AND l_linenumber = 1 THEN NULL ELSE l_returnflag END"


@query(f"SELECT l_orderkey, CASE WHEN count(*) FILTER (v IS NULL OR v = '') = count(*) THEN NULL ELSE count(*) FILTER (v IS NULL OR v = '') = 0 AND min(v) = max(v) END AS is_same FROM (SELECT l_orderkey, {_FLAG} AS v FROM lineitem) GROUP BY l_orderkey")
def q_all_same(t):
    rest = F.col("l_orderkey") % 7
    v = F.when(rest == 0, "").when((rest == 1) & (F.col("l_linenumber") == 1), None).otherwise(F.col("l_returnflag"))
    return t.lineitem.select("l_orderkey", v.alias("v")).groupBy("l_orderkey").agg(folder.all_same(F.col("v")).alias("is_same"))


@query(f"""SELECT o_custkey, min(j) = max(j) AS is_same, min(j) AS first_value FROM (SELECT l_orderkey, string_agg(l_returnflag, '\\\\' ORDER BY {_TIE}) AS j FROM lineitem GROUP BY 1) JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey""")
def q_all_same_multi(t):
    joined = folder.joined_values(t.lineitem, ["l_orderkey"], TIE, "l_returnflag")
    both = joined.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.groupBy("o_custkey").agg(folder.all_same(F.col("joined")).alias("is_same"), F.min("joined").alias("first_value"))


@query("SELECT l_orderkey, count(DISTINCT l_linenumber)::BIGINT AS n, min(l_linenumber) <= 2 AND max(l_linenumber) - min(l_linenumber) + 1 = count(DISTINCT l_linenumber) AS is_gapless FROM lineitem GROUP BY 1")
def q_number_gap(t):
    return folder.number_gap(t.lineitem, ["l_orderkey"], "l_linenumber")


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem WHERE l_linenumber <> 4), g AS (SELECT *, n - lag(n) OVER (PARTITION BY l_orderkey ORDER BY n) AS step FROM d)
SELECT l_orderkey, coalesce(bool_or(step <> 1), false) AS has_gap FROM g GROUP BY l_orderkey""")
def q_tag_gap(t):
    numbers = t.lineitem.where("l_linenumber <> 4").select("l_orderkey", F.col("l_linenumber").alias("n")).distinct()
    step = F.col("n") - F.lag("n").over(Window.partitionBy("l_orderkey").orderBy("n"))
    return numbers.withColumn("step", step).groupBy("l_orderkey").agg(F.coalesce(F.bool_or(F.col("step") != 1), F.lit(False)).alias("has_gap"))


@query("""WITH n AS (SELECT conv_id, role, turn, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations)
SELECT u.conv_id, u.nth::BIGINT AS nth, length(u.text)::BIGINT AS asked, length(a.text)::BIGINT AS answered FROM n u JOIN n a ON a.conv_id = u.conv_id AND a.nth = u.nth AND a.role = 'assistant' WHERE u.role = 'user'""")
def q_positional_join(t):
    nth = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")).cast("long")
    rows = t.conversations.select("conv_id", "role", nth.alias("nth"), F.length("text").cast("long").alias("n"))
    asked, answered = (rows.where(F.col("role") == r).select("conv_id", "nth", F.col("n").alias(n)) for r, n in (("user", "asked"), ("assistant", "answered")))
    return asked.join(answered, ["conv_id", "nth"])


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, p_name, l_quantity FROM lineitem JOIN part ON p_partkey = l_partkey")
def q_lookup_join(t):
    rows = t.lineitem.select("l_orderkey", big("l_linenumber"), "l_partkey", "l_quantity")
    return rows.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")


@query("SELECT l_orderkey, count(*)::BIGINT AS n, count(*) FILTER (l_discount > 0.05)::BIGINT AS n_bad, count(*) FILTER (l_discount > 0.05) || ' of ' || count(*) AS said FROM lineitem GROUP BY 1")
def q_group_badcount(t):
    agg = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("n_bad"))
    return agg.withColumn("said", F.concat_ws(" of ", F.col("n_bad").cast("string"), F.col("n").cast("string")))


@query("""SELECT lang, count(*)::BIGINT AS total, count(*) FILTER (l.doc_id IS NULL)::BIGINT AS unlabelled, count(*) FILTER (toxic = 1)::BIGINT AS toxic, count(*) FILTER (quality = 0)::BIGINT AS poor
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang HAVING count(*) FILTER (l.doc_id IS NULL) + count(*) FILTER (toxic = 1) + count(*) FILTER (quality = 0) > 0""")
def q_rollup_format(t):
    both = t.documents.select("doc_id", "lang").join(t.labels.withColumn("known", F.lit(True)), "doc_id", "left")
    counts = {"unlabelled": F.col("known").isNull(), "toxic": F.col("toxic") == 1, "poor": F.col("quality") == 0}
    return report.rollup(both, "lang", counts).where("unlabelled + toxic + poor > 0")


@query("SELECT coalesce(lang, 'all') AS lang, count(*)::BIGINT AS total, count(DISTINCT source)::BIGINT AS sources, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang), ())")
def q_rollup_totals(t):
    rows = t.documents.rollup("lang").agg(F.count("*").alias("total"), F.count_distinct("source").alias("sources"), F.sum("n_chars").alias("chars"))
    return rows.withColumn("lang", F.coalesce("lang", F.lit("all")))


_TEST = "l_tax > 0.02"


@query(f"""SELECT l_orderkey, count(*)::BIGINT AS n_copy, count(*) FILTER ({_TEST})::BIGINT AS n_test, count(*) FILTER ({_TEST} AND l_returnflag = 'R')::BIGINT AS n_mismatch,
  CASE WHEN count(*) FILTER ({_TEST}) = 0 THEN 0 ELSE count(*) FILTER (NOT ({_TEST})) END::BIGINT AS n_untested FROM lineitem GROUP BY 1""")
def q_test_copy(t):
    tested = F.col("l_tax") > 0.02
    n_test = F.count_if(tested)
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n_copy"), n_test.alias("n_test"), F.count_if(tested & (F.col("l_returnflag") == "R")).alias("n_mismatch"), F.when(n_test == 0, 0).otherwise(F.count_if(~tested)).cast("long").alias("n_untested"))


@query("SELECT l_orderkey, min(CASE WHEN l_returnflag <> 'N' THEN l_quantity END) AS confidence FROM lineitem GROUP BY 1")
def q_min_confidence(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.min(F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))).alias("confidence"))


@query("SELECT l_orderkey, bool_and(l_discount < 0.1) AS all_ok FROM lineitem GROUP BY 1")
def q_bool_and(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.bool_and(F.col("l_discount") < 0.1).alias("all_ok"))


_KINDS = ["view", "click", "signup", "purchase", "error"]


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}')::BIGINT AS {k}" for k in _KINDS) + " FROM events GROUP BY user_id")
def q_pivot_counts(t):
    return t.events.groupBy("user_id").pivot("event_type", _KINDS).count().na.fill(0)


@query(f"SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ', ' ORDER BY {_TIE}) AS bad FROM lineitem WHERE l_discount > 0.05 GROUP BY 1")
def q_listagg(t):
    bad = F.transform(F.sort_array(F.collect_list(F.struct(*TIE))), lambda x: x["l_linenumber"].cast("string"))
    return t.lineitem.where("l_discount > 0.05").groupBy("l_orderkey").agg(F.array_join(bad, ", ").alias("bad"))


@query("SELECT conv_id, turn, coalesce(lag(length(text) + 11) OVER (PARTITION BY conv_id ORDER BY turn), 0)::BIGINT AS before FROM conversations")
def q_lag_check(t):
    n = (F.length("text") + 11).cast("long")
    return t.conversations.select("conv_id", "turn", F.lag(n, 1, 0).over(Window.partitionBy("conv_id").orderBy("turn")).alias("before"))


@query("SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations")
def q_running_sum(t):
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return t.conversations.select("conv_id", "turn", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("long").alias("start"))


@query("""WITH s AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM s)
SELECT user_id, run::BIGINT AS run, event_type, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS total FROM r GROUP BY user_id, run, event_type""")
def q_run_length(t):
    return folder.run_lengths(t.events, ["user_id"], ["event_id"], "event_type", "event_id")


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 100 // count(*) OVER (PARTITION BY user_id))::BIGINT AS percent FROM events")
def q_progress(t):
    rows = numbered(t.events.select("event_id", "user_id"), ["user_id"], ["event_id"], total="total")
    return rows.select("event_id", F.floor((F.col("number") + 1) * 100 / F.col("total")).alias("percent"))


@query("""SELECT lpad(CAST(count(*) AS VARCHAR), 8, ' ') || ' ' || lang || ' document' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END AS line FROM documents GROUP BY lang""")
def q_report_lines(t):
    return report.count_lines(t.documents, "lang", "document")
