"""Merkle manifest of a dataset: trees of sixteen children a node, and a climb that recomputes the root from every leaf.

A row's leaf is the SHA-256 of its columns, each with its length before it. The leaves of a source, by doc_id, form a tree; the
roots of the sources, by source, form the tree above. All digests are lower-case hex and are hashed as such text.

Built levels are stored as node rows, each linked to its parent. The climb is a recursive query over them. It starts with the
runs of up to sixteen leaves that share a parent, and so all ancestors: a step appends a node's siblings once for the run and
folds the hash of each leaf of the run with them. Low nodes are met in a shuffle; there a node has few rows (16 times fewer at
each lower level). The nodes above, which all rows meet, are at most UPPER_NODES and are broadcast.

Nulls in any column are part of the leaf ("-"), and come first in the order of doc_id and source. Repeated rows are leaves of
their own; rows of one doc_id are ordered by their leaf. Empty and very long texts are hashed whole. A source of one row has this row's leaf as root, one source
alone has its root as that of the dataset, and an empty table gives no rows. Columns other than those named are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import written
from ferrule.operators.ordering import numbered

FAN = 16
#: Nodes that may be broadcast; a node has at most 16 digests of 64 characters, so 1.2 kB.
UPPER_NODES = 4096
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(columns: dict[str, Column]) -> Column:
    """Digest of a row: "-" for a null, else the value's UTF-8 length, a colon and the value."""
    texts = [c.cast("string") for c in columns.values()]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def leaves(docs: DataFrame, touched: Column, changed: dict[str, Column]) -> DataFrame:
    """source, doc_id, leaf and claim: the leaf of the row as it was, and as it is now where touched, with changed columns."""
    before = {c: F.col(c) for c in COLUMNS}
    now = F.when(F.coalesce(touched, F.lit(False)), leaf(before | changed))
    return docs.select("source", "doc_id", leaf(before).alias("leaf"), now.alias("claim")).withColumn("claim", F.coalesce("claim", "leaf"))


def _node(tree: Column, level: Column | int, pos: Column) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.concat_ws("/", tree.cast("string"), level.cast("string"), pos.cast("string"))


def _in_order(key: str, value: str) -> Column:
    """Aggregate: the texts of value in the order of key, one after the other."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value]), "")


def _levels(bottom: DataFrame, most: int) -> list[DataFrame]:
    """Levels above bottom (tree, pos, digest, size), as long as a tree has several nodes; size is that of the level."""
    out = [bottom]
    while most > 1:
        most = -(-most // FAN)
        up = out[-1].where("size > 1").groupBy("tree", F.expr(f"pos div {FAN}").alias("pos"))
        up = up.agg(_in_order("pos", "digest").alias("kids"), F.expr(f"(first(size) + {FAN - 1}) div {FAN}").alias("size"))
        out.append(written(up.withColumn("digest", F.sha2("kids", 256)), "level"))
    return out


def manifest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, nodes) of leaves (source, doc_id, leaf, claim).

    runs: members (doc_id, leaf, claim) in order, with node, digest, parent, place, height and is_subroot of what they form.
    nodes: node, kids (digests of its children), digest, parent, place (among the parent's children), height of the parent,
    is_subroot. The root's parent is null.
    """
    placed = written(numbered(rows, ["source"], ["doc_id", "leaf", "claim"], "number", "total", "tree"), "leaves")
    run = placed.groupBy("tree", F.expr(f"number div {FAN}").alias("pos")).agg(
        F.sort_array(F.collect_list(F.struct("number", "doc_id", "leaf", "claim"))).alias("members"), F.first("total").alias("total")
    )
    kids = F.array_join(F.transform("members", lambda m: m["leaf"]), "")
    lone = F.col("total") == 1  # is the root of its source as it is
    run = run.withColumn("kids", kids).withColumn("digest", F.when(lone, F.col("kids")).otherwise(F.sha2("kids", 256)))
    run = written(run.select("tree", "pos", "members", "digest", F.expr(f"(total + {FAN - 1}) div {FAN}").alias("size")), "runs")
    most, n_trees = run.agg(F.max("size"), F.max("tree")).first()
    low = _levels(run.select("tree", "pos", "digest", "size"), most or 0)
    subroots = reduce(DataFrame.unionByName, (x.where("size = 1").select("tree", "digest") for x in low))
    n_trees = (n_trees or 0) + 1
    bottom = subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest", F.lit(n_trees).cast("long").alias("size"))
    top = _levels(bottom, n_trees)[1:]

    def linked(level: DataFrame, height: int, of_source: bool) -> DataFrame:
        whole = F.col("size") == 1
        up = F.when(~whole, _node(F.col("tree"), height + 1, F.expr(f"pos div {FAN}")))
        place = F.when(~whole, F.col("pos"))
        parent_height = F.when(~whole, F.lit(height + 1))
        if of_source and n_trees > 1:
            up = F.coalesce(up, _node(F.lit(-1), len(low) + 1, F.expr(f"tree div {FAN}")))
            place, parent_height = F.coalesce(place, F.col("tree")), F.coalesce(parent_height, F.lit(len(low) + 1))
        return level.withColumns({
            "node": _node(F.col("tree"), height, F.col("pos")), "parent": up, "place": (place % FAN).cast("int"),
            "parent_height": parent_height, "height": F.lit(height), "is_subroot": whole & F.lit(of_source),
        }).drop("tree", "pos", "size")

    nodes = [linked(x, h, True) for h, x in enumerate(low[1:], 2)] + [linked(x, h, False) for h, x in enumerate(top, len(low) + 1)]
    runs = linked(run, 1, True)
    empty = runs.where("false").drop("members").withColumn("kids", F.lit(""))
    return runs, written(reduce(DataFrame.unionByName, nodes, empty), "nodes")


_CLIMB = """
WITH RECURSIVE climb(node, members, folds, above, subroot, digest, parent, place, parent_height) AS (
  SELECT node, members, folds, above, subroot, digest, parent, place, parent_height FROM {start}
  UNION ALL
  SELECT {hint} c.node, c.members,
    transform(c.folds, f -> sha2(concat(substr(n.kids, 1, 64 * c.place), f, substr(n.kids, 64 * c.place + 65)), 256)),
    concat(c.above, substr(n.kids, 1, 64 * c.place), substr(n.kids, 64 * c.place + 65)),
    coalesce(c.subroot, CASE WHEN n.is_subroot THEN n.digest END), n.digest, n.parent, n.place, n.parent_height
  FROM climb c JOIN {nodes} n ON c.parent = n.node
) SELECT * FROM climb WHERE {ended}
"""


def _climbed(start: DataFrame, nodes: DataFrame, ended: str, hint: str) -> DataFrame:
    """Recursive climb from start until ended; as many rows as it takes."""
    spark, limit = start.sparkSession, "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, -1)
    try:
        query = _CLIMB.replace("{hint}", hint).replace("{ended}", ended)
        return written(spark.sql(query, start=start, nodes=nodes), "climb")
    finally:
        spark.conf.set(limit, before)


def proofs(rows: DataFrame, upper_nodes: int = UPPER_NODES) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of leaves (source, doc_id, leaf, claim).

    proof_sha256 digests a leaf's siblings from its run up to the root; folded_root folds the claim with them.
    """
    runs, nodes = manifest(rows)
    without = lambda kids, i: F.concat(kids.substr(F.lit(1), 64 * i), kids.substr(64 * i + 65, F.lit(64 * FAN)))
    leaf_text = F.array_join(F.transform("members", lambda m: m["leaf"]), "")
    fold = lambda m, i: F.when(F.col("lone"), m["claim"]).otherwise(
        F.sha2(F.concat(leaf_text.substr(F.lit(1), 64 * i), m["claim"], leaf_text.substr(64 * i + 65, F.lit(64 * FAN))), 256)
    )
    start = runs.withColumn("lone", (F.size("members") == 1) & (F.col("digest") == F.col("members")[0]["leaf"])).select(
        "node", "members", F.transform("members", fold).alias("folds"), F.lit("").alias("above"),
        F.when(F.col("is_subroot"), F.col("digest")).alias("subroot"), "digest", "parent", "place", "parent_height",
    )
    counts, cut = {r["height"]: r["n"] for r in nodes.groupBy("height").agg(F.count("*").alias("n")).collect()}, 0  # a row a level
    while sum(n for h, n in counts.items() if h >= cut) > upper_nodes:
        cut += 1
    if any(h < cut for h in counts):
        start = _climbed(start, nodes.where(F.col("height") < cut), f"parent_height IS NULL OR parent_height >= {cut}", "")
    done = _climbed(start, nodes.where(F.col("height") >= cut), "parent IS NULL", "/*+ BROADCAST(n) */")
    each = done.select("subroot", F.col("digest").alias("root"), "above", leaf_text.alias("kids"), F.posexplode(F.arrays_zip("members", "folds")).alias("i", "x"))
    out = each.select(
        F.col("x.members.doc_id").alias("doc_id"), F.col("x.members.leaf").alias("leaf"), "subroot", "root",
        F.sha2(F.concat(without(F.col("kids"), F.col("i")), F.col("above")), 256).alias("proof_sha256"), F.col("x.folds").alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql(touched_every: int = 5, levels: int = 8) -> str:
    """DuckDB SQL of the same rows, for sources (and their number) of at most 16 ** levels; A-Z of text are lowered where touched."""

    def parts(low: str) -> str:
        texts = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", low)
        return " || ".join(f"coalesce(CAST(octet_length(encode({t})) AS VARCHAR) || ':' || {t}, '-')" for t in texts)

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: list_concat([CAST(ord(d) AS BIGINT)], list_transform(range(8), lambda i: CAST(-1 AS BIGINT)))))"
    crc = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bits}), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"
    sql = [
        f"WITH hashed AS (SELECT doc_id, source, sha256({parts('text')}) AS leaf, CASE WHEN {crc} % {touched_every} = 0 THEN sha256({parts(lower)}) END AS claim FROM documents)",
        "ranked AS (SELECT *, coalesce(claim, leaf) AS now, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, claim) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size FROM hashed)",
        "s0 AS (SELECT tree, pos, leaf AS digest, size FROM ranked)",
        "s_0 AS (SELECT doc_id, leaf, tree, pos, now AS folded, '' AS above FROM ranked)",
    ]

    def climb(t: str) -> None:
        for k in range(levels):
            sql.append(
                f"{t}{k + 1} AS (SELECT tree, pos // {FAN} AS pos, CASE WHEN min(size) = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest, "
                f"CASE WHEN min(size) = 1 THEN '' ELSE string_agg(digest, '' ORDER BY pos) END AS kids, (min(size) + {FAN - 1}) // {FAN} AS size FROM {t}{k} GROUP BY tree, pos // {FAN})"
            )
            left, right = f"substr(n.kids, 1, 64 * (c.pos % {FAN}))", f"substr(n.kids, 64 * (c.pos % {FAN}) + 65)"
            sql.append(
                f"{t}_{k + 1} AS (SELECT c.* REPLACE (c.pos // {FAN} AS pos, CASE WHEN n.kids = '' THEN c.folded ELSE sha256({left} || c.folded || {right}) END AS folded, "
                f"c.above || {left} || {right} AS above) FROM {t}_{k} c JOIN {t}{k + 1} n ON n.tree = c.tree AND n.pos = c.pos // {FAN})"
            )

    climb("s")
    sql.append(f"t0 AS (SELECT -1 AS tree, tree AS pos, digest, count(*) OVER () AS size FROM s{levels})")
    sql.append(f"t_0 AS (SELECT c.* REPLACE (c.tree AS pos, -1 AS tree), n.digest AS subroot FROM s_{levels} c JOIN s{levels} n ON n.tree = c.tree)")
    climb("t")
    return ",\n".join(sql) + f" SELECT c.doc_id, c.leaf, c.subroot, n.digest AS root, sha256(c.above) AS proof_sha256, c.folded AS folded_root, c.folded = n.digest AS verified FROM t_{levels} c JOIN t{levels} n ON n.pos = 0"
