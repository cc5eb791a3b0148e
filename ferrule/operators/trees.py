"""Nested intervals as trees: depth and parent from places and sizes, traces to the root, and the elements of EBML.

Depth is a running sum over openings and closings; a node's parent is the last one before it that is a level higher, found in
a window by level. Traces climb the stored parent links with a recursive query, all nodes at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.storage import written


def nested(rows: DataFrame, *keys: str) -> DataFrame:
    """rows (keys, idx, pos, size ...) with depth (from 0) and parent (an idx, null for roots), by keys.

    A node lies in another if its interval does; of equal intervals the one with the smaller idx is outside. Intervals that end
    where others begin are not in them. Empty intervals hold nothing. Intervals that overlap in part count as open up to their
    end. idx is unique within its keys.
    """
    opening = rows.select(*keys, "pos", F.lit(1).alias("_turn"), (-F.col("size")).alias("_by"), "idx", (F.col("size") > 0).cast("int").alias("_step"))
    closing = rows.where("size > 0").select(*keys, (F.col("pos") + F.col("size")).alias("pos"), F.lit(0).alias("_turn"), F.lit(0).cast("long").alias("_by"), "idx", F.lit(-1).alias("_step"))
    order = Window.partitionBy(*keys).orderBy("pos", "_turn", "_by", "idx")
    depth = F.coalesce(F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    events = opening.union(closing).withColumn("depth", depth).where("_turn = 1").drop("_turn")
    holder = events.where("_step = 1").select(*keys, "pos", "_by", "idx", (F.col("depth") + 1).alias("depth"), F.lit(True).alias("_holds"))
    asked = events.select(*keys, "pos", "_by", "idx", "depth", F.lit(False).alias("_holds")).union(holder)
    level = Window.partitionBy(*keys, "depth").orderBy("pos", "_by", "idx").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.last(F.when(F.col("_holds"), F.col("idx")), ignorenulls=True).over(level)
    found = asked.withColumn("parent", F.when(F.col("depth") > 0, parent)).where("NOT _holds")
    return rows.join(found.select(*keys, "idx", "depth", "parent"), [*keys, "idx"])


_TRACE = """
WITH RECURSIVE up({keys}, node, at, steps, trace) AS (
  SELECT {keys}, idx, parent, 0, array({name}) FROM {{start}}
  UNION ALL
  SELECT {own}, u.node, n.parent, u.steps + 1, concat(array(n.{name}), u.trace) FROM up u JOIN {{nodes}} n ON {same} AND u.at = n.idx
) SELECT {keys}, node AS idx, steps, trace FROM up WHERE at IS NULL
"""


def traces(nodes: DataFrame, start: DataFrame, name: str, *keys: str) -> DataFrame:
    """keys, idx, steps and trace (the names from the root down to it) of the start nodes; stored.

    nodes and start have keys, idx, parent and the column name.
    """
    spark, limit = nodes.sparkSession, "spark.sql.cteRecursionRowLimit"
    listed = ", ".join(keys)
    query = _TRACE.format(keys=listed, own=", ".join(f"u.{k}" for k in keys), same=" AND ".join(f"u.{k} = n.{k}" for k in keys), name=name)
    before = spark.conf.get(limit)
    spark.conf.set(limit, -1)  # as many rows as there are nodes
    try:
        return written(spark.sql(query, start=start.select(*keys, "idx", "parent", name), nodes=nodes.select(*keys, "idx", "parent", name)), "traces")
    finally:
        spark.conf.set(limit, before)


def first_of(nodes: DataFrame, name: str, kind: str, *keys: str) -> DataFrame:
    """keys and the node (a struct) that comes first among those of a kind."""
    every = [c for c in nodes.columns if c not in keys]
    return nodes.where(F.col(name) == kind).groupBy(*keys).agg(F.min_by(F.struct(*every), F.struct("pos", "idx")).alias("node"))


def ebml_payload(content: Column, pos: Column, size: Column) -> Column:
    """The bytes of an EBML element after its id and its length, both of which tell their size by their first byte."""

    def width(at: Column) -> Column:
        return 9 - F.length(F.conv(F.hex(F.substring(content, at.cast("int"), 1)), 16, 2))

    start = pos + 1 + width(pos + 1)
    start = start + width(start)
    return F.substring(content, start.cast("int"), (size - (start - pos - 1)).cast("int"))


def unsigned(payload: Column) -> Column:
    """Big-endian value of at most eight bytes, as a decimal text; null if there are none."""
    return F.when(F.length(payload).between(1, 8), F.conv(F.hex(payload), 16, 10))


def ascii_text(payload: Column) -> Column:
    """Text of a payload; zeros at the end do not count."""
    return F.regexp_replace(F.decode(payload, "US-ASCII"), "\\x00+$", "")
