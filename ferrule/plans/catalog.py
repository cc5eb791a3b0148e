"""The registry of queries: a function of (spark, sf_dir) and its SQL under one name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    """Registers a function of Tables as a query, with its SQL."""

    def register(f: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return register


def big(name: str, alias: str | None = None):
    return F.col(name).cast("long").alias(alias or name)


#: events as issues: path, idx, base_level, tags, repair_kind.
ISSUES_SQL = """(SELECT user_id AS path, event_id AS idx,
  CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 WHEN 'error' THEN 5 ELSE 0 END AS base_level,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS tags, CASE WHEN value > 150 THEN 'trim' END AS repair_kind, event_type, value FROM events)"""


def issues(t: Tables) -> DataFrame:
    level = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in (("view", 1), ("click", 2), ("signup", 3), ("purchase", 4), ("error", 5)) for x in p)), F.col("event_type")), F.lit(0))
    return t.events.select(
        F.col("user_id").alias("path"), F.col("event_id").alias("idx"), level.alias("base_level"),
        F.get_json_object("props", "$.k").cast("int").alias("tags"), F.when(F.col("value") > 150, "trim").alias("repair_kind"), "event_type", "value",
    )


def crc_sql(data: str, width: int, poly: int, reflected: bool, start: int = 0) -> str:
    """SQL for a checksum of a blob: a fold over its bytes with the table of remainders, a column of crc_tables."""
    octets = f"list_prepend({start}::BIGINT, list_transform(regexp_extract_all(hex({data}), '..'), lambda x: ('0x' || x)::BIGINT))"
    if reflected:
        step = f"xor(s >> 8, t{poly}[(xor(s, x) & 255) + 1])"
    else:
        step = f"xor(s << 8, t{poly}[xor(s >> {width - 8}, x) + 1]) & {(1 << width) - 1}"
    return f"list_reduce({octets}, lambda s, x: {step})"


def crc_tables_sql(*specs: tuple[int, int, bool]) -> str:
    """SQL for crc_tables: one row with the tables of polynomials (width, poly, reflected), made bit by bit."""
    parts = []
    for width, poly, reflected in specs:
        first = "i" if reflected else f"i << {width - 8}"
        on = f"CASE WHEN s & 1 = 1 THEN xor(s >> 1, {poly}) ELSE s >> 1 END" if reflected else f"CASE WHEN s >> {width - 1} = 1 THEN xor(s << 1, {poly}) & {(1 << width) - 1} ELSE s << 1 END"
        parts.append(f"""(WITH RECURSIVE b AS (SELECT i, 0 AS n, ({first})::BIGINT AS s FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, n + 1, {on} FROM b WHERE n < 8) SELECT list(s ORDER BY i) FROM b WHERE n = 8) AS t{poly}""")
    return f"(SELECT {', '.join(parts)}) AS crc_tables"
