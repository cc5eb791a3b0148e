"""The algebra of issues: levels, escalation, repairability, and the aggregates over them.

An issue is a row (path, idx, base_level, tags, repair_kind ...). Levels are numbers from 0 (none) to 6 (fatal); what a
level is worth in a run is derived from the run's two escalation masks and never stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.options import Severity


def raised_level(base: Column, repair_kind: Column) -> Column:
    """An issue that can be repaired is a warning at least."""
    return F.when(repair_kind.isNotNull(), F.greatest(base, F.lit(int(Severity.WARNING)))).otherwise(base)


def effective_level(base: Column, tags: Column, warn: int, err: int) -> Column:
    """Level under the masks: below a warning both escalate, a warning only becomes an error, more stays."""
    to_error, to_warning = tags.bitwiseAND(F.lit(err)) != 0, tags.bitwiseAND(F.lit(warn)) != 0
    error, warning = int(Severity.ERROR), int(Severity.WARNING)
    return F.when((base <= warning) & to_error, error).when((base < warning) & to_warning, warning).otherwise(base).cast("int")


def repairable(level: Column, repair_kind: Column, tried: Column | None = None) -> Column:
    """Has a repair that is untried, and is no error."""
    open_ = F.lit(True) if tried is None else ~tried
    return repair_kind.isNotNull() & open_ & (level < int(Severity.ERROR))


def has_tag(tags: Column, mask: int) -> Column:
    return tags.bitwiseAND(F.lit(mask)) != 0


def per_path(issues: DataFrame, *keys: str) -> DataFrame:
    """n_issues, max_level and n_repairable for each key; needs level and repair_kind."""
    return issues.groupBy(*keys).agg(
        F.count("*").alias("n_issues"),
        F.max("level").cast("int").alias("max_level"),
        F.count_if(repairable(F.col("level"), F.col("repair_kind"))).alias("n_repairable"),
    )


def max_level_where(mask: int) -> Column:
    """Aggregate: the highest level among issues with any of the tags; 0 if there are none."""
    return F.coalesce(F.max(F.when(has_tag(F.col("tags"), mask), F.col("level"))), F.lit(0)).cast("int")


def from_rules(files: DataFrame, rules: list, *keys: str) -> DataFrame:
    """Issues of a list of rules over one row per file: keys, idx (from 1, in the order of rules), message, base_level, tags, repair_kind.

    A rule has a guard and a message (columns), a level (a number or a column), tags and a repair kind. All rules are one projection.
    """
    level = lambda x: x.cast("int") if isinstance(x, Column) else F.lit(int(x))
    made = [
        F.when(
            r.guard,
            F.struct(r.message.alias("message"), level(r.level).alias("base_level"), F.lit(int(r.tags)).alias("tags"), F.lit(r.repair).cast("string").alias("repair_kind")),
        )
        for r in rules
    ]
    found = F.filter(F.array(*made), lambda x: x.isNotNull())
    rows = files.select(*keys, F.posexplode(found).alias("i", "x"))
    base = raised_level(F.col("x.base_level"), F.col("x.repair_kind")).cast("int")
    return rows.select(*keys, (F.col("i") + 1).cast("long").alias("idx"), "x.message", base.alias("base_level"), "x.tags", "x.repair_kind")


def in_phases(*phases: DataFrame) -> DataFrame:
    """Issues of several phases as one stream; phase numbers them from 1."""
    out = None
    for n, p in enumerate(phases, 1):
        p = p.withColumn("phase", F.lit(n))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out
