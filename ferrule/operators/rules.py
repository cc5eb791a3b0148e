"""Rules: a guard, a message, a level, tags and a repair; and the guards that several formats share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.options import Severity, Tag


@dataclass
class Rule:
    """An issue that a row has if guard is true."""

    guard: Column
    message: Column
    level: int | Column = Severity.ERROR
    tags: int = Tag.NONE
    repair: str | None = None


def tag_number(value: Column, optional: bool = False) -> Column:
    """Reason why a tag is no number, or null."""
    missing = value.isNull() | (value == "")
    return F.when(missing, None if optional else "tag is missing").when(~F.rlike(value, F.lit("^[0-9]")), "tag is not a number")


def tag_date(value: Column, optional: bool = False) -> Column:
    """Reason why a tag is no YYYY or YYYY-MM-DD of 1900 to 2099, or null."""
    missing = value.isNull() | (value == "")
    good = F.length(value).isin(4, 10) & F.rlike(value, F.lit("^(19|20)[0-9][0-9]"))
    return F.when(missing, None if optional else "tag is missing").when(~good, "tag is not a date")


def tag_text(value: Column) -> Column:
    """Reasons why a tag is untidy, joined by commas; empty if there are none."""
    blank = F.lit(" ")
    return F.concat_ws(",", F.when(F.startswith(value, blank), "leading"), F.when(F.endswith(value, blank), "trailing"), F.when(F.contains(value, F.lit("  ")), "adjacent"))


def missing_keys(things: DataFrame, values: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """(on, key) of required keys (a small table of key and is_optional) that a thing has no value for."""
    asked = things.withColumn("key", F.explode(keys.where("not is_optional").agg(F.collect_list("key")).scalar()))
    return asked.join(values.where("value is not null"), [on, "key"], "left_anti").select(on, "key")


def bloat(df: DataFrame, total: str, limit: int, cap: int) -> DataFrame:
    """Adds excess (what total has beyond limit) and keep (how much of it a repair leaves)."""
    excess = F.greatest(F.col(total) - limit, F.lit(0.0))
    return df.withColumn("excess", excess).withColumn("keep", F.least(F.lit(float(cap)), excess))
