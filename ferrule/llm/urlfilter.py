"""URL filters: ordered host and path rules, then a cascade of Bloom filters for the hosts that no rule settles.

Level 0 of the cascade encodes the listed keys; level 1 encodes the keys of the corpus that level 0 takes wrongly; level 2
the listed keys that level 1 takes wrongly, and so on until nothing is taken wrongly. As the corpus's complete key
universe is encoded, the answer is exact for every key in it, and no join with the list is needed. The first level's error
rate is set from the two counts, so that all levels together take a few bits for each listed key, times the logarithm of
(universe / list); the filters do not grow with the corpus itself.

Only DataFrame operations are used. The filters are read by tasks as one literal; beyond MAX_WORDS in all (32 MB) the list
is joined instead, with the same result.

Defined results: host and path of a null url, or one without "://", are empty; the empty host is never listed; repeated
rows get equal rows; an empty list or an empty table is a cascade without levels; null keys are dropped; extra columns are
ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import written

MAX_WORDS = 4_000_000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass
class Cascade:
    """Filters by level as array<long> columns; listed is the key list itself where filters would be too large."""

    levels: list[tuple[int, int, Column]]  # bits, hashes, words
    listed: DataFrame | None = None


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: from there up to "?" or "#"."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + 1), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits)) for j in range(hashes)]


def _has(key: Column, level: int, bits: int, hashes: int, words: Column) -> Column:
    """Whether a filter takes the key."""
    out = F.lit(True)
    for at in _positions(key, level, bits, hashes):
        word = F.get(words, F.shiftright(at, 6).cast("int"))
        out = out & (F.call_function("shiftrightunsigned", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return out


def _filter(keys: DataFrame, level: int, bits: int, hashes: int) -> DataFrame:
    """One row with the words of a filter; at most bits / 64 rows meet, already combined by word."""
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits, hashes))).alias("at"))
    one = at.select(F.shiftright("at", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int")).alias("bit"))
    blank = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bit"))
    words = one.union(blank).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    return words.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bit"))), lambda x: x["bit"]).alias("words"))


def build_cascade(listed: DataFrame, universe: DataFrame, max_words: int = MAX_WORDS) -> Cascade:
    """Cascade for the keys of listed over those of universe (one column key each; listed keys outside it are dropped)."""
    every = universe.select("key").where("key is not null").distinct()
    marked = every.join(listed.select("key").distinct().withColumn("listed", F.lit(True)), "key", "left")
    every = written(marked.select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "url-keys")
    n, total = every.where("listed").count(), every.count()
    cascade, words, level = Cascade([]), 0, 0
    todo, others = every.where("listed"), every.where("not listed")
    while n:
        rate = min(0.5, max(2.0**-24, 0.7 * n / max(1, total - n))) if level == 0 else 0.5
        hashes = max(1, round(-math.log2(rate)))
        bits = 64 * math.ceil(max(64, 1.4427 * n * hashes) / 64)
        words += bits // 64
        if words > max_words:
            return Cascade([], listed.select("key").distinct())
        filled = written(_filter(todo, level, bits, hashes), "url-filter").select("words").scalar()
        cascade.levels.append((bits, hashes, filled))
        todo, others = others.where(_has(F.col("key"), level, bits, hashes, filled)), todo
        todo = written(todo, "url-taken")
        n, level = todo.count(), level + 1
    return cascade


def contains(cascade: Cascade, key: Column) -> Column:
    """Exact membership of a key of the universe: it is listed if the first level that refuses it is an odd one."""
    out = F.lit(len(cascade.levels) % 2 == 1)
    for level in reversed(range(len(cascade.levels))):
        out = F.when(~_has(key, level, *cascade.levels[level]), F.lit(level % 2 == 1)).otherwise(out)
    return out


def ruled(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds rule (the name of the longest rule that fits host and path, else null) and ruling (its verdict)."""
    rule = ruling = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # later ones override
        on = (F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))
        fits = on & F.startswith(F.col("path"), F.lit(r.path))
        rule, ruling = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(ruling)
    return df.withColumns({"rule": rule, "ruling": ruling})


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; hosts that no rule fits are blocked if they are listed (key)."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    cascade = build_cascade(listed, urls.where("host <> ''").select(F.col("host").alias("key")))
    out = ruled(urls, rules)
    if cascade.listed is not None:
        out = out.join(cascade.listed.select(F.col("key").alias("host"), F.lit(True).alias("hit")), "host", "left")
        hit = F.coalesce("hit", F.lit(False))
    else:
        hit = (F.col("host") != "") & contains(cascade, F.col("host"))
    verdict = F.coalesce("ruling", F.when(hit, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
