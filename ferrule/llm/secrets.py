"""Secret scans: base patterns, and weak candidates that count only where complementary parts stand together.

Every pattern's matches are found with built-in regular expressions: the text between matches (split) and the matches
themselves give their lengths, and running sums give their places in code points. Weak candidates (key identifiers of
other makers, bare mixed tokens, endpoints) are then joined with the other parts of the same text whose starts lie within
SCOPE code points, by interval bins of that width. A weak secret counts if a key identifier is in its scope, a weak
identifier if a secret is, an endpoint if both are. Only DataFrame operations are used; texts are read once and never
shuffled, only places are.

Defined results: a null or empty text has no spans; repeated rows get equal rows, each on its own; equal places are
ordered by kind as listed; an empty table gives no rows; null ids are kept; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.llm.common import written

SCOPE = 256
ID, SECRET, ENDPOINT = 1, 2, 4


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    part: int
    weak: bool
    group: int = 0  # the group whose length counts
    least: int = 0
    needs: tuple[str, ...] = ()  # patterns that the match must also hold


# The patterns, base kinds first, in the order in which spans of one start are listed.
KINDS = [
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", SECRET, False, 2, 12),
    Kind("access", r"AKIA[A-Z0-9]+", ID, False, 0, 18),
    Kind("hex", r"[0-9a-f]{16,}", SECRET, False, 0, 16),
    Kind("key_id", r"(ASIA|AROA|AIDA|AIza|ghp_|sk_live_|pk_live_)[A-Za-z0-9_]{8,}", ID, True),
    Kind("mixed", r"[A-Za-z0-9+/]{24,}", SECRET, True, 0, 24, (r"[a-z]", r"[A-Z]", r"[0-9]")),
    Kind("endpoint", r"https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", ENDPOINT, True),
]


def _lengths(text: Column, kind: Kind) -> Column:
    """Per match: code points before it since the last match, its code points, and whether it is kept."""
    gaps = F.transform(F.split(text, kind.pattern, -1), lambda x: F.length(x))

    def measured(match: Column) -> Column:
        sized = match if not kind.group else F.regexp_extract(match, kind.pattern, kind.group)
        kept = F.length(sized) >= kind.least
        for p in kind.needs:
            kept = kept & F.rlike(match, F.lit(p))
        return F.struct(F.length(match).alias("length"), kept.alias("kept"))

    matches = F.transform(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), measured)
    rows = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m["length"].alias("length"), m["kept"].alias("kept")))
    return F.when(F.rlike(text, F.lit(kind.pattern)), rows)


def _joined(spans: Column) -> Column:
    lines = F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(F.array(*(F.lit(k.name) for k in KINDS)), s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(lines, ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), *(_lengths(text, k).alias(k.name) for k in KINDS))
    found = written(found, "secret-lengths")  # also fixes the row numbers
    parts = [
        found.where(F.col(k.name).isNotNull()).select("row", F.lit(i).alias("kind"), F.posexplode(k.name).alias("nth", "m"))
        for i, k in enumerate(KINDS)
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    so_far = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    every = every.select("row", "kind", "m.kept", F.col("m.length").alias("length"), F.sum(F.col("m.gap") + F.col("m.length")).over(so_far).alias("end"))
    every = every.where("kept").select("row", "kind", (F.col("end") - F.col("length")).alias("start"), "end")
    spans = written(every, "secret-spans")

    weak = [i for i, k in enumerate(KINDS) if k.weak]
    bin_of = F.floor(F.col("start") / SCOPE)
    asks = spans.where(F.col("kind").isin(weak)).withColumn("bin", bin_of)
    part = F.get(F.array(*(F.lit(k.part) for k in KINDS)), F.col("kind")).alias("part")
    near = spans.select(F.col("row"), F.col("start").alias("at"), part, F.explode(F.array(bin_of - 1, bin_of, bin_of + 1)).alias("bin")).where(F.col("part") != ENDPOINT)
    linked = asks.join(near, ["row", "bin"]).where(F.abs(F.col("at") - F.col("start")) <= SCOPE)
    linked = linked.groupBy("row", "kind", "start", "end").agg(F.bit_or("part").alias("parts"))
    own = F.get(F.array(*(F.lit(k.part) for k in KINDS)), F.col("kind"))
    needed = F.when(own == ID, SECRET).when(own == SECRET, ID).otherwise(ID | SECRET)
    linked = linked.where(F.col("parts").bitwiseAND(needed) == needed).select("row", "kind", "start", "end")

    base = spans.where(~F.col("kind").isin(weak))
    by_row = base.unionByName(linked).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("all"))
    out = found.select("row", "doc_id").join(by_row, "row", "left").withColumn("all", F.coalesce("all", F.expr("array()").cast(by_row.schema["all"].dataType)))
    n_base = sum(not k.weak for k in KINDS)
    base_only = F.filter("all", lambda s: s["kind"] < n_base)
    kinds = F.transform("all", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, F.lit(i)))).cast("long").alias(f"n_{KINDS[i].name}") for i in range(n_base)]
    return out.select("doc_id", *counts, F.sha2(_joined(base_only), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))


def oracle_sql() -> str:
    """The same in DuckDB's SQL, for a table documents with unique ids."""
    union = []
    for i, k in enumerate(KINDS):
        p = k.pattern.replace("'", "''").replace(r"\x20", " ")
        kept = [f"length({f'regexp_extract(m, {chr(39)}{p}{chr(39)}, {k.group})' if k.group else 'm'}) >= {k.least}", *(f"regexp_matches(m, '{n}')" for n in k.needs)]
        union.append(f"""SELECT doc_id, {i} AS kind, nth, length(gaps[nth]) AS gap, m, {' AND '.join(kept)} AS kept FROM (
  SELECT doc_id, string_split_regex(text, '{p}') AS gaps, unnest(regexp_extract_all(text, '{p}')) AS m, generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS nth FROM docs)""")
    names = "[" + ", ".join(f"'{k.name}'" for k in KINDS) + "]"
    roles = "[" + ", ".join(str(k.part) for k in KINDS) + "]"
    n_base = sum(not k.weak for k in KINDS)
    line = f"{names}[kind + 1] || ':' || start || ':' || stop"
    counts = ", ".join(f'count(*) FILTER (kind = {i})::BIGINT AS n_{KINDS[i].name}' for i in range(n_base))
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ({' UNION ALL '.join(union)}),
s AS (SELECT doc_id, kind, kept, sum(gap + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY nth)::BIGINT AS stop, length(m) AS n FROM m),
spans AS (SELECT doc_id, kind, stop - n AS start, stop, {roles}[kind + 1] AS part FROM s WHERE kept),
linked AS (SELECT a.doc_id, a.kind, a.start, a.stop FROM spans a WHERE a.kind >= {n_base}
  AND (a.part = {ID} OR EXISTS (SELECT 1 FROM spans b WHERE b.doc_id = a.doc_id AND b.part = {ID} AND abs(b.start - a.start) <= {SCOPE}))
  AND (a.part = {SECRET} OR EXISTS (SELECT 1 FROM spans b WHERE b.doc_id = a.doc_id AND b.part = {SECRET} AND abs(b.start - a.start) <= {SCOPE}))),
every AS (SELECT doc_id, kind, start, stop FROM spans WHERE kind < {n_base} UNION ALL SELECT * FROM linked),
g AS (SELECT doc_id, {counts},
  string_agg({line}, ',' ORDER BY start, kind) FILTER (kind < {n_base}) AS base, string_agg({line}, ',' ORDER BY start, kind) AS spans
  FROM every GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{KINDS[i].name}, 0) AS n_{KINDS[i].name}' for i in range(n_base))},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs d LEFT JOIN g ON g.doc_id = d.doc_id
"""
