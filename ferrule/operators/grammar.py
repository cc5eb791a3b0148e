"""Line grammars as data: a finite automaton over the lines of texts, run as a scan of composed transitions.

A grammar is a list of rules (state, pattern, next state, kind). A line in a state meets the first rule of this state whose
pattern it matches; a line that meets none leaves the state as it is and is of no kind. A line is thus a function from states to
states, and these functions compose. Lines are cut into blocks; the function of a block is folded from those of its lines, the
states in which blocks begin are found by the same scan over the blocks' functions, level by level, and then each block's lines
get their states. So a text of any length is read in parallel, and no task holds more than one block of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64


@dataclass(frozen=True)
class Rule:
    """In state, a line that matches pattern is of this kind (none: of no interest), and the next line is in state to."""

    state: str
    pattern: str
    to: str
    kind: str | None = None


@dataclass(frozen=True)
class Grammar:
    """Rules, tried in order; texts begin in state start."""

    start: str
    rules: tuple[Rule, ...]

    @property
    def states(self) -> list[str]:
        return list(dict.fromkeys([self.start, *(s for r in self.rules for s in (r.state, r.to))]))

    @property
    def patterns(self) -> list[str]:
        return list(dict.fromkeys(r.pattern for r in self.rules))


def _first(choices: list[tuple[Column, Column]], other: Column) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in choices:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return other if out is None else out.otherwise(other)


def _followed(first: Column, then: Column) -> Column:
    """Composition of two functions on states, given as arrays."""
    return F.transform(first, lambda s: F.get(then, s))


def _starts(functions: DataFrame, keys: list[str], n: int, start: int) -> DataFrame:
    """keys, at and begin (a state) of functions (keys, at, function) at 0 to n - 1: the state before each."""
    blocks = functions.groupBy(*keys, F.expr(f"at div {BLOCK}").alias("_block")).agg(F.sort_array(F.collect_list(F.struct("at", "function"))).alias("_items"))
    identity = F.sequence(F.lit(0), F.size(F.get("_items", F.lit(0))["function"]) - 1)
    if n > BLOCK:
        whole = F.aggregate("_items", identity, lambda a, x: _followed(a, x["function"]))
        above = _starts(blocks.select(*keys, F.col("_block").alias("at"), whole.alias("function")), keys, -(-n // BLOCK), start)
        blocks = blocks.join(above.select(*keys, F.col("at").alias("_block"), "begin"), [*keys, "_block"])
    else:
        blocks = blocks.withColumn("begin", F.lit(start))
    run = F.aggregate("_items", F.array("begin"), lambda a, x: F.concat(a, F.array(F.get(x["function"], F.element_at(a, -1)))))
    each = blocks.select(*keys, "_items", run.alias("_states")).select(*keys, "_states", F.posexplode("_items").alias("_i", "_x"))
    return each.select(*keys, F.col("_x.at").alias("at"), F.get("_states", F.col("_i")).alias("begin"))


def parsed(lines: DataFrame, grammar: Grammar, *keys: str) -> DataFrame:
    """keys, line_no, state, kind, a and b of lines (keys, line_no from 1 without gaps, line) that are of a kind.

    state is that before the line; a and b are the first two groups of the pattern (null where it has fewer). A null line is
    read as an empty one.
    """
    states, patterns = grammar.states, grammar.patterns
    number = {s: i for i, s in enumerate(states)}
    text = F.coalesce("line", F.lit(""))
    marks = F.lit(0).cast("long")  # a bit for each pattern, so that each is tried once
    if len(patterns) > 62:
        raise ValueError("a grammar has at most 62 patterns")
    for i, p in enumerate(patterns):
        marks = marks + F.when(F.rlike(text, F.lit(p)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    rows = lines.select(*keys, (F.col("line_no") - 1).cast("long").alias("at"), marks.alias("_marks"))

    def hit(rule: Rule) -> Column:
        return F.col("_marks").bitwiseAND(F.lit(1 << patterns.index(rule.pattern)).cast("long")) != 0

    function = F.array(*(_first([(hit(r), F.lit(number[r.to])) for r in grammar.rules if r.state == s], F.lit(number[s])) for s in states))
    n = lines.agg(F.max("line_no")).first()[0] or 0
    starts = _starts(rows.select(*keys, "at", function.alias("function")), list(keys), n, number[grammar.start])
    found = starts.join(lines.select(*keys, (F.col("line_no") - 1).cast("long").alias("at"), text.alias("line"), marks.alias("_marks")), [*keys, "at"])
    rule = _first([((F.col("begin") == number[r.state]) & hit(r), F.lit(i)) for i, r in enumerate(grammar.rules)], F.lit(None).cast("int"))
    found = found.withColumn("_rule", rule).where(F.col("_rule").isin([i for i, r in enumerate(grammar.rules) if r.kind]))

    def group(k: int) -> Column:
        with_group = [(F.col("_rule") == i, F.regexp_extract("line", r.pattern, k)) for i, r in enumerate(grammar.rules) if r.kind and _groups(r.pattern) >= k]
        return _first(with_group, F.lit(None).cast("string"))

    named = F.get(F.lit([r.kind or "" for r in grammar.rules]), F.col("_rule"))
    return found.select(*keys, (F.col("at") + 1).alias("line_no"), F.get(F.lit(states), F.col("begin")).alias("state"), named.alias("kind"), group(1).alias("a"), group(2).alias("b"))


def _groups(pattern: str) -> int:
    """Capturing groups of a pattern."""
    plain = pattern.replace("\\\\", "").replace("\\(", "")
    return plain.count("(") - plain.count("(?")
