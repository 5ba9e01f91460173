"""Rule sets over clue entries: each rule is a predicate or a query; a set is the union of its violations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cluemill.functions.text import letter_key, letters, word_list


@dataclass(frozen=True)
class Rule:
    """A violation where the predicate holds; null counts as no violation."""

    code: str
    severity: str
    fires: Callable[[], Column]
    detail: Callable[[], Column] = lambda: F.lit("")


class RuleSet:
    """Rules by code; all are evaluated in one pass over the rows."""

    def __init__(self, *rules: Rule) -> None:
        self.rules = {r.code: r for r in rules}

    def _codes(self) -> Column:
        found = [F.when(r.fires(), F.struct(F.lit(r.severity).alias("severity"), F.lit(r.code).alias("code"), r.detail().alias("detail"))) for r in self.rules.values()]
        return F.array_compact(F.array(*found))

    def violations(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.select(*keys, F.explode(self._codes()).alias("v")).select(*keys, "v.*")

    def firing_rates(self, rows: DataFrame) -> DataFrame:
        """(code, n, fired, rate) of every rule, those that never fire included."""
        counts = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(r.fires()).alias(c) for c, r in self.rules.items()])
        rows = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col("n"), F.col(c).alias("fired")) for c in self.rules]))
        return counts.select(rows.alias("r")).select("r.*").withColumn("rate", F.round(F.col("fired") / F.col("n"), 6))


def missing_words(needle: Column, hay: Column) -> Column:
    """Words of needle that hay lacks."""
    return F.array_except(word_list(needle), word_list(hay))


ENTRY_RULES = RuleSet(
    Rule("answer-differs", "E", lambda: letters(F.col("answer")) != letters(F.col("solution")), lambda: F.concat_ws(" / ", "answer", "solution")),
    Rule("answer-not-a-rearrangement", "W", lambda: letter_key(letters(F.col("answer"))) != letter_key(letters(F.col("solution")))),
    Rule("length-differs", "E", lambda: F.length(letters(F.col("solution"))) != F.col("n_cells")),
    Rule("definition-not-in-clue", "E", lambda: F.instr("clue", F.col("definition")) == 0),
    Rule("definition-words-not-in-clue", "W", lambda: F.size(missing_words(F.col("definition"), F.col("clue"))) > 0),
    Rule("indicator-not-in-clue", "E", lambda: F.exists("indicators", lambda i: F.instr(F.lower("clue"), F.lower(i)) == 0)),
    Rule("answer-in-clue", "E", lambda: (F.length(letters(F.col("answer"))) >= 4) & (F.instr(letters(F.col("clue")), letters(F.col("answer"))) > 0)),
    Rule("type-without-indicator", "W", lambda: F.col("clue_type").isNotNull() & (F.coalesce(F.size("indicators"), F.lit(0)) <= 0)),
    Rule("markup", "E", lambda: F.col("clue").rlike("<[a-zA-Z/]|&[a-z]+;")),
    Rule("no-enumeration", "W", lambda: F.regexp_extract("clue", r"\(([0-9][0-9, -]*)\)\s*$", 1) == ""),
)
