"""Quality rules as a ledger of bits: evaluate once, decide many times.

``measure`` computes every measurement of a text and ``ledger`` every rule's
outcome as a bit. Policies are versioned sets of rules; applying one, or asking
what a policy would keep without one of its rules, needs the bits only. All of
it is built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
_GAP = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Rules in bit order: name and the condition that fails a text. A bit keeps its meaning; new rules go to the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "exclamations": "5 * n_exclamations > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "short_words": "2 * word_chars < 5 * n_words",
    "long_words": "word_chars > 12 * n_words",
}
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A named version: a text is rejected if any of the rules fails."""

    version: str
    rules: tuple[str, ...] = field(default=tuple(RULES))

    @property
    def mask(self) -> int:
        return sum(1 << bit for bit, rule in enumerate(RULES) if rule in self.rules)


POLICIES = (Policy("base", BASE), Policy("v1"))


def _all_but(array: str, first: int) -> Column:
    return F.slice(array, F.lit(first), F.greatest(F.size(array) - 1, F.lit(0)))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements per row: words, their code points, symbols, exclamation marks, lines, repeats.

    A null text has none of anything. Repeated rows, null ids and the order of
    rows do not matter; other columns are not read. ``n_repeat_words`` counts words
    in three-word windows that the text has more than once. Windows are compared
    by 64-bit hash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    base = docs.select(F.col(id_col), text.alias("text"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _GAP)).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    counted = base.select(
        id_col, "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.replace("text", F.lit("!")))).cast("long").alias("n_exclamations"),
        lines.alias("lines"),
    )
    windows = F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    counted = counted.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_exclamations",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    # Only texts that repeat a window need to know where.
    repeats = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    placed = counted.withColumn("sorted", repeats).drop("windows")
    twice = F.filter(
        "sorted", lambda w, i: w["h"].eqNullSafe(F.get("sorted", i - 1)["h"]) | w["h"].eqNullSafe(F.get("sorted", i + 1)["h"])
    )
    found = placed.withColumn("at", F.sort_array(F.transform(twice, lambda w: w["i"]))).drop("sorted")
    gaps = F.zip_with(_all_but("at", 1), _all_but("at", 2), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap) + F.when(F.size("at") > 0, 3).otherwise(0)
    return found.withColumn("n_repeat_words", F.coalesce(F.when(F.col("at").isNotNull(), covered), F.lit(0)).cast("long")).drop("at")


def ledger(measured: DataFrame) -> DataFrame:
    """``measured`` with ``failed_bits``: bit i says that rule i fails."""
    bits = [F.expr(condition).cast("long") * (1 << bit) for bit, condition in enumerate(RULES.values())]
    return measured.withColumn("failed_bits", sum(bits[1:], bits[0]))


def passes(policy: Policy, bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def decide(ledger_rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """One verdict column ``kept_<version>`` per policy."""
    return ledger_rows.withColumns({f"kept_{p.version}": passes(p) for p in policies})


def ablate(ledger_rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """What each rule does in each policy, from counts of bit patterns.

    ``(version, rule, n_failed, n_only, n_kept, n_kept_without)``: texts that fail the
    rule, fail this rule alone, are kept, and would be kept without the rule.
    There are at most as many patterns as sets of rules.
    """
    patterns = ledger_rows.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    grid = [
        F.struct(F.lit(p.version).alias("version"), F.lit(rule).alias("rule"), F.lit(p.mask).cast("long").alias("mask"), F.lit(1 << bit).cast("long").alias("bit"))
        for p in policies
        for bit, rule in enumerate(RULES)
        if rule in p.rules
    ]
    inside = F.col("failed_bits").bitwiseAND(F.col("x.mask"))
    rest = inside.bitwiseAND(F.bitwise_not(F.col("x.bit")))

    def of(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return (
        patterns.withColumn("x", F.explode(F.array(*grid)))
        .groupBy(F.col("x.version").alias("version"), F.col("x.rule").alias("rule"))
        .agg(
            of(inside.bitwiseAND(F.col("x.bit")) != 0).alias("n_failed"),
            of(inside == F.col("x.bit")).alias("n_only"),
            of(inside == 0).alias("n_kept"),
            of(rest == 0).alias("n_kept_without"),
        )
    )
