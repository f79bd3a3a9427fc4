"""Quality rules: a table of thresholds compiled into one projection, without user functions.

``measure`` gives the counts of a text, ``judge`` the verdict; both are plain column expressions, so the rules run
inside the scan's stage, row by row, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreweave.llm.common import filled, let, words

#: Symbols counted by the base rules, and common words of four languages.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the", "of", "and", "to", "in", "that", "is", "was", "for", "with", "on", "it", "as", "at", "by", "this",
    "le", "la", "les", "de", "des", "du", "et", "en", "que", "qui", "un", "une", "pour", "dans", "par", "sur",
    "der", "die", "das", "und", "ein", "eine", "von", "mit", "ist", "auf", "zu", "nicht", "den", "sich",
    "el", "los", "las", "y", "es", "por", "con", "para", "del", "se", "una", "su",
)


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high``; a bound that is None is open."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The default threshold table. Ratios are shares of words or lines, lengths are in code points.
RULES = (
    Rule("word_length", 2.0, 14.0),
    Rule("symbol_ratio", high=0.1),
    Rule("stop_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.5),
    Rule("capital_ratio", high=0.5),
    Rule("ellipsis_line_ratio", high=0.3),
    Rule("bullet_line_ratio", high=0.9),
)


def repeated_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the array ``w``; the first one counts too."""

    def window(x: Column, i: Column) -> Column:
        return F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))

    def twice(s: Column) -> Column:
        same = lambda x, k: x["g"].eqNullSafe(F.get(s, k)["g"])
        hits = F.filter(s, lambda x, k: same(x, k + 1) | ((k > 0) & same(x, k - 1)))
        return let(F.array_sort(F.transform(hits, lambda x: x["i"])), covered)

    def covered(p: Column) -> Column:
        gain = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(gain, F.lit(0), lambda a, x: a + x)

    windows = F.sort_array(F.transform(F.slice(w, 1, F.size(w) - 2), window))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows, twice)).cast("long")


def measure(text: str | Column = "text") -> Column:
    """A struct of counts and ratios of one text. A null text has no words; ratios of nothing are 0."""
    t = filled(text)

    def of(w: Column, lines: Column) -> Column:
        n = F.size(w)
        share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
        n_chars = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
        n_symbols = F.length(t) - F.length(F.translate(t, SYMBOLS, ""))
        n_lines, n_dup = F.size(lines), F.size(lines) - F.size(F.array_distinct(lines))
        n_stop = F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS)))
        n_capital = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))
        n_ellipsis = F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…")))
        n_bullet = F.size(F.filter(lines, lambda x: F.substring(x, 1, 2).isin("- ", "* ", "• ")))
        return F.struct(
            n.cast("long").alias("n_words"),
            n_chars.cast("long").alias("word_chars"),
            n_symbols.cast("long").alias("n_symbols"),
            n_dup.cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            share(n_chars, n).alias("word_length"),
            share(n_symbols, n).alias("symbol_ratio"),
            share(n_stop, n).alias("stop_ratio"),
            share(n_dup, n_lines).alias("dup_line_ratio"),
            share(n_capital, n_chars).alias("capital_ratio"),
            share(n_ellipsis, n_lines).alias("ellipsis_line_ratio"),
            share(n_bullet, n_lines).alias("bullet_line_ratio"),
        )

    parts = F.struct(
        words(t).alias("w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    return let(parts, lambda p: of(p["w"], p["lines"]))


def judge(m: Column, rules: Sequence[Rule] = RULES) -> Column:
    """True where every rule of the table holds for the measures ``m``."""
    holds = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            holds = holds & (m[rule.metric] >= F.lit(float(rule.low)))
        if rule.high is not None:
            holds = holds & (m[rule.metric] <= F.lit(float(rule.high)))
    return holds


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Add ``quality``: counts and ratios, ``base_failed`` and ``kept``.

    ``base_failed``: under 50 words, or more than half of the words stand in repeated three-word windows. ``kept``:
    not that, and every rule of the table holds. Null and empty texts fail; repeated rows and null ids are judged
    each for itself; an empty table stays empty. An input column named ``quality`` is replaced.
    """

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        kept = ~failed & judge(m, rules)
        return m.withField("base_failed", failed).withField("kept", kept)

    return docs.withColumn("quality", let(measure(text), verdict))
