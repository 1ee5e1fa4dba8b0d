"""Quality rules: a threshold table compiled into one Spark projection.

All metrics come from one expression of built-in functions over the text; the
table of rules becomes one boolean. No Python runs on the executors and nothing
is shuffled.

Defined cases: a null text has no words and fails min_words, as an empty one
does. Texts of any length are read whole (a text's words and its 3-word windows
are held in one task, as the text itself is). Repeated rows are judged one by one, and a
ratio that equals its threshold passes. An empty table gives no rows. Other columns pass through
untouched; metric columns replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that it for was on are as with be at this have from or by an a "
    "le la les de des et un une du en est que qui dans pour pas sur au il "
    "der die das und ist nicht ein eine zu von den mit sich auf dem für "
    "el los las y una por con para como más se su lo al del"
).split()

_SPACE = " \t\n\u000b\u000c\r"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """metric must be at least ``low`` and at most ``high`` (None: no bound)."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None

    def passes(self, metrics: dict[str, Column]) -> Column:
        value = metrics[self.metric]
        checks = [value >= F.lit(self.low)] * (self.low is not None) + [value <= F.lit(self.high)] * (self.high is not None)
        return reduce(and_, checks, F.lit(True))


#: The base rules: length and repetition.
BASE_RULES = (
    Rule("min_words", "n_words", low=50),
    Rule("repeated_windows", "repeat_ratio", high=0.5),
)
#: The method's rules on top. They are wide: ordinary prose in any language passes.
METHOD_RULES = (
    Rule("mean_word_length", "mean_word_chars", low=1.5, high=20.0),
    Rule("symbol_ratio", "symbol_ratio", high=0.1),
    Rule("stop_words", "stop_ratio", low=0.005),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text that is not null."""
    return F.array_remove(F.split(F.translate(text, _SPACE[1:], " " * 5), " "), "")


def _repeat_words(words: Column, n: int = 3) -> Column:
    """Words in n-word windows that occur twice or more, by sorting (hash, position) pairs."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - n),
        lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(n)]).alias("h"), i.alias("i")),
    )
    again = _let(
        F.sort_array(windows),
        lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])), lambda x: x["i"])),
    )
    covered = _let(
        again,
        lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - x, F.lit(n)))), F.lit(0).cast("long"), lambda a, x: a + x),
    )
    return F.when(F.size(words) < n, F.lit(0).cast("long")).otherwise(covered)


def _measures(text: Column) -> Column:
    """A struct of integer measures of the text."""

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, _SPACE, "")) > 0)
        chars = F.length(F.translate(t, _SPACE, ""))
        return _let(
            words_of(t),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                chars.cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
                _let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("all"))).alias("lines"),
                _repeat_words(w).alias("n_repeat_words"),
                F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            ),
        )

    return _let(F.coalesce(text, F.lit("")), of)


def _ratios(m: Column) -> dict[str, Column]:
    words = F.greatest(m["n_words"], F.lit(1))
    return {
        "n_words": m["n_words"],
        "mean_word_chars": m["word_chars"] / words,
        "symbol_ratio": m["n_symbols"] / words,
        "stop_ratio": m["n_stop_words"] / words,
        "dup_line_ratio": m["lines"]["dup"] / F.greatest(m["lines"]["all"], F.lit(1)),
        "repeat_ratio": m["n_repeat_words"] / words,
    }


def compile_rules(rules: tuple[Rule, ...], measures: Column) -> Column:
    """One boolean: every rule passes."""
    metrics = _ratios(measures)
    return reduce(and_, [r.passes(metrics) for r in rules], F.lit(True))


def measure(df: DataFrame, text: str = "text", base=BASE_RULES, rules=METHOD_RULES) -> DataFrame:
    """df with the measures, ``base_failed`` and ``kept``."""
    everything = _let(
        _measures(F.col(text)),
        lambda m: F.struct(
            m["n_words"].alias("n_words"),
            m["word_chars"].alias("word_chars"),
            m["n_symbols"].alias("n_symbols"),
            m["lines"]["dup"].alias("n_dup_lines"),
            m["n_repeat_words"].alias("n_repeat_words"),
            m["n_stop_words"].alias("n_stop_words"),
            (~compile_rules(base, m)).alias("base_failed"),
            compile_rules((*base, *rules), m).alias("kept"),
        ),
    )
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "base_failed", "kept"]
    taken = "__quality"
    while taken in df.columns:
        taken += "_"
    whole = df.withColumn(taken, everything)
    return whole.withColumns({n: F.col(taken)[n] for n in names}).drop(taken)


def keep_good(df: DataFrame, text: str = "text", base=BASE_RULES, rules=METHOD_RULES) -> DataFrame:
    """Rows that pass every rule, with their columns as they were."""
    return df.where(_let(_measures(F.col(text)), lambda m: compile_rules((*base, *rules), m)))
