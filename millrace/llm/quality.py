"""Quality rules as a short-circuit cascade, ordered by rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD, let, words_of
from millrace.session import written

SYMBOLS = r"[#*$%&|<>]"
# Rows of the sample on which costs and selectivities are estimated. Only the order of the rules depends on it.
SAMPLE_ROWS = 500


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that a text has twice or more.

    Windows are compared by their 64-bit hash. Only texts with a repeat sort theirs.
    """
    windows = F.when(
        F.size(words) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(pos: Column) -> Column:
        reach = F.transform(pos, lambda p, i: F.least(F.lit(3), F.get(pos, i + 1) - p))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    def repeats(s: Column) -> Column:
        def same(i, j):
            return F.get(s, i)["h"] == F.get(s, j)["h"]

        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return F.sort_array(F.transform(twice, lambda i: F.get(s, i)["i"]))

    def count(w: Column) -> Column:
        by_hash = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        some = let(by_hash, lambda s: let(repeats(s), covered))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(some)

    return let(windows, count)


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(WORD))


# What a rule may measure of a text: each is a native expression of the text alone, 0 for null.
def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("bigint")


def word_chars(text: Column) -> Column:
    return F.length(F.array_join(words_of(text), "")).cast("bigint")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS)).cast("bigint")


def n_lines(text: Column) -> Column:
    return F.size(_lines(text)).cast("bigint")


def n_dup_lines(text: Column) -> Column:
    return let(_lines(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")


def n_repeat_words(text: Column) -> Column:
    return let(words_of(text), _repeated).cast("bigint")


def n_capitals(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Z]")).cast("bigint")


MEASURES = {f.__name__: f for f in (n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals)}


@dataclass(frozen=True)
class Rule:
    """Rejects a text when ``rejects`` of the ``measures`` named, each given as a column, holds."""

    name: str
    measures: tuple[str, ...]
    rejects: Callable[..., Column]

    def on(self, value: Callable[[str], Column]) -> Column:
        return F.coalesce(self.rejects(*map(value, self.measures)), F.lit(False))


# Production rules. The first two are the base; the others tell junk by symbols, repeated lines and capitals.
RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 50),
    Rule("repeats", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 50 * n),
    Rule("symbols", ("n_symbols", "word_chars"), lambda s, c: 10 * s > c),
    Rule("lines", ("n_dup_lines", "n_lines"), lambda d, n: 10 * d > 4 * n),
    Rule("capitals", ("n_capitals", "word_chars"), lambda u, c: 10 * u > 4 * c),
)


def cascade_order(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second on a sample of at most ``sample_rows`` rows, best first.

    Each rule is timed alone over the sample. Ties, and rules that reject nothing, go by their cost.
    """
    sample = written(docs.select(F.col(text).alias("_text")).limit(sample_rows), "rules")

    def timed(rejects: Column) -> tuple[float, int]:
        start = time.perf_counter()
        row = sample.agg(F.count_if(rejects).alias("n")).first()
        return time.perf_counter() - start, row["n"]

    idle, _ = timed(F.col("_text").isNull())
    found = []
    for rule in rules:
        seconds, rejected = timed(rule.on(lambda m: MEASURES[m](F.col("_text"))))
        cost = max(seconds - idle, 1e-4)
        found.append((-rejected / cost, cost, rule.name, rule))
    return [f[-1] for f in sorted(found, key=lambda f: f[:3])]


def quality_cascade(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    text: str = "text",
    report: bool = False,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``docs`` with ``kept`` and ``rejected_by``, the first rule of the learned order that rejects the row.

    A row meets the rules one after the other and leaves at the first rejection, so that a dear measure is taken
    of the rows alone that all rules before it let pass. With ``report`` all measures are taken of all rows,
    once, and come as columns; rules then read those. ``kept`` is the same for any order and sample;
    ``rejected_by`` depends on the order.

    A null text measures 0 everywhere, as an empty one, and is rejected by ``few_words``. Columns of ``docs`` keep
    their place; those named as an output are replaced. Rows are judged one by one: repeated rows and null ids are
    rows like any other; an empty table gives an empty one. No shuffle.
    """
    order = cascade_order(docs, rules, text, sample_rows)
    if report:
        docs = docs.withColumns({m: f(F.col(text)) for m, f in MEASURES.items()})

    def value(m: str) -> Column:
        return F.col(m) if report else MEASURES[m](F.col(text))

    verdict = F.lit(None).cast("string")
    for rule in reversed(order):
        verdict = F.when(rule.on(value), F.lit(rule.name)).otherwise(verdict)
    return docs.withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull())
