"""Quality rules as a short-circuit cascade.

Every rule is a condition on measures of the text that rejects a document. A bounded sample shows what each rule costs a row and
which documents it rejects. The first rule is the one with most rejections per second, the next the one with most
rejections per second among the documents that the first lets pass, and so on. A document that one rule rejects
is not shown to the next (the branches of ``CASE WHEN`` are computed only as far as needed). The order decides what is
spent, never which documents stay. Where all measures are asked for anyway, the rules look at those and nothing is measured twice.

Defined results: a null or empty text has no words and is rejected (``too_short``). Repeated rows are judged one by
one. A table without rows gives a table without rows; its rules keep the order in which they are listed.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampertrace.llm.arrays import SPACE, column, let, whole, words_of
from ampertrace.session import cut_lineage

SYMBOLS = "#*$%&|<>"
#: rows of the sample on which costs and rejections are estimated; it decides the order of the rules only
SAMPLE_ROWS = 8000


def count_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def count_word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, "")).cast("long")


def count_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def count_capitals(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long")


def count_repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def count_repeated_words(text: Column, n: int = 3) -> Column:
    """Words that lie in an ``n``-word window found twice or more in the text.

    The windows' hashes are sorted with their places, so equal windows are neighbours; the covered words are the
    gaps between the places of such windows, ``n`` at most each.
    """

    def windows(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - n)
        return F.transform(places, lambda i: F.struct(F.xxhash64(*[w[i + k] for k in range(n)]).alias("h"), i.alias("i")))

    def repeated(s: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            before = F.when(k > 0, s[k - 1]["h"])
            return (F.coalesce(x["h"] == before, F.lit(False))) | (F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)))

        return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda i, k: F.coalesce(F.least(F.get(p, k + 1) - i, F.lit(n)), F.lit(n))), F.lit(0), lambda a, x: a + x
        )

    counted = let(words_of(text), lambda w: F.when(
        F.size(w) >= n, let(F.sort_array(windows(w)), lambda s: let(repeated(s), covered))).otherwise(0))
    return counted.cast("long")


def count_lines(text: Column) -> Column:
    return F.size(F.split(text, "\n")).cast("long")


MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": count_words, "word_chars": count_word_chars, "n_symbols": count_symbols, "n_capitals": count_capitals,
    "n_lines": count_lines, "n_dup_lines": count_repeated_lines, "n_repeat_words": count_repeated_words,
}
Measure = Callable[[str], Column]


def of_text(text: Column) -> Measure:
    """Measures computed from the text where a rule asks for them."""
    return lambda name: MEASURES[name](text)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measure], Column]


#: the thresholds compare whole numbers, so that no rounding decides
RULES: tuple[Rule, ...] = (
    Rule("too_short", lambda m: m("n_words") < 50),
    Rule("repetitive", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    Rule("symbols", lambda m: 10 * m("n_symbols") > 3 * m("n_words")),
    Rule("shouting", lambda m: 10 * m("n_capitals") > 4 * m("word_chars")),
    Rule("long_words", lambda m: m("word_chars") > 15 * m("n_words")),
    Rule("same_lines", lambda m: 10 * m("n_dup_lines") > 5 * m("n_lines")),
)


@dataclass(frozen=True)
class Sample:
    """``seconds`` of each rule a row, and how many rows each set of rules rejects (bit k: rule k)."""

    seconds: tuple[float, ...]
    rejected: dict[int, int]


def estimate(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> Sample:
    """What rules cost and reject on a sample of ``sample_rows`` rows at most, spread by a hash of the text.

    Each rule reads the same written sample by itself, and so does a condition that costs nothing: what its job takes, as every job
    does, is no rule's cost.
    """
    drawn = docs.select(whole(column(docs, text)).alias("_t")).filter(F.pmod(F.xxhash64("_t"), F.lit(8)) == 0).limit(sample_rows)
    sample = cut_lineage(drawn)
    bits = sum((F.when(r.rejects(of_text(F.col("_t"))), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(rules)), F.lit(0))
    rejected = {r["bits"]: r["n"] for r in sample.groupBy(bits.alias("bits")).agg(F.count("*").alias("n")).collect()}
    rows = max(1, sum(rejected.values()))

    def seconds(condition: Column) -> float:
        started = time.perf_counter()
        sample.agg(F.count_if(condition)).first()
        return time.perf_counter() - started

    nothing = min(seconds(F.length("_t") < 0) for _ in range(2))
    return Sample(tuple(max(0.0, seconds(r.rejects(of_text(F.col("_t")))) - nothing) / rows for r in rules), rejected)


def ordered(rules: Sequence[Rule], sample: Sample) -> list[Rule]:
    """Greedy by rejections per second among the rows that are left; rules that reject nothing more come last, cheap ones first."""
    left, order, passed = list(range(len(rules))), [], 0
    while left:
        gain = lambda k: sum(n for bits, n in sample.rejected.items() if bits >> k & 1 and not bits & passed)  # noqa: B023, E731
        best = max(left, key=lambda k: (gain(k) / max(sample.seconds[k], 1e-9), -sample.seconds[k], -k))
        left.remove(best)
        order.append(rules[best])
        passed |= 1 << best
    return order


def verdict(measure: Measure, rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects, null where none does."""
    cascade = F.when(rules[0].rejects(measure), rules[0].name)
    for rule in rules[1:]:
        cascade = cascade.when(rule.rejects(measure), rule.name)
    return cascade


def plan(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> list[Rule]:
    return ordered(rules, estimate(docs, text, rules))


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that no rule rejects, all columns as they were."""
    return docs.filter(verdict(of_text(whole(column(docs, text))), plan(docs, text, rules)).isNull())


def judge(docs: DataFrame, id_: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Measures and verdict of each document, rejected ones too. All measures are columns here, so the cascade compares numbers only."""
    order = plan(docs, text, rules)
    slim = docs.select(column(docs, id_).alias("doc_id"), whole(column(docs, text)).alias("_t"))
    counts = slim.select("doc_id", *[count(F.col("_t")).alias(name) for name, count in MEASURES.items()])
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        (verdict(F.col, order).isNull() & ~base_failed).alias("kept"),
    )
