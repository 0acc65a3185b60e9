"""Column helpers for work inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: words are runs of anything but these characters
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often the body or its lambdas name it."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def whole(text: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them where the table already has such columns."""
    taken = {c.lower() for c in df.columns}
    free = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        free.append(name)
    return free


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots included."""
    return df[f"`{name}`"]


#: elements that are folded one by one; ``running`` folds blocks of so many, then the blocks
FOLDED = 256


def running(values: Column, zero: Column, both: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array the fold of those before it, by an associative ``both`` with the neutral element ``zero``.

    An array that grows by one element a step is copied each time. So blocks of ``FOLDED`` elements are folded by themselves, and then their
    totals: even very many elements are copied a few hundred times at most, not once for each other.
    """

    def folded(array: Column) -> Column:
        start = F.struct(zero.alias("all"), F.slice(F.array(zero), 1, 0).alias("before"))
        return F.aggregate(
            array, start, lambda acc, x: F.struct(both(acc["all"], x).alias("all"), F.array_append(acc["before"], acc["all"]).alias("before"))
        )

    def blocks_of(array: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(array) + 1, F.lit(FOLDED)), lambda i: i <= F.size(array))
        return F.transform(starts, lambda i: folded(F.slice(array, i, FOLDED)))

    def whole_array(parts: Column) -> Column:
        offsets = folded(F.transform(parts, lambda p: p["all"]))["before"]
        return let(offsets, lambda o: F.flatten(F.transform(parts, lambda p, i: F.transform(p["before"], lambda x: both(o[i], x)))))

    return let(values, lambda v: let(blocks_of(v), whole_array))
