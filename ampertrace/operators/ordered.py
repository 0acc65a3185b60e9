"""Ordered operations on keys of any size.

A plain window over a device key puts the whole history of that device into one task. The operators
here cut each key's timeline into time slots, run the window inside a slot, and carry the state over
slot borders through a table with one row per (key, slot). A task never holds more than one slot of
one key, whatever share of the rows the key has; the border table is at most
``time span / slot length`` rows per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT_SECONDS = 3600
MICROS = 1_000_000


def group_key(*columns: str) -> Column:
    """One never-null text key for several nullable columns; NULL and '' stay different."""
    return F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])


def micros(ts: Column | str) -> Column:
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(MICROS))


def time_slot(ts: Column | str, seconds: int = SLOT_SECONDS) -> Column:
    return F.floor(micros(ts) / F.lit(seconds * MICROS))


def _slot_column(ts: str, slot: Column | None) -> Column:
    """Hour of the timestamp, or the given column: any non-decreasing function of the order."""
    return time_slot(ts) if slot is None else slot


def _windows(key: str, order: Sequence[str]):
    # the slot comes first: sorting by a number is much cheaper than by the text key
    inside = Window.partitionBy("_slot", key).orderBy(*order)
    across = Window.partitionBy(key).orderBy("_slot")
    return inside, across


def segment(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    context: dict[str, Column],
    starts: Callable[[Column, Column], Column],
    *,
    seq: str = "seq",
    slot: Column | None = None,
) -> DataFrame:
    """Number the runs of each key: a row opens a run when it is the first or ``starts(row, previous)``.

    Adds ``seq`` (1-based), ``is_start`` and ``prev`` (the previous row's context struct, NULL for the
    first row of a key). ``order[0]`` is the timestamp unless ``slot`` gives the slots.
    """
    inside, across = _windows(key, order)
    local = (
        df.withColumn("_slot", _slot_column(order[0], slot))
        .withColumn("_ctx", F.struct(*[c.alias(n) for n, c in context.items()]))
        .withColumn("_prev", F.lag("_ctx").over(inside))
        .withColumn(
            "_inner",
            F.when(F.col("_prev").isNull(), F.lit(0)).otherwise(
                F.coalesce(starts(F.col("_ctx"), F.col("_prev")), F.lit(False)).cast("int")
            ),
        )
        .withColumn("_local", F.sum("_inner").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    )
    position = F.struct(*order)
    borders = (
        local.groupBy("_slot", key)
        .agg(
            F.min_by("_ctx", position).alias("_first"),
            F.max_by("_ctx", position).alias("_last"),
            F.sum("_inner").alias("_inners"),
        )
        .withColumn("_before", F.lag("_last").over(across))
        .withColumn(
            "_head",
            F.when(F.col("_before").isNull(), F.lit(1)).otherwise(
                F.coalesce(starts(F.col("_first"), F.col("_before")), F.lit(False)).cast("int")
            ),
        )
        .withColumn(
            "_base",
            F.sum(F.col("_head") + F.col("_inners")).over(across.rowsBetween(Window.unboundedPreceding, 0))
            - F.col("_inners"),
        )
        .select(key, "_slot", "_before", "_head", "_base")
    )
    return (
        local.join(borders, ["_slot", key])
        .withColumn(seq, (F.col("_base") + F.col("_local")).cast("long"))
        .withColumn("is_start", F.when(F.col("_prev").isNull(), F.col("_head")).otherwise(F.col("_inner")) == 1)
        .withColumn("prev", F.coalesce("_prev", "_before"))
        .drop("_slot", "_ctx", "_prev", "_inner", "_local", "_before", "_head", "_base")
    )


def with_running(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    values: dict[str, tuple[str, Column]],
    *,
    include_current: bool = True,
    slot: Column | None = None,
) -> DataFrame:
    """Running ``sum`` / ``max`` / ``min`` of expressions over an unbounded key."""
    inside, across = _windows(key, order)
    frame = inside.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    apply = {"sum": F.sum, "max": F.max, "min": F.min}
    local = df.withColumn("_slot", _slot_column(order[0], slot))
    local = local.withColumns({f"_v_{n}": c for n, (_, c) in values.items()})
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    borders = (
        local.groupBy("_slot", key)
        .agg(*[apply[kind](f"_v_{n}").alias(f"_t_{n}") for n, (kind, _) in values.items()])
        .select(key, "_slot", *[apply[kind](f"_t_{n}").over(before).alias(f"_b_{n}") for n, (kind, _) in values.items()])
    )
    local = local.withColumns({f"_s_{n}": apply[kind](f"_v_{n}").over(frame) for n, (kind, _) in values.items()})

    def merge(n: str, kind: str) -> Column:
        here, earlier = F.col(f"_s_{n}"), F.col(f"_b_{n}")
        if kind == "sum":
            return F.coalesce(here + earlier, here, earlier)
        return (F.greatest if kind == "max" else F.least)(here, earlier)

    out = local.join(borders, ["_slot", key]).withColumns({n: merge(n, kind) for n, (kind, _) in values.items()})
    return out.drop("_slot", *[f"{p}{n}" for n in values for p in ("_v_", "_t_", "_b_", "_s_")])


def with_next(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    context: dict[str, Column],
    *,
    name: str = "next",
    slot: Column | None = None,
) -> DataFrame:
    """``lead`` of a struct of expressions over an unbounded key."""
    inside, across = _windows(key, order)
    local = (
        df.withColumn("_slot", _slot_column(order[0], slot))
        .withColumn("_ctx", F.struct(*[c.alias(n) for n, c in context.items()]))
        .withColumn("_next", F.lead("_ctx").over(inside))
    )
    borders = (
        local.groupBy("_slot", key)
        .agg(F.min_by("_ctx", F.struct(*order)).alias("_first"))
        .withColumn("_after", F.lead("_first").over(across))
        .select(key, "_slot", "_after")
    )
    return (
        local.join(borders, ["_slot", key])
        .withColumn(name, F.coalesce("_next", "_after"))
        .drop("_slot", "_ctx", "_next", "_after")
    )


def with_history(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    *,
    previous: dict[str, Column] | None = None,
    seen_before: dict[str, Column] | None = None,
    seen_upto: dict[str, Column] | None = None,
    slot: Column | None = None,
) -> DataFrame:
    """``lag`` struct ``prev`` and latest non-null values (before, or up to, the row) in one pass."""
    inside, across = _windows(key, order)
    position = F.struct(*order)
    seen = {**(seen_before or {}), **(seen_upto or {})}
    local = df.withColumn("_slot", _slot_column(order[0], slot)).withColumns({f"_v_{n}": c for n, c in seen.items()})
    aggregates = [
        F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), position)).alias(f"_l_{n}") for n in seen
    ]
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.last(f"_l_{n}", ignorenulls=True).over(earlier).alias(f"_b_{n}") for n in seen]
    if previous:
        local = local.withColumn("_ctx", F.struct(*[c.alias(n) for n, c in previous.items()]))
        aggregates.append(F.max_by("_ctx", position).alias("_last"))
        carried.append(F.lag("_last").over(across).alias("_before"))
    borders = local.groupBy("_slot", key).agg(*aggregates).select(key, "_slot", *carried)
    filled = {
        f"_s_{n}": F.last(f"_v_{n}", ignorenulls=True).over(
            inside.rowsBetween(Window.unboundedPreceding, 0 if n in (seen_upto or {}) else -1)
        )
        for n in seen
    }
    if previous:
        filled["_prev"] = F.lag("_ctx").over(inside)
    out = local.withColumns(filled).join(borders, ["_slot", key])
    final = {n: F.coalesce(f"_s_{n}", f"_b_{n}") for n in seen}
    if previous:
        final["prev"] = F.coalesce("_prev", "_before")
    out = out.withColumns(final)
    return out.drop(
        "_slot", "_ctx", "_prev", "_before", *[f"{p}{n}" for n in seen for p in ("_v_", "_b_", "_s_")]
    )


def attach_facts(df: DataFrame, facts: DataFrame, key: str, ts: str, slot: Column | None = None) -> DataFrame:
    """Join per-key facts to ordered rows through (key, slot), so that a huge key is not one join group."""
    slotted = df.withColumn("_slot", _slot_column(ts, slot))
    spread = slotted.select(key, "_slot").distinct().join(facts, key)
    return slotted.join(spread, ["_slot", key]).drop("_slot")
