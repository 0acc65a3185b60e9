"""Cutting events into sessions and rolling sessions up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampertrace.functions.text import blank_to_null
from ampertrace.operators.ordered import group_key, seconds_between, segment
from ampertrace.session import spread

DEVICE_KEYS = ("phone", "project_number", "device_name", "charger_name", "position")
SESSION_BREAK_SECONDS = 20 * 60
SHORT_BREAK_SECONDS = 15 * 60
ORDER = ("event_ts", "raw_id")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def sessionize_sql(events: DataFrame, gap_seconds: int = SESSION_BREAK_SECONDS) -> DataFrame:
    """Sessions that also end when software, sample, scenario, card, object or dual flag changes.

    Adds ``session_seq`` and the previous row's time and power values *within the session*.
    """
    hint = F.lower(F.coalesce(blank_to_null(F.col("scenario_hint")), F.lit("")))
    context = {
        "software": _text("software_version"),
        "sample": _text("sample_label"),
        "scenario": hint,
        "card": _text("card_position"),
        "object": _text("fod_object"),
        "dual": _text("dual_charging_flag"),
    }
    carried = {name: F.col(name) for name in ("event_ts", "eff", "rx", "tx")}

    def starts(row: Column, previous: Column) -> Column:
        changed = seconds_between(row["event_ts"], previous["event_ts"]) > gap_seconds
        for name in context:
            changed = changed | (row[name] != previous[name])
        return changed

    cut = segment(
        spread(events.filter(F.col("event_ts").isNotNull())).withColumn("_device", group_key(*DEVICE_KEYS)),
        "_device",
        ORDER,
        {**context, **carried},
        starts,
        seq="session_seq",
    )
    inside = ~F.col("is_start")
    return cut.withColumns(
        {
            "session_prev_eff": F.when(inside, F.col("prev.eff")),
            "session_prev_rx": F.when(inside, F.col("prev.rx")),
            "session_prev_tx": F.when(inside, F.col("prev.tx")),
            "gap_seconds": F.when(inside, seconds_between(F.col("event_ts"), F.col("prev.event_ts"))),
        }
    ).drop("prev", "is_start", "_device")


def sessionize_gap(events: DataFrame, keys: Sequence[str], gap_seconds: int = SHORT_BREAK_SECONDS) -> DataFrame:
    """Sessions cut by time gaps only. Adds ``session_seq``."""
    cut = segment(
        events.filter(F.col("event_ts").isNotNull()).withColumn("_group", group_key(*keys)),
        "_group",
        ORDER,
        {"event_ts": F.col("event_ts")},
        lambda row, previous: seconds_between(row["event_ts"], previous["event_ts"]) > gap_seconds,
        seq="session_seq",
    )
    return cut.drop("prev", "is_start", "_group")


def session_key(keys: Sequence[str], seq: str) -> Column:
    return F.md5(F.concat_ws("|", *[_text(k) for k in keys], F.col(seq).cast("string")))


def drop_flag(previous: Column, value: Column, minimum: float, relative: float) -> Column:
    fall = previous - value
    enough = (fall >= minimum) if minimum > 0 else (fall > 0)
    return (previous > 0) & enough & (fall / F.when(previous > 0, previous) >= relative)


def session_rollup(events: DataFrame) -> DataFrame:
    """One row per session of ``sessionize_sql`` output.

    Gaps longer than 300 s inside a session are kept as a list: their number is bounded by the time
    span of the session, not by its rows, so the interruption count needs no second pass.
    """
    status_place = F.when(blank_to_null(F.col("hmi_status")).isNotNull(), F.struct(*ORDER))
    last_text = (
        "software_version", "source_csv_file", "scenario_hint", "fod_object", "card_position", "sample_label",
        "manual_result", "defect_id", "defect_comment", "dual_charging_label",
    )
    gap = F.col("gap_seconds")
    rolled = events.groupBy(*DEVICE_KEYS, "session_seq").agg(
        F.count("*").cast("int").alias("source_row_count"),
        *[F.max(c).alias(c) for c in last_text],
        F.min("event_ts").alias("start_ts"),
        F.max("event_ts").alias("end_ts"),
        F.avg("eff").alias("avg_eff"),
        F.avg("rx").alias("avg_rx"),
        F.avg("tx").alias("avg_tx"),
        F.max("temperature").alias("max_temperature"),
        F.array_sort(F.collect_set("hmi_status")).alias("status_codes"),
        F.min_by("hmi_status", status_place).alias("first_status"),
        F.max_by("hmi_status", status_place).alias("last_status"),
        F.percentile(F.when(gap > 0, gap), 0.5).alias("median_gap_seconds"),
        F.collect_list(F.when(gap > 300, gap)).alias("_long_gaps"),
        F.count_if(drop_flag(F.col("session_prev_eff"), F.col("eff"), 15.0, 0.25)).cast("int").alias("eff_drop_count"),
        F.count_if(drop_flag(F.col("session_prev_rx"), F.col("rx"), 0.0, 0.20)).cast("int").alias("rx_drop_count"),
        F.count_if(drop_flag(F.col("session_prev_tx"), F.col("tx"), 0.0, 0.20)).cast("int").alias("tx_drop_count"),
    )
    limit = F.greatest(F.lit(300.0), F.coalesce(F.col("median_gap_seconds"), F.lit(60.0)) * 4.0)
    return (
        rolled.withColumn("_limit", limit)
        .withColumn(
            "interruption_count",
            F.size(F.filter("_long_gaps", lambda g: g > F.col("_limit"))).cast("int"),
        )
        .withColumn("session_key", session_key(DEVICE_KEYS, "session_seq"))
        .drop("_long_gaps", "_limit")
    )


def build_sessions(processed: DataFrame) -> DataFrame:
    return session_rollup(sessionize_sql(processed))
