"""Status intervals, metric transitions, interruptions, alert segments and merged problem spans.

Input of the event operators is the output of ``sessionize_context``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampertrace.operators.context_sessions import METRICS
from ampertrace.operators.ordered import (
    attach_facts, group_key, micros, seconds_between, segment, with_history, with_next, with_running,
)
from ampertrace.operators.sessions import ORDER
from ampertrace.session import cut_lineage

# Change thresholds per metric, and the level below which a rise is only start-up.
ABSOLUTE_WARNING = {"eff": 5.0, "rx": 0.4, "tx": 0.4, "rpp": 0.2, "current_a": 0.03, "voltage_v": 0.15}
ABSOLUTE_ALARM = {"eff": 12.0, "rx": 0.8, "tx": 0.8, "rpp": 0.4, "current_a": 0.08, "voltage_v": 0.35}
RELATIVE_WARNING = 0.10
RELATIVE_ALARM = 0.20
START_UP_LEVEL = {"rx": 2.5, "tx": 2.5, "rpp": 0.3, "current_a": 0.08, "voltage_v": 3.5}
WARM_UP_SECONDS = 180
ALERT_THRESHOLD = 0.20
ALERT_METRICS = ("rx", "tx", "rpp", "current_a", "voltage_v")
MERGE_GAP_SECONDS = 90.0
FULL = "2"


def completion_facts(events: DataFrame) -> DataFrame:
    """Per session: median gap, interruption limit, time of charge completion, whether all statuses are final."""
    gap = seconds_between(F.col("event_ts"), F.col("prev.event_ts"))
    real = F.col("status") != "N/A"
    final = F.col("status") == FULL
    facts = events.groupBy("session_key").agg(
        F.max("event_ts").alias("session_end"),
        F.count("*").alias("session_rows"),
        F.percentile(F.when(gap > 0, gap), 0.5).alias("median_gap"),
        F.min(F.when(final & (F.col("prev_status") != FULL), F.col("event_ts"))).alias("completed_ts"),
        F.min(F.when(final, F.col("event_ts"))).alias("_first_final"),
        F.max(real & ~final).alias("_other"),
    )
    only_final = F.col("_first_final").isNotNull() & ~F.col("_other")
    return facts.withColumns(
        {
            "only_final": only_final,
            "interruption_limit": F.greatest(F.lit(300.0), F.coalesce("median_gap", F.lit(60.0)) * 4.0),
            "completion_ts": F.coalesce("completed_ts", F.when(only_final, F.col("_first_final"))),
        }
    ).drop("_first_final", "_other")


def with_metric_rows(events: DataFrame) -> DataFrame:
    """Adds the session facts and ``is_metric``: rows before charge completion."""
    rows = attach_facts(events, completion_facts(events), "session_key", "event_ts")
    before = F.when(F.col("completed_ts").isNotNull(), F.col("event_ts") < F.col("completed_ts")).otherwise(
        ~F.col("only_final")
    )
    return cut_lineage(rows.withColumn("is_metric", before))


def metric_rows(events: DataFrame) -> DataFrame:
    return with_metric_rows(events).filter("is_metric")


def _is_start_up(metric: str, before: Column, after: Column) -> Column:
    early = seconds_between(F.col("event_ts"), F.col("session_start")) <= WARM_UP_SECONDS
    if metric in START_UP_LEVEL:
        early = early | (before <= START_UP_LEVEL[metric])
    return (after > before) & early


def transition_severity(metric: str) -> Column:
    """``warning``, ``alarm`` or NULL for the step from the previous metric row to this one."""
    before, after = F.col(f"prev.{metric}"), F.col(metric)
    step = F.abs(after - before)
    share = step / F.when(F.abs(before) >= 1e-9, F.abs(before))
    alarm = (share >= RELATIVE_ALARM) | (step >= ABSOLUTE_ALARM[metric])
    counts = (share >= RELATIVE_WARNING) | (step >= ABSOLUTE_WARNING[metric])
    return F.when(
        F.col("is_metric") & share.isNotNull() & counts & ~_is_start_up(metric, before, after),
        F.when(alarm, F.lit("alarm")).otherwise(F.lit("warning")),
    )


def transition_events(rows: DataFrame) -> DataFrame:
    """One row per spike or drop; input from ``with_metric_rows``. Only hits are expanded."""
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    transition_severity(m).isNotNull(),
                    F.struct(
                        F.lit(m).alias("metric"),
                        F.when(F.col(m) > F.col(f"prev.{m}"), F.lit("spike")).otherwise(F.lit("drop")).alias("event_type"),
                        transition_severity(m).alias("severity"),
                        F.col(f"prev.{m}").alias("before"),
                        F.col(m).alias("after"),
                    ),
                )
                for m in METRICS
            ]
        )
    )
    return rows.select(
        "session_key", "raw_id", F.col("prev.event_ts").alias("start_ts"), F.col("event_ts").alias("end_ts"),
        F.explode(hits).alias("_e"),
    ).select("session_key", "raw_id", "start_ts", "end_ts", "_e.*")


def interruption_severity() -> Column:
    gap = seconds_between(F.col("event_ts"), F.col("prev.event_ts"))
    alarm = gap >= F.greatest(F.col("interruption_limit") * 2.0, F.lit(1200.0))
    return F.when(gap > F.col("interruption_limit"), F.when(alarm, F.lit("alarm")).otherwise(F.lit("warning")))


def interruption_events(rows: DataFrame) -> DataFrame:
    return rows.withColumn("severity", interruption_severity()).filter(F.col("severity").isNotNull()).select(
        "session_key", "raw_id", F.col("prev.event_ts").alias("start_ts"), F.col("event_ts").alias("end_ts"), "severity",
        seconds_between(F.col("event_ts"), F.col("prev.event_ts")).alias("gap_seconds"),
    )


def _falls(before: Column, after: Column) -> Column:
    level, step = F.abs(before), before - after
    share = step / F.when(level >= 1e-9, level)
    return (after < before) & F.when(level < 1e-9, step > 1e-9).otherwise(share > ALERT_THRESHOLD)


def alert_segments(events: DataFrame) -> DataFrame:
    """Falling steps of more than 20 % between consecutive *known* values of a metric in a session."""
    place = F.struct(*ORDER)
    rows = with_history(
        events,
        "session_key",
        ORDER,
        seen_before={
            f"_k_{m}": F.when(F.col(m).isNotNull(), F.struct(F.col(m).alias("value"), place.alias("place")))
            for m in ALERT_METRICS
        },
    )
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    _falls(F.col(f"_k_{m}.value"), F.col(m)),
                    F.struct(
                        F.lit(m).alias("metric"), F.col(f"_k_{m}.place.event_ts").alias("start_ts"),
                        F.col("event_ts").alias("end_ts"), F.col(f"_k_{m}.value").alias("before"), F.col(m).alias("after"),
                    ),
                )
                for m in ALERT_METRICS
            ]
        )
    )
    return rows.select("session_key", "raw_id", F.explode(hits).alias("_e")).select("session_key", "raw_id", "_e.*")


def status_intervals(events: DataFrame) -> DataFrame:
    """Runs of equal status per session; a run ends where the next one starts."""
    runs = segment(
        events.select("session_key", *ORDER, "status"),
        "session_key",
        ORDER,
        {"status": F.col("status"), "event_ts": F.col("event_ts")},
        lambda row, previous: row["status"] != previous["status"],
        seq="run",
    )
    pieces = cut_lineage(
        runs.groupBy("session_key", "run").agg(
            F.min("status").alias("status"), F.min("event_ts").alias("start_time"), F.count("*").alias("sample_count")
        )
    )
    ends = completion_facts(events).select(
        "session_key", F.col("session_end").alias("_last_ts"), F.col("median_gap").alias("_gap")
    )
    linked = with_next(pieces, "session_key", ("start_time", "run"), {"start_time": F.col("start_time")})
    linked = attach_facts(linked, ends, "session_key", "start_time")
    tail = F.greatest(F.coalesce("_gap", F.lit(60.0)), F.lit(1.0))
    last_end = F.timestamp_micros((micros("_last_ts") + F.round(tail * 1_000_000)).cast("long")).cast("timestamp_ntz")
    end = F.coalesce(F.col("next.start_time"), last_end)
    return linked.withColumn("end_time", end).select(
        "session_key", "run", "status", "start_time", "end_time", "sample_count",
        F.greatest(seconds_between(F.col("end_time"), F.col("start_time")), F.lit(0.0)).alias("duration_seconds"),
    )


def status_asof(samples: DataFrame) -> DataFrame:
    """Latest real status of the session at or before each row, as ``status_at``."""
    return with_history(
        samples, "session_key", ORDER, seen_upto={"status_at": F.when(F.col("status") != "N/A", F.col("status"))}
    )


def occurrence_ranges(events: DataFrame, gap_seconds: int = 1200) -> DataFrame:
    """Ranges in which a status occurs at one phone, project and position without a gap over 20 minutes."""
    keys = ("phone", "project_number", "position", "status")
    rows = events.filter(F.col("event_ts").isNotNull()).withColumn("_group", group_key(*keys))
    cut = segment(
        rows, "_group", ORDER, {"event_ts": F.col("event_ts")},
        lambda row, previous: seconds_between(row["event_ts"], previous["event_ts"]) > gap_seconds, seq="_range",
    )
    return (
        cut.groupBy(*keys, "_range")
        .agg(F.min("event_ts").alias("start_ts"), F.max("event_ts").alias("end_ts"), F.count("*").alias("row_count"))
        .drop("_range")
    )


def merge_spans(annotations: DataFrame) -> DataFrame:
    """Merge spans of a session when the gap to the spans before is at most max(90 s, 2 x median gap).

    Input: session_key, start_time, end_time, severity, median_gap. A span is critical for severities
    alarm and deviation. Spans are first made unique per (session, start, end).
    """
    critical = F.col("severity").isin("alarm", "deviation")
    spans = (
        annotations.filter(F.col("start_time").isNotNull() & F.col("end_time").isNotNull())
        .groupBy("session_key", "start_time", "end_time")
        .agg(F.max(critical).alias("_critical"), F.count("*").alias("_n"), F.max("median_gap").alias("_gap"))
    )
    spans = cut_lineage(spans)
    order = ("start_time", "end_time")
    reached = with_running(
        spans, "session_key", order, {"_reached": ("max", F.col("end_time"))}, include_current=False
    )
    limit = F.greatest(F.lit(MERGE_GAP_SECONDS), F.coalesce("_gap", F.lit(60.0)) * 2.0)
    opens = F.col("_reached").isNull() | (seconds_between(F.col("start_time"), F.col("_reached")) > limit)
    numbered = with_running(
        reached.withColumn("_opens", opens.cast("int")), "session_key", order, {"span": ("sum", F.col("_opens"))}
    )
    return numbered.groupBy("session_key", "span").agg(
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.when(F.max("_critical"), F.lit("alarm")).otherwise(F.lit("warning")).alias("severity"),
        F.sum("_n").alias("annotation_count"),
    )
