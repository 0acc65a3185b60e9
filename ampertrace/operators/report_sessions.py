"""Report sessions: one row per context session with trimmed metrics, dominant texts and text evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampertrace.functions.payload import boolish
from ampertrace.functions.text import blank_to_null, clean_text, strip
from ampertrace.operators.context_sessions import METRICS
from ampertrace.operators.ordered import seconds_between
from ampertrace.operators.quantiles import exact_quantiles
from ampertrace.operators.sessions import DEVICE_KEYS, ORDER, drop_flag
from ampertrace.operators.spans import interruption_severity, transition_severity
from ampertrace.session import cut_lineage

BUFFERED_ROWS = 1_000_000
TEXT_FIELDS = (
    "software_version", "source_csv_file", "fod_object", "card_position", "sample_label", "manual_result", "defect_id",
    "defect_comment",
)
ROW_TEXTS = (
    "scenario_hint", "fod_object", "card_position", "sample_label", "manual_result", "defect_id", "defect_comment",
    "row_json",
)
# Phrases the rules look for in session texts.
PHRASES = {
    "rfid": ("rfid", "card position"),
    "protection_2": ("protection_2",),
    "fod": ("fod", "foreign object"),
    "nfc": ("nfc",),
    "full_charge": ("0-100", "charging 0 -100"),
    "full_charge_scenario": ("0-100",),
    "not_applicable": ("test not required",),
    "setup_issue": ("blower fault",),
    "charging_problem": (
        "toggling", "toggling status", "no charging", "charging interrupted", "charging interference", "charging inter",
    ),
    "fod_problem": ("no fod detected", "inappropriate temperature"),
    "nfc_problem": ("no ok", "nok", "not ok"),
}
DEFECT_WORD = r"(?i)\bdefect(?:\s*id)?\b\s*[:#=-]?\s*([A-Za-z]+-\d+|\d{3,}|[A-Za-z0-9_-]{4,})"
DEFECT_JSON = r'(?i)"defect(?:\s*_?id)?"\s*:\s*"([^"]+)"'


def text_evidence(text: Column) -> dict[str, Column]:
    """Phrase flags of one text in which the single values stand on their own lines."""
    flags = {
        f"t_{name}": _contains_any(text, phrases) for name, phrases in PHRASES.items()
    }
    flags["t_wlc"] = text.rlike(r"\bwlc\b")
    flags["t_ok"] = text.rlike("(^|[\n ])ok(\n|$)")
    # the plain search keeps the patterns away from most texts
    flags["t_defect"] = text.contains("defect") & (text.rlike(DEFECT_WORD) | text.rlike(DEFECT_JSON))
    return flags


def _contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    found = text.contains(phrases[0])
    for phrase in phrases[1:]:
        found = found | text.contains(phrase)
    return found


def defect_refs(c: Column) -> Column:
    """Distinct defect references of a text, words first, then JSON values."""
    found = F.concat(F.regexp_extract_all(c, F.lit(DEFECT_WORD), 1), F.regexp_extract_all(c, F.lit(DEFECT_JSON), 1))
    cleaned = F.transform(
        found, lambda r: F.regexp_replace(F.regexp_replace(r, r"\s+", " "), r"^[ :#\-_,.;]+|[ :#\-_,.;]+$", "")
    )
    kept = F.filter(cleaned, lambda r: r != "")
    return F.filter(
        kept,
        lambda r, i: F.array_position(F.transform(kept, lambda x: F.lower(x)), F.lower(r)) == i + 1,
    )


def defect_reference_rows(events: DataFrame) -> DataFrame:
    """Distinct (session, lower-cased reference); a child table instead of an unbounded list."""
    texts = F.concat_ws("\n", *[clean_text(c) for c in ROW_TEXTS])
    return (
        events.select("session_key", F.explode(defect_refs(texts)).alias("reference"))
        .select("session_key", F.lower("reference").alias("reference"))
        .distinct()
    )


def dominant_texts(events: DataFrame, fields: dict[str, Column], key: str = "session_key") -> DataFrame:
    """Most frequent non-blank value per session and field; ties by last occurrence, then by value.

    Rows are counted per combination of values first: a session has few, so that map-side aggregation
    takes nearly all rows before they are spread over the fields.
    """
    combined = events.select(key, *[c.alias(f"_f_{n}") for n, c in fields.items()], F.struct(*ORDER).alias("_place"))
    combined = combined.groupBy(key, *[f"_f_{n}" for n in fields]).agg(
        F.count("*").alias("_n"), F.max("_place").alias("_place")
    )
    pairs = F.array_compact(
        F.array(
            *[
                F.when(F.col(f"_f_{n}").isNotNull(), F.struct(F.lit(n).alias("field"), F.col(f"_f_{n}").alias("value")))
                for n in fields
            ]
        )
    )
    counted = (
        combined.select(key, "_n", "_place", F.explode(pairs).alias("_p"))
        .groupBy(key, F.col("_p.field").alias("field"), F.col("_p.value").alias("value"))
        .agg(F.sum("_n").alias("n"), F.max("_place").alias("last"))
    )
    return counted.groupBy(key).agg(
        *[
            F.max_by("value", F.when(F.col("field") == n, F.struct("n", "last", "value"))).alias(n)
            for n in fields
        ]
    )


def status_table(events: DataFrame) -> DataFrame:
    """Per session: distinct statuses with sample count and first place, ordered by first place."""
    per_status = events.groupBy("session_key", "status").agg(
        F.count("*").alias("n"), F.min(F.struct(*ORDER)).alias("first")
    )
    stats = F.sort_array(F.collect_list(F.struct(F.col("first"), F.col("status"), F.col("n"))))
    return per_status.groupBy("session_key").agg(stats.alias("status_stats"))


def finalize(rows: DataFrame) -> DataFrame:
    """One row per session; input from ``with_metric_rows``."""
    metric = F.col("is_metric")
    delay = F.col("ingest_delay_seconds")
    gap = seconds_between(F.col("event_ts"), F.col("prev.event_ts"))
    place = F.struct(*ORDER)
    severities = [transition_severity(m) for m in METRICS] + [interruption_severity()]
    count_of = lambda level: sum((F.coalesce(s == level, F.lit(False)).cast("int") for s in severities), F.lit(0))
    drops = (
        (metric & drop_flag(F.col("prev.eff"), F.col("eff"), 15.0, 0.25)).cast("int"),
        (metric & drop_flag(F.col("prev.rx"), F.col("rx"), 0.0, 0.20)).cast("int"),
        (metric & drop_flag(F.col("prev.tx"), F.col("tx"), 0.0, 0.20)).cast("int"),
    )
    has_event = F.coalesce(*severities).isNotNull()
    texts = F.concat_ws("\n", *[F.nullif(clean_text(c), F.lit("")) for c in ROW_TEXTS])
    voltage_place = F.when(metric & F.col("voltage_v").isNotNull(), place)
    battery_place = F.when(F.col("battery_level").isNotNull(), place)
    rows = rows.withColumn("_texts", texts).withColumns(
        {**text_evidence(F.col("_texts")), "_reference": F.when(F.contains("_texts", F.lit("defect")), F.get(defect_refs(F.col("_texts")), F.lit(0)))}
    )
    flags = [c for c in rows.columns if c.startswith("t_")]
    base = rows.groupBy("session_key", *DEVICE_KEYS).agg(
        F.count("*").alias("sample_count"),
        F.min("raw_id").alias("first_raw_id"),
        F.max("raw_id").alias("last_raw_id"),
        F.min("event_ts").alias("start_ts"),
        F.max("event_ts").alias("end_ts"),
        F.count_if(metric).alias("metric_sample_count"),
        F.min(F.when(metric, F.col("event_ts"))).alias("_metric_start"),
        F.max(F.when(metric, F.col("event_ts"))).alias("_metric_end"),
        F.max("completion_ts").alias("completed_charge_ts"),
        *[F.avg(F.when(metric, F.col(m))).alias(f"avg_{m}") for m in ("eff", "rx", "tx", "rpp", "current_a")],
        F.avg("temperature").alias("avg_temperature"),
        F.max("temperature").alias("max_temperature"),
        F.min_by("battery_level", battery_place).alias("battery_start"),
        F.max_by("battery_level", battery_place).alias("battery_end"),
        F.min_by("voltage_v", voltage_place).alias("voltage_start"),
        F.max_by("voltage_v", voltage_place).alias("voltage_end"),
        F.percentile(F.when(F.col("session_rows") <= BUFFERED_ROWS, delay), 0.5).alias("_small_delay"),
        F.max(F.when(gap > 0, gap)).alias("max_gap_seconds"),
        F.count_if(gap > F.col("interruption_limit")).alias("interruption_count"),
        *[F.sum(d).alias(f"_d{i}") for i, d in enumerate(drops)],
        F.sum(count_of("warning")).alias("warning_event_count"),
        F.sum(count_of("alarm")).alias("alarm_event_count"),
        F.min(F.when(has_event, F.col("prev.event_ts"))).alias("first_event_ts"),
        F.min_by("prev.status", F.when(has_event, F.col("prev.event_ts"))).alias("first_event_status"),
        F.max_by("status", F.when(F.col("status") != "N/A", place)).alias("last_status"),
        F.min_by("_reference", F.when(F.col("_reference").isNotNull(), place)).alias("first_reference"),
        *[F.max(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags],
    )
    # delays of huge sessions would not fit one aggregation buffer
    huge = exact_quantiles(
        rows.filter(F.col("session_rows") > BUFFERED_ROWS), ["session_key"], {"_huge_delay": "ingest_delay_seconds"}
    )
    base = base.join(huge, "session_key", "left").withColumn(
        "median_ingest_delay", F.coalesce("_small_delay", "_huge_delay")
    ).drop("_small_delay", "_huge_delay")
    dominant = dominant_texts(
        rows,
        {
            **{f: blank_to_null(f) for f in TEXT_FIELDS},
            "dual_charging": boolish("dual_charging_label").cast("string"),
        },
    )
    out = base.join(dominant, "session_key", "left").join(status_table(rows), "session_key", "left")
    late = F.concat_ws("\n", *[F.nullif(clean_text(c), F.lit("")) for c in ("position", "software_version", "source_csv_file")])
    merged = {n: F.col(n) | F.coalesce(c, F.lit(False)) for n, c in text_evidence(late).items()}
    minutes = lambda a, b: F.greatest(seconds_between(F.col(b), F.col(a)) / 60.0, F.lit(0.0))
    codes = F.filter(F.transform("status_stats", lambda s: s["status"]), lambda c: c != "N/A")
    sessions = out.withColumns(
        {
            **merged,
            **{f: F.coalesce(F.col(f), F.lit("")) for f in TEXT_FIELDS},
            "duration_minutes": minutes("start_ts", "end_ts"),
            "metric_duration_minutes": F.when(F.col("metric_sample_count") > 0, minutes("_metric_start", "_metric_end")),
            "status_codes": F.array_sort(codes),
            "drop_count": sum((F.coalesce(F.col(f"_d{i}"), F.lit(0)) for i in range(3)), F.lit(0)).cast("long"),
            "metrics_trimmed_at_full_charge": F.col("completed_charge_ts").isNotNull()
            & (F.col("metric_sample_count") != F.col("sample_count")),
        }
    ).drop("_metric_start", "_metric_end", "_d0", "_d1", "_d2")
    return cut_lineage(sessions)


def annotate_project(sessions: DataFrame) -> DataFrame:
    """Whether the project reports any status, and which fields it ever fills.

    One small row per project joined back; a window would put a whole project into one task.
    """
    project = strip("project_number")
    text = lambda c: F.max(blank_to_null(c).isNotNull())
    facts = (
        sessions.groupBy(project.alias("_project"))
        .agg(
            F.max(F.size("status_codes") > 0).alias("project_has_status_readout"),
            F.max(F.col("max_temperature").isNotNull()).alias("project_has_temperature"),
            F.max(F.col("avg_eff").isNotNull()).alias("project_has_eff"),
            text("card_position").alias("project_has_card_position"),
            text("fod_object").alias("project_has_fod_object"),
            text("software_version").alias("project_has_software_version"),
        )
        .filter(F.col("_project") != "")
    )
    return sessions.withColumn("_project", project).join(facts, "_project", "left").drop("_project")
