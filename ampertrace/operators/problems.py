"""Problem list of the report: items, filters, order, summary and breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampertrace.functions.payload import status_description
from ampertrace.functions.text import blank_to_null, strip, text_or_blank
from ampertrace.operators.filters import distinct_values
from ampertrace.operators.rules import problem_time

CLASSES = ("defect", "not_ok", "potential_defect")
OPTION_FIELDS = (
    "project_number", "classification", "test_type", "sample_label", "software_version", "phone", "position",
    "dual_charging_label",
)


def classification() -> Column:
    verdict = F.col("verdict")
    return F.when(verdict.isin("defect", "not_ok"), verdict).when(verdict == "warning", F.lit("potential_defect"))


def problems(assessed: DataFrame) -> DataFrame:
    """One item per session with a problem; input from ``rules.assess``."""
    rows = problem_time(assessed).withColumn("classification", classification()).filter(F.col("classification").isNotNull())
    first_real = F.get(F.filter("status_stats", lambda s: s["status"] != "N/A"), F.lit(0))["status"]
    at_event = F.nullif(F.col("first_event_status"), F.lit("N/A"))
    code = F.coalesce("problem_status", at_event, first_real, F.lit(""))
    return rows.select(
        "session_key",
        "classification",
        F.get("reasons", F.lit(0)).alias("short_reason"),
        "severity_score",
        *[strip(text_or_blank(c)).alias(c) for c in ("project_number", "sample_label", "software_version", "phone", "position")],
        F.col("scenario_label").alias("test_type"),
        code.alias("status_code"),
        F.when(code != "", status_description(code)).otherwise(F.lit("")).alias("status_description"),
        F.coalesce("first_reference", blank_to_null("defect_id"), F.lit("")).alias("defect_id"),
        F.when(F.col("dual_charging") == "true", F.lit("tak")).when(F.col("dual_charging") == "false", F.lit("nie"))
        .otherwise(F.lit("")).alias("dual_charging_label"),
        "source_csv_file", "first_raw_id", "last_raw_id", "start_ts", "end_ts", "problem_ts",
        F.coalesce("end_ts", "start_ts").alias("sort_time"),
    )


def filter_problems(items: DataFrame, **wanted: str) -> DataFrame:
    """Equality on item fields; ``defect_id`` is a case-insensitive part."""
    for field, value in wanted.items():
        if not value:
            continue
        if field == "defect_id":
            items = items.filter(F.contains(F.lower("defect_id"), F.lit(value.lower())))
        else:
            items = items.filter(F.col(field) == value)
    return items


def problem_order() -> list[Column]:
    place = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("classification"))
    return [place.asc(), F.col("sort_time").asc(), F.col("session_key").asc()]


def order_problems(items: DataFrame) -> DataFrame:
    return items.orderBy(*problem_order())


def breakdown(items: DataFrame, field: str) -> DataFrame:
    return (
        items.filter(blank_to_null(field).isNotNull())
        .groupBy(strip(field).alias("label"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), F.lower("label"), "label")
    )


def problem_summary(items: DataFrame) -> DataFrame:
    """Counts by class, most frequent software and reason; ties by label."""

    def top(field: str) -> DataFrame:
        counts = breakdown(items, field)
        best = F.min_by(F.struct("label", "n"), F.struct((-F.col("n")).alias("a"), F.col("label").alias("b")))
        return counts.agg(best.alias("_t")).select(
            F.coalesce(F.col("_t.label"), F.lit("Brak danych")).alias(f"top_{field}"),
            F.coalesce(F.col("_t.n"), F.lit(0)).alias(f"top_{field}_count"),
        )

    counts = items.agg(
        F.count("*").alias("problem_count"),
        *[F.count_if(F.col("classification") == c).alias(f"{c}_count") for c in CLASSES],
    )
    return counts.crossJoin(top("software_version")).crossJoin(top("short_reason"))


def problem_options(items: DataFrame) -> DataFrame:
    return distinct_values(items, OPTION_FIELDS)
