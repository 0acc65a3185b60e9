"""Raw telemetry to the processed event table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampertrace.functions import payload as P
from ampertrace.functions.text import blank_to_null
from ampertrace.operators.filters import candidate_flag
from ampertrace.operators.ordered import seconds_between
from ampertrace.session import spread

# Columns and types of the processed event table.
PROCESSED_SCHEMA = {
    "raw_id": "bigint", "device_name": "string", "source_csv_file": "string", "source_seq": "bigint",
    "event_ts": "timestamp_ntz", "charger_name": "string", "phone": "string", "position": "string",
    "project_number": "string", "software_version": "string", "scenario_hint": "string", "fod_object": "string",
    "card_position": "string", "sample_label": "string", "manual_result": "string", "defect_id": "string",
    "defect_comment": "string", "dual_charging_label": "string", "dual_charging_flag": "boolean",
    "row_json": "string", "hmi_status": "string", "inserted_at": "timestamp_ntz", "eff": "double", "rx": "double",
    "tx": "double", "rpp": "double", "current_a": "double", "temperature": "double", "battery_level": "double",
    "voltage_v": "double", "ingest_delay_seconds": "double", "analysis_candidate": "boolean",
}
SESSION_COLUMNS = (
    "session_key", "phone", "project_number", "device_name", "charger_name", "position", "source_row_count",
    "software_version", "source_csv_file", "scenario_hint", "fod_object", "card_position", "sample_label",
    "manual_result", "defect_id", "defect_comment", "dual_charging_label", "start_ts", "end_ts", "avg_eff", "avg_rx",
    "avg_tx", "max_temperature", "status_codes", "first_status", "last_status", "interruption_count",
    "eff_drop_count", "rx_drop_count", "tx_drop_count",
)


def text_time(c: Column | str) -> Column:
    """Timestamp without zone out of text; blank or malformed text gives NULL."""
    return blank_to_null(c).try_cast("timestamp_ntz")


def read_raw(spark: SparkSession, path: str, source_format: str = "parquet", **options) -> DataFrame:
    """Raw rows with typed times. CSV input is read with a header and no schema inference."""
    reader = spark.read.format(source_format)
    if source_format == "csv":
        reader = reader.option("header", "true").option("multiLine", "false").option("escape", '"')
    return typed_raw(reader.options(**options).load(path))


def typed_raw(raw: DataFrame) -> DataFrame:
    return raw.withColumns(
        {
            "raw_id": F.col("raw_id").cast("bigint"),
            "source_seq": F.col("source_seq").cast("bigint"),
            "event_ts": text_time("event_ts"),
            "inserted_at": text_time("inserted_at"),
        }
    )


def conform(df: DataFrame, schema: dict[str, str] = PROCESSED_SCHEMA, required: Sequence[str] | None = None) -> DataFrame:
    """Project to the schema (or to ``required`` columns of it); absent columns become typed NULLs."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(name).cast(schema[name]) if name in present else F.lit(None).cast(schema[name])).alias(name)
            for name in (required or schema)
        ]
    )


def validate_sessions(df: DataFrame) -> DataFrame:
    missing = sorted(set(SESSION_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"session table lacks columns: {', '.join(missing)}")
    return df


def ingest_delay(event_ts: str = "event_ts", inserted_at: str = "inserted_at") -> Column:
    return seconds_between(F.col(inserted_at), F.col(event_ts))


def _payload_fields(df: DataFrame, json_null_is_text: bool = False) -> DataFrame:
    """Adds ``_found``, a struct of all metric and text fields of ``row_json``."""
    metrics = {**P.METRIC_KEYS, **P.EFFICIENCY_KEYS}
    texts = {**P.TEXT_KEYS, **P.STATUS_KEYS}
    staged = df.withColumn("_top", P.payload_map("row_json"))
    staged = staged.withColumn("_flat", P.is_flat(F.col("row_json"), F.col("_top")))
    staged = staged.withColumn("_entries", F.when(F.col("_flat"), P.entries_of(F.col("_top"))))
    staged = staged.withColumn("_deep", P.nested_fields(F.when(~F.col("_flat"), F.col("row_json")), metrics, texts))
    return staged.withColumn(
        "_found",
        F.struct(
            *[F.coalesce(F.col("_deep")[n], P.flat_metric(F.col("_entries"), k)).alias(n) for n, k in metrics.items()],
            *[
                F.coalesce(F.col("_deep")[n], P.flat_text(F.col("_entries"), k, json_null_is_text)).alias(n)
                for n, k in texts.items()
            ],
        ),
    ).drop("_top", "_flat", "_entries", "_deep")


def build_processed(raw: DataFrame, variant: str = "processed", json_null_is_text: bool = False) -> DataFrame:
    """Typed events with payload fields, ingest delay and candidate flag."""
    found = _payload_fields(typed_raw(spread(raw)), json_null_is_text)
    take = lambda n: F.col("_found")[n]
    typed = found.withColumns(
        {
            **{n: take(n) for n in P.METRIC_KEYS},
            **{n: take(n) for n in P.TEXT_KEYS},
            "eff": P.efficiency(take("eff"), take("eff_left"), take("eff_right")),
            "hmi_status": P.norm_status(take("hmi_status")),
            "dual_charging_flag": P.boolish(take("dual_charging_label")),
            "ingest_delay_seconds": ingest_delay(),
        }
    ).drop("_found")
    return conform(typed.withColumn("analysis_candidate", candidate_flag(typed, variant)))


def write_processed(processed: DataFrame, path: str) -> None:
    """Overwrite the processed table, partitioned by event date."""
    processed.withColumn("event_date", F.to_date("event_ts")).write.mode("overwrite").partitionBy("event_date").parquet(path)


def write_sessions(sessions: DataFrame, path: str) -> None:
    validate_sessions(sessions).withColumn("start_date", F.to_date("start_ts")).write.mode("overwrite").partitionBy(
        "start_date"
    ).parquet(path)


def enrich(events: DataFrame) -> DataFrame:
    """Fill missing metrics, texts, time and delay from the payload, only where they are NULL."""
    found = _payload_fields(spread(events))
    take = lambda n: F.col("_found")[n]
    present = set(events.columns)
    fill: dict[str, Column] = {}
    for n in P.METRIC_KEYS:
        fill[n] = F.coalesce(F.col(n), take(n)) if n in present else take(n)
    for n in P.TEXT_KEYS:
        text = F.nullif(F.trim(F.regexp_replace(take(n), r"\s+", " ")), F.lit(""))
        fill[n] = F.coalesce(F.col(n), text) if n in present else text
    fill["eff"] = F.coalesce(F.col("eff"), P.efficiency(take("eff"), take("eff_left"), take("eff_right")))
    out = found.withColumns(fill)
    out = out.withColumn(
        "event_ts",
        F.coalesce(
            F.col("event_ts"),
            text_time(F.coalesce(F.get_json_object("row_json", "$.timestamp"), F.get_json_object("row_json", "$.event_ts"))),
        ),
    )
    delay = F.col("ingest_delay_seconds") if "ingest_delay_seconds" in present else F.lit(None).cast("double")
    return out.withColumn("ingest_delay_seconds", F.coalesce(delay, ingest_delay())).drop("_found")
