"""Incremental refresh of the processed table, and gap sessions over a stream.

The batch jobs refresh everything once a day. These two keep the processed table current between
refreshes; they use the same row-local functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ampertrace.operators.sessions import DEVICE_KEYS
from ampertrace.sources.telemetry import build_processed

# Columns of the raw table; times arrive as text.
RAW_SCHEMA = (
    "raw_id long, device_name string, source_csv_file string, source_seq long, event_ts string, inserted_at string, "
    "charger_name string, phone string, position string, project_number string, software_version string, row_json string"
)


def append_processed(spark: SparkSession, raw_path: str, out_path: str, checkpoint: str) -> StreamingQuery:
    """Process the raw files that are new since the last run and append them by event date. Stateless."""
    raw = spark.readStream.schema(RAW_SCHEMA).parquet(raw_path)
    rows = build_processed(raw).withColumn("event_date", F.to_date("event_ts"))
    return (
        rows.writeStream.format("parquet").partitionBy("event_date").option("path", out_path)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )


def gap_sessions(events: DataFrame, gap: str = "20 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions cut by time gaps only; a session is emitted when the watermark has passed it.

    ``event_ts`` is read as UTC. Two events exactly one gap apart belong to one session.
    """
    timed = events.withColumn("event_time", F.col("event_ts").cast("timestamp")).withWatermark("event_time", late)
    return timed.groupBy(*DEVICE_KEYS, F.session_window("event_time", gap).alias("_w")).agg(
        F.count("*").alias("source_row_count"), F.min("event_time").alias("start_ts"), F.max("event_time").alias("end_ts"),
        F.avg("eff").alias("avg_eff"), F.max("temperature").alias("max_temperature"),
    ).drop("_w")
