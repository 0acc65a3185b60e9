"""Daily ranking snapshots, one partition per date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "generated_at timestamp_ntz, source_relation string, source_row_count long, session_count int, payload string, "
    "snapshot_date date"
)
ZONE = "Europe/Warsaw"


def snapshot_date_of(spark: SparkSession) -> date:
    """Today's date where the devices are."""
    return spark.range(1).select(F.to_date(F.from_utc_timestamp(F.current_timestamp(), ZONE)).alias("d")).first()["d"]


def snapshot_row(sections: DataFrame, totals: DataFrame, day: date, source: str) -> DataFrame:
    """The day's row: all ranked rows (a few per section) packed as JSON, with the totals of the run."""
    rows = sections.agg(F.to_json(F.array_sort(F.collect_list(F.struct("section", "rank", *[c for c in sections.columns if c not in ("section", "rank")])))).alias("payload"))
    return rows.crossJoin(totals).select(
        F.from_utc_timestamp(F.current_timestamp(), ZONE).cast("timestamp_ntz").alias("generated_at"),
        F.lit(source).alias("source_relation"),
        F.col("source_row_count").cast("long").alias("source_row_count"),
        F.col("session_count").cast("int").alias("session_count"),
        "payload",
        F.lit(day).cast("date").alias("snapshot_date"),
    )


def write_snapshot(row: DataFrame, path: str) -> None:
    """Replace the partition of the row's date; other dates stay."""
    row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def latest_snapshot(spark: SparkSession, path: str, today: date | None = None) -> DataFrame:
    """The most recent snapshot with ``is_current``; blanks replaced by defaults."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return newest(rows, today)


def newest(rows: DataFrame, today: date | None = None) -> DataFrame:
    best = rows.orderBy(F.col("snapshot_date").desc(), F.col("generated_at").desc()).limit(1)
    day = F.lit(today).cast("date") if today else F.to_date(F.from_utc_timestamp(F.current_timestamp(), ZONE))
    return best.select(
        "snapshot_date", "generated_at", F.coalesce("source_relation", F.lit("")).alias("source_relation"),
        F.coalesce("source_row_count", F.lit(0)).alias("source_row_count"), F.coalesce("session_count", F.lit(0)).alias("session_count"),
        F.coalesce("payload", F.lit("[]")).alias("payload"), (F.col("snapshot_date") == day).alias("is_current"),
    )
