"""Nightly reliability job: events to sessions to verdicts to ranking to snapshot."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampertrace.operators import ranking
from ampertrace.operators.sessions import build_sessions
from ampertrace.operators.verdicts import classify_sessions
from ampertrace.session import cut_lineage
from ampertrace.sources.snapshots import snapshot_row, write_snapshot
from ampertrace.sources.telemetry import validate_sessions

SECTIONS = ("phone", "project", "project_software", "software")


def rank_sessions(sessions: DataFrame) -> DataFrame:
    """All four sections of the ranking from a session table."""
    classified = cut_lineage(classify_sessions(validate_sessions(sessions)))
    scored = cut_lineage(ranking.score(ranking.reliability(classified, *SECTIONS)))
    sections = ranking.rank_section(scored).filter(F.col("section") != "project_software")
    return sections.unionByName(ranking.best_per_project(scored))


def nightly(processed: DataFrame, snapshot_path: str, day: date, source: str = "sessions") -> DataFrame:
    """Run the job for a day and return the ranked rows written into the snapshot."""
    sessions = cut_lineage(build_sessions(processed))
    ranked = cut_lineage(rank_sessions(sessions))
    totals = sessions.agg(
        F.count("*").alias("session_count"), F.coalesce(F.sum("source_row_count"), F.lit(0)).alias("source_row_count")
    )
    write_snapshot(snapshot_row(ranked, totals, day, source), snapshot_path)
    return ranked
