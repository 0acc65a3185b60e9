"""Problem report: events to context sessions to rule verdicts to problem items."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ampertrace.operators.context_sessions import sessionize_context
from ampertrace.operators.filters import Scope, apply_scope, candidate_flag, expand_windows
from ampertrace.operators.problems import breakdown, order_problems, problem_options, problem_summary, problems
from ampertrace.operators.report_sessions import annotate_project, finalize
from ampertrace.operators.rules import assess, classify_intervals
from ampertrace.operators.spans import status_intervals, with_metric_rows
from ampertrace.session import cut_lineage
from ampertrace.sources.telemetry import conform, enrich

#: fields by which the items are counted
BREAKDOWNS = ("test_type", "software_version", "phone", "project_number", "position", "short_reason")


def report_events(processed: DataFrame, scope: Scope | None = None) -> DataFrame:
    """Rows in scope around candidate rows, with what they lack taken from their payloads. Scope filters reach the scan."""
    rows = enrich(apply_scope(conform(processed), scope or Scope()))
    rows = cut_lineage(rows.withColumn("analysis_candidate", candidate_flag(rows, "compat")))
    return expand_windows(rows, rows.filter("analysis_candidate"))


def assessed_sessions(events: DataFrame) -> DataFrame:
    return assess(annotate_project(finalize(with_metric_rows(sessionize_context(events)))))


def problem_report(processed: DataFrame, scope: Scope | None = None) -> DataFrame:
    """The problem items in their order."""
    return order_problems(problems(assessed_sessions(report_events(processed, scope))))


def full_report(processed: DataFrame, scope: Scope | None = None) -> dict[str, DataFrame]:
    """All tables of the report over one set of events and sessions: items in order, summary, counts by field, options of the
    filters, sessions with verdicts, and the status intervals of the sessions with problems."""
    rows = cut_lineage(with_metric_rows(sessionize_context(report_events(processed, scope))))
    sessions = cut_lineage(assess(annotate_project(finalize(rows))))
    items = cut_lineage(problems(sessions))
    with_problem = sessions.join(items.select("session_key"), "session_key", "left_semi")
    return {
        "items": order_problems(items),
        "summary": problem_summary(items),
        **{f"by_{field}": breakdown(items, field) for field in BREAKDOWNS},
        "options": problem_options(items),
        "sessions": sessions,
        "timeline": classify_intervals(status_intervals(rows).join(with_problem.select("session_key"), "session_key", "left_semi"), with_problem),
    }
