"""Full analysis of work items as one job over a shared, prepared input."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ampertrace.operators import workitems as W
from ampertrace.operators.people import attach_people, masked_copies
from ampertrace.session import cut_lineage


def prepare_items(items: DataFrame, people: DataFrame) -> DataFrame:
    """Known people attached, names masked and scrubbed; written once because every table reads it.

    The attached items are written too: masking reads their texts more than once, and without that each reading would join
    all people again, with as many broadcasts in one job. So are the people, whose names are folded for each reader otherwise.
    """
    people = cut_lineage(people)
    known = cut_lineage(attach_people(items, people))
    masked = masked_copies(known, "work_item", people, {"safe_summary": "hash", "scrubbed_summary": "strip"})
    return cut_lineage(W.prepared(masked, "scrubbed_summary", "safe_summary"))


def workitem_analysis(items: DataFrame, people: DataFrame) -> dict[str, DataFrame]:
    rows = prepare_items(items, people)
    return {
        "summary": W.workitem_summary(rows),
        "repeated_cases": W.repeated_cases(rows),
        "case_items": W.case_items(rows),
        "owner_department_details": W.department_details(rows, "owner"),
        "creator_department_details": W.department_details(rows, "creator"),
        "department_split": W.department_split(rows),
        "project_details": W.project_details(rows),
        "owner_hash_counts": W.people_counts(rows, "owner"),
        "creator_hash_counts": W.people_counts(rows, "creator"),
        "keyword_counts": W.keyword_counts(rows),
    }
