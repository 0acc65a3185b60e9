"""Reliability ranking of phones, projects and software releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampertrace.functions.text import strip, text_or_blank
from ampertrace.operators.quantiles import exact_quantiles

# Smallest session count per section, smallest status coverage, list length.
MIN_SESSIONS = {"phone": 30, "project": 50, "project_software": 10, "software": 20}
MIN_COVERAGE = 0.80
TOP_LIMIT = 6

_DIMENSIONS = {"phone": "phone", "project": "project_number", "software": "software_version"}
_SECTION_KEYS = {
    "phone": ("phone",),
    "project": ("project",),
    "project_software": ("project", "software"),
    "software": ("software",),
}


def _section_row(section: str) -> Column:
    keys = _SECTION_KEYS[section]
    label_of = keys[-1]
    return F.struct(
        F.lit(section).alias("section"),
        F.col(f"{label_of}_label").alias("label"),
        *[
            (strip(text_or_blank(column)) if name in keys else F.lit("")).alias(name)
            for name, column in _DIMENSIONS.items()
        ],
    )


def reliability(classified: DataFrame, *sections: str) -> DataFrame:
    """Counts, medians and distinct dimension counts per group, for one or more sections in one pass."""
    keys = ["section", "label", "phone", "project", "software"]
    dimension = {f"_{name}": F.nullif(strip(column), F.lit("")) for name, column in _DIMENSIONS.items()}
    rows = classified.select(
        F.explode(F.array(*[_section_row(s) for s in sections])).alias("_g"),
        "has_status_readout", "verdict", "is_clean", "avg_eff", "avg_rx", "avg_tx", "end_ts",
        *[c.alias(n) for n, c in dimension.items()],
    ).select("_g.*", "*").drop("_g")
    counts = rows.groupBy(*keys).agg(
        F.count("*").alias("session_count"),
        F.count_if("has_status_readout").alias("covered_count"),
        F.count_if(F.col("verdict") == "defect").alias("defect_count"),
        F.count_if(F.col("verdict") == "not_ok").alias("not_ok_count"),
        F.count_if(F.col("verdict") == "warning").alias("warning_count"),
        F.count_if("is_clean").alias("clean_count"),
        F.max("end_ts").alias("last_seen"),
    )
    distinct = (
        rows.select(*keys, F.explode(F.array(*[
            F.struct(F.lit(n).alias("d"), F.col(f"_{n}").alias("v")) for n in _DIMENSIONS
        ])).alias("_d"))
        .filter(F.col("_d.v").isNotNull())
        .select(*keys, F.col("_d.d").alias("_d"), F.col("_d.v").alias("_v"))
        .distinct()
        .groupBy(*keys)
        .agg(*[F.count_if(F.col("_d") == n).alias(f"{n}_count") for n in _DIMENSIONS])
    )
    medians = exact_quantiles(rows, keys, {"median_eff": "avg_eff", "median_rx": "avg_rx", "median_tx": "avg_tx"})
    return (
        counts.join(distinct, keys, "left")
        .join(medians, keys, "left")
        .fillna(0, [f"{n}_count" for n in _DIMENSIONS])
    )


def score(groups: DataFrame) -> DataFrame:
    """Rates, reliability score 0..100 and eligibility of each group."""
    n = F.col("session_count")
    rates = groups.withColumns(
        {
            "status_coverage": F.col("covered_count") / n,
            "defect_rate": F.col("defect_count") / n,
            "not_ok_rate": F.col("not_ok_count") / n,
            "warning_rate": F.col("warning_count") / n,
            "clean_rate": F.col("clean_count") / n,
        }
    )
    penalty = (
        60.0 * F.col("defect_rate")
        + 25.0 * F.col("not_ok_rate")
        + 10.0 * F.col("warning_rate")
        + 5.0 * (1.0 - F.col("status_coverage"))
    )
    minimum = F.create_map(*[F.lit(x) for pair in MIN_SESSIONS.items() for x in pair])[F.col("section")]
    return rates.withColumns(
        {
            "reliability_score": F.greatest(F.lit(0.0), F.lit(100.0) - penalty),
            "eligible": (n >= minimum) & (F.col("status_coverage") >= MIN_COVERAGE),
        }
    )


def ranking_order() -> list[Column]:
    return [
        F.col("eligible").desc(),
        F.col("reliability_score").desc(),
        F.col("defect_rate").asc(),
        F.col("not_ok_rate").asc(),
        F.col("warning_rate").asc(),
        F.col("clean_rate").desc(),
        F.col("session_count").desc(),
        F.col("label").asc(),
        F.col("project").asc(),
    ]


def shown_groups(scored: DataFrame) -> DataFrame:
    """Eligible groups of every section, or all groups where none is eligible."""
    facts = scored.groupBy("section").agg(F.max("eligible").alias("_any"))
    return scored.join(facts, "section").filter(F.col("eligible") | ~F.col("_any")).drop("_any")


def rank_section(scored: DataFrame, limit: int = TOP_LIMIT) -> DataFrame:
    """Top rows of every section: eligible groups, or all of them where none is eligible.

    Spark prunes each section to its first rows before the shuffle, because only the first ranks are kept.
    """
    place = Window.partitionBy("section").orderBy(*ranking_order())
    return shown_groups(scored).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= limit)


def best_per_project(scored: DataFrame, limit: int = TOP_LIMIT) -> DataFrame:
    """First release of each project in ranking order, then the first ``limit`` of these."""
    pairs = scored.filter(F.col("section") == "project_software")
    first = (
        shown_groups(pairs).filter(F.col("project") != "")
        .withColumn("_place", F.row_number().over(Window.partitionBy("project").orderBy(*ranking_order())))
        .filter(F.col("_place") == 1)
    )
    place = Window.partitionBy("section").orderBy(*ranking_order())
    return (
        first.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= limit).drop("_place")
    )


def leaders(ranked: DataFrame, best: DataFrame) -> DataFrame:
    """Leader of each section; the project-software leader comes from ``best_per_project``."""
    rows = ranked.filter(F.col("section") != "project_software").unionByName(best)
    return rows.filter(F.col("rank") == 1)
