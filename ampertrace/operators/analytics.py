"""Session analytics: peers, releases, positions, statuses, scenarios, decision ranking.

Session operators take the output of ``report_sessions.finalize`` (blank keys are '').
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampertrace.functions.payload import norm_status
from ampertrace.functions.text import label_or_default, position_number, strip, text_or_blank
from ampertrace.operators.quantiles import exact_quantiles

# Weights and limits of the rankings.
WEIGHTS = {"median_eff": 0.4, "median_rx": 0.2, "median_tx": 0.15, "clean_rate": 0.25}
MIN_SESSIONS = 2
TOP_LIMIT = 6
TOPLIST_LIMIT = 5
FLAGGED_LIMIT = 8
POSITION_LIMIT = 24
POSITION_RELEASE_LIMIT = 48
BASELINE_RELEASES = 3
ALARM_DROP = 4.0
WARNING_DROP = 2.0
COVERAGE_METRICS = ("eff", "rx", "tx", "rpp", "current_a", "temperature", "battery_level", "voltage_v")
GOOD_STATUSES = ("2", "3")
PEER_COLUMNS = {
    "_duration": "duration_minutes", "_eff": "avg_eff", "_rx": "avg_rx", "_tx": "avg_tx", "_lag": "median_ingest_delay",
}


def peer_flags(sessions: DataFrame) -> DataFrame:
    """Compare sessions with the medians of their phone and project (at least three sessions).

    Adds five flags, ``peer_issue_count`` and ``peer_severity``.
    """
    keys = ["phone", "project_number"]
    counts = sessions.groupBy(*keys).agg(F.count("*").alias("_peers"))
    medians = exact_quantiles(sessions, keys, PEER_COLUMNS)
    rows = sessions.join(counts.join(medians, keys, "left"), keys)
    many = F.col("_peers") >= 3

    def low_power(metric: str) -> Column:
        middle, value = F.col(f"_{metric}"), F.col(f"avg_{metric}")
        return (value < middle * 0.6) & (value < middle - 2)

    flags = {
        "peer_short": (F.col("duration_minutes") < F.col("_duration") * 0.45) & (F.col("sample_count") >= 3),
        "peer_low_eff": (F.col("avg_eff") < F.col("_eff") - 8) & (F.col("avg_eff") < F.col("_eff") * 0.85),
        "peer_low_rx": low_power("rx"),
        "peer_low_tx": low_power("tx"),
        "peer_late": F.col("median_ingest_delay") > F.greatest(F.col("_lag") * 3, F.lit(120.0)),
    }
    # a missing median never flags: greatest() would ignore it
    flags["peer_late"] = flags["peer_late"] & F.col("_lag").isNotNull()
    out = rows.withColumns({n: F.coalesce(many & c, F.lit(False)) for n, c in flags.items()})
    weight = {n: 1 if n == "peer_late" else 2 for n in flags}
    return out.withColumns(
        {
            "peer_issue_count": sum((F.col(n).cast("int") for n in flags), F.lit(0)),
            "peer_severity": sum((F.col(n).cast("int") * w for n, w in weight.items()), F.lit(0)),
        }
    ).drop("_peers", *PEER_COLUMNS)


def flagged(assessed: DataFrame, limit: int = FLAGGED_LIMIT) -> DataFrame:
    """Sessions with issues, worst first; input is assessed and peer-flagged."""
    bad = F.col("verdict").isin("warning", "not_ok", "defect")
    reasons = F.when(bad, F.least(F.size("reasons"), F.lit(2))).otherwise(0)
    stops, drops = F.col("interruption_count") > 0, F.col("drop_count") > 0
    issues = (
        F.col("peer_issue_count") + stops.cast("int") + F.least(F.col("drop_count"), F.lit(3)) + reasons
    )
    score = (
        F.col("peer_severity")
        + F.when(stops, 3).otherwise(0)
        + F.when(drops, F.least(F.col("drop_count"), F.lit(3))).otherwise(0)
        + F.when(bad, F.col("severity_score")).otherwise(0)
    )
    scored = assessed.withColumns({"issue_count": issues.cast("int"), "total_severity": score.cast("int")})
    return (
        scored.filter("issue_count > 0")
        .withColumn("severity", F.when(F.col("total_severity") >= 5, F.lit("critical")).otherwise(F.lit("warn")))
        .orderBy(F.col("total_severity").desc(), F.col("end_ts").desc(), "session_key")
        .limit(limit)
    )


def as_ranking_input(assessed: DataFrame) -> DataFrame:
    """Report sessions in the shape the reliability ranking reads."""
    clean = (F.col("verdict") == "ok") & (F.col("interruption_count") == 0) & (F.col("drop_count") == 0)
    return assessed.withColumns(
        {
            "has_status_readout": F.size("status_codes") > 0,
            "is_clean": clean,
            "phone_label": label_or_default("phone", "brak telefonu"),
            "project_label": label_or_default("project_number", "brak projektu"),
            "software_label": label_or_default("software_version", "brak release"),
        }
    )


def _with_medians(groups: DataFrame, sessions: DataFrame, keys: Sequence[str], values: dict[str, str]) -> DataFrame:
    return groups.join(exact_quantiles(sessions, keys, values), list(keys), "left")


def decision_rank(sessions: DataFrame, label: Column) -> DataFrame:
    """Weighted, min-max normalised score 0..100 per label; weights are renormalised over known metrics."""
    rows = sessions.withColumn("label", F.coalesce(F.nullif(strip(label), F.lit("")), F.lit("brak danych")))
    n = F.col("session_count")
    stops, drops, peers = F.col("interruption_count") > 0, F.col("drop_count") > 0, F.col("peer_issue_count") > 0
    groups = rows.groupBy("label").agg(
        F.count("*").alias("session_count"),
        F.sum("sample_count").alias("sample_count"),
        F.count_if(~stops & ~drops & ~peers).alias("_clean"),
        F.count_if(stops).alias("_stops"),
        F.count_if(drops).alias("_drops"),
        F.count_if(peers).alias("_peers"),
        F.count_distinct(F.nullif("software_version", F.lit(""))).alias("release_count"),
        F.max("end_ts").alias("last_seen"),
    )
    groups = _with_medians(groups, rows, ["label"], {"median_eff": "avg_eff", "median_rx": "avg_rx", "median_tx": "avg_tx"})
    groups = groups.withColumns(
        {
            "clean_rate": F.col("_clean") / n, "interruption_rate": F.col("_stops") / n, "drop_rate": F.col("_drops") / n,
            "peer_issue_rate": F.col("_peers") / n, "_eligible": n >= MIN_SESSIONS,
        }
    )
    bounds = groups.agg(
        *[
            F.coalesce(f(F.when(F.col("_eligible"), F.col(m))), F.when(~F.max("_eligible"), f(m))).alias(f"_{name}_{m}")
            for m in WEIGHTS
            for name, f in (("low", F.min), ("high", F.max))
        ]
    )
    scored = groups.crossJoin(F.broadcast(bounds))

    def normal(m: str) -> Column:
        low, high = F.col(f"_low_{m}"), F.col(f"_high_{m}")
        share = (F.col(m) - low) / F.nullif(high - low, F.lit(0.0))
        return F.when(
            F.col(m).isNotNull() & low.isNotNull(),
            F.when(high - low < 1e-9, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))),
        )

    total = sum((F.coalesce(normal(m) * w, F.lit(0.0)) for m, w in WEIGHTS.items()), F.lit(0.0))
    weight = sum((F.when(normal(m).isNotNull(), w).otherwise(0.0) for m, w in WEIGHTS.items()), F.lit(0.0))
    out = scored.withColumn("decision_score", F.when(weight > 0, total / weight * 100))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def decision_order() -> list[Column]:
    return [F.col("decision_score").desc_nulls_last(), F.col("session_count").desc(), F.col("sample_count").desc(), F.col("label")]


def pair_label() -> Column:
    return F.concat_ws(" / ", label_or_default("phone", "brak telefonu"), label_or_default("project_number", "brak projektu"))


def _by_release(sessions: DataFrame) -> DataFrame:
    rows = sessions.withColumn("label", strip(text_or_blank("software_version"))).filter(
        (F.col("label") != "") & F.col("avg_eff").isNotNull()
    )
    groups = rows.groupBy("label").agg(
        F.count("*").alias("session_count"), F.sum("sample_count").alias("sample_count"),
        F.min("start_ts").alias("first_seen"), F.max("end_ts").alias("last_seen"),
    )
    return _with_medians(groups, rows, ["label"], {"median_eff": "avg_eff"})


def release_rank(sessions: DataFrame, limit: int = TOP_LIMIT) -> DataFrame:
    rows = _by_release(sessions).filter(F.col("session_count") >= MIN_SESSIONS)
    return rows.orderBy(F.col("median_eff").desc(), F.col("session_count").desc(), "label").limit(limit)


def release_regression(sessions: DataFrame) -> DataFrame:
    """Each release against the median of the three releases before it. One row per release is ordered."""
    releases = _by_release(sessions).withColumn("_eligible", F.col("session_count") >= MIN_SESSIONS)
    ordered = Window.partitionBy("_eligible").orderBy("first_seen", "label")
    before = F.array_sort(F.collect_list("median_eff").over(ordered.rowsBetween(-BASELINE_RELEASES, -1)))
    count = F.size(before)
    middle = (F.get(before, F.floor((count - 1) / 2).cast("int")) + F.get(before, F.floor(count / 2).cast("int"))) / 2
    staged = releases.withColumns(
        {"_before": before, "baseline_eff": F.when(count > 0, middle), "_ready": count == BASELINE_RELEASES}
    ).withColumn("delta", F.col("median_eff") - F.col("baseline_eff"))
    staged = staged.withColumns(
        {
            "better_count": F.size(F.filter("_before", lambda m: m > F.col("median_eff"))),
            "_candidate": F.col("_ready") & (F.col("delta") <= -WARNING_DROP),
        }
    )
    alarm = F.col("_ready") & (F.col("delta") <= -ALARM_DROP) & (F.col("better_count") >= 2)
    beside = F.coalesce(F.lag("_candidate").over(ordered), F.lit(False)) | F.coalesce(
        F.lead("_candidate").over(ordered), F.lit(False)
    )
    staged = staged.withColumns({"alarm": alarm, "warning": F.col("_candidate") & beside & ~alarm})
    trend = (
        F.when(~F.col("_eligible"), F.lit("insufficient"))
        .when(F.col("alarm"), F.lit("drop"))
        .when(F.col("warning"), F.lit("warning"))
        .when(~F.col("_ready"), F.lit("baseline"))
        .when(F.col("_candidate"), F.lit("steady"))
        .when(F.col("delta") >= ALARM_DROP, F.lit("up"))
        .otherwise(F.lit("steady"))
    )
    return staged.select(
        "label", "session_count", "sample_count", "median_eff", "first_seen", "last_seen",
        *[F.when(F.col("_eligible"), F.col(c)).alias(c) for c in ("baseline_eff", "delta", "better_count", "alarm", "warning")],
        trend.alias("trend"),
    )


def position_risk(sessions: DataFrame, limit: int = POSITION_LIMIT) -> DataFrame:
    """Medians, rates and risk score per position; input is peer-flagged."""
    rows = sessions.withColumns(
        {
            "label": label_or_default("position", "brak"),
            "_battery": F.col("battery_end") - F.col("battery_start"),
            "_voltage": F.col("voltage_end") - F.col("voltage_start"),
        }
    )
    alarm, warn, stop = F.col("alarm_event_count") > 0, F.col("warning_event_count") > 0, F.col("interruption_count") > 0
    named = lambda c: F.count_distinct(F.nullif(strip(c), F.lit("")))
    groups = rows.groupBy("label").agg(
        F.count("*").alias("session_count"), F.sum("sample_count").alias("sample_count"),
        F.max("max_temperature").alias("peak_temperature"),
        F.count_if(stop).alias("_stop"), F.count_if(warn).alias("_warn"), F.count_if(alarm).alias("_alarm"),
        F.count_if(~alarm & ~warn & ~stop & (F.col("peer_issue_count") == 0)).alias("_clean"),
        named("software_version").alias("release_count"), named("phone").alias("phone_count"),
        named("project_number").alias("project_count"), F.max("end_ts").alias("last_seen"),
    )
    groups = _with_medians(
        groups, rows, ["label"],
        {
            "median_eff": "avg_eff", "median_rx": "avg_rx", "median_tx": "avg_tx", "median_rpp": "avg_rpp",
            "median_current_a": "avg_current_a", "median_temperature": "avg_temperature",
            "median_battery_span": "_battery", "median_voltage_change": "_voltage",
        },
    )
    n = F.col("session_count")
    rated = groups.withColumns(
        {f"{a}_rate": F.col(f"_{b}") / n for a, b in (("interruption", "stop"), ("warning", "warn"), ("alarm", "alarm"), ("clean", "clean"))}
    )
    risk = (
        F.col("alarm_rate") * 100 + F.col("interruption_rate") * 60 + F.col("warning_rate") * 40
        + F.greatest(F.lit(0.0), F.coalesce("peak_temperature", F.lit(0.0)) - 35.0)
    )
    return (
        rated.withColumn("risk_score", risk).drop("_stop", "_warn", "_alarm", "_clean")
        .orderBy(F.col("risk_score").desc(), F.col("alarm_rate").desc(), F.col("interruption_rate").desc(), F.col("session_count").desc(), "label")
        .limit(limit)
    )


def position_release(sessions: DataFrame, limit: int = POSITION_RELEASE_LIMIT) -> DataFrame:
    keys = ["position_label", "release_label"]
    rows = sessions.withColumns(
        {"position_label": label_or_default("position", "brak"), "release_label": label_or_default("software_version", "brak release")}
    )
    groups = rows.groupBy(*keys).agg(
        F.count("*").alias("session_count"), F.max("max_temperature").alias("peak_temperature"),
        F.sum("alarm_event_count").alias("alarm_count"), F.sum("warning_event_count").alias("warning_count"),
        F.sum("interruption_count").alias("interruption_count"), F.max("end_ts").alias("last_seen"),
    )
    out = _with_medians(groups, rows, keys, {"median_eff": "avg_eff", "median_rpp": "avg_rpp"})
    return out.orderBy(*[F.col(c).desc() for c in ("last_seen", *keys)]).limit(limit)


def coverage(events: DataFrame) -> DataFrame:
    """Available and missing values of each metric."""
    present = [c for c in COVERAGE_METRICS if c in events.columns]
    counts = events.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in present])
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("metric"), (F.col(c) if c in present else F.lit(0)).cast("long").alias("available_count"))
                for c in COVERAGE_METRICS
            ]
        )
    )
    return counts.select("_n", pairs.alias("_p")).select(
        "_p.metric", "_p.available_count", (F.col("_n") - F.col("_p.available_count")).alias("missing_count"),
        F.coalesce(F.try_divide("_p.available_count", "_n"), F.lit(0.0)).alias("coverage_rate"),
    )


def _live(events: DataFrame) -> DataFrame:
    status = norm_status("hmi_status", "report")
    return events.withColumns({"_status": status, "_real": status != "N/A", "_good": status.isin(*GOOD_STATUSES)})


def position_status(events: DataFrame) -> DataFrame:
    """Row counts and bad rate per position number."""
    rows = _live(events).withColumn("position_number", position_number("position")).filter(F.col("position_number").isNotNull())
    groups = rows.groupBy("position_number").agg(
        F.min(strip("position")).alias("position_label"), F.count("*").alias("total_rows"),
        F.count_if("_real").alias("considered_rows"), F.count_if(F.col("_real") & F.col("_good")).alias("pass_rows"),
        F.count_if(F.col("_real") & ~F.col("_good")).alias("not_ok_rows"),
        F.array_sort(F.collect_set(F.when(F.col("_real"), F.col("_status")))).alias("status_codes"),
    )
    out = _with_medians(groups, rows, ["position_number"], {"median_eff": "eff"})
    considered = F.nullif("considered_rows", F.lit(0))
    return out.withColumns(
        {"bad_rate": F.try_divide("not_ok_rows", considered), "defect_rate": F.when(F.col("considered_rows") > 0, F.lit(0.0))}
    )


def status_table(events: DataFrame) -> DataFrame:
    """Share of rows per status with the number of positions, phones and projects; worst class first."""
    rows = _live(events).filter("_real")
    named = lambda c, d: F.count_distinct(label_or_default(c, d))
    groups = rows.groupBy(F.col("_status").alias("status_code")).agg(
        F.count("*").alias("row_count"), named("position", "brak").alias("position_count"),
        named("phone", "brak telefonu").alias("phone_count"), named("project_number", "brak projektu").alias("project_count"),
        F.max("_good").alias("_good"),
    )
    total = F.broadcast(rows.agg(F.count("*").alias("_total")))
    rated = groups.crossJoin(total).withColumns(
        {
            "row_rate": F.col("row_count") / F.col("_total"),
            "verdict_class": F.when(F.col("_good"), F.lit("ok")).otherwise(F.lit("warn")),
        }
    ).drop("_total", "_good")
    number = F.coalesce(F.col("status_code").try_cast("int"), F.lit(999))
    return rated.orderBy(F.col("verdict_class").desc(), F.col("row_count").desc(), number, "status_code")


def scenario_table(assessed: DataFrame) -> DataFrame:
    verdicts = ("ok", "not_ok", "defect", "no_data", "status_unavailable")
    groups = assessed.groupBy("scenario_label").agg(
        F.count("*").alias("session_count"),
        F.count_distinct(F.nullif(strip("position"), F.lit(""))).alias("position_count"),
        *[F.count_if(F.col("verdict") == v).alias(f"{v}_count") for v in verdicts],
    )
    considered = F.col("ok_count") + F.col("not_ok_count") + F.col("defect_count")
    rated = groups.withColumn("bad_rate", F.try_divide(F.col("not_ok_count") + F.col("defect_count"), considered))
    return rated.orderBy(*[F.col(c).desc() for c in ("defect_count", "not_ok_count", "session_count")], "scenario_label")


def overview(events: DataFrame, assessed: DataFrame) -> DataFrame:
    """Row status per position with the verdict counts of its sessions."""
    verdicts = ("ok", "not_ok", "defect", "no_data", "status_unavailable")
    by_session = (
        assessed.withColumn("position_number", position_number("position")).filter(F.col("position_number").isNotNull())
        .groupBy("position_number").agg(
            F.count("*").alias("session_count"), *[F.count_if(F.col("verdict") == v).alias(f"{v}_session_count") for v in verdicts]
        )
    )
    joined = position_status(events).join(by_session, "position_number", "full_outer")
    counts = ["considered_rows", "pass_rows", "not_ok_rows", "session_count", *[f"{v}_session_count" for v in verdicts]]
    label = F.coalesce("position_label", F.concat(F.lit("P"), F.col("position_number").cast("string")))
    return joined.fillna(0, counts).withColumn("position_label", label).orderBy(
        F.coalesce("defect_rate", F.lit(0.0)).desc(), F.coalesce("bad_rate", F.lit(0.0)).desc(), F.col("not_ok_rows").desc(), "position_number"
    )


def metric_toplist(ranked: DataFrame, field: str, higher_is_better: bool = True, limit: int = TOPLIST_LIMIT) -> DataFrame:
    """Top groups by one metric: those with enough sessions, or all where none has."""
    known = ranked.filter(F.col(field).isNotNull())
    enough = F.broadcast(known.agg(F.coalesce(F.max(F.col("session_count") >= MIN_SESSIONS), F.lit(False)).alias("_any")))
    kept = known.crossJoin(enough).filter((F.col("session_count") >= MIN_SESSIONS) | ~F.col("_any")).drop("_any")
    value = F.col(field).desc() if higher_is_better else F.col(field).asc()
    return kept.orderBy(value, F.col("session_count").desc(), F.col("sample_count").desc(), "label").limit(limit)
