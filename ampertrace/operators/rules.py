"""Project rules: scenario inference and verdict of a report session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampertrace.functions.text import blank_to_null, strip
from ampertrace.operators.ordered import attach_facts
from ampertrace.operators.verdicts import overlaps, within
from ampertrace.session import cut_lineage

# Status sets of the rules. All project profiles use the same sets today.
CHARGING_FAILURE = ("0", "1", "4", "6", "8", "9", "13", "14", "17")
CHARGING_CONTEXT = ("2", "5", "15", "16")
FOD_PASS = ("4", "6")
FOD_NOT_OK = ("3", "5", "8", "9", "13", "14", "17")
FOD_SYSTEM = ("8", "9", "13", "14", "17")
RFID_PASS = ("15", "16")
CHARGING_OK = ("3",)
PROFILED_PROJECTS = ("0854_086", "0854_108")
PROBLEM_VERDICTS = ("warning", "not_ok", "defect")

_PROFILE_SETS = {
    "charging_ok_statuses": CHARGING_OK,
    "charging_not_ok_statuses": CHARGING_FAILURE + CHARGING_CONTEXT,
    "rfid_pass_statuses": RFID_PASS,
    "rfid_not_ok_statuses": (),
    "fod_pass_statuses": FOD_PASS,
    "fod_not_ok_statuses": FOD_NOT_OK,
}


def profiles(spark: SparkSession) -> DataFrame:
    """Rule profiles by project; the row ``default`` serves all others."""
    schema = T.StructType(
        [T.StructField("profile_project", T.StringType())]
        + [T.StructField(n, T.ArrayType(T.StringType())) for n in _PROFILE_SETS]
    )
    rows = [(p, *[list(v) for v in _PROFILE_SETS.values()]) for p in ("default", *PROFILED_PROJECTS)]
    return spark.createDataFrame(rows, schema)


def with_profile(sessions: DataFrame, profile_table: DataFrame | None = None) -> DataFrame:
    """Attach the project's rule sets, or the default ones. The profile table has a row per profiled project."""
    table = profiles(sessions.sparkSession) if profile_table is None else profile_table
    own = table.filter(F.col("profile_project") != "default").withColumnsRenamed({n: f"_own_{n}" for n in _PROFILE_SETS})
    default = table.filter(F.col("profile_project") == "default").drop("profile_project")
    joined = sessions.join(own, strip("project_number") == F.col("profile_project"), "left").crossJoin(default)
    return joined.withColumns({n: F.coalesce(f"_own_{n}", n) for n in _PROFILE_SETS}).drop(
        "profile_project", *[f"_own_{n}" for n in _PROFILE_SETS]
    )


def _has(c: str) -> Column:
    return blank_to_null(c).isNotNull()


def scenario_rules() -> Column:
    """Struct of scenario code, label and confidence."""
    codes = F.col("status_codes")

    def result(code: str, label: str | Column, confidence: str | Column) -> Column:
        text = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(F.lit(code).alias("code"), text(label).alias("label"), text(confidence).alias("confidence"))

    rfid_label = F.when(F.col("t_protection_2"), F.lit("RFID Protection 2")).otherwise(F.lit("RFID Protection"))
    rfid_codes = F.concat("rfid_pass_statuses", "rfid_not_ok_statuses")
    mixed = result("unknown", "Unknown / mixed", "low")
    return (
        F.when(_has("card_position") | F.arrays_overlap(codes, rfid_codes) | F.col("t_rfid"), result("rfid", rfid_label, "high"))
        .when(_has("fod_object") | F.col("t_fod"), result("fod", "FOD", "high"))
        .when(F.col("t_nfc"), result("nfc", "NFC", "medium"))
        .when(F.col("t_full_charge_scenario") | F.col("t_wlc"), result("charging", "Charging / WLC", "high"))
        .when(codes == F.array(F.lit("5")), mixed)
        .when(overlaps(codes, "4", "6") & ~overlaps(codes, "2", "3"), mixed)
        .otherwise(
            result(
                "charging", "Charging / WLC", F.when(F.size(codes) > 0, F.lit("medium")).otherwise(F.lit("low"))
            )
        )
    )


def completed_normally() -> Column:
    codes = F.col("status_codes")
    return F.col("t_full_charge") & within(codes, "2", "3") & (F.col("last_status") == "2") & overlaps(codes, "3")


# One row per rule: scenario, name, verdict, may become a defect. Conditions and suspect statuses are
# in _conditions(); the first rule of a scenario that holds decides.
_RULES = (
    ("rfid", "rfid_protected", "ok", False),
    ("rfid", "rfid_not_protected", "not_ok", True),
    ("fod", "fod_text", "not_ok", True),
    ("fod", "fod_still_charging", "not_ok", True),
    ("fod", "fod_unwanted_block", "not_ok", True),
    ("fod", "fod_system_error", "not_ok", True),
    ("fod", "fod_blocked", "ok", False),
    ("fod", "fod_unclear", "warning", False),
    ("nfc", "nfc_negative", "not_ok", False),
    ("nfc", "nfc_positive", "ok", False),
    ("nfc", "nfc_unclear", "no_data", False),
    ("unknown", "unknown_failure", "not_ok", True),
    ("unknown", "unknown_unclear", "warning", False),
    ("charging", "charge_completed", "ok", False),
    ("charging", "charge_failure_status", "not_ok", True),
    ("charging", "charge_text", "not_ok", True),
    ("charging", "charge_running", "ok", False),
    ("charging", "charge_full_only", "warning", False),
    ("charging", "charge_unconfirmed", "warning", False),
    ("charging", "charge_context_status", "warning", False),
    ("charging", "charge_unusual", "warning", False),
)


def _conditions() -> dict[str, tuple[Column, Column]]:
    """Rule name -> (condition, statuses that count as evidence for repeatability)."""
    codes = F.col("status_codes")
    none = F.array().cast("array<string>")
    yes = F.lit(True)
    among = lambda *s: F.array_intersect(codes, F.array(*[F.lit(x) for x in s]))
    return {
        "rfid_protected": (F.size(F.array_except(codes, "rfid_pass_statuses")) == 0, none),
        "rfid_not_protected": (yes, F.array_except(codes, "rfid_pass_statuses")),
        "fod_text": (F.col("t_fod_problem"), codes),
        "fod_still_charging": (overlaps(codes, "3", "5"), among("3", "5")),
        "fod_unwanted_block": (overlaps(codes, "6") & F.col("t_charging_problem"), among("6")),
        "fod_system_error": (overlaps(codes, *FOD_SYSTEM), among(*FOD_SYSTEM)),
        "fod_blocked": (F.arrays_overlap(codes, "fod_pass_statuses"), none),
        "fod_unclear": (yes, none),
        "nfc_negative": (F.col("t_nfc_problem"), none),
        "nfc_positive": (F.col("t_ok"), none),
        "nfc_unclear": (yes, none),
        "unknown_failure": (overlaps(codes, *CHARGING_FAILURE), among(*CHARGING_FAILURE)),
        "unknown_unclear": (yes, none),
        "charge_completed": (completed_normally(), none),
        "charge_failure_status": (overlaps(codes, *CHARGING_FAILURE), among(*CHARGING_FAILURE)),
        "charge_text": (F.col("t_charging_problem"), codes),
        "charge_running": (F.size(F.array_except(codes, "charging_ok_statuses")) == 0, none),
        "charge_full_only": (codes == F.array(F.lit("2")), none),
        "charge_unconfirmed": (within(codes, "2", "3"), none),
        "charge_context_status": (overlaps(codes, "5", "15", "16"), among("5", "15", "16")),
        "charge_unusual": (yes, none),
    }


def _decide() -> Column:
    conditions = _conditions()
    decision = None
    for scenario, name, verdict, eligible in reversed(_RULES):
        condition, suspects = conditions[name]
        holds = (F.col("scenario_code") == scenario) & condition
        result = F.struct(
            F.lit(name).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(eligible).alias("eligible"),
            suspects.alias("suspects"),
        )
        decision = F.when(holds, result) if decision is None else F.when(holds, result).otherwise(decision)
    return decision


def _silent_verdict() -> Column:
    """Verdict of a session without any status."""
    return (
        F.when((F.col("scenario_code") == "nfc") & F.col("t_nfc_problem"), F.lit("not_ok"))
        .when((F.col("scenario_code") != "nfc") & F.col("t_not_applicable"), F.lit("not_applicable"))
        .when(F.col("project_has_status_readout") == F.lit(False), F.lit("status_unavailable"))
        .otherwise(F.lit("no_data"))
    )


def is_repeatable() -> Column:
    """Two bad samples, two interruptions, two alarms, or a problem text with three samples."""
    bad_samples = F.aggregate(
        F.filter("status_stats", lambda s: F.array_contains(F.col("_suspects"), s["status"])),
        F.lit(0).cast("long"),
        lambda n, s: n + s["n"],
    )
    text = F.col("t_charging_problem") | F.col("t_fod_problem")
    return (
        (bad_samples >= 2)
        | (F.col("interruption_count") >= 2)
        | (F.col("alarm_event_count") >= 2)
        | (text & (F.col("sample_count") >= 3))
    )


def assess(sessions: DataFrame, profile_table: DataFrame | None = None) -> DataFrame:
    """Adds scenario, verdict, severity and reason codes; input from ``annotate_project``."""
    codes = F.col("status_codes")
    staged = with_profile(sessions, profile_table).withColumn("_scenario", scenario_rules())
    staged = staged.withColumns(
        {
            "scenario_code": F.col("_scenario.code"),
            "scenario_label": F.col("_scenario.label"),
            "scenario_confidence": F.col("_scenario.confidence"),
            "_silent": F.size(codes) == 0,
        }
    )
    staged = staged.withColumn("_rule", _decide())
    stops, drops, alarms = (F.col(c) > 0 for c in ("interruption_count", "drop_count", "alarm_event_count"))
    issue = stops | drops | alarms
    base = F.col("_rule.verdict")
    staged = staged.withColumns(
        {
            "base_verdict": F.when(F.col("_silent"), _silent_verdict()).otherwise(base),
            "_moved": F.when(F.col("_silent"), _silent_verdict())
            .when(issue & (base == "ok"), F.lit("not_ok"))
            .otherwise(base),
            "_suspects": F.when(issue, codes).otherwise(F.col("_rule.suspects")),
        }
    )
    open_case = ~F.col("_silent") & (F.col("_moved") == "not_ok")
    setup = F.col("t_setup_issue") & ~F.col("t_defect")
    referenced = open_case & F.col("t_defect")
    repeated = open_case & ~setup & ~F.col("t_defect") & F.col("_rule.eligible") & is_repeatable()
    unconfirmed = open_case & ~setup & ~F.col("t_defect") & F.col("_rule.eligible") & ~is_repeatable()
    verdict = F.when(referenced | repeated, F.lit("defect")).otherwise(F.col("_moved"))
    base_score = F.when(base == "not_ok", 2).when(base.isin("warning", "no_data"), 1).otherwise(0)
    silent_score = (
        F.when(F.col("_moved") == "not_ok", 2).when(F.col("_moved") == "not_applicable", 1).otherwise(0)
    )
    score = (
        F.when(F.col("_silent"), silent_score)
        .when(referenced | repeated, F.lit(4))
        .otherwise(F.greatest(base_score, F.when(issue, F.lit(2)).otherwise(F.lit(0))))
    )
    loud = ~F.col("_silent")
    reasons = F.array_compact(
        F.array(
            F.when(loud, F.col("_rule.rule")),
            F.when(F.col("_silent"), F.concat(F.lit("no_status_"), F.col("_moved"))),
            F.when(loud & stops, F.lit("interruptions")),
            F.when(loud & drops, F.lit("metric_drops")),
            F.when(loud & alarms, F.lit("metric_alarms")),
            F.when(open_case & setup, F.lit("setup_issue")),
            F.when(referenced, F.lit("defect_reference")),
            F.when(repeated, F.lit("repeatable")),
            F.when(unconfirmed, F.lit("not_confirmed")),
        )
    )
    out = staged.withColumns({"verdict": verdict, "severity_score": score, "reasons": reasons, "is_repeatable": is_repeatable()})
    return cut_lineage(out.drop("_scenario", "_silent", "_rule", "_moved", "_suspects"))


def problem_time(assessed: DataFrame) -> DataFrame:
    """First sample whose status is a problem in the scenario, and the time of the problem.

    Without such a sample: start of the first metric or interruption event, else session start.
    """
    every = F.array(*[F.lit(str(i)) for i in range(18)])
    suspects = (
        F.when(~F.col("verdict").isin(*PROBLEM_VERDICTS) | (F.col("scenario_code") == "nfc"), F.array().cast("array<string>"))
        .when(F.col("scenario_code") == "rfid", F.array_except(every, "rfid_pass_statuses"))
        .when(F.col("scenario_code") == "fod", F.array_union("fod_not_ok_statuses", F.array(F.lit("4"), F.lit("6"))))
        .otherwise(F.col("charging_not_ok_statuses"))
    )
    staged = assessed.withColumn("_suspects", suspects)
    hit = F.get(F.filter("status_stats", lambda s: F.array_contains(F.col("_suspects"), s["status"])), F.lit(0))
    timed = F.when(F.size("status_codes") > 0, F.coalesce(hit["first"]["event_ts"], F.col("first_event_ts"), F.col("start_ts")))
    return staged.withColumns({"problem_status": hit["status"], "problem_ts": timed}).drop("_suspects")


def expectations() -> dict[str, Column]:
    """Allowed, warning and final statuses of the scenario; rfid and fod check every interval."""
    scenario = F.col("scenario_code")
    plain = F.array(F.lit("2"), F.lit("3"))
    none = F.array().cast("array<string>")
    return {
        "_allowed": F.when(scenario == "rfid", F.col("rfid_pass_statuses"))
        .when(scenario == "fod", F.col("fod_pass_statuses")).otherwise(plain),
        "_warning": F.when(scenario == "rfid", F.col("rfid_not_ok_statuses"))
        .when(scenario == "fod", F.col("fod_not_ok_statuses")).otherwise(none),
        "_final": F.when(scenario == "rfid", F.col("rfid_pass_statuses"))
        .when(scenario == "fod", F.col("fod_pass_statuses")).otherwise(F.array(F.lit("2"))),
        "_strict": scenario.isin("rfid", "fod"),
    }


def classify_intervals(intervals: DataFrame, assessed: DataFrame) -> DataFrame:
    """Adds ``marker`` (deviation, warning or NULL) to status intervals."""
    wanted = assessed.select("session_key", *[c.alias(n) for n, c in expectations().items()])
    real = F.col("status") != "N/A"
    spans = attach_facts(intervals, wanted, "session_key", "start_time")
    facts = spans.groupBy("session_key").agg(
        F.max(F.when(real, F.col("run"))).alias("_last_run"),
        F.max(real & F.array_contains("_allowed", F.col("status"))).alias("_any_allowed"),
    )
    checked = F.col("_strict") | (F.col("_any_allowed") & (F.col("run") != F.col("_last_run")))
    wrong = real & checked & ~F.array_contains("_allowed", F.col("status"))
    marker = F.when(
        wrong, F.when(F.array_contains("_warning", F.col("status")), F.lit("warning")).otherwise(F.lit("deviation"))
    )
    return (
        attach_facts(spans, facts, "session_key", "start_time")
        .withColumn("marker", marker)
        .withColumn("is_final", F.coalesce(F.col("run") == F.col("_last_run"), F.lit(False)))
        .withColumn("final_expected", F.when(F.col("is_final"), F.array_contains("_final", F.col("status"))))
        .drop("_allowed", "_warning", "_final", "_strict", "_last_run", "_any_allowed")
    )


def session_timelines(classified: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per session: deviation and warning counts, class and whether it ended as expected."""
    phone = F.lower(strip("phone"))
    readout = sessions.groupBy(phone.alias("_phone")).agg(F.max(F.size("status_codes") > 0).alias("_readout"))
    counts = classified.groupBy("session_key").agg(
        F.count_if(F.col("marker") == "deviation").alias("deviation_count"),
        F.count_if(F.col("marker") == "warning").alias("warning_count"),
        F.max(F.when(F.col("is_final"), F.col("status"))).alias("final_status"),
        F.coalesce(F.max("final_expected"), F.lit(False)).alias("ended_expected"),
        F.max(F.col("status") != "N/A").alias("_real"),
    )
    rows = sessions.select("session_key", phone.alias("_phone")).join(readout, "_phone").join(counts, "session_key")
    kind = (
        F.when(~F.col("_real"), F.when(F.col("_readout"), F.lit("missing_in_session")).otherwise(F.lit("no_readout")))
        .when(F.col("deviation_count") > 0, F.lit("deviation"))
        .when(F.col("warning_count") > 0, F.lit("warning"))
        .otherwise(F.lit("ok"))
    )
    return rows.withColumn("classification", kind).drop("_phone", "_readout", "_real")


def timeline_summary(timelines: DataFrame) -> DataFrame:
    silent = F.col("classification").isin("no_readout", "missing_in_session")
    return timelines.agg(
        F.count("*").alias("session_count"),
        F.count_if("ended_expected").alias("completed_sessions"),
        F.count_if(F.col("deviation_count") > 0).alias("sessions_with_deviation"),
        F.count_if(F.col("warning_count") > 0).alias("sessions_with_warning"),
        F.count_if(silent).alias("sessions_without_readout"),
        F.sum("deviation_count").alias("deviation_total"),
        F.sum("warning_count").alias("warning_total"),
    )


