"""Scenario code and verdict of a rolled-up session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampertrace.functions.text import blank_to_null, has_phrase, joined, label_or_default

NEGATIVE = "not ok|no ok|nok"
INTERRUPTED = "toggling|toggling status|no charging|charging interrupted|charging interference|charging inter"


def overlaps(codes: Column, *wanted: str) -> Column:
    return F.arrays_overlap(codes, F.array(*[F.lit(w) for w in wanted]))


def within(codes: Column, *allowed: str) -> Column:
    return F.size(F.array_except(codes, F.array(*[F.lit(a) for a in allowed]))) == 0


def _facts(sessions: DataFrame) -> DataFrame:
    """Name every text blob and flag once; the branches below only combine them."""
    codes = F.coalesce(F.col("status_codes"), F.array().cast("array<string>"))
    full = F.lower(
        joined(
            "scenario_hint", "fod_object", "card_position", "position", "sample_label", "manual_result", "defect_id",
            "defect_comment", "source_csv_file", "dual_charging_label",
        )
    )
    card_text = F.lower(
        joined(
            "scenario_hint", "fod_object", "card_position", "sample_label", "manual_result", "defect_comment",
            "source_csv_file",
        )
    )
    object_text = F.lower(joined("scenario_hint", "fod_object", "defect_comment"))
    result_text = F.lower(joined("scenario_hint", "manual_result", "defect_comment"))
    charge_text = F.lower(joined("scenario_hint", "source_csv_file", "manual_result"))
    staged = sessions.withColumns(
        {
            "status_codes": codes,
            "hint_blob": full,
            "_card_text": card_text,
            "_object_text": object_text,
            "_result_text": result_text,
            "_charge_text": charge_text,
            "has_fod_object": blank_to_null("fod_object").isNotNull(),
            "has_card_position": blank_to_null("card_position").isNotNull(),
            "interruption_count": F.coalesce("interruption_count", F.lit(0)),
            "drop_issue_count": F.coalesce("eff_drop_count", F.lit(0))
            + F.coalesce("rx_drop_count", F.lit(0))
            + F.coalesce("tx_drop_count", F.lit(0)),
            "has_explicit_defect_reference": blank_to_null("defect_id").isNotNull()
            | has_phrase(joined("defect_comment", "source_csv_file", "manual_result"), "defect"),
        }
    )
    has = lambda c, *parts: _any([F.col(c).contains(p) for p in parts])
    return staged.withColumns(
        {
            "has_status_readout": F.exists("status_codes", lambda code: code != "N/A"),
            "_rfid": F.col("has_card_position") | overlaps(F.col("status_codes"), "15", "16") | has("_card_text", "rfid"),
            "_fod": F.col("has_fod_object") | has("_object_text", "fod", "foreign object"),
            "_nfc": has("_result_text", "nfc") & ~has("_result_text", "rfid"),
            "_full_charge": has("_charge_text", "charging 0-100%", "charging 0 -100%", "0-100%"),
            "_negative": has_phrase(F.col("hint_blob"), NEGATIVE),
            "_positive": has_phrase(F.col("hint_blob"), "ok") & ~has_phrase(F.col("hint_blob"), NEGATIVE),
        }
    )


def _any(conditions: list[Column]) -> Column:
    merged = conditions[0]
    for condition in conditions[1:]:
        merged = merged | condition
    return merged


def first_match(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """Ordered decision table: the result of the first condition that holds."""
    column = F.lit(otherwise)
    for condition, result in reversed(rules):
        column = F.when(condition, F.lit(result)).otherwise(column)
    return column


def scenario_code() -> Column:
    codes = F.col("status_codes")
    return first_match(
        [
            (F.col("_rfid"), "rfid"),
            (F.col("_fod"), "fod"),
            (F.col("_nfc"), "nfc"),
            (F.col("_full_charge") | F.col("_charge_text").contains("wlc"), "charging"),
            (overlaps(codes, "4", "6") & ~overlaps(codes, "2", "3"), "unknown"),
        ],
        "charging",
    )


def base_verdict() -> Column:
    codes, blob, text = F.col("status_codes"), F.col("hint_blob"), F.col("_result_text")
    silent = ~F.col("has_status_readout")
    fod, nfc = F.col("_fod"), F.col("_nfc")
    told_bad = has_phrase(text, NEGATIVE)
    return first_match(
        [
            (silent & nfc & told_bad, "not_ok"),
            (silent & nfc & has_phrase(text, "ok") & ~told_bad, "ok"),
            (silent, "other"),
            (F.col("_rfid") & within(codes, "15", "16"), "ok"),
            (F.col("_rfid"), "not_ok"),
            (fod & blob.contains("no fod detected"), "not_ok"),
            (fod & blob.contains("inappropriate temperature"), "not_ok"),
            (fod & overlaps(codes, "3", "5"), "not_ok"),
            (fod & overlaps(codes, "8", "9", "13", "14", "17"), "not_ok"),
            (fod & overlaps(codes, "4", "6"), "ok"),
            (nfc & F.col("_negative"), "not_ok"),
            (nfc & F.col("_positive"), "ok"),
            (overlaps(codes, "0", "1", "4", "6", "8", "9", "13", "14", "17"), "not_ok"),
            (has_phrase(blob, INTERRUPTED), "not_ok"),
            (
                F.col("_full_charge")
                & within(codes, "2", "3")
                & overlaps(codes, "3")
                & (F.coalesce("last_status", F.lit("")) == "2"),
                "ok",
            ),
            (within(codes, "3"), "ok"),
        ],
        "warning",
    )


def final_verdict() -> tuple[Column, Column]:
    base, stops, drops = F.col("base_verdict"), F.col("interruption_count"), F.col("drop_issue_count")
    issue = (stops > 0) | (drops > 0)
    severe = F.col("has_explicit_defect_reference") | (stops >= 2) | (drops >= 2)
    verdict = (
        F.when((base == "ok") & issue, F.lit("not_ok"))
        .when((base == "not_ok") & severe, F.lit("defect"))
        .otherwise(base)
    )
    return verdict, (base == "ok") & ~issue


def classify_sessions(sessions: DataFrame) -> DataFrame:
    """Scenario, base and final verdict plus the labels the ranking groups by."""
    verdict, clean = final_verdict()
    facts = _facts(sessions)
    out = (
        facts.withColumn("scenario_code", scenario_code())
        .withColumn("base_verdict", base_verdict())
        .withColumn("verdict", verdict)
        .withColumn("is_clean", clean)
        .withColumns(
            {
                "phone_label": label_or_default("phone", "brak telefonu"),
                "project_label": label_or_default("project_number", "brak projektu"),
                "software_label": label_or_default("software_version", "brak release"),
            }
        )
    )
    return out.drop(*[c for c in out.columns if c.startswith("_")])
