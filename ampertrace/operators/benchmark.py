"""Reference workbooks: cell classes, rollups and comparison with live data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampertrace.functions.text import as_column, strip
from ampertrace.operators.workitems import top_values

# Workbook colours, first position column per sheet, scenario of a sheet.
GREEN = ("FF00B050", "FF47D359", "FF92D050")
YELLOW = ("FFFFCC00", "FFF2CEEF")
RED = ("FFFF4B4B",)
SHEETS = {
    "CHARGING 0 -100 %": ("charging", "Charging 0-100%", 6),
    "NFC": ("nfc", "NFC", 6),
    "FOD": ("fod", "FOD", 9),
    "WLC": ("wlc", "WLC", 7),
    "RFID Protection": ("rfid_primary", "RFID Protection", 6),
    "RFID Protection_2": ("rfid_secondary", "RFID Protection 2", 6),
}


def cell_text(c: Column | str) -> Column:
    return strip(F.regexp_replace(F.coalesce(as_column(c), F.lit("")), r"\s+", " "))


def status_codes(c: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(as_column(c), F.lit(r"(?i)\b(?:status|state)\s*(\d+)\b"), F.lit(1))))


def _number(c: Column, pattern: str) -> Column:
    return F.translate(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")), ",", ".").try_cast("double")


def percent(c: Column | str) -> Column:
    return _number(as_column(c), r"(-?\d+(?:[.,]\d+)?)\s*%")


def temperature(c: Column | str) -> Column:
    text = as_column(c)
    return F.coalesce(
        _number(text, r"(?i)(-?\d+(?:[.,]\d+)?)\s*(?:°c|â°c|c)\b"), _number(text, r"(?i)temp\s*(-?\d+(?:[.,]\d+)?)")
    )


def _has_status(low: Column, codes: str) -> Column:
    return low.rlike(rf"\b(?:status|state)\s*(?:{codes})\b")


# One line per rule and sheet group, first hit decides: name, class. Conditions are in _conditions().
_CELL_RULES = {
    "nfc": (("nfc_ok", "pass"), ("nfc_no_ok", "not_ok"), ("defect_note", "defect")),
    "charging": (
        ("defect_note", "defect"), ("status_3", "pass"), ("status_2_full", "pass"), ("blower", "not_ok"),
        ("unstable", "not_ok"), ("system_error", "not_ok"), ("other_status", "not_ok"),
    ),
    "fod": (
        ("stopped", "skip"), ("no_detection", "not_ok"), ("red", "defect"), ("yellow", "not_ok"), ("green", "pass"),
        ("hot", "not_ok"), ("fod_error", "not_ok"), ("fod_block", "pass"), ("fod_charging", "not_ok"),
        ("percent_only", "not_ok"),
    ),
    "rfid": (("defect_note", "defect"), ("protected", "pass"), ("toggling", "not_ok"), ("rfid_status", "not_ok")),
}


def _conditions(sheet: Column, low: Column, fill: Column) -> dict[str, Column]:
    codes = status_codes(low)
    any_of = lambda *s: F.arrays_overlap(codes, F.array(*[F.lit(x) for x in s]))
    coloured = lambda fills: F.coalesce(fill.isin(*fills), F.lit(False))
    return {
        "nfc_ok": low == "ok",
        "nfc_no_ok": low.contains("no ok") | (low == "nok"),
        "defect_note": low.contains("defect id") | low.startswith("defect "),
        "status_3": _has_status(low, "3"),
        "status_2_full": (sheet == "CHARGING 0 -100 %") & low.rlike(r"\bstatus\s*2\b"),
        "blower": low.contains("blower fault"),
        "unstable": low.contains("toggling") | low.contains("no charging") | low.contains("charging inter"),
        "system_error": _has_status(low, "8|9|13|14|17"),
        "other_status": _has_status(low, "0|1|4|5|6|15|16"),
        "stopped": low.startswith("test were stopped"),
        "no_detection": low.contains("no fod detected") | low.contains("no charging"),
        "red": coloured(RED),
        "yellow": coloured(YELLOW),
        "green": coloured(GREEN),
        "hot": F.coalesce(temperature(low) >= 45, F.lit(False)),
        "fod_error": any_of("13", "17"),
        "fod_block": any_of("4", "6"),
        "fod_charging": any_of("3", "5"),
        "percent_only": percent(low).isNotNull(),
        "protected": _has_status(low, "15|16"),
        "toggling": low.contains("toggling"),
        "rfid_status": _has_status(low, "1|3|4|6|8|9|13|17"),
    }


def classify_cell(sheet: Column | str, text: Column | str, fill: Column | str) -> Column:
    """Struct of class (pass, not_ok, defect, skip or NULL) and the rule that decided."""
    sheet, fill, low = as_column(sheet), as_column(fill), F.lower(cell_text(text))
    conditions = _conditions(sheet, low, fill)
    groups = {
        "nfc": sheet == "NFC",
        "charging": sheet.isin("CHARGING 0 -100 %", "WLC"),
        "fod": sheet == "FOD",
        "rfid": sheet.isin("RFID Protection", "RFID Protection_2"),
    }
    hits = [
        F.when(groups[g] & conditions[rule], F.struct(F.lit(kind).alias("category"), F.lit(rule).alias("rule")))
        for g, rules in _CELL_RULES.items()
        for rule, kind in rules
    ]
    empty = (low == "") | low.isin("#value!", "#ref!", "-", "n/a", "na")
    skip = low.contains("test not required") | (low == "tested") | low.startswith("tested on sw")
    return F.when(
        ~empty, F.when(skip, F.struct(F.lit("skip").alias("category"), F.lit("not_required").alias("rule"))).otherwise(F.coalesce(*hits))
    )


def classified_cells(cells: DataFrame) -> DataFrame:
    """Cells that have a class, with scenario and position number (columns project_number, file, sheet, col_no, text, fill_rgb)."""
    code = F.create_map(*[F.lit(x) for s, (c, _, _) in SHEETS.items() for x in (s, c)])
    start = F.create_map(*[F.lit(x) for s, (_, _, n) in SHEETS.items() for x in (s, n)])
    rows = cells.filter(F.col("sheet").isin(*SHEETS)).withColumns(
        {
            "scenario_code": F.try_element_at(code, F.col("sheet")),
            "position_number": F.col("col_no") - F.try_element_at(start, F.col("sheet")) + 1,
            "_class": classify_cell("sheet", "text", "fill_rgb"),
        }
    )
    return rows.filter((F.col("position_number") >= 1) & F.col("_class").isNotNull()).withColumns(
        {"category": F.col("_class.category"), "rule": F.col("_class.rule")}
    ).drop("_class")


def _rates(groups: DataFrame) -> DataFrame:
    considered = F.col("pass_count") + F.col("not_ok_count") + F.col("defect_count")
    return groups.withColumns(
        {
            "bad_rate": F.try_divide(F.col("not_ok_count") + F.col("defect_count"), considered),
            "defect_rate": F.try_divide("defect_count", considered),
        }
    )


def _category_counts() -> list[Column]:
    return [F.count_if(F.col("category") == c).alias(f"{c}_count") for c in ("pass", "not_ok", "defect", "skip")]


def benchmark_by_scenario(cells: DataFrame) -> DataFrame:
    rows = classified_cells(cells)
    keys = ["project_number", "scenario_code"]
    out = rows.groupBy(*keys).agg(
        F.count_distinct("file").alias("file_count"), F.count_distinct("position_number").alias("position_count"), *_category_counts()
    )
    statuses = rows.select(*keys, F.explode(status_codes(cell_text("text"))).alias("status"))
    fills = rows.select(*keys, F.coalesce("fill_rgb", F.lit("")).alias("fill"))
    for source, value, name in ((statuses, "status", "top_statuses"), (fills, "fill", "top_fills"), (rows, "rule", "top_rules")):
        out = out.join(top_values(source, keys, value, 4, name), keys, "left")
    return _rates(out)


def benchmark_by_position(cells: DataFrame) -> DataFrame:
    rows = classified_cells(cells)
    return _rates(
        rows.groupBy("project_number", "position_number").agg(
            F.count_distinct("scenario_code").alias("scenario_count"), *_category_counts()
        )
    )


def compare_benchmark(live: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Live positions against benchmark positions (position_number, bad_rate, defect_rate each)."""
    left = live.select("position_number", F.col("bad_rate").alias("live_bad_rate"), F.col("defect_rate").alias("live_defect_rate"))
    right = benchmark.select(
        "position_number", F.col("bad_rate").alias("benchmark_bad_rate"), F.col("defect_rate").alias("benchmark_defect_rate")
    )
    joined = left.join(right, "position_number", "full_outer")
    bad = F.col("live_bad_rate") - F.col("benchmark_bad_rate")
    defect = F.coalesce("live_defect_rate", F.lit(0.0)) - F.coalesce("benchmark_defect_rate", F.lit(0.0))
    verdict = (
        F.when(bad.isNull(), F.lit("neutral"))
        .when((defect > 0.03) | (bad > 0.12), F.lit("critical"))
        .when(bad > 0.05, F.lit("warn"))
        .when(bad < -0.08, F.lit("ok"))
        .otherwise(F.lit("neutral"))
    )
    return joined.withColumn("verdict_class", verdict)


def infer_project(df: DataFrame, benchmark: DataFrame, given: str = "") -> DataFrame:
    """One row with the project to compare with: the given one, else the only one present, if it has a benchmark."""
    known = benchmark.select("project_number").distinct()
    project = strip("project_number")
    present = df.agg(F.min(F.nullif(project, F.lit(""))).alias("low"), F.max(F.nullif(project, F.lit(""))).alias("high"))
    only = present.select(F.when(F.col("low") == F.col("high"), F.col("low")).alias("project_number"))
    found = only.join(known, "project_number", "left_semi").select("project_number", F.lit(1).alias("_rank"))
    if given:
        asked = df.sparkSession.range(1).select(F.lit(given).alias("project_number"))
        found = found.unionByName(asked.join(known, "project_number", "left_semi").select("project_number", F.lit(0).alias("_rank")))
    return found.agg(F.coalesce(F.min_by("project_number", "_rank"), F.lit("")).alias("project_number"))
