"""Candidate flags, filter scopes, listings and filter options."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampertrace.functions.payload import FALSE_WORDS, TRUE_WORDS
from ampertrace.functions.text import blank_to_null, has_phrase, joined, text_or_blank
from ampertrace.operators.ordered import group_key

# Statuses and phrases that make a row worth looking at.
PROBLEM_STATUSES = ("0", "1", "4", "5", "6", "8", "9", "13", "14", "17")
BAD_RESULT = "not ok|no ok|nok"
BAD_COMMENT = "not ok|no ok|nok|defect|failure|charging inter|no charging|toggling"
BAD_COMMENT_SHORT = "not ok|no ok|nok|defect|failure"
SEARCH_COLUMNS = (
    "raw_id", "device_name", "source_csv_file", "charger_name", "phone", "position", "project_number",
    "software_version",
)
SORT_COLUMNS = ("raw_id", "event_ts", "inserted_at", "device_name", "charger_name")
OPTION_COLUMNS = ("phone", "project_number", "software_version", "position")
GROUP_COLUMNS = ("phone", "project_number", "device_name", "charger_name", "position", "source_csv_file")
SESSION_BREAK_SECONDS = 20 * 60
CANDIDATE_ROW_MULTIPLIER = 4
ROWS_PER_GROUP = 12


def candidate_flag(df: DataFrame, variant: str = "processed") -> Column:
    """Whether a row needs attention. The four variants differ in the scenario and 15/16 clauses."""
    present = set(df.columns)

    def column(name: str) -> Column:
        return F.col(name) if name in present else F.lit(None).cast("string")

    status = blank_to_null(column("hmi_status"))
    has_defect = blank_to_null(column("defect_id")).isNotNull()
    has_card = blank_to_null(column("card_position")).isNotNull()
    has_object = blank_to_null(column("fod_object")).isNotNull()
    bad_result = has_phrase(text_or_blank(column("manual_result")), BAD_RESULT)
    bad_comment = has_phrase(text_or_blank(column("defect_comment")), BAD_COMMENT)
    if variant == "compat":
        used = [c for c in ("scenario_hint", "sample_label", "source_csv_file", "row_json") if c in present]
        scenario = F.lower(joined(*used)) if used else F.lit("")
    else:
        scenario = F.lower(text_or_blank(column("scenario_hint")))
    rfid = scenario.contains("rfid")
    fod = scenario.contains("fod")
    foreign = scenario.contains("foreign object")

    while_charging = has_card | has_object | rfid | fod
    if variant in ("processed", "compat"):
        while_charging = while_charging | foreign
    told = has_defect | bad_result
    protected = {
        "processed": told | bad_comment | has_object | fod | foreign | (~has_card & ~rfid),
        "sessions": ~rfid | told | bad_comment,
        "raw": told | has_phrase(text_or_blank(column("defect_comment")), BAD_COMMENT_SHORT) | (~has_card & ~rfid),
        "compat": ~rfid | told | bad_comment,
    }[variant]
    flag = F.coalesce(
        told
        | bad_comment
        | F.coalesce(status.isin(*PROBLEM_STATUSES), F.lit(False))
        | F.coalesce((status == "3") & while_charging, F.lit(False))
        | F.coalesce(status.isin("15", "16") & protected, F.lit(False)),
        F.lit(False),
    )
    if variant == "compat" and "analysis_candidate" in present:
        return F.coalesce(F.col("analysis_candidate"), flag)
    return flag


@dataclass(frozen=True)
class Scope:
    search_text: str = ""
    phone: str = ""
    project_number: str = ""
    software_version: str = ""
    position: str = ""
    sample: str = ""
    defect_id: str = ""
    dual_charging: str = ""
    event_ts_from: date | None = None
    event_ts_to: date | None = None
    inserted_at_from: date | None = None
    inserted_at_to: date | None = None
    result_class: str = ""
    hmi_status: str = ""


def _contains(c: Column, needle: str) -> Column:
    """Case-insensitive literal search: wildcards in the needle are escaped."""
    for special in ("\\", "%", "_"):
        needle = needle.replace(special, "\\" + special)
    return c.cast("string").ilike(f"%{needle}%")


def scope_conditions(scope: Scope) -> list[Column]:
    conditions: list[Column] = []
    if scope.search_text:
        conditions.append(reduce(lambda a, b: a | b, [_contains(F.col(c), scope.search_text) for c in SEARCH_COLUMNS]))
    for field, column in (
        ("phone", "phone"), ("project_number", "project_number"), ("software_version", "software_version"),
        ("position", "position"), ("sample", "sample_label"),
    ):
        if getattr(scope, field):
            conditions.append(F.col(column) == getattr(scope, field))
    if scope.defect_id:
        conditions.append(_contains(F.col("defect_id"), scope.defect_id))
    word = scope.dual_charging.strip().lower()
    if word in TRUE_WORDS or word in FALSE_WORDS:
        conditions.append(F.col("dual_charging_flag") == F.lit(word in TRUE_WORDS))
    for column in ("event_ts", "inserted_at"):
        first, last = getattr(scope, f"{column}_from"), getattr(scope, f"{column}_to")
        if first is not None:
            conditions.append(F.col(column) >= F.lit(first.isoformat()).cast("timestamp_ntz"))
        if last is not None:
            conditions.append(F.col(column) < F.lit((last + timedelta(days=1)).isoformat()).cast("timestamp_ntz"))
    return conditions


def apply_scope(df: DataFrame, scope: Scope) -> DataFrame:
    return reduce(lambda d, c: d.filter(c), scope_conditions(scope), df)


def recency(column: str = "event_ts") -> list[Column]:
    return [F.col(column).desc_nulls_last(), F.col("raw_id").desc()]


def page(df: DataFrame, sort_by: str, direction: str, number: int, size: int, total: int | None = None) -> DataFrame:
    """One page of a listing; the page number is clamped to the total."""
    if sort_by not in SORT_COLUMNS:
        raise ValueError(f"cannot sort by {sort_by}")
    total = df.count() if total is None else total
    last = max(1, -(-total // size))
    number = min(max(1, number), last)
    down = direction == "desc"
    column = F.col(sort_by)
    first = column.desc_nulls_last() if down else column.asc_nulls_last()
    tie = F.col("raw_id").desc() if down else F.col("raw_id").asc()
    return df.orderBy(first, tie).offset((number - 1) * size).limit(size)


def recent_candidates(df: DataFrame, n: int, by: str = "event_ts") -> DataFrame:
    return df.filter("analysis_candidate").orderBy(*recency(by)).limit(n)


def recent_rows(df: DataFrame, n: int, by: str = "event_ts") -> DataFrame:
    return df.orderBy(*recency(by)).limit(n)


def with_total(df: DataFrame) -> DataFrame:
    """Every row with the total row count, from a separate one-row aggregate."""
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias("total_rows"))))


def with_group(df: DataFrame) -> DataFrame:
    """Adds ``_g``, the group identity in which NULL and blank are equal."""
    return df.withColumn("_g", F.concat_ws("\u0001", *[text_or_blank(c) for c in GROUP_COLUMNS]))


def top_groups(df: DataFrame, n: int) -> DataFrame:
    """Groups with the most recent candidate rows."""
    blanks = [text_or_blank(c).alias(c) for c in GROUP_COLUMNS]
    return (
        df.filter("analysis_candidate")
        .groupBy(*blanks)
        .agg(F.max("event_ts").alias("last_candidate_ts"))
        .orderBy(F.col("last_candidate_ts").desc_nulls_last(), *GROUP_COLUMNS)
        .limit(n)
    )


def restrict_to_groups(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of the given groups; blank and NULL keys are equal."""
    return with_group(df).join(with_group(groups).select("_g").distinct(), "_g", "left_semi").drop("_g")


def trim_groups(df: DataFrame, n_groups: int, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """The most recent ``n_groups`` groups with at most ``rows_per_group`` recent rows each.

    Both limits are the feature. Spark prunes each group to its first rows before the shuffle.
    """
    keyed = with_group(df)
    recent = (
        keyed.groupBy("_g")
        .agg(F.max(F.struct(F.col("event_ts"), F.col("raw_id"))).alias("_latest"))
        .orderBy(F.col("_latest").desc_nulls_last())
        .limit(n_groups)
    )
    place = Window.partitionBy("_g").orderBy(*recency())
    return (
        keyed.join(recent.select("_g"), "_g", "left_semi")
        .withColumn("_place", F.row_number().over(place))
        .filter(F.col("_place") <= rows_per_group)
        .drop("_g", "_place")
    )


def expand_windows(df: DataFrame, seeds: DataFrame, pad_seconds: int = SESSION_BREAK_SECONDS) -> DataFrame:
    """Rows of the seeds' groups between each group's first seed - pad and last seed + pad.

    Every group has one window, so a row matches at most once and no de-duplication is needed
    unless ``raw_id`` repeats in the input.
    """
    pad = F.make_dt_interval(secs=F.lit(pad_seconds))
    windows = (
        with_group(seeds.filter(F.col("event_ts").isNotNull()))
        .groupBy("_g")
        .agg((F.min("event_ts") - pad).alias("_from"), (F.max("event_ts") + pad).alias("_to"))
    )
    return (
        with_group(df)
        .join(windows, "_g")
        .filter(F.col("event_ts").between(F.col("_from"), F.col("_to")))
        .drop("_g", "_from", "_to")
    )


def distinct_on(df: DataFrame, key: str, order: Sequence[Column], columns: Sequence[str] | None = None) -> DataFrame:
    """First row per key in the given order, by a map-side combinable aggregate."""
    names = list(columns or df.columns)
    best = df.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-blank values per column, as (field, value)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return (
        df.select(pairs.alias("_p")).select("_p.*").filter(blank_to_null("value").isNotNull()).distinct()
        .orderBy("field", "value")
    )


def filter_options(df: DataFrame) -> DataFrame:
    return distinct_values(df, OPTION_COLUMNS)


def device_group(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumn("_device", group_key(*columns))
