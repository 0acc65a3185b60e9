"""Text helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim all white space, not spaces only."""
    return F.regexp_replace(as_column(c).cast("string"), r"^\s+|\s+$", "")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def label_or_default(c: Column | str, default: str) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(default))


def text_or_blank(c: Column | str) -> Column:
    return F.coalesce(as_column(c).cast("string"), F.lit(""))


def clean_text(c: Column | str) -> Column:
    """Collapse white space and lower-case; NULL becomes ''."""
    return F.lower(strip(F.regexp_replace(text_or_blank(c), r"\s+", " ")))


def joined(*columns: Column | str) -> Column:
    return F.concat_ws(" ", *[text_or_blank(c) for c in columns])


def has_phrase(c: Column, phrases: str) -> Column:
    """Whole-phrase search in lower-cased text; ``phrases`` is an alternation."""
    return F.lower(c).rlike(f"(^|[^a-z])({phrases})([^a-z]|$)")


def scenario_hint(c: Column | str) -> Column:
    """Scenario family of a free-text hint (rfid, fod, nfc, charging); any other text stays as cleaned."""
    text = clean_text(c)
    return (
        F.when(text.contains("rfid") | text.contains("card position"), F.lit("rfid"))
        .when(text.contains("fod") | text.contains("foreign object"), F.lit("fod"))
        .when(text.contains("nfc"), F.lit("nfc"))
        .when(text.contains("0-100") | text.contains("charging 0 -100") | text.contains("wlc"), F.lit("charging"))
        .otherwise(text)
    )


def position_number(c: Column | str) -> Column:
    """Number of a position label such as ``P 3``."""
    return F.nullif(F.regexp_extract(as_column(c), r"(?i)\bP\s*(\d+)\b", 1), F.lit("")).try_cast("int")
