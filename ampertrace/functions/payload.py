"""Values out of open JSON payloads, and the scalar parsers around them.

Flat payloads, the common case, stay inside the JVM. Only payloads that hold nested objects or
arrays are shipped to an Arrow batch function that walks the tree.

Where several keys could match, the order of the candidate list decides; at each level the node's
own keys come before its children.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ampertrace.functions.text import as_column, blank_to_null, strip

# Key families per metric and text field.
METRIC_KEYS = {
    "rx": ("rx",),
    "tx": ("tx",),
    "rpp": ("rpp", "received_power", "rx_power", "power_rx"),
    "current_a": ("current (a)", "current_a", "coil_current", "rx_current"),
    "temperature": ("temperature", "temperature_c", "temp", "temp_c"),
    "battery_level": ("battery_level", "battery_percent", "battery_pct", "soc", "soc_percent"),
    "voltage_v": ("voltage", "voltage (v)", "voltage_v", "battery_voltage", "vbat"),
}
EFFICIENCY_KEYS = {
    "eff": ("eff", "efficiency"),
    "eff_left": ("eff_left_charger",),
    "eff_right": ("eff_right_charger",),
}
TEXT_KEYS = {
    "scenario_hint": (
        "scenario", "test_scenario", "test scenario", "sheet_name", "sheet", "worksheet", "tab_name", "test_type",
        "test type",
    ),
    "fod_object": ("fod object", "fod_object", "foreign object", "foreign_object", "foreign item", "fod item"),
    "card_position": (
        "card position", "card_position", "rfid card position", "nfc card position", "card location", "card_location",
    ),
    "sample_label": ("sample", "sample id", "sample_id", "prototype", "device sample"),
    "manual_result": ("result", "manual result", "manual_result", "test result", "verdict"),
    "defect_id": ("defect id", "defect_id", "defect", "bug id", "jira"),
    "defect_comment": ("defect comment", "defect_comment", "defect description", "comment", "remarks", "note"),
    "dual_charging_label": ("dual charging", "dual_charging", "dual charger", "dual"),
}
STATUS_KEYS = {"hmi_status": ("hmi_status",)}

TRUE_WORDS = ("true", "yes", "y", "tak", "1", "dual", "enabled")
FALSE_WORDS = ("false", "no", "n", "nie", "0", "single", "disabled")
NO_STATUS_WORDS = ("N/A", "NA", "NONE", "NULL", "NAN")

# Status codes and their meaning.
STATUS_DESCRIPTIONS = {
    "0": "Over/under voltage",
    "1": "Surface empty / IDLE",
    "2": "Phone fully charged",
    "3": "Phone charging",
    "4": "Foreign object detected (No Qi communication)",
    "5": "FOD and lower efficiency",
    "6": "Foreign object and cell phone detected, no charging",
    "7": "Charging interrupted by key search",
    "8": "WCM overtemperature",
    "9": "Control unit defective / error",
    "10": "WCM disabled",
    "11": "Charging interrupt due to energy availability",
    "12": "Charging with low power due to energy availability drop",
    "13": "Internal error from Qi device",
    "14": "Unknown error",
    "15": "Not active WCA NFC card - RFID protection",
    "16": "NFC not active - two or more NFC devices detected",
    "17": "WCA not active safe state involving FusI or ISO26262",
    "N/A": "Brak statusu w row_json",
}


def try_json(c: Column | str) -> Column:
    """Variant value, NULL for blank or invalid text.

    The parser ignores anything after the first value; inside brackets and inside an object it cannot.
    """
    text = blank_to_null(c)
    whole = (
        F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
        & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    )
    return F.when(whole, F.try_parse_json(text))


def try_float(c: Column | str) -> Column:
    """First plain decimal number in the text; a comma counts as decimal point, exponents do not."""
    return _try_float(as_column(c))


def _try_float(c: Column) -> Column:
    return F.regexp_extract(F.translate(c, ",", "."), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def norm_status(c: Column | str, mode: str = "sql") -> Column:
    """Digits of a status, else the upper-cased text. Mode ``report`` maps missing words to ``N/A``."""
    text = blank_to_null(c)
    digits = F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit(""))
    value = F.coalesce(digits, F.upper(text))
    if mode == "sql":
        return value
    missing = text.isNull() | F.upper(text).isin(*NO_STATUS_WORDS) | F.lower(text).isin("true", "false")
    return F.when(missing, F.lit("N/A")).otherwise(value)


def boolish(c: Column | str) -> Column:
    word = F.lower(strip(as_column(c).cast("string")))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def status_description(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in STATUS_DESCRIPTIONS.items() for x in pair])
    return F.coalesce(known[code], F.lit("Nieznany status"))


STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def payload_map(c: Column | str) -> Column:
    """Top level of a JSON object; nested values stay JSON text. NULL for anything that is not strict JSON."""
    return F.from_json(as_column(c), "map<string,string>", STRICT)


def payload_entries(c: Column | str) -> Column:
    """Top level of a JSON object as (lower-case key, text value) pairs."""
    return entries_of(payload_map(c))


def entries_of(top: Column) -> Column:
    return F.transform(
        F.map_entries(top), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value"))
    )


def _best_entry(entries: Column, keys: Sequence[str], parse) -> Column:
    """Parsed value of the first listed key that has one. Keys are compared before values are parsed."""
    order = F.array(*[F.lit(k) for k in keys])
    found = F.transform(
        F.filter(entries, lambda e: e["key"].isin(*keys)),
        lambda e, i: F.struct(F.array_position(order, e["key"]).alias("place"), i.alias("at"), parse(e["value"]).alias("value")),
    )
    return F.array_min(F.filter(found, lambda e: e["value"].isNotNull()))["value"]


def flat_metric(entries: Column, keys: Sequence[str]) -> Column:
    return _best_entry(entries, keys, _try_float)


def flat_text(entries: Column, keys: Sequence[str], json_null_is_text: bool = False) -> Column:
    value = _best_entry(entries, keys, lambda v: F.when(v != "", v))
    if json_null_is_text:
        null_hit = F.exists(entries, lambda e: e["key"].isin(*keys) & e["value"].isNull())
        return F.coalesce(value, F.when(null_hit, F.lit("null")))
    return value


_NUMBER = re.compile(r"-?\d+(?:\.\d+)?")


def _as_text(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, str):
        return value or None
    return json.dumps(value, ensure_ascii=False)


def _as_number(value) -> float | None:
    """A JSON number as it is; in any other value the first plain decimal number of its text."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        try:
            return float(value)
        except OverflowError:
            return None
    text = _as_text(value)
    match = _NUMBER.search(text.strip().replace(",", ".")) if text else None
    return float(match.group()) if match else None


def _reject(word: str):
    raise ValueError(f"{word} is not JSON")


def _parse(raw: str | None):
    """The value of strict JSON; None for anything unreadable, too deep nesting included."""
    if raw is None:
        return None
    try:
        return json.loads(raw, parse_constant=_reject)
    except (ValueError, RecursionError):
        return None


def _index(root, wanted: set[str]) -> dict[str, list]:
    """Values of the wanted keys in reading order: a node's own keys come before its children."""
    values: dict[str, list] = {}
    waiting = [root]
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict):
            for name, value in node.items():
                key = name.strip().lower()
                if key in wanted:
                    values.setdefault(key, []).append(value)
            children = list(node.values())
        else:
            children = node if isinstance(node, list) else []
        waiting += [child for child in reversed(children) if isinstance(child, (dict, list))]
    return values


def nested_fields(c: Column, metrics: dict[str, Sequence[str]], texts: dict[str, Sequence[str]]) -> Column:
    """Struct of all requested fields found anywhere in the tree; one JSON parse per row."""
    wanted = [(n, tuple(k), _as_number) for n, k in metrics.items()] + [(n, tuple(k), _as_text) for n, k in texts.items()]
    every_key = {key for _, keys, _ in wanted for key in keys}
    schema = ", ".join([f"`{n}` double" for n in metrics] + [f"`{n}` string" for n in texts])

    @F.pandas_udf(schema)
    def extract(payloads: pd.Series) -> pd.DataFrame:
        columns: dict[str, list] = {n: [] for n, _, _ in wanted}
        for raw in payloads:
            values = _index(_parse(raw), every_key)
            for name, keys, parse in wanted:
                hits = (parse(value) for key in keys for value in values.get(key, ()))
                columns[name].append(next((h for h in hits if h is not None), None))
        return pd.DataFrame(
            {n: pd.Series(v, dtype="float64" if parse is _as_number else "object") for (n, _, parse), v in zip(wanted, columns.values())}
        )

    return extract(c)


def is_flat(c: Column, top: Column) -> Column:
    """True where the top level (``payload_map``) says all; anything else needs the tree walk.

    That is one JSON object without brackets or braces inside, without numbers that have an exponent (as text they
    look like a text with a number in it) and without a key that is there twice.
    """
    keys = F.map_keys(top)
    plain = c.rlike(r"^\s*\{[^\[\]{}]*\}\s*$") & ~c.rlike(r":\s*-?[0-9.]+[eE]")
    return F.coalesce(plain & (F.size(keys) == F.size(F.array_distinct(keys))), F.lit(False))


def efficiency(direct: Column, left: Column, right: Column) -> Column:
    """Direct value, else the mean of both sides, else the side that is present."""
    return F.coalesce(direct, (left + right) / 2.0, left, right)


def first_field(c: Column | str, *keys: str) -> Column:
    """First non-null of several top-level keys; objects are unwrapped by value, text or content."""
    raw = as_column(c)
    found = []
    for key in keys:
        found += [F.get_json_object(raw, f"$['{key}'].{inner}") for inner in ("value", "text", "content")]
        plain = F.get_json_object(raw, f"$['{key}']")
        found.append(F.when(~plain.rlike(r"^\s*\{"), plain))
    return F.coalesce(*found)
