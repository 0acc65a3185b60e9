"""Sessions by conflicting test context, as used by the problem report.

A blank context value never conflicts. A value conflicts when the session has already seen another
value of the same field. The sequential rule becomes a local one: let ``reach`` of a row be the
latest earlier place where one of its fields had a different value. The row opens a session exactly
when the current session started at or before ``reach``. Only rows with a ``reach`` (a changed value)
or a time gap can open a session, and most of these are certain from their direct neighbour.

Between two certain starts the others follow from pointers: if a session starts at p, the next one starts at the first row
whose reach is p or later, and that is a running minimum from the end. The pointers are composed with themselves, so that round k
holds the start 2^k sessions on, and the certain starts are then followed through all rounds, longest steps first. So a run of n
sessions takes log n joins, evenly dealt by row, whatever share of the rows a device has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampertrace.functions.payload import boolish, norm_status
from ampertrace.functions.text import clean_text, scenario_hint, strip, text_or_blank
from ampertrace.operators.ordered import MICROS, SLOT_SECONDS, micros, seconds_between, segment, with_history, with_running
from ampertrace.operators.sessions import DEVICE_KEYS, ORDER, SESSION_BREAK_SECONDS
from ampertrace.session import cut_lineage, spread

METRICS = ("eff", "rx", "tx", "rpp", "current_a", "voltage_v")
OTHER_COLUMNS = {
    "battery_level": "double", "temperature": "double", "row_json": "string", "card_position": "string",
    "fod_object": "string", "defect_comment": "string", "dual_charging_label": "string",
    "ingest_delay_seconds": "double",
}


def context_markers() -> dict[str, Column]:
    return {
        "software": F.nullif(clean_text("software_version"), F.lit("")),
        "sample": F.nullif(clean_text("sample_label"), F.lit("")),
        "scenario": F.nullif(scenario_hint("scenario_hint"), F.lit("")),
        "card": F.nullif(clean_text("card_position"), F.lit("")),
        "object": F.nullif(clean_text("fod_object"), F.lit("")),
        "dual": boolish("dual_charging_label").cast("string"),
    }


def _with_optional(events: DataFrame) -> DataFrame:
    wanted = {**{m: "double" for m in METRICS}, **OTHER_COLUMNS}
    return events.withColumns(
        {c: F.lit(None).cast(t) for c, t in wanted.items() if c not in events.columns}
    )


def _candidates(rows: DataFrame, gap_seconds: int) -> DataFrame:
    """Rows that can open a session, with ``_gap`` and ``_reach``. Only keys, order and markers are shuffled."""
    markers = context_markers()
    place = F.struct(*ORDER)
    narrow = rows.select("_device", *ORDER, *[c.alias(f"_m_{n}") for n, c in markers.items()])
    history = with_history(
        narrow,
        "_device",
        ORDER,
        previous={"event_ts": F.col("event_ts")},
        seen_before={
            f"_seen_{n}": F.when(F.col(f"_m_{n}").isNotNull(), F.struct(F.col(f"_m_{n}").alias("value"), place.alias("place")))
            for n in markers
        },
    )
    reach = F.greatest(
        *[F.when(F.col(f"_seen_{n}.value") != F.col(f"_m_{n}"), F.col(f"_seen_{n}.place")) for n in markers]
    )
    gap = F.col("prev").isNull() | (seconds_between(F.col("event_ts"), F.col("prev.event_ts")) > gap_seconds)
    return history.select("_device", *ORDER, gap.alias("_gap"), reach.alias("_reach")).filter("_gap or _reach is not null")


def _next_starts(candidates: DataFrame) -> DataFrame:
    """``_run p next``: for a session that starts at ``p`` where the next one of the run starts, if there is one."""
    reaches = candidates.select("_run", F.col("reach").alias("at"), F.lit(0).alias("kind"), F.col("p").alias("value"))
    starts = candidates.select("_run", F.col("p").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(candidates.schema["p"].dataType).alias("value"))
    back = reaches.filter("at is not null").unionByName(starts).withColumns(
        {"_time": -micros(F.col(f"at.{ORDER[0]}")), "_id": -F.col(f"at.{ORDER[1]}")}
    )
    slot = F.floor(F.col("_time") / F.lit(SLOT_SECONDS * MICROS))
    followed = with_running(back, "_run", ("_time", "_id", "kind"), {"next": ("min", F.col("value"))}, slot=slot)
    return followed.filter("kind = 1 and next is not null").select("_run", F.col("at").alias("p"), "next")


def _session_starts(candidates: DataFrame) -> DataFrame:
    runs = segment(
        candidates,
        "_device",
        ORDER,
        {"gap": F.col("_gap"), "reach": F.col("_reach"), "place": F.struct(*ORDER)},
        lambda row, previous: row["gap"] | (row["reach"] >= previous["place"]),
        seq="_block",
    )
    run = F.concat_ws("\u0001", "_device", F.col("_block").cast("string")).alias("_run")
    rows = cut_lineage(runs.select("_device", run, F.struct(*ORDER).alias("p"), F.col("_reach").alias("reach"), "is_start"))
    open_runs = rows.filter("not is_start").select("_run").distinct()
    # the first row of a run is certain, and what it reaches lies before the run
    pointed = rows.withColumn("reach", F.when(~F.col("is_start"), F.col("reach"))).join(open_runs, "_run", "left_semi")
    steps = [cut_lineage(_next_starts(pointed.select("_run", "p", "reach")))]
    while not steps[-1].isEmpty():
        further = steps[-1].select("_run", F.col("p").alias("next"), F.col("next").alias("_after"))
        steps.append(cut_lineage(steps[-1].join(further, ["_run", "next"]).select("_run", "p", F.col("_after").alias("next"))))
    found = rows.filter("is_start").select("_device", "_run", "p")
    for step in reversed(steps[:-1]):
        found = cut_lineage(found.unionByName(found.join(step, ["_run", "p"]).select("_device", "_run", F.col("next").alias("p"))))
    return found.select("_device", *[F.col(f"p.{c}").alias(c) for c in ORDER], F.lit(True).alias("_starts"))


def sessionize_context(events: DataFrame, gap_seconds: int = SESSION_BREAK_SECONDS) -> DataFrame:
    """Adds ``session_key``, ``session_start``, ``is_start``, ``status``, ``prev`` and ``prev_status``.

    ``prev`` holds time, status and metrics of the previous row, ``prev_status`` the latest real status
    before the row; both are NULL where they lie outside the session. The few candidate rows and the
    result are written once, because several later steps read them.
    """
    place = F.struct(*ORDER)
    rows = (
        _with_optional(spread(events))
        .filter(F.col("event_ts").isNotNull())
        .withColumns({c: strip(text_or_blank(c)) for c in DEVICE_KEYS})
        .withColumn("_device", F.concat_ws("\u0001", *DEVICE_KEYS))
        .withColumn("status", norm_status("hmi_status", "report"))
    )
    starts = _session_starts(cut_lineage(_candidates(rows, gap_seconds)))
    marked = rows.join(starts, ["_device", *ORDER], "left")
    out = with_history(
        marked,
        "_device",
        ORDER,
        previous={c: F.col(c) for c in ("event_ts", "status", *METRICS)},
        seen_upto={"_start": F.when(F.col("_starts"), place)},
        seen_before={
            "_real": F.when(F.col("status") != "N/A", F.struct(F.col("status").alias("status"), place.alias("place")))
        },
    )
    starts = F.coalesce(F.col("_starts"), F.lit(False))
    sessions = out.withColumns(
        {
            "session_key": F.md5(F.concat_ws("|", *DEVICE_KEYS, F.col("_start.raw_id").cast("string"))),
            "session_start": F.col("_start.event_ts"),
            "is_start": starts,
            "prev": F.when(~starts, F.col("prev")),
            "prev_status": F.when(F.col("_real.place") >= F.col("_start"), F.col("_real.status")),
        }
    ).drop("_device", "_starts", "_start", "_real")
    return cut_lineage(sessions)
