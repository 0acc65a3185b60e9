"""Session cutting and rules against a literal sequential version and golden rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ampertrace.operators import rules, spans
from ampertrace.operators.context_sessions import sessionize_context
from ampertrace.operators.report_sessions import annotate_project, finalize
from ampertrace.operators.sessions import build_sessions, sessionize_gap, sessionize_sql
from ampertrace.operators.verdicts import classify_sessions

START = datetime(2024, 1, 1)
COLUMNS = (
    "raw_id", "event_ts", "inserted_at", "device_name", "charger_name", "phone", "project_number", "position", "software_version",
    "source_csv_file", "scenario_hint", "fod_object", "card_position", "sample_label", "manual_result", "defect_id",
    "defect_comment", "dual_charging_label", "dual_charging_flag", "hmi_status", "eff", "rx", "tx", "temperature",
)
TYPES = {"raw_id": "long", "dual_charging_flag": "boolean", **{c: "double" for c in ("eff", "rx", "tx", "temperature")}}
SCHEMA = ", ".join(f"{c} {TYPES.get(c, 'timestamp_ntz' if c in ('event_ts', 'inserted_at') else 'string')}" for c in COLUMNS)


def event(raw_id, second, **values):
    row = dict.fromkeys(COLUMNS)
    row.update(raw_id=raw_id, event_ts=START + timedelta(seconds=second), inserted_at=START + timedelta(seconds=second + 5))
    row.update(device_name="d", charger_name="c", phone="p", project_number="0854_086", position="P1", software_version="1")
    row.update(values)
    return row


def frame(spark, events):
    return spark.createDataFrame([tuple(e[c] for c in COLUMNS) for e in events], SCHEMA).repartition(3)


def seqs(df):
    return [r["session_seq"] for r in df.orderBy("raw_id").collect()]


@pytest.mark.parametrize(
    "events, expected",
    [
        ([event(1, 0), event(2, 1200)], [1, 1]),
        ([event(1, 0), event(2, 1201)], [1, 2]),
        ([event(1, 0, sample_label="A"), event(2, 60)], [1, 2]),
        ([event(1, 0, phone=None), event(2, 1, phone="")], [1, 1]),
        ([event(1, 0), event(2, 0)], [1, 1]),
    ],
)
def test_sql_session_borders(spark, events, expected):
    assert seqs(sessionize_sql(frame(spark, events))) == expected


def test_null_and_blank_keys_are_different_devices(spark):
    out = build_sessions(frame(spark, [event(1, 0, phone=None), event(2, 1, phone="")]))
    assert out.count() == 2


def test_gap_sessions_need_more_than_fifteen_minutes(spark):
    assert seqs(sessionize_gap(frame(spark, [event(1, 0), event(2, 900), event(3, 1801)]), ("phone",))) == [1, 1, 2]


def test_interruptions_and_drops(spark):
    def rolled(events):
        return build_sessions(frame(spark, events)).first()

    def gaps(*seconds):
        at, out = 0, [event(0, 0)]
        for i, s in enumerate(seconds, 1):
            at += s
            out.append(event(i, at))
        return rolled(out)["interruption_count"]

    assert gaps(60, 60, 60, 301) == 1
    assert gaps(100, 100, 401) == 1
    assert gaps(100, 100, 400) == 0
    pair = lambda c, a, b: rolled([event(1, 0, **{c: a}), event(2, 60, **{c: b})])[f"{c}_drop_count"]
    assert [pair("eff", 60.0, 45.0), pair("eff", 70.0, 55.0), pair("rx", 10.0, 8.0), pair("rx", 0.0, -1.0)] == [1, 0, 1, 0]


def test_verdicts(spark):
    cases = [
        (dict(hmi_status="3"), "ok", True),
        (dict(hmi_status="2"), "warning", False),
        (dict(hmi_status="8", defect_id="X-1"), "defect", False),
        (dict(hmi_status=None), "other", False),
        (dict(hmi_status="15"), "ok", True),
        (dict(hmi_status="3", card_position="left"), "not_ok", False),
        (dict(hmi_status="4", fod_object="coin"), "ok", True),
        (dict(hmi_status="4", fod_object="coin", defect_comment="No FOD detected"), "not_ok", False),
        (dict(hmi_status=None, scenario_hint="NFC", manual_result="NOK"), "not_ok", False),
        (dict(hmi_status="7"), "warning", False),
    ]
    events = [event(i, 0, phone=f"p{i}", **values) for i, (values, _, _) in enumerate(cases)]
    got = {r["phone"]: (r["verdict"], r["is_clean"]) for r in classify_sessions(build_sessions(frame(spark, events))).collect()}
    assert got == {f"p{i}": (verdict, clean) for i, (_, verdict, clean) in enumerate(cases)}


CONTEXT = ("software_version", "sample_label", "card_position", "fod_object")


def loop_sessions(events):
    """The sequential rule, row by row."""
    out, seen, previous, current = {}, {}, None, None
    for e in sorted(events, key=lambda e: (e["event_ts"], e["raw_id"])):
        marks = {c: (e[c] or "").strip().lower() for c in CONTEXT}
        conflict = any(v and seen.get(c) and v != seen[c] for c, v in marks.items())
        if previous is None or conflict or (e["event_ts"] - previous).total_seconds() > 1200:
            current, seen = e["raw_id"], {}
        for c, v in marks.items():
            seen[c] = v or seen.get(c, "")
        out[e["raw_id"]], previous = current, e["event_ts"]
    return out


@pytest.mark.parametrize("seed, blank", [(1, 0.8), (2, 0.5), (3, 0.0), (4, 0.95)])
def test_context_sessions_equal_the_sequential_rule(spark, seed, blank):
    rng = random.Random(seed)
    events, at = [], 0
    for i in range(400):
        at += rng.choice([0, 1, 60, 600, 1200, 1201, 4000])
        values = {c: None if rng.random() < blank else rng.choice(["A", " b ", "c"]) for c in CONTEXT}
        events.append(event(i, at, **values))
    got = sessionize_context(frame(spark, events))
    starts = {r["session_key"]: r["raw_id"] for r in got.filter("is_start").collect()}
    assert {r["raw_id"]: starts[r["session_key"]] for r in got.collect()} == loop_sessions(events)


def test_a_long_run_of_uncertain_candidates_needs_no_fold(spark):
    """One device, two fields that change in turn and are blank in between: hardly a row is certain from its neighbour."""
    rows = spark.range(200_000).select(
        F.col("id").alias("raw_id"), F.timestamp_seconds(1_704_067_200 + F.col("id")).cast("timestamp_ntz").alias("event_ts"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("s"), (F.col("id") / 6).cast("int"))).alias("sample_label"),
        F.when(F.col("id") % 2 == 1, F.concat(F.lit("c"), (F.col("id") / 10).cast("int"))).alias("card_position"),
    )
    events = rows.select(*[F.col(c) if c in rows.columns else F.lit("x" if c == "phone" else None).cast(TYPES.get(c, "timestamp_ntz" if c == "inserted_at" else "string")).alias(c) for c in COLUMNS])
    got = sessionize_context(events)
    found = {r["raw_id"] for r in got.filter("is_start").select("raw_id").collect()}
    want, seen = set(), {}
    for i in range(200_000):
        field, value = ("s", i // 6) if i % 2 == 0 else ("c", i // 10)
        if not want or seen.get(field, value) != value:
            want.add(i)
            seen = {}
        seen[field] = value
    assert found == want and len(want) > 30_000


def test_intervals_completion_and_transitions(spark):
    statuses = [("3", 0), ("3", 60), ("2", 120)]
    ev = sessionize_context(frame(spark, [event(i, s, hmi_status=c, eff=50.0) for i, (c, s) in enumerate(statuses)]))
    runs = [(r["status"], r["duration_seconds"]) for r in spans.status_intervals(ev).orderBy("run").collect()]
    assert runs == [("3", 120.0), ("2", 60.0)]
    assert [r["raw_id"] for r in spans.metric_rows(ev).orderBy("raw_id").collect()] == [0, 1]
    only_full = sessionize_context(frame(spark, [event(1, 0, hmi_status="2"), event(2, 60, hmi_status="2")]))
    assert spans.metric_rows(only_full).count() == 0

    steps = [event(1, 0, eff=50.0, rx=2.0), event(2, 240, eff=55.0, rx=4.0), event(3, 480, eff=70.0, rx=4.0)]
    found = spans.transition_events(spans.with_metric_rows(sessionize_context(frame(spark, steps))))
    assert {(r["raw_id"], r["metric"], r["event_type"], r["severity"]) for r in found.collect()} == {
        (2, "eff", "spike", "warning"), (3, "eff", "spike", "alarm"),
    }


def test_sessions_partition_the_events_and_ignore_input_order(spark):
    rng = random.Random(7)
    events = [
        event(i, rng.randrange(0, 90_000), phone=rng.choice("ppq"), sample_label=rng.choice(["A", None]), hmi_status=rng.choice(["2", "3", "8", None]))
        for i in range(500)
    ]
    one = build_sessions(frame(spark, events))
    two = build_sessions(frame(spark, sorted(events, key=lambda e: -e["raw_id"])).repartition(7))
    assert one.agg(F.sum("source_row_count")).first()[0] == 500
    assert sorted(one.collect(), key=str) == sorted(two.collect(), key=str)


def test_problem_order(spark):
    from ampertrace.operators.problems import order_problems

    rows = [("a", "not_ok", 1), ("b", "defect", 9), ("c", "potential_defect", 0), ("d", "defect", 2), ("e", "defect", 2)]
    df = spark.createDataFrame(rows, "session_key string, classification string, sort_time int")
    assert [r["session_key"] for r in order_problems(df).collect()] == ["d", "e", "b", "a", "c"]


def test_rule_verdicts(spark):
    cases = [
        ([dict(hmi_status="3")], "ok"),
        ([dict(hmi_status="8")], "not_ok"),
        ([dict(hmi_status="8"), dict(hmi_status="8")], "defect"),
        ([dict(hmi_status="8", defect_comment="blower fault"), dict(hmi_status="8")], "not_ok"),
        ([dict(hmi_status="8", defect_comment="Defect ID: AB-1")], "defect"),
        ([dict(hmi_status="5", fod_object="coin")], "not_ok"),
        ([dict(hmi_status="4", fod_object="coin")], "ok"),
        ([dict(hmi_status=None)], "no_data"),
        ([dict(hmi_status=None, manual_result="Test not required")], "not_applicable"),
        ([dict(hmi_status=None, scenario_hint="NFC", manual_result="nok")], "not_ok"),
        ([dict(hmi_status="3", scenario_hint="Charging 0-100%"), dict(hmi_status="2", scenario_hint="Charging 0-100%")], "ok"),
        ([dict(hmi_status="2")], "warning"),
        ([dict(hmi_status="16", position="P9")], "ok"),
        ([dict(hmi_status="3", eff=60.0), dict(hmi_status="3", eff=40.0)], "not_ok"),
    ]
    events = [
        event(100 * i + j, 60 * j, phone=f"p{i}", **values) for i, (rows, _) in enumerate(cases) for j, values in enumerate(rows)
    ]
    sessions = finalize(spans.with_metric_rows(sessionize_context(frame(spark, events))))
    done = rules.assess(annotate_project(sessions))
    assert {r["phone"]: r["verdict"] for r in done.collect()} == {f"p{i}": v for i, (_, v) in enumerate(cases)}
    silent = frame(spark, [event(1, 0, project_number="other")])
    alone = rules.assess(annotate_project(finalize(spans.with_metric_rows(sessionize_context(silent)))))
    assert alone.first()["verdict"] == "status_unavailable"
