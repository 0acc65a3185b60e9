"""Context sessions and what the problem report derives from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampertrace.operators import context_sessions, sessions, spans
from ampertrace.sources.telemetry import ingest_delay
from checks import inputs
from checks.q_sessions import rounded, rounded_sql  # noqa: F401
from checks.registry import query

P = inputs.plain(inputs.PROCESSED)
ALL = inputs.plain(inputs.ALL_METRICS)
METRICS = ("eff", "rx", "tx", "rpp", "current_a", "voltage_v")
_HINT = """case when scenario_hint ilike '%rfid%' then 'rfid' when scenario_hint ilike '%fod%' then 'fod'
  when scenario_hint ilike '%nfc%' then 'nfc' when scenario_hint like '%0-100%' then 'charging' end"""

# The sequential rule itself, one row of every device per step.
SESSION_SQL = f"""
p as ({ALL}),
o as (select *, phone || '|' || project_number || '|' || device_name || '|' || charger_name || '|' || position as dev,
  row_number() over (partition by phone, project_number, device_name, charger_name, position order by event_ts, raw_id) as rn,
  lower(nullif(trim(software_version),'')) as c1, lower(nullif(trim(sample_label),'')) as c2, {_HINT} as c3,
  lower(nullif(trim(fod_object),'')) as c4, case when dual_charging_label = 'dual' then 'true' end as c5,
  coalesce(hmi_status, 'N/A') as status, lag(event_ts) over (partition by phone, project_number, device_name, charger_name, position order by event_ts, raw_id) as pts
  from p where event_ts is not null),
r as (
 select dev, rn, raw_id as sid, c1 as m1, c2 as m2, c3 as m3, c4 as m4, c5 as m5 from o where rn = 1
 union all
 select o.dev, o.rn, case when x then o.raw_id else r.sid end,
  case when x then o.c1 else coalesce(r.m1, o.c1) end, case when x then o.c2 else coalesce(r.m2, o.c2) end,
  case when x then o.c3 else coalesce(r.m3, o.c3) end, case when x then o.c4 else coalesce(r.m4, o.c4) end,
  case when x then o.c5 else coalesce(r.m5, o.c5) end
 from r join o on o.dev = r.dev and o.rn = r.rn + 1,
 lateral (select (epoch_us(o.event_ts) - epoch_us(o.pts) > 1200000000 or coalesce(o.c1 <> r.m1, false) or coalesce(o.c2 <> r.m2, false)
   or coalesce(o.c3 <> r.m3, false) or coalesce(o.c4 <> r.m4, false) or coalesce(o.c5 <> r.m5, false)) as x)),
ev0 as (select o.*, md5(o.dev || '|' || cast(r.sid as varchar)) as session_key, r.sid = o.raw_id as is_start from o join r on o.dev = r.dev and o.rn = r.rn),
ev as (select *, lag(event_ts) over w as prev_ts, {', '.join(f'lag({m}) over w as prev_{m}' for m in METRICS)},
  first_value(event_ts) over w as session_start,
  last_value(case when status <> 'N/A' then status end ignore nulls) over (partition by session_key order by event_ts, raw_id rows between unbounded preceding and 1 preceding) as prev_status,
  (epoch_us(event_ts) - epoch_us(lag(event_ts) over w)) / 1000000.0 as gap
  from ev0 window w as (partition by session_key order by event_ts, raw_id)),
fa as (select session_key, max(event_ts) as session_end, quantile_cont(gap, 0.5) filter (where gap > 0) as median_gap,
  min(event_ts) filter (where status = '2' and prev_status <> '2') as completed_ts,
  min(event_ts) filter (where status = '2') as ff, coalesce(bool_or(status not in ('N/A','2')), false) as oth from ev group by 1),
f as (select *, ff is not null and not oth as only_final, greatest(300.0, coalesce(median_gap, 60.0) * 4.0) as lim,
  coalesce(completed_ts, case when ff is not null and not oth then ff end) as completion_ts from fa),
m as (select ev.*, f.median_gap, f.completed_ts, f.completion_ts, f.only_final, f.lim, f.session_end,
  case when f.completed_ts is not null then event_ts < f.completed_ts else not f.only_final end as is_metric from ev join f using (session_key))
"""
RECURSIVE = f"with recursive {SESSION_SQL}"


def events(spark, sf):
    rows = inputs.all_metrics(spark, sf).withColumn("ingest_delay_seconds", ingest_delay())
    return context_sessions.sessionize_context(rows)


@query("e2_context_sessions", f"{RECURSIVE} select raw_id, session_key, is_start, prev_ts, prev_status from ev")
def _(spark, sf):
    return events(spark, sf).select(
        "raw_id", "session_key", "is_start", F.col("prev.event_ts").alias("prev_ts"), "prev_status"
    )


GAP_KEYS = ("phone", "project_number", "position", "software_version")
GAP_SQL = f"""with p as ({P}), l as (select *, case when coalesce(epoch_us(event_ts) - epoch_us(lag(event_ts) over w) > 900000000, true) then 1 else 0 end as b
 from p window w as (partition by {", ".join(GAP_KEYS)} order by event_ts, raw_id))
select raw_id, cast(sum(b) over (partition by {", ".join(GAP_KEYS)} order by event_ts, raw_id rows unbounded preceding) as bigint) as session_seq from l"""


@query("e3_gap_sessions", GAP_SQL)
def _(spark, sf):
    return sessions.sessionize_gap(inputs.processed(spark, sf), GAP_KEYS).select("raw_id", "session_seq")


@query("e12_metric_rows", f"{RECURSIVE} select raw_id, session_key, completion_ts from m where is_metric")
def _(spark, sf):
    return spans.metric_rows(events(spark, sf)).select("raw_id", "session_key", "completion_ts")


def _transition(metric: str, warn: float, alarm: float, level: float | None) -> str:
    rise = f"prev_{metric} <= {level} or " if level is not None else ""
    return f"""select session_key, raw_id, prev_ts as start_ts, event_ts as end_ts, '{metric}' as metric,
 case when {metric} > prev_{metric} then 'spike' else 'drop' end as event_type,
 case when abs({metric} - prev_{metric}) / abs(prev_{metric}) >= 0.2 or abs({metric} - prev_{metric}) >= {alarm} then 'alarm' else 'warning' end as severity,
 prev_{metric} as before, {metric} as after from m
 where is_metric and prev_{metric} is not null and {metric} is not null and abs(prev_{metric}) >= 1e-9
 and (abs({metric} - prev_{metric}) / abs(prev_{metric}) >= 0.1 or abs({metric} - prev_{metric}) >= {warn})
 and not ({metric} > prev_{metric} and ({rise} epoch_us(event_ts) - epoch_us(session_start) <= 180000000))"""


TRANSITIONS = " union all ".join(
    [
        _transition("eff", 5.0, 12.0, None), _transition("rx", 0.4, 0.8, 2.5), _transition("tx", 0.4, 0.8, 2.5), _transition("rpp", 0.2, 0.4, 0.3),
        _transition("current_a", 0.03, 0.08, 0.08), _transition("voltage_v", 0.15, 0.35, 3.5),
    ]
)


@query("e8_transition_events", f"{RECURSIVE} {TRANSITIONS}")
def _(spark, sf):
    return spans.transition_events(spans.with_metric_rows(events(spark, sf)))


INTERRUPTIONS = """select session_key, raw_id, prev_ts as start_ts, event_ts as end_ts, gap as gap_seconds,
 case when gap >= greatest(2 * lim, 1200.0) then 'alarm' else 'warning' end as severity from m where gap > lim"""


@query("e9_interruption_events", f"{RECURSIVE} {INTERRUPTIONS}")
def _(spark, sf):
    return spans.interruption_events(spans.with_metric_rows(events(spark, sf)))


def _alerts(metric: str) -> str:
    """Falls against the last row of the session in which the metric is known."""
    before = "over (partition by session_key order by event_ts, raw_id rows between unbounded preceding and 1 preceding)"
    return f"""select session_key, raw_id, '{metric}' as metric, kts as start_ts, event_ts as end_ts, known as before, {metric} as after
 from (select *, last_value({metric} ignore nulls) {before} as known, last_value(case when {metric} is not null then event_ts end ignore nulls) {before} as kts from ev)
 where known > 0 and {metric} < known and (known - {metric}) / known > 0.2"""


@query("e10_alert_segments", f"{RECURSIVE} " + " union all ".join(map(_alerts, METRICS[1:])))
def _(spark, sf):
    return spans.alert_segments(events(spark, sf))


INTERVAL_SQL = """iv0 as (select *, case when status is distinct from lag(status) over (partition by session_key order by event_ts, raw_id) then 1 else 0 end as nb from m),
iv1 as (select *, cast(sum(nb) over (partition by session_key order by event_ts, raw_id rows unbounded preceding) as bigint) as run from iv0),
iv2 as (select session_key, run, min(status) as status, min(event_ts) as start_time, count(*) as sample_count, max(session_end) as se, max(median_gap) as mg from iv1 group by 1, 2),
iv as (select session_key, run, status, start_time, sample_count, coalesce(lead(start_time) over (partition by session_key order by run),
  make_timestamp(epoch_us(se) + cast(round(greatest(coalesce(mg, 60.0), 1.0) * 1000000) as bigint))) as end_time from iv2)"""


@query(
    "e6_status_intervals",
    f"{RECURSIVE}, {INTERVAL_SQL} select session_key, run, status, start_time, end_time, sample_count, (epoch_us(end_time) - epoch_us(start_time)) / 1000000.0 as duration_seconds from iv",
)
def _(spark, sf):
    return spans.status_intervals(events(spark, sf))


@query("c14_status_asof", f"{RECURSIVE} select raw_id, case when status <> 'N/A' then status else prev_status end as status_at from ev")
def _(spark, sf):
    return spans.status_asof(events(spark, sf)).select("raw_id", "status_at")


@query(
    "e7_occurrence_ranges",
    f"""with p as ({P}), s as (select *, coalesce(hmi_status,'N/A') as status from p),
 l as (select *, case when coalesce(epoch_us(event_ts) - epoch_us(lag(event_ts) over w) > 1200000000, true) then 1 else 0 end as b
  from s window w as (partition by phone, project_number, position, status order by event_ts, raw_id)),
 n as (select *, sum(b) over (partition by phone, project_number, position, status order by event_ts, raw_id rows unbounded preceding) as g from l)
 select phone, project_number, position, status, min(event_ts) as start_ts, max(event_ts) as end_ts, count(*) as row_count from n group by phone, project_number, position, status, g""",
)
def _(spark, sf):
    from ampertrace.functions.payload import norm_status

    return spans.occurrence_ranges(
        inputs.processed(spark, sf).withColumn("status", norm_status("hmi_status", "report"))
    )


SPANS = """an as (select session_key, start_ts as start_time, end_ts as end_time, severity from tr union all select session_key, start_ts, end_ts, severity from ie),
 a1 as (select an.session_key, start_time, end_time, bool_or(severity = 'alarm') as al, count(*) as n, max(f.median_gap) as median_gap from an join f using (session_key) group by 1, 2, 3),
 a2 as (select *, max(end_time) over (partition by session_key order by start_time, end_time rows between unbounded preceding and 1 preceding) as reached from a1),
 a3 as (select *, case when reached is null or (epoch_us(start_time) - epoch_us(reached)) / 1000000.0 > greatest(90.0, 2 * coalesce(median_gap, 60.0)) then 1 else 0 end as op from a2),
 a4 as (select *, cast(sum(op) over (partition by session_key order by start_time, end_time rows unbounded preceding) as bigint) as span from a3)"""


@query(
    "e11_merge_spans",
    f"{RECURSIVE}, tr as ({TRANSITIONS}), ie as ({INTERRUPTIONS}), {SPANS} select session_key, span, min(start_time) as start_time, max(end_time) as end_time, "
    "case when bool_or(al) then 'alarm' else 'warning' end as severity, cast(sum(n) as bigint) as annotation_count from a4 group by 1, 2",
)
def _(spark, sf):
    rows = spans.with_metric_rows(events(spark, sf))
    columns = ["session_key", F.col("start_ts").alias("start_time"), F.col("end_ts").alias("end_time"), "severity"]
    notes = spans.transition_events(rows).select(*columns).unionByName(spans.interruption_events(rows).select(*columns))
    gaps = rows.select("session_key", "median_gap").distinct()
    return spans.merge_spans(notes.join(gaps, "session_key"))


# ---- report sessions and rules -----------------------------------------------------------------

_TXT = "coalesce(nullif(lower(scenario_hint),''),'') || chr(10) || coalesce(lower(fod_object),'') || chr(10) || coalesce(lower(sample_label),'') || chr(10) || coalesce(lower(manual_result),'') || chr(10) || coalesce(lower(defect_id),'')"
_DOM = """(select session_key, arg_max(v, (n, l, v)) as {name} from (select session_key, trim({col}) as v, count(*) as n, max((event_ts, raw_id)) as l from m
 where nullif(trim({col}),'') is not null group by 1, 2) group by 1)"""
_DOMS = {
    c: _DOM.format(name=c, col=c)
    for c in ("software_version", "source_csv_file", "fod_object", "sample_label", "manual_result", "defect_id")
}
_SEV = {}
for _m, _w, _a, _lv in (
    ("eff", 5.0, 12.0, None), ("rx", 0.4, 0.8, 2.5), ("tx", 0.4, 0.8, 2.5), ("rpp", 0.2, 0.4, 0.3), ("current_a", 0.03, 0.08, 0.08), ("voltage_v", 0.15, 0.35, 3.5),
):
    _rise = f"prev_{_m} <= {_lv} or " if _lv is not None else ""
    _SEV[_m] = f"""case when is_metric and abs(prev_{_m}) >= 1e-9 and (abs({_m} - prev_{_m}) / abs(prev_{_m}) >= 0.1 or abs({_m} - prev_{_m}) >= {_w})
 and not ({_m} > prev_{_m} and ({_rise} epoch_us(event_ts) - epoch_us(session_start) <= 180000000))
 then case when abs({_m} - prev_{_m}) / abs(prev_{_m}) >= 0.2 or abs({_m} - prev_{_m}) >= {_a} then 'alarm' else 'warning' end end"""
_GAPSEV = "case when gap > lim then case when gap >= greatest(2 * lim, 1200.0) then 'alarm' else 'warning' end end"
_ALL = [*_SEV, "stop"]
_ANY = " or ".join(f"s_{x} is not null" for x in _ALL)


def _level(level: str) -> str:
    return "cast(sum(" + " + ".join(f"case when s_{x} = '{level}' then 1 else 0 end" for x in _ALL) + ") as bigint)"


FINAL_SQL = f"""
mt as (select *, {_TXT} as txt, {", ".join(f"{e} as s_{x}" for x, e in _SEV.items())}, {_GAPSEV} as s_stop,
  lag(status) over (partition by session_key order by event_ts, raw_id) as prev_st from m),
base as (select session_key, phone, project_number, device_name, charger_name, position, count(*) as sample_count, min(event_ts) as start_ts, max(event_ts) as end_ts,
  count(*) filter (where is_metric) as metric_sample_count, min(event_ts) filter (where is_metric) as ms, max(event_ts) filter (where is_metric) as me,
  max(completion_ts) as completed_charge_ts, avg(eff) filter (where is_metric) as avg_eff, avg(rx) filter (where is_metric) as avg_rx, avg(tx) filter (where is_metric) as avg_tx,
  avg(temperature) as avg_temperature, max(temperature) as max_temperature, max(gap) filter (where gap > 0) as max_gap_seconds,
  quantile_cont((epoch_us(inserted_at) - epoch_us(event_ts)) / 1000000.0, 0.5) as median_ingest_delay,
  count(*) filter (where gap > lim) as interruption_count,
  count(*) filter (where is_metric and prev_eff > 0 and prev_eff - eff >= 15 and (prev_eff - eff) / prev_eff >= 0.25)
  + count(*) filter (where is_metric and prev_rx > 0 and prev_rx > rx and (prev_rx - rx) / prev_rx >= 0.2)
  + count(*) filter (where is_metric and prev_tx > 0 and prev_tx > tx and (prev_tx - tx) / prev_tx >= 0.2) as drop_count,
  {_level('warning')} as warning_event_count, {_level('alarm')} as alarm_event_count,
  min(prev_ts) filter (where {_ANY}) as first_event_ts, arg_min(prev_st, prev_ts) filter (where {_ANY}) as first_event_status,
  arg_max(status, (event_ts, raw_id)) filter (where status <> 'N/A') as last_status,
  arg_min(status, (event_ts, raw_id)) filter (where status <> 'N/A') as first_status,
  coalesce(list_sort(list(distinct status) filter (where status <> 'N/A')), []::varchar[]) as status_codes,
  bool_or(contains(txt,'rfid')) as t_rfid, bool_or(contains(txt,'fod')) as t_fod, bool_or(contains(txt,'nfc')) as t_nfc,
  bool_or(contains(txt,'0-100')) as t_full, bool_or(contains(txt,'not ok')) as t_neg, bool_or(regexp_matches(txt, '(^|[\\n ])ok(\\n|$)')) as t_ok,
  max(case when dual_charging_label = 'dual' then 'true' end) as dual_charging from mt group by all),
ses as (select base.*, coalesce(d1.software_version,'') as software_version, coalesce(d2.source_csv_file,'') as source_csv_file, coalesce(d3.fod_object,'') as fod_object,
  coalesce(d4.sample_label,'') as sample_label, coalesce(d5.manual_result,'') as manual_result, coalesce(d6.defect_id,'') as defect_id,
  (epoch_us(end_ts) - epoch_us(start_ts)) / 1000000.0 as duration_seconds, (epoch_us(me) - epoch_us(ms)) / 1000000.0 as metric_duration_seconds,
  greatest((epoch_us(end_ts) - epoch_us(start_ts)) / 60000000.0, 0) as duration_minutes,
  case when metric_sample_count > 0 then greatest((epoch_us(me) - epoch_us(ms)) / 60000000.0, 0) end as metric_duration_minutes,
  completed_charge_ts is not null and metric_sample_count <> sample_count as metrics_trimmed_at_full_charge
  from base left join {_DOMS['software_version']} d1 using (session_key) left join {_DOMS['source_csv_file']} d2 using (session_key)
  left join {_DOMS['fod_object']} d3 using (session_key) left join {_DOMS['sample_label']} d4 using (session_key)
  left join {_DOMS['manual_result']} d5 using (session_key) left join {_DOMS['defect_id']} d6 using (session_key)),
pj as (select project_number as pn, bool_or(len(status_codes) > 0) as project_has_status_readout, bool_or(avg_eff is not null) as project_has_eff,
  bool_or(fod_object <> '') as project_has_fod_object from ses group by 1)
"""
FINAL_EXACT = (
    "session_key", "phone", "project_number", "sample_count", "start_ts", "end_ts", "metric_sample_count",
    "completed_charge_ts", "max_temperature", "interruption_count", "drop_count", "warning_event_count",
    "alarm_event_count", "first_event_ts", "last_status", "software_version", "source_csv_file", "fod_object",
    "sample_label", "manual_result", "defect_id", "dual_charging", "metrics_trimmed_at_full_charge",
)
FINAL_FLOATS = (
    "avg_eff", "avg_rx", "avg_tx", "avg_temperature", "max_gap_seconds", "median_ingest_delay", "duration_seconds",
    "metric_duration_seconds",
)


def report_sessions_of(rows):
    from ampertrace.operators import report_sessions

    return report_sessions.finalize(spans.with_metric_rows(rows))


@query(
    "j12_report_sessions",
    f"{RECURSIVE}, {FINAL_SQL} select {rounded_sql(FINAL_EXACT, FINAL_FLOATS, 6)}, array_to_string(status_codes, ',') as status_codes from ses",
)
def _(spark, sf):
    df = report_sessions_of(events(spark, sf)).withColumns(
        {n.replace("minutes", "seconds"): F.col(n) * 60 for n in ("duration_minutes", "metric_duration_minutes")}
    )
    return rounded(df, (*FINAL_EXACT, "status_codes"), FINAL_FLOATS, 6).withColumn("status_codes", F.array_join("status_codes", ","))


@query(
    "h14_dominant_texts",
    f"{RECURSIVE}, {FINAL_SQL} select session_key, nullif(manual_result,'') as manual_result, nullif(software_version,'') as software_version from ses where manual_result <> '' or software_version <> ''",
)
def _(spark, sf):
    from ampertrace.functions.text import blank_to_null
    from ampertrace.operators.report_sessions import dominant_texts

    fields = ("manual_result", "software_version")
    return dominant_texts(events(spark, sf), {f: blank_to_null(f) for f in fields})


def annotated(spark, sf):
    from ampertrace.operators.report_sessions import annotate_project

    return annotate_project(report_sessions_of(events(spark, sf)))


@query(
    "c13_project_context",
    f"{RECURSIVE}, {FINAL_SQL} select session_key, project_has_status_readout, project_has_eff, project_has_fod_object from ses left join pj on pn = project_number",
)
def _(spark, sf):
    return annotated(spark, sf).select("session_key", "project_has_status_readout", "project_has_eff", "project_has_fod_object")


_FAIL = "['0','1','4','6','8','9','13','14','17']"
RULES_SQL = f"""
sc as (select ses.*, pj.project_has_status_readout as readout, case when list_has_any(status_codes, ['15','16']) or t_rfid then 'rfid' when fod_object <> '' or t_fod then 'fod'
   when t_nfc then 'nfc' when t_full then 'charging' when status_codes = ['5'] then 'unknown'
   when list_has_any(status_codes, ['4','6']) and not list_has_any(status_codes, ['2','3']) then 'unknown' else 'charging' end as scenario_code,
   len(status_codes) = 0 as silent from ses left join pj on pn = project_number),
ru as (select *, case
   when scenario_code = 'rfid' then case when list_has_all(['15','16'], status_codes) then 'rfid_protected' else 'rfid_not_protected' end
   when scenario_code = 'fod' then case when list_has_any(status_codes, ['3','5']) then 'fod_still_charging' when list_has_any(status_codes, ['8','9','13','14','17']) then 'fod_system_error'
     when list_has_any(status_codes, ['4','6']) then 'fod_blocked' else 'fod_unclear' end
   when scenario_code = 'nfc' then case when t_neg then 'nfc_negative' when t_ok then 'nfc_positive' else 'nfc_unclear' end
   when scenario_code = 'unknown' then case when list_has_any(status_codes, {_FAIL}) then 'unknown_failure' else 'unknown_unclear' end
   when t_full and list_has_all(['2','3'], status_codes) and last_status = '2' and list_has_any(status_codes, ['3']) then 'charge_completed'
   when list_has_any(status_codes, {_FAIL}) then 'charge_failure_status' when list_has_all(['3'], status_codes) then 'charge_running'
   when status_codes = ['2'] then 'charge_full_only' when list_has_all(['2','3'], status_codes) then 'charge_unconfirmed'
   when list_has_any(status_codes, ['5','15','16']) then 'charge_context_status' else 'charge_unusual' end as rule,
   interruption_count > 0 or drop_count > 0 or alarm_event_count > 0 as issue from sc),
rv as (select *, case when rule in ('rfid_protected','fod_blocked','nfc_positive','charge_completed','charge_running') then 'ok'
   when rule in ('fod_unclear','unknown_unclear','charge_full_only','charge_unconfirmed','charge_context_status','charge_unusual') then 'warning'
   when rule = 'nfc_unclear' then 'no_data' else 'not_ok' end as bv,
   rule in ('rfid_not_protected','fod_still_charging','fod_system_error','unknown_failure','charge_failure_status') as eligible from ru),
sus as (select rv.session_key, count(*) filter (where rv.issue and ev.status <> 'N/A'
    or not issue and (rule = 'rfid_not_protected' and ev.status not in ('15','16','N/A') or rule = 'fod_still_charging' and ev.status in ('3','5')
    or rule = 'fod_system_error' and ev.status in ('8','9','13','14','17') or rule in ('unknown_failure','charge_failure_status') and list_contains({_FAIL}, ev.status)
    or rule = 'charge_context_status' and ev.status in ('5','15','16'))) as bad from rv join ev using (session_key) group by 1),
av as (select rv.*, case when silent and scenario_code = 'nfc' and t_neg then 'not_ok' when silent and readout = false then 'status_unavailable' when silent then 'no_data'
   when issue and bv = 'ok' then 'not_ok' else bv end as moved,
   (bad >= 2 or interruption_count >= 2 or alarm_event_count >= 2) as is_repeatable from rv join sus using (session_key)),
asd as (select *, case when not silent and moved = 'not_ok' and eligible and is_repeatable then 'defect' else moved end as verdict,
   case when silent then case when moved = 'not_ok' then 2 else 0 end when moved = 'not_ok' and eligible and is_repeatable then 4
     else greatest(case when bv = 'not_ok' then 2 when bv in ('warning','no_data') then 1 else 0 end, case when issue then 2 else 0 end) end as severity_score,
   case when silent then 'no_status_' || moved else rule end || case when not silent and interruption_count > 0 then ',interruptions' else '' end
   || case when not silent and drop_count > 0 then ',metric_drops' else '' end || case when not silent and alarm_event_count > 0 then ',metric_alarms' else '' end
   || case when not silent and moved = 'not_ok' and eligible and is_repeatable then ',repeatable' else '' end
   || case when not silent and moved = 'not_ok' and eligible and not is_repeatable then ',not_confirmed' else '' end as reasons,
   case scenario_code when 'rfid' then 'RFID Protection' when 'fod' then 'FOD' when 'nfc' then 'NFC' when 'unknown' then 'Unknown / mixed' else 'Charging / WLC' end as scenario_label from av)
"""
ASSESS = f"{RECURSIVE}, {FINAL_SQL}, {RULES_SQL}"


def assessed(spark, sf):
    from ampertrace.operators.rules import assess

    return assess(annotated(spark, sf))


@query("j4_j5_rule_verdicts", f"{ASSESS} select session_key, scenario_code, scenario_label, verdict, severity_score, reasons from asd")
def _(spark, sf):
    return assessed(spark, sf).select(
        "session_key", "scenario_code", "scenario_label", "verdict", "severity_score", F.array_join("reasons", ",").alias("reasons")
    )


@query(
    "j6_j7_repeatable_and_completed",
    f"{ASSESS} select session_key, is_repeatable, coalesce(t_full and list_has_all(['2','3'], status_codes) and last_status = '2' and list_has_any(status_codes, ['3']), false) as completed_normally from asd where not silent",
)
def _(spark, sf):
    from ampertrace.operators.rules import completed_normally

    rows = assessed(spark, sf).filter(F.size("status_codes") > 0)
    return rows.select(
        "session_key", "is_repeatable", F.coalesce(completed_normally(), F.lit(False)).alias("completed_normally")
    )


@query("j9_project_profiles", "select c_custkey, c_custkey % 3 = 0 as profiled, '2,5' as context, '4,6' as fod_pass from customer")
def _(spark, sf):
    from ampertrace.operators.rules import with_profile

    projects = inputs.table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lit("0854_086")).otherwise(F.lit("other")).alias("project_number")
    )
    return with_profile(projects).select(
        "c_custkey", (F.col("project_number") == "0854_086").alias("profiled"),
        F.array_join(F.array_intersect("charging_not_ok_statuses", F.array(F.lit("2"), F.lit("5"))), ",").alias("context"),
        F.array_join("fod_pass_statuses", ",").alias("fod_pass"),
    )


PROBLEM_SQL = f"""{ASSESS},
pst as (select asd.session_key, arg_min(ev.status, (ev.event_ts, ev.raw_id)) as problem_status, min(ev.event_ts) as pts2 from asd join ev using (session_key)
  where verdict in ('warning','not_ok','defect') and ev.status <> 'N/A' and (scenario_code = 'rfid' and ev.status not in ('15','16')
   or scenario_code = 'fod' and ev.status in ('3','5','8','9','13','14','17','4','6')
   or scenario_code in ('charging','unknown') and (list_contains({_FAIL}, ev.status) or ev.status in ('2','5','15','16'))) group by 1),
pr as (select asd.*, problem_status, case when not silent then coalesce(pts2, first_event_ts, start_ts) end as problem_ts,
  case when verdict in ('defect','not_ok') then verdict when verdict = 'warning' then 'potential_defect' end as classification,
  coalesce(problem_status, nullif(first_event_status,'N/A'), first_status, '') as status_code,
  case dual_charging when 'true' then 'tak' else '' end as dual_charging_label, split_part(reasons, ',', 1) as short_reason,
  scenario_label as test_type, coalesce(end_ts, start_ts) as sort_time from asd left join pst using (session_key)),
it as (select * from pr where classification is not null)"""


@query("j8_problem_time", f"{PROBLEM_SQL} select session_key, problem_status, problem_ts from pr")
def _(spark, sf):
    from ampertrace.operators.rules import problem_time

    return problem_time(assessed(spark, sf)).select("session_key", "problem_status", "problem_ts")


ITEM = ("session_key", "classification", "short_reason", "test_type", "status_code", "defect_id", "dual_charging_label", "sort_time", "problem_ts")


def items(spark, sf):
    from ampertrace.operators.problems import problems

    return problems(assessed(spark, sf))


@query("j13_problem_items", f"{PROBLEM_SQL} select {', '.join(ITEM)} from it")
def _(spark, sf):
    return items(spark, sf).select(*ITEM)


@query("b6_filter_problems", f"{PROBLEM_SQL} select session_key from it where phone = 'PH1' and classification = 'not_ok' and defect_id ilike '%def%'")
def _(spark, sf):
    from ampertrace.operators.problems import filter_problems

    return filter_problems(items(spark, sf), phone="PH1", classification="not_ok", defect_id="def").select("session_key")


@query("d21_problem_breakdown", f"{PROBLEM_SQL} select test_type as label, count(*) as n from it group by 1")
def _(spark, sf):
    from ampertrace.operators.problems import breakdown

    return breakdown(items(spark, sf), "test_type")


@query(
    "d20_problem_summary",
    f"""{PROBLEM_SQL}, sv as (select software_version as label, count(*) as n from it where software_version <> '' group by 1 order by n desc, label limit 1),
 sr as (select short_reason as label, count(*) as n from it group by 1 order by n desc, label limit 1)
 select count(*) as problem_count, count(*) filter (where classification = 'defect') as defect_count, count(*) filter (where classification = 'not_ok') as not_ok_count,
 count(*) filter (where classification = 'potential_defect') as potential_defect_count, (select label from sv) as top_software_version, (select n from sv) as top_software_version_count,
 (select label from sr) as top_short_reason, (select n from sr) as top_short_reason_count from it""",
)
def _(spark, sf):
    from ampertrace.operators.problems import problem_summary

    return problem_summary(items(spark, sf))


@query(
    "f8_problem_order",
    f"{PROBLEM_SQL} select session_key, classification, sort_time from it order by case classification when 'defect' then 0 when 'not_ok' then 1 else 2 end, sort_time, session_key",
)
def _(spark, sf):
    from ampertrace.operators.problems import order_problems

    return order_problems(items(spark, sf)).select("session_key", "classification", "sort_time")


@query(
    "g2_problem_options",
    f"{PROBLEM_SQL} select 'phone' as field, phone as value from it union select 'classification', classification from it union select 'test_type', test_type from it "
    "union select 'dual_charging_label', 'tak' from it where dual_charging_label = 'tak' union select 'software_version', software_version from it "
    "union select 'sample_label', sample_label from it union select 'project_number', project_number from it union select 'position', position from it",
)
def _(spark, sf):
    from ampertrace.operators.problems import problem_options

    return problem_options(items(spark, sf))


CLASS_SQL = f"""{ASSESS}, {INTERVAL_SQL},
ci as (select iv.*, asd.scenario_code as sc, case asd.scenario_code when 'rfid' then ['15','16'] when 'fod' then ['4','6'] else ['2','3'] end as al from iv join asd using (session_key)),
cf as (select session_key, max(run) filter (where status <> 'N/A') as lr, bool_or(status <> 'N/A' and list_contains(al, status)) as aa from ci group by 1),
cm as (select ci.*, lr, case when status <> 'N/A' and not list_contains(al, status) and (sc in ('rfid','fod') or (aa and run <> lr)) then
  case when sc = 'fod' and status in ('3','5','8','9','13','14','17') then 'warning' else 'deviation' end end as marker,
  coalesce(run = lr, false) as is_final from ci join cf using (session_key))"""


@query("j10_classify_intervals", f"{CLASS_SQL} select session_key, run, status, marker, is_final from cm")
def _(spark, sf):
    from ampertrace.operators.rules import assess, classify_intervals
    from ampertrace.operators.report_sessions import annotate_project

    rows = events(spark, sf)
    done = assess(annotate_project(report_sessions_of(rows)))
    return classify_intervals(spans.status_intervals(rows), done).select("session_key", "run", "status", "marker", "is_final")


@query(
    "j11_timeline_summary",
    f"""{CLASS_SQL}, tl as (select session_key, count(*) filter (where marker = 'deviation') as d, count(*) filter (where marker = 'warning') as w,
 coalesce(bool_or(is_final and (sc = 'rfid' and status in ('15','16') or sc = 'fod' and status in ('4','6') or sc not in ('rfid','fod') and status = '2')), false) as ee,
 bool_or(status <> 'N/A') as re from cm group by 1)
 select count(*) as session_count, count(*) filter (where ee) as completed_sessions, count(*) filter (where d > 0) as sessions_with_deviation,
 count(*) filter (where w > 0) as sessions_with_warning, count(*) filter (where not re) as sessions_without_readout,
 cast(sum(d) as bigint) as deviation_total, cast(sum(w) as bigint) as warning_total from tl""",
)
def _(spark, sf):
    from ampertrace.operators.report_sessions import annotate_project
    from ampertrace.operators.rules import assess, classify_intervals, session_timelines, timeline_summary

    rows = events(spark, sf)
    done = assess(annotate_project(report_sessions_of(rows)))
    return timeline_summary(session_timelines(classify_intervals(spans.status_intervals(rows), done), done))
