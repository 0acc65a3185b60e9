"""Sessions, verdicts and reliability ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampertrace.operators import ranking, sessions, verdicts
from checks import inputs
from checks.registry import query

P = inputs.plain(inputs.PROCESSED)

EVENTS_SQL = f"""
p as ({P}),
l as (select *, lag(event_ts) over w as pts,
  lag(concat_ws('#', coalesce(software_version,''), coalesce(sample_label,''), lower(coalesce(scenario_hint,'')),
     coalesce(card_position,''), coalesce(fod_object,''), coalesce(cast(dual_charging_flag as varchar),''))) over w as pctx,
  concat_ws('#', coalesce(software_version,''), coalesce(sample_label,''), lower(coalesce(scenario_hint,'')),
     coalesce(card_position,''), coalesce(fod_object,''), coalesce(cast(dual_charging_flag as varchar),'')) as ctx
  from p where event_ts is not null
  window w as (partition by phone, project_number, device_name, charger_name, position order by event_ts, raw_id)),
b as (select *, case when pts is null or event_ts - pts > interval 20 minute or ctx <> pctx then 1 else 0 end as bnd from l),
n as (select *, cast(sum(bnd) over (partition by phone, project_number, device_name, charger_name, position
   order by event_ts, raw_id rows unbounded preceding) as bigint) as session_seq from b),
ev as (select *, lag(eff) over w2 as session_prev_eff, lag(rx) over w2 as session_prev_rx, lag(tx) over w2 as session_prev_tx,
   (epoch_us(event_ts) - epoch_us(lag(event_ts) over w2)) / 1000000.0 as gap_seconds
   from n window w2 as (partition by phone, project_number, device_name, charger_name, position, session_seq order by event_ts, raw_id))
"""

SESSIONS_SQL = f"""{EVENTS_SQL},
g as (select phone, project_number, device_name, charger_name, position, session_seq,
   quantile_cont(gap_seconds, 0.5) filter (where gap_seconds > 0) as median_gap_seconds from ev group by all),
ss as (select md5(concat_ws('|', phone, project_number, device_name, charger_name, position, cast(session_seq as varchar))) as session_key,
  ev.phone, ev.project_number, ev.device_name, ev.charger_name, ev.position, ev.session_seq, cast(count(*) as int) as source_row_count,
  max(software_version) as software_version, max(source_csv_file) as source_csv_file, max(scenario_hint) as scenario_hint,
  max(fod_object) as fod_object, max(card_position) as card_position, max(sample_label) as sample_label,
  max(manual_result) as manual_result, max(defect_id) as defect_id, max(defect_comment) as defect_comment,
  max(dual_charging_label) as dual_charging_label, min(event_ts) as start_ts, max(event_ts) as end_ts,
  avg(eff) as avg_eff, avg(rx) as avg_rx, avg(tx) as avg_tx, max(temperature) as max_temperature,
  coalesce(list_sort(list(distinct hmi_status) filter (where hmi_status is not null)), []::varchar[]) as status_codes,
  arg_min(hmi_status, (event_ts, raw_id)) filter (where hmi_status is not null) as first_status,
  arg_max(hmi_status, (event_ts, raw_id)) filter (where hmi_status is not null) as last_status,
  max(median_gap_seconds) as median_gap_seconds,
  cast(count(*) filter (where gap_seconds > greatest(300.0, coalesce(median_gap_seconds, 60.0) * 4.0)) as int) as interruption_count,
  cast(count(*) filter (where session_prev_eff > 0 and session_prev_eff - eff >= 15 and (session_prev_eff - eff) / session_prev_eff >= 0.25) as int) as eff_drop_count,
  cast(count(*) filter (where session_prev_rx > 0 and session_prev_rx - rx > 0 and (session_prev_rx - rx) / session_prev_rx >= 0.2) as int) as rx_drop_count,
  cast(count(*) filter (where session_prev_tx > 0 and session_prev_tx - tx > 0 and (session_prev_tx - tx) / session_prev_tx >= 0.2) as int) as tx_drop_count
  from ev join g using (phone, project_number, device_name, charger_name, position, session_seq)
  group by ev.phone, ev.project_number, ev.device_name, ev.charger_name, ev.position, ev.session_seq)
"""

CLASSIFIED_SQL = f"""{SESSIONS_SQL},
f0 as (select *, coalesce(status_codes, []::varchar[]) as sc,
  lower(concat_ws(' ', coalesce(scenario_hint,''), coalesce(fod_object,''), coalesce(card_position,''), coalesce(position,''),
    coalesce(sample_label,''), coalesce(manual_result,''), coalesce(defect_id,''), coalesce(defect_comment,''),
    coalesce(source_csv_file,''), coalesce(dual_charging_label,''))) as blob,
  lower(concat_ws(' ', coalesce(scenario_hint,''), coalesce(fod_object,''), coalesce(card_position,''), coalesce(sample_label,''),
    coalesce(manual_result,''), coalesce(defect_comment,''), coalesce(source_csv_file,''))) as ct,
  lower(concat_ws(' ', coalesce(scenario_hint,''), coalesce(fod_object,''), coalesce(defect_comment,''))) as ot,
  lower(concat_ws(' ', coalesce(scenario_hint,''), coalesce(manual_result,''), coalesce(defect_comment,''))) as rt,
  lower(concat_ws(' ', coalesce(scenario_hint,''), coalesce(source_csv_file,''), coalesce(manual_result,''))) as cht,
  eff_drop_count + rx_drop_count + tx_drop_count as drop_issue_count,
  (nullif(trim(defect_id),'') is not null or regexp_matches(lower(concat_ws(' ', coalesce(defect_comment,''),
     coalesce(source_csv_file,''), coalesce(manual_result,''))), '(^|[^a-z])defect([^a-z]|$)')) as has_ref from ss),
f as (select *, len(list_filter(sc, lambda x: x <> 'N/A')) > 0 as has_status_readout,
  (nullif(trim(card_position),'') is not null or list_has_any(sc, ['15','16']) or contains(ct,'rfid')) as rfid,
  (nullif(trim(fod_object),'') is not null or contains(ot,'fod') or contains(ot,'foreign object')) as fod,
  (contains(rt,'nfc') and not contains(rt,'rfid')) as nfc,
  regexp_matches(rt, '(^|[^a-z])(not ok|no ok|nok)([^a-z]|$)') as rneg, regexp_matches(rt, '(^|[^a-z])ok([^a-z]|$)') as rpos,
  regexp_matches(blob, '(^|[^a-z])(not ok|no ok|nok)([^a-z]|$)') as bneg, regexp_matches(blob, '(^|[^a-z])ok([^a-z]|$)') as bpos
  from f0),
c0 as (select *,
  case when rfid then 'rfid' when fod then 'fod' when nfc then 'nfc'
   when contains(cht,'0-100%') or contains(cht,'charging 0 -100%') or contains(cht,'wlc') then 'charging'
   when list_has_any(sc,['4','6']) and not list_has_any(sc,['2','3']) then 'unknown' else 'charging' end as scenario_code,
  case when not has_status_readout and nfc and rneg then 'not_ok' when not has_status_readout and nfc and rpos then 'ok'
   when not has_status_readout then 'other'
   when rfid and list_has_all(['15','16'], sc) then 'ok' when rfid then 'not_ok'
   when fod and (contains(blob,'no fod detected') or contains(blob,'inappropriate temperature')) then 'not_ok'
   when fod and list_has_any(sc,['3','5','8','9','13','14','17']) then 'not_ok'
   when fod and list_has_any(sc,['4','6']) then 'ok'
   when nfc and bneg then 'not_ok' when nfc and bpos then 'ok'
   when list_has_any(sc,['0','1','4','6','8','9','13','14','17']) then 'not_ok'
   when regexp_matches(blob, '(^|[^a-z])(toggling|toggling status|no charging|charging interrupted|charging interference|charging inter)([^a-z]|$)') then 'not_ok'
   when (contains(cht,'0-100%') or contains(cht,'charging 0 -100%')) and list_has_all(['2','3'], sc) and list_has_any(sc,['3']) and last_status = '2' then 'ok'
   when list_has_all(['3'], sc) then 'ok' else 'warning' end as base_verdict from f),
c as (select *, case when base_verdict = 'ok' and (interruption_count > 0 or drop_issue_count > 0) then 'not_ok'
   when base_verdict = 'not_ok' and (has_ref or interruption_count >= 2 or drop_issue_count >= 2) then 'defect' else base_verdict end as verdict,
   (base_verdict = 'ok' and interruption_count = 0 and drop_issue_count = 0) as is_clean from c0)
"""


def group_sql(section: str, label: str, keys: dict[str, str]) -> str:
    minimum = {"phone": 30, "project": 50, "project_software": 10, "software": 20}[section]
    dims = ", ".join(f"{keys.get(d, chr(39) * 2)} as {d}" for d in ("phone", "project", "software"))
    return f"""select '{section}' as section, {label} as label, {dims}, count(*) as session_count,
   count(*) filter (where has_status_readout) as covered_count, count(*) filter (where verdict='defect') as defect_count,
   count(*) filter (where verdict='not_ok') as not_ok_count, count(*) filter (where verdict='warning') as warning_count,
   count(*) filter (where is_clean) as clean_count, max(end_ts) as last_seen,
   count(distinct phone) as phone_count, count(distinct project_number) as project_count, count(distinct software_version) as software_count,
   quantile_cont(avg_eff,0.5) as median_eff, quantile_cont(avg_rx,0.5) as median_rx, quantile_cont(avg_tx,0.5) as median_tx, {minimum} as mn
   from c group by {", ".join(keys.values())}"""


GROUPS_SQL = {
    "phone": group_sql("phone", "phone", {"phone": "phone"}),
    "project": group_sql("project", "project_number", {"project": "project_number"}),
    "project_software": group_sql(
        "project_software", "software_version", {"project": "project_number", "software": "software_version"}
    ),
    "software": group_sql("software", "software_version", {"software": "software_version"}),
}


def scored_sql(*sections: str) -> str:
    union = " union all ".join(GROUPS_SQL[s] for s in sections)
    return f"""{CLASSIFIED_SQL}, a as ({union}),
r as (select *, covered_count/session_count as status_coverage, defect_count/session_count as defect_rate,
  not_ok_count/session_count as not_ok_rate, warning_count/session_count as warning_rate, clean_count/session_count as clean_rate from a),
s as (select *, greatest(0.0, 100.0 - (60.0*defect_rate + 25.0*not_ok_rate + 10.0*warning_rate + 5.0*(1.0-status_coverage))) as reliability_score,
  session_count >= mn and status_coverage >= 0.80 as eligible from r)
"""


ORDER_SQL = (
    "eligible desc, reliability_score desc, defect_rate, not_ok_rate, warning_rate, clean_rate desc, "
    "session_count desc, label, project"
)
SECTIONS = ("phone", "project", "project_software", "software")
SCORE_COLUMNS = (
    "section", "label", "phone", "project", "software", "session_count", "covered_count", "defect_count",
    "not_ok_count", "warning_count", "clean_count", "last_seen", "phone_count", "project_count", "software_count",
    "eligible",
)
SCORE_FLOATS = (
    "status_coverage", "defect_rate", "not_ok_rate", "warning_rate", "clean_rate", "median_eff", "median_rx",
    "median_tx", "reliability_score",
)


def rounded(df: DataFrame, exact: tuple, floats: tuple, digits: int = 6) -> DataFrame:
    return df.select(*exact, *[F.round(c, digits).alias(c) for c in floats])


def rounded_sql(exact: tuple, floats: tuple, digits: int = 6) -> str:
    return ", ".join([*exact, *[f"round({c}, {digits}) as {c}" for c in floats]])


SCORE_SQL = rounded_sql(SCORE_COLUMNS, SCORE_FLOATS)


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.build_sessions(inputs.processed(spark, sf_dir))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.classify_sessions(built(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str, *sections: str) -> DataFrame:
    rows = classified(spark, sf_dir).persist()
    return ranking.score(ranking.reliability(rows, *sections))


EVENT_COLUMNS = ("raw_id", "session_seq", "session_prev_eff", "session_prev_rx", "session_prev_tx", "gap_seconds")


@query("e1_e4_sessionize_sql", f"with {EVENTS_SQL} select {', '.join(EVENT_COLUMNS)} from ev")
def _(spark, sf):
    return sessions.sessionize_sql(inputs.processed(spark, sf)).select(*EVENT_COLUMNS)


SESSION_EXACT = (
    "session_key", *sessions.DEVICE_KEYS, "session_seq", "source_row_count", "software_version", "source_csv_file",
    "scenario_hint", "fod_object", "card_position", "sample_label", "manual_result", "defect_id", "defect_comment",
    "dual_charging_label", "start_ts", "end_ts", "max_temperature", "first_status", "last_status",
    "interruption_count", "eff_drop_count", "rx_drop_count", "tx_drop_count",
)
SESSION_FLOATS = ("avg_eff", "avg_rx", "avg_tx", "median_gap_seconds")  # a median of microseconds has at most 7 digits


@query(
    "c1_d1_d4_h11_session_rollup",
    f"with {SESSIONS_SQL} select {rounded_sql(SESSION_EXACT, SESSION_FLOATS, 7)}, "
    "array_to_string(status_codes, ',') as status_codes from ss",
)
def _(spark, sf):
    df = built(spark, sf)
    return rounded(df, (*SESSION_EXACT, "status_codes"), SESSION_FLOATS, 7).withColumn(
        "status_codes", F.array_join("status_codes", ",")
    )


VERDICT = ("session_key", "scenario_code", "base_verdict", "verdict", "is_clean", "has_status_readout")


@query("j1_j3_session_verdicts", f"with {CLASSIFIED_SQL} select {', '.join(VERDICT)} from c")
def _(spark, sf):
    return classified(spark, sf).select(*VERDICT)


@query("d5_d7_reliability_by_phone", f"with {scored_sql('phone')} select {SCORE_SQL} from s")
def _(spark, sf):
    return rounded(scored(spark, sf, "phone"), SCORE_COLUMNS, SCORE_FLOATS)


@query("d6_reliability_all_sections", f"with {scored_sql(*SECTIONS)} select {SCORE_SQL} from s")
def _(spark, sf):
    return rounded(scored(spark, sf, *SECTIONS), SCORE_COLUMNS, SCORE_FLOATS)


RANK_SQL = f"""with {{source}}, k as (select *, max(eligible) over (partition by section) as anyel from s),
 o as (select *, cast(row_number() over (partition by section order by {ORDER_SQL}) as int) as rank from k where eligible or not anyel)"""


@query(
    "f5_reliability_by_phone",
    RANK_SQL.format(source=scored_sql("phone")) + f" select rank, {SCORE_SQL} from o where rank <= 6",
)
def _(spark, sf):
    ranked = ranking.rank_section(scored(spark, sf, "phone"))
    return rounded(ranked, ("rank", *SCORE_COLUMNS), SCORE_FLOATS)


@query(
    "f5_rank_all_sections",
    RANK_SQL.format(source=scored_sql(*SECTIONS)) + f" select rank, {SCORE_SQL} from o where rank <= 6",
)
def _(spark, sf):
    ranked = ranking.rank_section(scored(spark, sf, *SECTIONS))
    return rounded(ranked, ("rank", *SCORE_COLUMNS), SCORE_FLOATS)


BEST_SQL = f""", fp as (select *, row_number() over (partition by project order by {ORDER_SQL}) as place from o
   where section = 'project_software' and project <> ''),
 bp as (select * exclude (rank, place), cast(row_number() over (order by {ORDER_SQL}) as int) as rank from fp where place = 1)"""


@query(
    "e15_best_software_per_project",
    RANK_SQL.format(source=scored_sql("project_software")) + BEST_SQL + f" select rank, {SCORE_SQL} from bp where rank <= 6",
)
def _(spark, sf):
    best = ranking.best_per_project(scored(spark, sf, "project_software"))
    return rounded(best, ("rank", *SCORE_COLUMNS), SCORE_FLOATS)


@query(
    "f9_section_leaders",
    RANK_SQL.format(source=scored_sql(*SECTIONS)) + BEST_SQL + """ select section, label, project, session_count,
    round(reliability_score, 6) as reliability_score from o where rank = 1 and section <> 'project_software'
    union all select section, label, project, session_count, round(reliability_score, 6) from bp where rank = 1""",
)
def _(spark, sf):
    groups = scored(spark, sf, *SECTIONS)
    rows = ranking.leaders(ranking.rank_section(groups), ranking.best_per_project(groups))
    return rounded(rows, ("section", "label", "project", "session_count"), ("reliability_score",))
