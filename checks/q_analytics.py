"""Session analytics, nightly job, snapshots."""

from __future__ import annotations

import tempfile
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampertrace.operators import analytics as A
from ampertrace.operators import ranking
from ampertrace.plans.nightly import nightly
from ampertrace.plans.problem_report import full_report, problem_report
from ampertrace.sources import snapshots, telemetry
from ampertrace.session import cut_lineage, shared_folder
from checks import inputs
from checks.q_report import ALL, ASSESS, PROBLEM_SQL, assessed, events, report_sessions_of  # noqa: F401
from checks.q_scalars import FLAGS as CANDIDATE
from checks.q_scalars import GROUP_KEYS, P
from checks.q_sessions import (
    BEST_SQL, ORDER_SQL, RANK_SQL, SCORE_COLUMNS, SCORE_FLOATS, SCORE_SQL, SECTIONS, SESSION_EXACT, SESSIONS_SQL, built,
    rounded, rounded_sql, scored_sql,
)
from checks.registry import query

PEER = f"""{ASSESS},
pm as (select phone, project_number, count(*) as pn, quantile_cont(duration_minutes, 0.5) as md, quantile_cont(avg_eff, 0.5) as m_eff, quantile_cont(avg_rx, 0.5) as mr,
  quantile_cont(avg_tx, 0.5) as mt, quantile_cont(median_ingest_delay, 0.5) as ml from asd group by 1, 2),
pf0 as (select asd.*, coalesce(pn >= 3 and duration_minutes < md * 0.45 and sample_count >= 3, false) as peer_short,
  coalesce(pn >= 3 and avg_eff < m_eff - 8 and avg_eff < m_eff * 0.85, false) as peer_low_eff, coalesce(pn >= 3 and avg_rx < mr * 0.6 and avg_rx < mr - 2, false) as peer_low_rx,
  coalesce(pn >= 3 and avg_tx < mt * 0.6 and avg_tx < mt - 2, false) as peer_low_tx, coalesce(pn >= 3 and median_ingest_delay > greatest(ml * 3, 120.0), false) as peer_late
  from asd join pm using (phone, project_number)),
pf as (select *, peer_short::int + peer_low_eff::int + peer_low_rx::int + peer_low_tx::int + peer_late::int as peer_issue_count,
  2 * (peer_short::int + peer_low_eff::int + peer_low_rx::int + peer_low_tx::int) + peer_late::int as peer_severity from pf0)"""
FLAGS = ("peer_short", "peer_low_eff", "peer_low_rx", "peer_low_tx", "peer_late")


def peers(spark, sf):
    return cut_lineage(A.peer_flags(assessed(spark, sf)))


@query("e14_peer_flags", f"{PEER} select session_key, {', '.join(FLAGS)}, peer_issue_count, peer_severity from pf")
def _(spark, sf):
    return peers(spark, sf).select("session_key", *FLAGS, "peer_issue_count", "peer_severity")


@query(
    "f7_flagged_sessions",
    f"""{PEER}, fl as (select *, verdict in ('warning','not_ok','defect') as bad, len(string_split(reasons, ',')) as nr from pf),
 fs as (select *, peer_issue_count + case when interruption_count > 0 then 1 else 0 end + least(drop_count, 3) + case when bad then least(nr, 2) else 0 end as issue_count,
  peer_severity + case when interruption_count > 0 then 3 else 0 end + least(drop_count, 3) + case when bad then severity_score else 0 end as total_severity from fl)
 select session_key, cast(issue_count as int) as issue_count, cast(total_severity as int) as total_severity, case when total_severity >= 5 then 'critical' else 'warn' end as severity
 from fs where issue_count > 0 order by total_severity desc, end_ts desc, session_key limit 8""",
)
def _(spark, sf):
    return A.flagged(peers(spark, sf)).select("session_key", "issue_count", "total_severity", "severity")


@query(
    "d8_reliability_of_report_sessions",
    f"""{ASSESS}, a as (select 'phone' as section, phone as label, count(*) as session_count, count(*) filter (where not silent) as covered_count,
 count(*) filter (where verdict = 'defect') as defect_count, count(*) filter (where verdict = 'not_ok') as not_ok_count, count(*) filter (where verdict = 'warning') as warning_count,
 count(*) filter (where verdict = 'ok' and interruption_count = 0 and drop_count = 0) as clean_count, quantile_cont(avg_eff, 0.5) as median_eff from asd group by phone)
 select section, label, session_count, covered_count, defect_count, not_ok_count, warning_count, clean_count, round(median_eff, 6) as median_eff,
 round(greatest(0.0, 100.0 - (60.0 * defect_count + 25.0 * not_ok_count + 10.0 * warning_count + 5.0 * (session_count - covered_count)) / session_count), 6) as reliability_score from a""",
)
def _(spark, sf):
    rows = ranking.score(ranking.reliability(A.as_ranking_input(assessed(spark, sf)), "phone"))
    exact = ("section", "label", "session_count", "covered_count", "defect_count", "not_ok_count", "warning_count", "clean_count")
    return rounded(rows, exact, ("median_eff", "reliability_score"))


#: expected values, written out so that the code under test does not state them
DECISION_WEIGHTS = {"median_eff": 0.4, "median_rx": 0.2, "median_tx": 0.15, "clean_rate": 0.25}


def decision_sql(label: str) -> str:
    norm = lambda m: f"case when {m} is not null and lo_{m} is not null then case when hi_{m} - lo_{m} < 1e-9 then 1.0 else greatest(0.0, least(1.0, ({m} - lo_{m}) / (hi_{m} - lo_{m}))) end end"
    total = " + ".join(f"coalesce({norm(m)} * {w}, 0)" for m, w in DECISION_WEIGHTS.items())
    weight = " + ".join(f"case when {m} is not null and lo_{m} is not null then {w} else 0 end" for m, w in DECISION_WEIGHTS.items())
    bounds = ", ".join(f"min({m}) filter (where session_count >= 2) as lo_{m}, max({m}) filter (where session_count >= 2) as hi_{m}" for m in DECISION_WEIGHTS)
    return f"""{PEER}, dg as (select {label} as label, count(*) as session_count, cast(sum(sample_count) as bigint) as sample_count,
 quantile_cont(avg_eff, 0.5) as median_eff, quantile_cont(avg_rx, 0.5) as median_rx, quantile_cont(avg_tx, 0.5) as median_tx,
 count(*) filter (where interruption_count = 0 and drop_count = 0 and peer_issue_count = 0) / count(*) as clean_rate, count(*) filter (where interruption_count > 0) / count(*) as interruption_rate,
 count(*) filter (where drop_count > 0) / count(*) as drop_rate, count(*) filter (where peer_issue_count > 0) / count(*) as peer_issue_rate,
 count(distinct nullif(software_version, '')) as release_count from pf group by 1),
 db as (select {bounds} from dg), dr as (select dg.*, ({total}) / ({weight}) * 100 as decision_score from dg, db)"""


DEC_EXACT = ("label", "session_count", "sample_count", "release_count")
DEC_FLOATS = ("median_eff", "median_rx", "median_tx", "clean_rate", "interruption_rate", "drop_rate", "peer_issue_rate", "decision_score")


@query("d9_decision_rank", f"{decision_sql('phone')} select {rounded_sql(DEC_EXACT, DEC_FLOATS)} from dr")
def _(spark, sf):
    return rounded(A.decision_rank(peers(spark, sf), F.col("phone")), DEC_EXACT, DEC_FLOATS)


PAIR = "phone || ' / ' || project_number"


@query("d10_pair_rank", f"{decision_sql(PAIR)} select {rounded_sql(DEC_EXACT, DEC_FLOATS)} from dr")
def _(spark, sf):
    return rounded(A.decision_rank(peers(spark, sf), A.pair_label()), DEC_EXACT, DEC_FLOATS)


@query(
    "f6_metric_toplist",
    f"{decision_sql(PAIR)} select label, round(median_rx, 6) as median_rx from dr where session_count >= 2 order by dr.median_rx desc, session_count desc, sample_count desc, label limit 5",
)
def _(spark, sf):
    ranked = A.decision_rank(peers(spark, sf), A.pair_label())
    return rounded(A.metric_toplist(ranked, "median_rx"), ("label",), ("median_rx",))


RELEASE = f"""{ASSESS}, rl as (select software_version as label, count(*) as session_count, cast(sum(sample_count) as bigint) as sample_count, quantile_cont(avg_eff, 0.5) as median_eff,
 min(start_ts) as first_seen, max(end_ts) as last_seen from asd where software_version <> '' and avg_eff is not null group by 1)"""


@query("d11_release_rank", f"{RELEASE} select label, session_count, sample_count, round(median_eff, 6) as median_eff from rl where session_count >= 2 order by rl.median_eff desc, session_count desc, label limit 6")
def _(spark, sf):
    return rounded(A.release_rank(report_sessions_of(events(spark, sf))), ("label", "session_count", "sample_count"), ("median_eff",))


@query(
    "e13_release_regression",
    f"""{RELEASE}, r1 as (select *, session_count >= 2 as el from rl),
 r2 as (select *, list_sort(list(median_eff) over (partition by el order by first_seen, label rows between 3 preceding and 1 preceding)) as bf from r1),
 r3 as (select *, len(bf) = 3 as ready, list_median(bf) as baseline_eff, median_eff - list_median(bf) as delta, len(list_filter(bf, lambda x: x > median_eff)) as better_count from r2),
 r4 as (select *, coalesce(ready and delta <= -2, false) as ca, coalesce(ready and delta <= -4 and better_count >= 2, false) as alarm from r3),
 r5 as (select *, ca and not alarm and (coalesce(lag(ca) over w, false) or coalesce(lead(ca) over w, false)) as warning from r4 window w as (partition by el order by first_seen, label))
 select label, session_count, round(baseline_eff, 6) as baseline_eff, round(delta, 6) as delta, case when el then cast(coalesce(better_count, 0) as int) end as better_count,
 case when not el then 'insufficient' when alarm then 'drop' when warning then 'warning' when not coalesce(ready, false) then 'baseline' when ca then 'steady' when delta >= 4 then 'up' else 'steady' end as trend from r5""".replace("list_median(bf)", "list_aggregate(bf, 'median')"),
)
def _(spark, sf):
    rows = A.release_regression(report_sessions_of(events(spark, sf)))
    return rounded(rows, ("label", "session_count", "better_count", "trend"), ("baseline_eff", "delta"))


POS_FLOATS = ("median_eff", "median_rx", "median_tx", "median_temperature", "interruption_rate", "warning_rate", "alarm_rate", "clean_rate", "risk_score")
POS_EXACT = ("label", "session_count", "sample_count", "peak_temperature", "release_count", "phone_count", "project_count")


@query(
    "d12_position_risk",
    f"""{PEER}, g as (select position as label, count(*) as session_count, cast(sum(sample_count) as bigint) as sample_count, max(max_temperature) as peak_temperature,
 count(distinct software_version) as release_count, count(distinct phone) as phone_count, count(distinct project_number) as project_count,
 quantile_cont(avg_eff, 0.5) as median_eff, quantile_cont(avg_rx, 0.5) as median_rx, quantile_cont(avg_tx, 0.5) as median_tx, quantile_cont(avg_temperature, 0.5) as median_temperature,
 count(*) filter (where interruption_count > 0) / count(*) as interruption_rate, count(*) filter (where warning_event_count > 0) / count(*) as warning_rate,
 count(*) filter (where alarm_event_count > 0) / count(*) as alarm_rate,
 count(*) filter (where interruption_count = 0 and warning_event_count = 0 and alarm_event_count = 0 and peer_issue_count = 0) / count(*) as clean_rate from pf group by 1),
 h as (select *, alarm_rate * 100 + interruption_rate * 60 + warning_rate * 40 + greatest(0.0, peak_temperature - 35) as risk_score from g)
 select {rounded_sql(POS_EXACT, POS_FLOATS)} from h""",
)
def _(spark, sf):
    return rounded(A.position_risk(peers(spark, sf)), POS_EXACT, POS_FLOATS)


@query(
    "d13_position_release",
    f"""{ASSESS} select position as position_label, software_version as release_label, count(*) as session_count, max(max_temperature) as peak_temperature,
 cast(sum(alarm_event_count) as bigint) as alarm_count, cast(sum(warning_event_count) as bigint) as warning_count, cast(sum(interruption_count) as bigint) as interruption_count,
 max(end_ts) as last_seen, round(quantile_cont(avg_eff, 0.5), 6) as median_eff from asd group by 1, 2""",
)
def _(spark, sf):
    rows = A.position_release(report_sessions_of(events(spark, sf)))
    exact = ("position_label", "release_label", "session_count", "peak_temperature", "alarm_count", "warning_count", "interruption_count", "last_seen")
    return rounded(rows, exact, ("median_eff",))


@query(
    "d14_metric_coverage",
    f"with p as ({inputs.plain(inputs.ALL_METRICS)}) "
    + " union all ".join(
        f"select '{m}' as metric, count({m}) as available_count, count(*) - count({m}) as missing_count, round(count({m}) / count(*), 9) as coverage_rate from p"
        for m in ("eff", "rx", "tx", "rpp", "current_a", "temperature", "battery_level", "voltage_v")
    ),
)
def _(spark, sf):
    return A.coverage(inputs.all_metrics(spark, sf)).withColumn("coverage_rate", F.round("coverage_rate", 9))


STATUS_ROWS = f"p as ({P}), sr as (select *, coalesce(hmi_status, 'N/A') as st from p)"
POSITION = f"""{STATUS_ROWS}, ps as (select cast(substr(position, 2) as int) as position_number, position as position_label, count(*) as total_rows, count(*) filter (where st <> 'N/A') as considered_rows,
 count(*) filter (where st in ('2','3')) as pass_rows, count(*) filter (where st not in ('2','3','N/A')) as not_ok_rows, quantile_cont(eff, 0.5) as median_eff from sr group by position)"""


@query(
    "d15_position_status",
    f"with {POSITION} select cast(position_number as int) as position_number, position_label, total_rows, considered_rows, pass_rows, not_ok_rows, round(median_eff, 6) as median_eff, round(not_ok_rows / considered_rows, 6) as bad_rate from ps",
)
def _(spark, sf):
    rows = A.position_status(inputs.processed(spark, sf))
    exact = ("position_number", "position_label", "total_rows", "considered_rows", "pass_rows", "not_ok_rows")
    return rounded(rows, exact, ("median_eff", "bad_rate"))


@query(
    "d16_status_table",
    f"""with {STATUS_ROWS} select st as status_code, count(*) as row_count, count(distinct position) as position_count, count(distinct phone) as phone_count, count(distinct project_number) as project_count,
 case when st in ('2','3') then 'ok' else 'warn' end as verdict_class, round(count(*) / (select count(*) from sr where st <> 'N/A'), 6) as row_rate from sr where st <> 'N/A' group by 1""",
)
def _(spark, sf):
    rows = A.status_table(inputs.processed(spark, sf))
    return rounded(rows, ("status_code", "row_count", "position_count", "phone_count", "project_count", "verdict_class"), ("row_rate",))


SCENARIO = ", ".join(f"count(*) filter (where verdict = '{v}') as {v}_count" for v in ("ok", "not_ok", "defect", "no_data", "status_unavailable"))


@query(
    "d17_scenario_table",
    f"""{ASSESS}, g as (select scenario_label, count(*) as session_count, count(distinct position) as position_count, {SCENARIO} from asd group by 1)
 select *, round((not_ok_count + defect_count) / nullif(ok_count + not_ok_count + defect_count, 0), 6) as bad_rate from g""",
)
def _(spark, sf):
    return A.scenario_table(assessed(spark, sf)).withColumn("bad_rate", F.round("bad_rate", 6))


@query(
    "d18_position_overview",
    f"""{ASSESS}, {POSITION.replace('p as (', 'p9 as (', 1).replace('from p)', 'from p9)')}, v as (select position, count(*) as session_count, count(*) filter (where verdict = 'ok') as ok_session_count,
 count(*) filter (where verdict = 'not_ok') as not_ok_session_count, count(*) filter (where verdict = 'defect') as defect_session_count from asd group by position)
 select cast(position_number as int) as position_number, considered_rows, not_ok_rows, session_count, ok_session_count, not_ok_session_count, defect_session_count from ps join v on position = position_label""",
)
def _(spark, sf):
    rows = A.overview(inputs.processed(spark, sf), assessed(spark, sf))
    return rows.select(
        "position_number", "considered_rows", "not_ok_rows", "session_count", "ok_session_count", "not_ok_session_count", "defect_session_count"
    )


# ---- tables and jobs -----------------------------------------------------------------------------

NIGHTLY = (
    RANK_SQL.format(source=scored_sql(*SECTIONS)) + BEST_SQL
    + f" select rank, {SCORE_SQL} from o where rank <= 6 and section <> 'project_software' union all select rank, {SCORE_SQL} from bp where rank <= 6"
)


def _folder(spark) -> str:
    return tempfile.mkdtemp(prefix="snapshot-", dir=shared_folder(spark)) if "://" not in shared_folder(spark) else f"{shared_folder(spark)}/snapshot"


@query("j24_nightly_job", NIGHTLY)
def _(spark, sf):
    ranked = nightly(inputs.processed(spark, sf), _folder(spark), date(2024, 2, 1))
    return rounded(ranked, ("rank", *SCORE_COLUMNS), SCORE_FLOATS)


@query(
    "a7_a8_snapshot_upsert_and_latest",
    f"with {SESSIONS_SQL} select date '2024-02-02' as snapshot_date, 'sessions' as source_relation, cast(sum(source_row_count) as bigint) as source_row_count, cast(count(*) as int) as session_count, true as is_current from ss",
)
def _(spark, sf):
    path = _folder(spark)
    for day in (date(2024, 2, 1), date(2024, 2, 2), date(2024, 2, 2)):
        nightly(inputs.processed(spark, sf), path, day)
    latest = snapshots.latest_snapshot(spark, path, date(2024, 2, 2))
    return latest.select("snapshot_date", "source_relation", "source_row_count", "session_count", "is_current")


@query(
    "a6_sessions_table",
    f"with {SESSIONS_SQL} select session_key, source_row_count, start_ts, interruption_count from ss",
)
def _(spark, sf):
    path = _folder(spark) + "/sessions"
    telemetry.write_sessions(built(spark, sf), path)
    return spark.read.parquet(path).select("session_key", "source_row_count", "start_ts", "interruption_count")


#: rows of a group between its first candidate - 20 minutes and its last + 20 minutes
_KEYS = [f"coalesce({c}, '') as g{k}" for k, c in enumerate(GROUP_KEYS)]
_NAMES = ", ".join(f"g{k}" for k in range(len(GROUP_KEYS)))
REPORT_SQL = PROBLEM_SQL.replace(
    f"p as ({ALL}),",
    f"""p0 as (select *, {', '.join(_KEYS)} from ({ALL})), wi as (select {_NAMES}, min(event_ts) - interval 20 minute as wf, max(event_ts) + interval 20 minute as wt
 from p0 where {CANDIDATE["compat"]} group by {_NAMES}), p as (select p0.* from p0 join wi using ({_NAMES}) where event_ts between wf and wt),""",
)
ITEM_COLUMNS = ("session_key", "classification", "short_reason", "status_code", "problem_ts")


@query("j13_problem_report_end_to_end", f"{REPORT_SQL} select {', '.join(ITEM_COLUMNS)} from it")
def _(spark, sf):
    return problem_report(inputs.all_metrics(spark, sf)).select(*ITEM_COLUMNS)


@query(
    "j12_j13_full_report",
    f"""{REPORT_SQL} select 'items' as part, classification as label, count(*) as n from it group by 2 union all select 'phones', phone, count(*) from it where phone <> '' group by 2
 union all select 'types', test_type, count(*) from it where test_type <> '' group by 2 union all select 'positions', position, count(*) from it where position <> '' group by 2
 union all select 'sessions', verdict, count(*) from asd group by 2""",
)
def _(spark, sf):
    report = full_report(inputs.all_metrics(spark, sf))
    counted = lambda df, part, c: df.groupBy(F.col(c).alias("label")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "label", "n")
    parts = [counted(report["items"], "items", "classification"), counted(report["sessions"], "sessions", "verdict")]
    parts += [report[f"by_{c}"].select(F.lit(part).alias("part"), "label", "n") for part, c in (("phones", "phone"), ("types", "test_type"), ("positions", "position"))]
    return reduce(DataFrame.unionByName, parts)
