"""Scalar functions, telemetry source, candidate flags, scopes and listings."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ampertrace.functions import payload, text
from ampertrace.operators import filters
from ampertrace.operators.verdicts import overlaps, within
from ampertrace.sources import telemetry
from checks import inputs
from checks.registry import query

P = inputs.plain(inputs.PROCESSED)

# Raw rows: the processed projection packed into JSON again, with nesting, mixed case and decimal commas.
RAW = f"""
with pr as ({inputs.PROCESSED})
select raw_id, device_name, source_csv_file, raw_id as source_seq, cast(event_ts as string) as event_ts,
 cast(inserted_at as string) as inserted_at, charger_name, phone, position, project_number, software_version,
 concat('\x02"hmi_status":', case when hmi_status is null then 'null' else concat('"status ', hmi_status, '"') end,
  ',"Eff":"', cast(cast(eff as int) as string), ',5"',
  case when raw_id % 3 = 0 then concat(',"nested":\x02"rx":', cast(cast(rx as int) as string), '\x03') else concat(',"rx":', cast(cast(rx as int) as string)) end,
  ',"TX":"', cast(cast(tx as int) as string), ' W","temp_c":', cast(cast(temperature as int) as string),
  ',"sheet_name":', coalesce('"' || scenario_hint || '"', 'null'), ',"sample":"', sample_label, '"',
  ',"result":', coalesce('"' || manual_result || '"', 'null'), ',"jira":', coalesce('"' || defect_id || '"', 'null'),
  ',"fod object":', coalesce('"' || fod_object || '"', 'null'), ',"dual":', coalesce('"' || dual_charging_label || '"', 'null'), '\x03') as row_json
from pr
"""
RAW_ORACLE = inputs.plain(RAW).replace("\x02", "{").replace("\x03", "}")


def raw(spark, sf):
    # braces of the JSON text are doubled for the SQL formatter
    return inputs.project(spark, sf, RAW.replace("\x02", "{{").replace("\x03", "}}"))


def raw_sql(select: str) -> str:
    return f"with raw as ({RAW_ORACLE}) {select}"


NOT_OK = "'(^|[^a-z])(not ok|no ok|nok)([^a-z]|$)'"
FAIL = "'(^|[^a-z])(not ok|no ok|nok|defect|failure|charging inter|no charging|toggling)([^a-z]|$)'"
FLAG_HEAD = f"""(nullif(trim(defect_id),'') is not null or regexp_matches(lower(coalesce(manual_result,'')), {NOT_OK})
  or regexp_matches(lower(coalesce(defect_comment,'')), {FAIL}) or coalesce(hmi_status in ('0','1','4','5','6','8','9','13','14','17'), false)"""
SCEN = "lower(coalesce(scenario_hint,''))"
CHARGING = f"nullif(trim(card_position),'') is not null or nullif(trim(fod_object),'') is not null or contains({SCEN},'rfid') or contains({SCEN},'fod')"
NO_CARD = f"(nullif(trim(card_position),'') is null and not contains({SCEN},'rfid'))"
FLAGS = {
    "processed": f"{FLAG_HEAD} or coalesce(hmi_status = '3' and ({CHARGING} or contains({SCEN},'foreign object')), false)"
    f" or coalesce(hmi_status in ('15','16') and (nullif(trim(fod_object),'') is not null or contains({SCEN},'fod') or contains({SCEN},'foreign object') or {NO_CARD}), false))",
    "sessions": f"{FLAG_HEAD} or coalesce(hmi_status = '3' and ({CHARGING}), false) or coalesce(hmi_status in ('15','16') and not contains({SCEN},'rfid'), false))",
    "raw": f"{FLAG_HEAD} or coalesce(hmi_status = '3' and ({CHARGING}), false) or coalesce(hmi_status in ('15','16') and {NO_CARD}, false))",
}
BLOB = "lower(concat_ws(' ', coalesce(scenario_hint,''), coalesce(sample_label,''), coalesce(source_csv_file,'')))"
FLAGS["compat"] = (
    f"{FLAG_HEAD} or coalesce(hmi_status = '3' and (nullif(trim(card_position),'') is not null or nullif(trim(fod_object),'') is not null "
    f"or contains({BLOB},'rfid') or contains({BLOB},'fod') or contains({BLOB},'foreign object')), false) "
    f"or coalesce(hmi_status in ('15','16') and not contains({BLOB},'rfid'), false))"
)

FIELDS = """json_extract_string(row_json,'$.hmi_status') as js, json_extract_string(row_json,'$.Eff') as je,
 coalesce(json_extract_string(row_json,'$.rx'), json_extract_string(row_json,'$.nested.rx')) as jr, json_extract_string(row_json,'$.TX') as jt,
 json_extract_string(row_json,'$.temp_c') as jtemp, json_extract_string(row_json,'$.sheet_name') as scenario_hint,
 json_extract_string(row_json,'$.sample') as sample_label, json_extract_string(row_json,'$.result') as manual_result,
 json_extract_string(row_json,'$.jira') as defect_id, json_extract_string(row_json,'$."fod object"') as fod_object,
 json_extract_string(row_json,'$.dual') as dual_charging_label, null::varchar as card_position, null::varchar as defect_comment"""
BUILT_SQL = raw_sql(
    f"""select * exclude (js, je, jr, jt, jtemp), {FLAGS['processed']} as analysis_candidate from (
 select raw_id, device_name, source_csv_file, source_seq, try_cast(event_ts as timestamp) as event_ts, try_cast(inserted_at as timestamp) as inserted_at,
 charger_name, phone, position, project_number, software_version, {FIELDS},
 nullif(regexp_extract(js, '([0-9]+)', 1),'') as hmi_status, cast(replace(je, ',', '.') as double) as eff, cast(jr as double) as rx,
 cast(regexp_extract(jt, '([0-9]+)', 1) as double) as tx, cast(jtemp as double) as temperature,
 case when dual_charging_label = 'dual' then true end as dual_charging_flag,
 (epoch_us(try_cast(inserted_at as timestamp)) - epoch_us(try_cast(event_ts as timestamp))) / 1000000.0 as ingest_delay_seconds from raw)"""
)
BUILT_COLUMNS = (
    "raw_id", "device_name", "source_csv_file", "source_seq", "event_ts", "inserted_at", "charger_name", "phone",
    "position", "project_number", "software_version", "scenario_hint", "sample_label", "manual_result", "defect_id",
    "fod_object", "dual_charging_label", "card_position", "defect_comment", "hmi_status", "eff", "rx", "tx",
    "temperature", "dual_charging_flag", "ingest_delay_seconds", "analysis_candidate",
)


@query("a5_c4_h9_build_processed", BUILT_SQL)
def _(spark, sf):
    return telemetry.build_processed(raw(spark, sf)).select(*BUILT_COLUMNS)


@query(
    "a1_read_raw_times",
    raw_sql("select raw_id, source_seq, try_cast(event_ts as timestamp) as event_ts, try_cast(inserted_at as timestamp) as inserted_at from raw"),
)
def _(spark, sf):
    return telemetry.typed_raw(raw(spark, sf)).select("raw_id", "source_seq", "event_ts", "inserted_at")


@query(
    "a2_conform_missing_columns",
    f"with p as ({P}) select raw_id, event_ts, hmi_status, eff, null::double as rpp, null::double as voltage_v, null::varchar as row_json, null::boolean as analysis_candidate from p",
)
def _(spark, sf):
    full = telemetry.conform(inputs.processed(spark, sf))
    return full.select("raw_id", "event_ts", "hmi_status", "eff", "rpp", "voltage_v", "row_json", "analysis_candidate")


@query("a3_narrow_source", f"with p as ({P}) select raw_id, event_ts, hmi_status, null::double as current_a from p")
def _(spark, sf):
    return telemetry.conform(inputs.processed(spark, sf), required=("raw_id", "event_ts", "hmi_status", "current_a"))


@query("a4_validate_sessions")
def _(spark, sf):
    from checks.q_sessions import built

    return telemetry.validate_sessions(built(spark, sf)).select("session_key", "source_row_count")


for _variant in ("processed", "sessions", "raw"):

    @query(f"b{('processed', 'sessions', 'raw').index(_variant) + 1}_candidate_flag_{_variant}",
           f"with p as ({P}) select raw_id, {FLAGS[_variant]} as analysis_candidate from p")
    def _(spark, sf, variant=_variant):
        df = inputs.processed(spark, sf)
        return df.select("raw_id", filters.candidate_flag(df, variant).alias("analysis_candidate"))


@query(
    "b4_candidate_flag_compat",
    f"with p as ({P}) select raw_id, coalesce(case when raw_id % 5 = 0 then false end, {FLAGS['compat']}) as analysis_candidate from p",
)
def _(spark, sf):
    df = inputs.processed(spark, sf).drop("card_position", "defect_comment")
    df = df.withColumn("analysis_candidate", F.when(F.col("raw_id") % 5 == 0, F.lit(False)))
    return df.select("raw_id", filters.candidate_flag(df, "compat").alias("analysis_candidate"))


@query(
    "b5_apply_scope",
    f"""with p as ({P}) select raw_id, phone, event_ts from p where (cast(raw_id as varchar) ilike '%log%' or device_name ilike '%log%'
 or source_csv_file ilike '%LOG\\_1%' escape '\\' or charger_name ilike '%log\\_1%' escape '\\') and project_number = '0854_086'
 and sample_label = 'S1' and event_ts >= timestamp '2024-01-03' and event_ts < timestamp '2024-01-20'""",
)
def _(spark, sf):
    scope = filters.Scope(
        search_text="LOG_1", project_number="0854_086", sample="S1", event_ts_from=date(2024, 1, 3), event_ts_to=date(2024, 1, 19)
    )
    return filters.apply_scope(inputs.processed(spark, sf), scope).select("raw_id", "phone", "event_ts")


@query("b5_scope_dual_and_defect", f"with p as ({P}) select raw_id, defect_id from p where dual_charging_flag and defect_id ilike '%def-%'")
def _(spark, sf):
    scope = filters.Scope(dual_charging="tak", defect_id="def-")
    return filters.apply_scope(inputs.processed(spark, sf), scope).select("raw_id", "defect_id")


@query("b7_ingest_delay", f"with p as ({P}) select raw_id, (epoch_us(inserted_at) - epoch_us(event_ts)) / 1000000.0 as ingest_delay_seconds from p")
def _(spark, sf):
    return inputs.processed(spark, sf).select("raw_id", telemetry.ingest_delay().alias("ingest_delay_seconds"))


ENRICH_SQL = raw_sql(
    f"""select raw_id, coalesce(case when raw_id % 2 = 0 then 1.0 end, cast(replace(je, ',', '.') as double)) as eff, cast(jr as double) as rx,
 cast(jtemp as double) as temperature, coalesce(case when raw_id % 4 = 0 then 'given' end, scenario_hint) as scenario_hint, sample_label,
 (epoch_us(try_cast(inserted_at as timestamp)) - epoch_us(try_cast(event_ts as timestamp))) / 1000000.0 as ingest_delay_seconds
 from (select raw_id, event_ts, inserted_at, {FIELDS} from raw)"""
)


@query("b8_enrich_from_payload", ENRICH_SQL)
def _(spark, sf):
    df = telemetry.typed_raw(raw(spark, sf)).withColumns(
        {
            "eff": F.when(F.col("raw_id") % 2 == 0, F.lit(1.0)),
            "scenario_hint": F.when(F.col("raw_id") % 4 == 0, F.lit("given")),
        }
    )
    return telemetry.enrich(df).select(
        "raw_id", "eff", "rx", "temperature", "scenario_hint", "sample_label", "ingest_delay_seconds"
    )


@query(
    "b12_label_defaults",
    f"with p as ({P}) select raw_id, coalesce(nullif(trim(defect_id),''),'brak') as defect_label, coalesce(nullif(trim(phone),''),'brak telefonu') as phone_label from p",
)
def _(spark, sf):
    return inputs.processed(spark, sf).select(
        "raw_id",
        text.label_or_default("defect_id", "brak").alias("defect_label"),
        text.label_or_default("phone", "brak telefonu").alias("phone_label"),
    )


@query("h1_try_json", "select event_id, case when json_valid(case when event_id % 3 = 0 then props || '}' else props end) then '{\"k\":' || cast(regexp_extract(props, '([0-9]+)', 1) as varchar) || '}' end as parsed from events")
def _(spark, sf):
    broken = F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    return inputs.table(spark, sf, "events").select("event_id", F.to_json(payload.try_json(broken)).alias("parsed"))


@query(
    "h2_try_float",
    "select event_id, case when event_id % 4 = 0 then null else cast(replace(regexp_extract(replace(cast(value as varchar), '.', ','), '(-?[0-9]+(,[0-9]+)?)', 1), ',', '.') as double) end as number from events",
)
def _(spark, sf):
    events = inputs.table(spark, sf, "events")
    messy = F.when(F.col("event_id") % 4 == 0, F.lit("none")).otherwise(
        F.concat(F.lit("  "), F.translate(F.col("value").cast("decimal(20,2)").cast("string"), ".", ","), F.lit(" W"))
    )
    return events.select("event_id", payload.try_float(messy).alias("number"))


METRIC_SQL = raw_sql(f"select raw_id, cast(jr as double) as rx, cast(jtemp as double) as temperature, cast(replace(je, ',', '.') as double) as eff, scenario_hint, sample_label, defect_id from (select raw_id, {FIELDS} from raw)")


@query("h3_h5_h6_nested_payload_fields", METRIC_SQL)
def _(spark, sf):
    found = payload.nested_fields(
        F.col("row_json"),
        {"rx": payload.METRIC_KEYS["rx"], "temperature": payload.METRIC_KEYS["temperature"], "eff": payload.EFFICIENCY_KEYS["eff"]},
        {n: payload.TEXT_KEYS[n] for n in ("scenario_hint", "sample_label", "defect_id")},
    )
    return raw(spark, sf).select("raw_id", found.alias("f")).select("raw_id", "f.*")


@query(
    "h3_h4_flat_payload_fields",
    raw_sql(f"select raw_id, cast(regexp_extract(jt, '([0-9]+)', 1) as double) as tx, cast(jtemp as double) as temperature, manual_result from (select raw_id, {FIELDS} from raw)"),
)
def _(spark, sf):
    m = payload.payload_entries("row_json")
    return raw(spark, sf).select(
        "raw_id",
        payload.flat_metric(m, payload.METRIC_KEYS["tx"]).alias("tx"),
        payload.flat_metric(m, payload.METRIC_KEYS["temperature"]).alias("temperature"),
        payload.flat_text(m, payload.TEXT_KEYS["manual_result"]).alias("manual_result"),
    )


@query(
    "h6_efficiency_sides",
    "select event_id, case when event_id % 4 = 0 then value when event_id % 4 = 1 then value * 1.5 when event_id % 4 = 2 then value else value * 2 end as eff from events",
)
def _(spark, sf):
    k, v = F.col("event_id") % 4, F.col("value")
    return inputs.table(spark, sf, "events").select(
        "event_id", payload.efficiency(F.when(k == 0, v), F.when(k.isin(1, 2), v), F.when(k == 1, v * 2).when(k == 3, v * 2)).alias("eff")
    )


STATUS_IN = "case event_id % 5 when 0 then 'status ' || cast(event_id % 18 as varchar) when 1 then ' idle ' when 2 then ' ' when 3 then 'NaN' end"


@query(
    "h7_norm_status",
    "select event_id, case event_id % 5 when 0 then cast(event_id % 18 as varchar) when 1 then 'IDLE' when 3 then 'NAN' end as sql_status, case event_id % 5 when 0 then cast(event_id % 18 as varchar) when 1 then 'IDLE' else 'N/A' end as report_status from events",
)
def _(spark, sf):
    m, e = F.col("event_id") % 5, F.col("event_id")
    s = (
        F.when(m == 0, F.concat(F.lit("status "), (e % 18).cast("string"))).when(m == 1, F.lit(" idle "))
        .when(m == 2, F.lit(" ")).when(m == 3, F.lit("NaN"))
    )
    return inputs.table(spark, sf, "events").select(
        "event_id", payload.norm_status(s).alias("sql_status"), payload.norm_status(s, "report").alias("report_status")
    )


@query("h8_boolish", f"with p as ({P}) select raw_id, case when manual_result = 'OK' then null when dual_charging_label = 'dual' then true when raw_id % 2 = 0 then false end as flag from p")
def _(spark, sf):
    word = F.when(F.col("manual_result") == "OK", F.lit("OK")).when(F.col("dual_charging_label") == "dual", F.lit(" Tak ")).when(
        F.col("raw_id") % 2 == 0, F.lit("Single")
    )
    return inputs.processed(spark, sf).select("raw_id", payload.boolish(word).alias("flag"))


#: expected values, written out so that the code under test does not state them
EXPECTED_STATUSES = {
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
_STATUS_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in EXPECTED_STATUSES.items())


@query(
    "h10_status_dictionary",
    f"with p as ({P}), d(code, description) as (values {_STATUS_ROWS}) select coalesce(hmi_status,'N/A') as code, coalesce(d.description,'Nieznany status') as description, count(*) as n from p left join d on d.code = coalesce(hmi_status,'N/A') group by all",
)
def _(spark, sf):
    code = payload.norm_status("hmi_status", "report")
    rows = inputs.processed(spark, sf).groupBy(code.alias("code")).agg(F.count("*").alias("n"))
    return rows.withColumn("description", payload.status_description(F.col("code")))


@query("h12_first_field", "select event_id, case when event_id % 2 = 0 then regexp_extract(props, '([0-9]+)', 1) else 'k' || cast(event_id as varchar) end as field from events")
def _(spark, sf):
    k = F.regexp_extract("props", "([0-9]+)", 1)
    packed = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"title":{"value":"'), k, F.lit('"}}'))).otherwise(
        F.concat(F.lit('{"title":null,"name":"k'), F.col("event_id").cast("string"), F.lit('"}'))
    )
    return inputs.table(spark, sf, "events").select("event_id", payload.first_field(packed, "title", "name").alias("field"))


@query("h13_position_number", "select p_partkey, case when p_partkey % 3 = 0 then cast(p_size as int) end as number from part")
def _(spark, sf):
    from ampertrace.functions.text import position_number

    label = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("pos P "), F.col("p_size").cast("string"), F.lit(" left"))).otherwise(
        F.concat(F.lit("UP"), F.col("p_size").cast("string"))
    )
    return inputs.table(spark, sf, "part").select("p_partkey", position_number(label).alias("number"))


@query(
    "i1_i2_context_text",
    f"""with p as ({P}) select raw_id, lower(coalesce(scenario_hint,'')) as cleaned, case scenario_hint when 'RFID Protection' then 'rfid' when 'FOD test' then 'fod'
  when 'NFC' then 'nfc' when 'Charging 0-100%' then 'charging' else '' end as hint from p""",
)
def _(spark, sf):
    padded = F.concat(F.lit("  "), F.regexp_replace("scenario_hint", " ", " \n "), F.lit(" "))
    return inputs.processed(spark, sf).select(
        "raw_id", text.clean_text(padded).alias("cleaned"), text.scenario_hint(padded).alias("hint")
    )


SETS = """select o_custkey, list_sort(list(distinct o_orderstatus)) as s from orders group by 1"""


@query(
    "g5_array_predicates",
    f"with a as ({SETS}) select o_custkey, list_has_any(s, ['F','P']) as overlap, list_has_all(['F','O'], s) as contained, s = ['O'] as same from a",
)
def _(spark, sf):
    codes = F.array_sort(F.collect_set("o_orderstatus")).alias("s")
    sets = inputs.table(spark, sf, "orders").groupBy("o_custkey").agg(codes)
    s = F.col("s")
    return sets.select(
        "o_custkey", overlaps(s, "F", "P").alias("overlap"), within(s, "F", "O").alias("contained"), (s == F.array(F.lit("O"))).alias("same")
    )


CAND = f"with p as ({P}), c as (select *, {FLAGS['processed']} as analysis_candidate from p)"


def flagged(spark, sf):
    df = inputs.processed(spark, sf)
    return df.withColumn("analysis_candidate", filters.candidate_flag(df))


@query("f1_page", f"{CAND} select raw_id, charger_name from c order by charger_name desc nulls last, raw_id desc limit 50 offset 100")
def _(spark, sf):
    return filters.page(flagged(spark, sf), "charger_name", "desc", 3, 50).select("raw_id", "charger_name")


@query("f2_recent_candidates", f"{CAND} select raw_id, inserted_at from c where analysis_candidate order by inserted_at desc nulls last, raw_id desc limit 64")
def _(spark, sf):
    return filters.recent_candidates(flagged(spark, sf), 64, "inserted_at").select("raw_id", "inserted_at")


@query("f3_recent_rows", f"{CAND} select raw_id, event_ts from c order by event_ts desc nulls last, raw_id desc limit 1200")
def _(spark, sf):
    return filters.recent_rows(flagged(spark, sf), 1200).select("raw_id", "event_ts")


#: expected values, written out so that the code under test does not state them
GROUP_KEYS = ("phone", "project_number", "device_name", "charger_name", "position", "source_csv_file")
GROUP = ", ".join(f"coalesce({c},'') as {c}" for c in GROUP_KEYS)
GROUP_NAMES = ", ".join(GROUP_KEYS)
TOP = f"t as (select {GROUP}, max(event_ts) as last_candidate_ts from c where analysis_candidate group by all order by last_candidate_ts desc nulls last, {GROUP_NAMES} limit 16)"


@query("f4_top_groups", f"{CAND}, {TOP} select * from t")
def _(spark, sf):
    return filters.top_groups(flagged(spark, sf), 16)


@query("c2_restrict_to_groups", f"{CAND}, {TOP} select c.raw_id from c where exists (select 1 from t where {' and '.join(f'coalesce(c.{x},chr(0)) = t.{x}' for x in GROUP_KEYS)})")
def _(spark, sf):
    rows = flagged(spark, sf)
    return filters.restrict_to_groups(rows, filters.top_groups(rows, 16)).select("raw_id")


TRIM = f"""r as (select *, max((event_ts, raw_id)) over (partition by {GROUP_NAMES}) as latest, row_number() over (partition by {GROUP_NAMES} order by event_ts desc nulls last, raw_id desc) as rn from c where analysis_candidate),
 q as (select *, dense_rank() over (order by latest desc) as gr from r), seeds as (select * from q where gr <= 16 and rn <= 12)"""


@query("e16_trim_groups", f"{CAND}, {TRIM} select raw_id from seeds")
def _(spark, sf):
    return filters.trim_groups(flagged(spark, sf).filter("analysis_candidate"), 16).select("raw_id")


@query(
    "c3_expand_windows",
    f"{CAND}, {TRIM}, w as (select {GROUP_NAMES}, min(event_ts) - interval 20 minute as f, max(event_ts) + interval 20 minute as t from seeds group by {GROUP_NAMES}) "
    f"select c.raw_id from c join w on {' and '.join(f'c.{x} = w.{x}' for x in GROUP_KEYS)} and c.event_ts between w.f and w.t",
)
def _(spark, sf):
    rows = flagged(spark, sf)
    seeds = filters.trim_groups(rows.filter("analysis_candidate"), 16)
    return filters.expand_windows(rows, seeds).select("raw_id")


@query("e5_total_rows", f"{CAND} select raw_id, count(*) over () as total_rows from c where analysis_candidate")
def _(spark, sf):
    return filters.with_total(flagged(spark, sf).filter("analysis_candidate").select("raw_id"))


@query("g4_distinct_on", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def _(spark, sf):
    return filters.distinct_on(
        inputs.table(spark, sf, "events"), "user_id", [F.col("ts"), F.col("event_id")], ("user_id", "event_id", "event_type")
    )


@query(
    "g1_filter_options",
    f"with p as ({P}) " + " union ".join(f"select '{c}' as field, {c} as value from p where nullif(trim({c}),'') is not null" for c in filters.OPTION_COLUMNS),
)
def _(spark, sf):
    return filters.filter_options(inputs.processed(spark, sf))
