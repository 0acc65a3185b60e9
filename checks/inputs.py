"""Projections of the driver tables onto the input schemas, as SQL valid in Spark and DuckDB.

``{events}`` stands for the table; the oracle side replaces it by the plain view name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ampertrace.session import prepare

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

PROCESSED = """
with e as (
 select event_id, ts, user_id, event_type, value, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k,
        cast(extract(day from ts) as int) as d
 from {events})
select event_id as raw_id, ts as event_ts, ts + (event_id % 7) * interval '30' second as inserted_at,
 'dev1' as device_name, concat('CH', cast(user_id % 2 as string)) as charger_name,
 concat('PH', cast(user_id % 3 as string)) as phone,
 case when user_id % 2 = 0 then '0854_086' else '0854_108' end as project_number,
 concat('P', cast(1 + user_id % 3 as string)) as position, concat('SW', cast(cast(floor(d / 4) as int) as string)) as software_version,
 concat('log_', cast(d as string), '.csv') as source_csv_file,
 case d % 5 when 0 then 'RFID Protection' when 1 then 'FOD test' when 2 then 'NFC' when 3 then null else 'Charging 0-100%' end as scenario_hint,
 case when d % 5 = 1 and d % 2 = 0 then 'coin' end as fod_object,
 cast(null as string) as card_position, concat('S', cast(d % 2 as string)) as sample_label,
 case when k % 10 = 1 then 'OK' when k % 10 = 2 then 'NOT OK' end as manual_result,
 case when k = 99 then concat('DEF-', cast(event_id as string)) end as defect_id,
 cast(null as string) as defect_comment,
 case when d % 7 = 0 then 'dual' end as dual_charging_label, case when d % 7 = 0 then true end as dual_charging_flag,
 case when event_type = 'error' and k % 4 = 0 then cast(k % 18 as string) when event_type = 'purchase' then '2'
      when d % 5 = 0 then '15' when d % 5 = 1 then '4' when k % 11 = 0 then null else '3' end as hmi_status,
 cast(case when event_type = 'error' then 40 + k % 10 else 70 + k % 10 end as double) as eff,
 cast(5 + k % 10 as double) as rx, cast(8 + k % 6 as double) as tx, cast(25 + k % 20 as double) as temperature
from e
"""

# The same rows with all metrics, some of them not in every row.
ALL_METRICS = f"""
select x.*, case when raw_id % 3 <> 0 then cast(raw_id % 7 as double) / 10 end as rpp, cast(raw_id % 5 as double) / 50 as current_a,
 case when raw_id % 4 <> 1 then 3 + cast(raw_id % 9 as double) / 8 end as voltage_v, case when raw_id % 6 = 0 then cast(raw_id % 100 as double) end as battery_level
from ({PROCESSED}) x
"""

WORK_ITEMS = """
select o.o_orderkey as work_item_id, concat('PRJ', cast(o.o_custkey % 12 as string)) as project,
 case when o.o_orderkey % 10 < 5 then 'Defect' when o.o_orderkey % 10 < 9 then 'Finding (review)' else 'Task' end as type,
 c.c_name as owner, concat('Customer#', lpad(cast((o.o_custkey * 7) % 1700 as string), 9, '0')) as creator,
 concat(p.p_name, ' fails at ', lower(o.o_orderpriority), ' ABC-', cast(o.o_orderkey as string)) as work_item,
 concat('https://items/', cast(o.o_orderkey % 1000 as string)) as work_item_url,
 o.o_orderdate as created
from {orders} o join {customer} c on c.c_custkey = o.o_custkey join {part} p on p.p_partkey = 1 + o.o_orderkey % (select max(p_partkey) from {part})
"""

PEOPLE = """
select c_custkey as id, c_name as name, lower(replace(c_name, '#', ' ')) as normalized_name,
 concat('DEP', cast(c_nationkey % 5 as string)) as department, concat('login', cast(c_custkey as string)) as jazz_login
from {customer}
"""

REPORT_STEPS = """
select l_orderkey as report_id,
 cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) as int) as row_no,
 l_linenumber as raw_no,
 case l_returnflag when 'A' then 'Passed' when 'N' then 'Blocked' else 'Failed' end as result,
 case when l_partkey % 9 = 0 then '' else concat('note ', cast(l_partkey as string)) end as comment,
 case when l_suppkey % 4 = 0 then concat('D-', cast(l_suppkey as string)) end as defect_id
from {lineitem}
"""

STD_DOCS = """
select p_partkey as doc_id, concat('Material ', p_name, ' per ', case p_partkey % 5 when 0 then 'ISO ' when 1 then 'DIN EN ' when 2 then 'MBN' when 3 then 'VDA ' else 'SAE J' end,
 cast(10000 + p_partkey % 60 as string), case when p_partkey % 3 = 0 then concat(':', cast(2010 + p_size % 10 as string)) else '' end, ' and 2011/65/EU') as text
from {part}
"""

STD_INDEX = """
select concat('Standards/', case s_suppkey % 4 when 0 then 'ISO' when 1 then 'EN' when 2 then 'MBN' else 'VDA' end, '/', case s_suppkey % 4 when 0 then 'ISO' when 1 then 'EN' when 2 then 'MBN' else 'VDA' end, '_',
 cast(10000 + s_suppkey % 60 as string), '_', cast(2012 + s_nationkey % 10 as string), '-', lpad(cast(1 + s_suppkey % 12 as string), 2, '0'), case when s_suppkey % 2 = 0 then '_EN' else '_DE' end, '.pdf') as path,
 s_suppkey as mtime from {supplier}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def project(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    prepare(spark)
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def plain(sql: str) -> str:
    """The same projection for DuckDB."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark, sf_dir, PROCESSED)


def all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark, sf_dir, ALL_METRICS)


def work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark, sf_dir, WORK_ITEMS)


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark, sf_dir, PEOPLE)
