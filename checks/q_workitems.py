"""Work items, people directory, keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampertrace.functions import names
from ampertrace.operators import people as people_ops
from ampertrace.operators import workitems as W
from ampertrace.plans.workitem_analysis import prepare_items, workitem_analysis
from ampertrace.sources import tables
from checks import inputs
from checks.registry import ORACLES, query

ITEMS = inputs.plain(inputs.WORK_ITEMS)
PEOPLE = inputs.plain(inputs.PEOPLE)
HASH = "sha256('person::' || lower(replace({0}, '#', ' ')))"

# Known people attached and summaries normalised. The item texts hold no names, tickets are cut by pattern.
BASE = f"""w as ({ITEMS}), pe as ({PEOPLE}),
a as (select w.project, w.type, w.work_item_id, w.work_item, w.work_item_url, w.created, coalesce(o.name,'') as owner, coalesce(o.department,'') as owner_department,
  case when o.name is null then '' else {HASH.format('o.name')} end as owner_hash, coalesce(c.name,'') as creator, coalesce(c.department,'') as creator_department,
  case when c.name is null then '' else {HASH.format('c.name')} end as creator_hash
  from w left join pe o on o.name = w.owner left join pe c on c.name = w.creator where o.name is not null or c.name is not null),
it as (select *, case when type = 'Defect' then 'Defect' when type = 'Task' then 'Other' else 'Finding' end as item_class,
  trim(regexp_replace(regexp_replace(lower(work_item), ' abc-[0-9]+', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) as normalized_summary from a),
hd as (select normalized_summary, count(*) as n, count(*) filter (where item_class = 'Defect') as defect_count, count(*) filter (where item_class = 'Finding') as finding_count,
  count(*) filter (where item_class = 'Other') as other_count, min(work_item) as title from it group by 1 having count(*) > 1)"""
WITH = f"with {BASE}"


def work(spark, sf):
    return inputs.work_items(spark, sf)


def directory(spark, sf):
    return people_ops.directory(inputs.people(spark, sf))


def prepared(spark, sf):
    return prepare_items(work(spark, sf), directory(spark, sf))


def joined(c: str):
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["value"], x["n"].cast("string"))), ",").alias(c)


def top_sql(name: str, key: str, value: str, n: int, source: str = "it") -> str:
    return f"""{name} as (select {key}, string_agg(v || ':' || cast(n as varchar), ',' order by n desc, v) as {name}_v from (
  select {key}, v, n, row_number() over (partition by {key} order by n desc, v) as p from (select {key}, {value} as v, count(*) as n from {source} where {value} <> '' and {key} <> '' group by 1, 2)) where p <= {n} group by 1)"""


ATTACHED = ("work_item_id", "project", "type", "owner", "owner_department", "owner_hash", "creator", "creator_department", "creator_hash")


@query("b9_attach_people", f"{WITH} select {', '.join(ATTACHED)} from a")
def _(spark, sf):
    return people_ops.attach_people(work(spark, sf), directory(spark, sf)).select(*ATTACHED)


@query(
    "b10_person_view",
    f"{WITH} select work_item_id, creator as owner, creator_department as department, creator_hash as person_hash from a where creator <> ''",
)
def _(spark, sf):
    view = people_ops.person_view(people_ops.attach_people(work(spark, sf), directory(spark, sf)), "creator")
    return view.select("work_item_id", "owner", "department", "person_hash")


@query("b11_work_item_class", f"{WITH} select work_item_id, case when type = 'Defect' then 'Defect' when type = 'Task' then 'Other' else 'Finding' end as item_class from w")
def _(spark, sf):
    return work(spark, sf).select("work_item_id", names.work_item_class("type").alias("item_class"))


@query(
    "a14_filter_workitems",
    f"{WITH} select work_item_id, max(created) as created from w where type <> 'Task' and created > timestamp '1997-01-01' group by 1",
)
def _(spark, sf):
    rows = work(spark, sf)
    return W.filter_workitems(rows.unionByName(rows), "1997-01-01").select("work_item_id", "created")


@query(
    "c5_merge_roles",
    f"""{WITH}, ow as (select * from a where owner <> ''), cr as (select * from a where creator <> '' and type <> 'Task')
 select cast(coalesce(ow.work_item_id, cr.work_item_id) as varchar) as work_item_id, coalesce(ow.project, cr.project) as project, coalesce(ow.owner, '') as owner,
 coalesce(ow.owner_department, '') as owner_department, coalesce(cr.creator, '') as creator, coalesce(cr.creator_hash, '') as creator_hash
 from ow full join cr on ow.work_item_id = cr.work_item_id""",
)
def _(spark, sf):
    known = people_ops.attach_people(work(spark, sf), directory(spark, sf))
    owners = people_ops.person_view(known, "owner")
    creators = people_ops.person_view(known.filter("type <> 'Task'"), "creator")
    return W.merge_roles(owners, creators).select(
        "work_item_id", "project", "owner", "owner_department", "creator", "creator_hash"
    )


GIVEN = """case c_custkey % 4 when 0 then c_name when 1 then substr(c_name, 10) || '  customer' when 2 then 'Mr ' || c_name || ' (old)' else 'x' || c_name end"""


@query(
    "c6_resolve_people",
    f"{WITH} select {GIVEN} as given, pe.name, pe.department from customer join pe on pe.id = c_custkey where c_custkey % 4 <> 3",
)
def _(spark, sf):
    wanted = inputs.table(spark, sf, "customer").selectExpr(f"{GIVEN} as name")
    return people_ops.resolve_people(wanted, directory(spark, sf)).select("given", "name", "department")


@query(
    "c12_match_label",
    f"""{WITH} select case s_suppkey % 3 when 0 then s_name when 1 then substr(s_name, 10) || ' Supplier' else 'upplier#' || substr(s_name, 10) end as wanted,
 s_name as label from supplier""",
)
def _(spark, sf):
    supplier = inputs.table(spark, sf, "supplier")
    wanted = supplier.selectExpr(
        "case s_suppkey % 3 when 0 then s_name when 1 then substr(s_name, 10) || ' Supplier' else 'upplier#' || substr(s_name, 10) end as wanted"
    )
    entries = supplier.selectExpr("s_name as label", "concat('uri/', s_suppkey) as uri")
    return people_ops.match_label(wanted, entries).select("wanted", "label")


@query(
    "c15_resolve_responsible",
    f"""{WITH} select o_orderkey, pe.name as responsible_name, pe.department as responsible_department, 'login' || cast(pe.id as varchar) as responsible_login
 from orders join pe on pe.id = o_custkey % 100""",
)
def _(spark, sf):
    cases = inputs.table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "concat('Customer#', lpad(cast(o_custkey % 100 as string), 9, '0')) as responsible_name",
        "case when o_orderkey % 2 = 0 then concat('customer ', lpad(cast(o_custkey % 100 as string), 9, '0')) end as responsible_normalized",
    )
    return people_ops.resolve_responsible(cases, directory(spark, sf)).select(
        "o_orderkey", "responsible_name", "responsible_department", "responsible_login"
    )


@query(
    "c16_decode_and_managers",
    f"""{WITH} select c_custkey, coalesce(pe.name, '') as name, coalesce(pe.department, '') as department,
 case when c_custkey % 2 = 0 then 'Department Manager DD' else '' end as manager from customer left join pe on pe.id = c_custkey""",
)
def _(spark, sf):
    rows = inputs.table(spark, sf, "customer").select("c_custkey", names.person_hash(names.norm_person("c_name")).alias("person_hash"))
    decoded = people_ops.decode_people(rows, directory(spark, sf)).withColumnRenamed("department", "_d")
    managed = people_ops.with_managers(
        decoded.withColumn("department", F.when(F.col("c_custkey") % 2 == 0, F.lit(" dd ")).otherwise(F.lit("?")))
    )
    return managed.select("c_custkey", "name", F.col("_d").alias("department"), "manager")


@query(
    "d28_match_stats",
    f"""{WITH}, r as (select w.*, o.name is not null as ok, c.name is not null as ck from w left join pe o on o.name = w.owner left join pe c on c.name = w.creator)
 select count(*) as parsed, count(*) filter (where ok) as owner_matched, count(*) filter (where ck) as creator_matched, count(*) filter (where ok or ck) as either_matched,
 count(*) filter (where ok and ck) as both_matched, count(*) filter (where not ok and not ck) as dropped,
 coalesce((select string_agg(owner, ',' order by owner) from (select distinct owner from r where not ok order by owner limit 5)), '') as unknown_owner_samples,
 coalesce((select string_agg(creator, ',' order by creator) from (select distinct creator from r where not ck order by creator limit 5)), '') as unknown_creator_samples from r""",
)
def _(spark, sf):
    return people_ops.match_stats(work(spark, sf), directory(spark, sf))


@query(
    "d22_repeated_cases",
    f"""{WITH}, {top_sql('projects', 'normalized_summary', 'project', 8)}, {top_sql('owner_departments', 'normalized_summary', 'owner_department', 5)},
 {top_sql('creator_departments', 'normalized_summary', 'creator_department', 5)}, {top_sql('owner_people', 'normalized_summary', 'owner_hash', 5)},
 {top_sql('creator_people', 'normalized_summary', 'creator_hash', 5)}
 select normalized_summary, n, defect_count, finding_count, other_count, title, case when defect_count > 0 and finding_count = 0 then 'Defect' when finding_count > 0 and defect_count = 0 then 'Finding' else 'Mixed' end as case_type,
 projects_v as projects, owner_departments_v as owner_departments, creator_departments_v as creator_departments, owner_people_v as owner_people, creator_people_v as creator_people
 from hd left join projects using (normalized_summary) left join owner_departments using (normalized_summary) left join creator_departments using (normalized_summary)
 left join owner_people using (normalized_summary) left join creator_people using (normalized_summary)""",
)
def _(spark, sf):
    cases = W.repeated_cases(prepared(spark, sf))
    lists = ("projects", "owner_departments", "creator_departments", "owner_people", "creator_people")
    return cases.select(
        "normalized_summary", "n", "defect_count", "finding_count", "other_count", "title", "case_type", *[joined(c) for c in lists]
    )


@query(
    "d22_case_items",
    f"""{WITH} select normalized_summary, cast(p as int) as place, work_item_id from (select it.*, row_number() over (partition by normalized_summary order by work_item_id, project, work_item) as p
 from it where normalized_summary in (select normalized_summary from hd)) where p <= 12""",
)
def _(spark, sf):
    return W.case_items(prepared(spark, sf)).select("normalized_summary", "place", "work_item_id")


@query(
    "d23_workitem_summary",
    f"""{WITH} select count(*) as total_items, count(*) filter (where item_class = 'Defect') as defects, count(*) filter (where item_class = 'Finding') as findings,
 count(*) filter (where item_class = 'Other') as other, count(distinct nullif(owner_department,'')) as owner_departments, count(distinct nullif(creator_department,'')) as creator_departments,
 count(distinct project) as projects, (select count(*) from hd) as repeated_groups, (select cast(sum(n) as bigint) from hd) as repeated_items from it""",
)
def _(spark, sf):
    return W.workitem_summary(prepared(spark, sf))


@query(
    "d24_department_details",
    f"""{WITH}, {top_sql('tp', 'creator_department', 'creator_hash', 3)} select creator_department as department, count(*) as total, count(*) filter (where item_class = 'Defect') as defects,
 count(*) filter (where item_class = 'Finding') as findings, count(*) filter (where item_class = 'Other') as other, max(tp_v) as top_people
 from it join tp using (creator_department) where creator_department <> '' group by 1 order by total desc, 1 limit 10""",
)
def _(spark, sf):
    rows = W.department_details(prepared(spark, sf), "creator")
    return rows.select("department", "total", "defects", "findings", "other", joined("top_people"))


@query(
    "d25_department_split",
    f"""{WITH}, u as (select owner_department as department, 'o' as r, item_class from it union all select creator_department, 'c', item_class from it)
 select department, count(*) filter (where r='o') as owner_count, count(*) filter (where r='c') as creator_count,
 count(*) filter (where r='o' and item_class='Defect') as owner_defects, count(*) filter (where r='o' and item_class='Finding') as owner_findings,
 count(*) filter (where r='c' and item_class='Defect') as creator_defects, count(*) filter (where r='c' and item_class='Finding') as creator_findings
 from u where department <> '' group by 1""",
)
def _(spark, sf):
    return W.department_split(prepared(spark, sf))


@query(
    "d26_project_details",
    f"""{WITH}, {top_sql('od', 'project', 'owner_department', 3)}, {top_sql('cd', 'project', 'creator_department', 3)}
 select project, count(*) as total, count(*) filter (where item_class = 'Defect') as defects, count(*) filter (where item_class = 'Finding') as findings,
 count(*) filter (where normalized_summary in (select normalized_summary from hd)) as repeated, max(od_v) as owner_departments, max(cd_v) as creator_departments
 from it left join od using (project) left join cd using (project) group by 1 order by total desc, project limit 12""",
)
def _(spark, sf):
    rows = W.project_details(prepared(spark, sf))
    return rows.select("project", "total", "defects", "findings", "repeated", joined("owner_departments"), joined("creator_departments"))


@query("d27_people_counts", f"{WITH} select creator_hash as person_hash, count(*) as n from it where creator_hash <> '' group by 1 order by n desc, person_hash limit 20")
def _(spark, sf):
    return W.people_counts(prepared(spark, sf), "creator")


STOP = ", ".join(f"'{w}'" for w in names.STOP_WORDS)


@query(
    "i8_keyword_counts",
    f"{WITH}, k as (select unnest(string_split(normalized_summary, ' ')) as keyword from it) select keyword, count(*) as n from k where length(keyword) >= 4 and not regexp_matches(keyword, '^[0-9]+$') and keyword not in ({STOP}) group by 1",
)
def _(spark, sf):
    return W.keyword_counts(prepared(spark, sf))


GROUPS = f"""{WITH}, en as (select case_key, work_item_url, case when work_item_id % 2 = 0 then 'X1' else 'x1' end as wid, work_item as summary, project from (
   select *, 'case ' || cast(work_item_id % 40 as varchar) as case_key from a)),
 one as (select case_key, min(project) as project from en group by case_key, lower(work_item_url), lower(wid), lower(summary)),
 gr as (select case_key, project, count(*) as n from one group by 1, 2)"""


def groups(spark, sf):
    known = people_ops.attach_people(work(spark, sf), directory(spark, sf))
    entries = known.select(
        F.concat(F.lit("case "), (F.col("work_item_id") % 40).cast("string")).alias("case_key"),
        "work_item_url", F.when(F.col("work_item_id") % 2 == 0, F.lit("X1")).otherwise(F.lit(" x1")).alias("work_item_id"),
        F.col("work_item").alias("summary"), "project",
    )
    return W.case_groups(entries)


@query("d29_case_groups", f"{GROUPS} select * from gr")
def _(spark, sf):
    return groups(spark, sf)


@query(
    "b13_ll_candidates",
    f"{GROUPS} select case_key, case_key as title, cast(sum(n) as bigint) as entry_count, 'dept' as input_creator_department from gr group by 1",
)
def _(spark, sf):
    by_case = groups(spark, sf)
    cases = by_case.select("case_key").distinct().select(
        "case_key", F.concat(F.col("case_key"), F.lit("  ")).alias("title"), F.lit("").alias("normalized_summary"),
        F.lit("someone").alias("responsible_name"), F.lit(" dept ").alias("responsible_department"),
    )
    return W.ll_candidates(by_case, cases).select("case_key", "title", "entry_count", "input_creator_department")


#: table of the analysis: the query that it is part of, its columns, arrays last
ANALYSIS = {
    "summary": ("d23_workitem_summary", "total_items defects findings other owner_departments creator_departments projects repeated_groups repeated_items", ""),
    "repeated_cases": (
        "d22_repeated_cases", "normalized_summary n defect_count finding_count other_count title case_type",
        "projects owner_departments creator_departments owner_people creator_people",
    ),
    "case_items": ("d22_case_items", "normalized_summary place work_item_id", ""),
    "creator_department_details": ("d24_department_details", "department total defects findings other", "top_people"),
    "owner_department_details": ("d24_department_details", "department total defects findings other", "top_people"),
    "department_split": ("d25_department_split", "department owner_count creator_count owner_defects owner_findings creator_defects creator_findings", ""),
    "project_details": ("d26_project_details", "project total defects findings repeated", "owner_departments creator_departments"),
    "creator_hash_counts": ("d27_people_counts", "person_hash n", ""),
    "owner_hash_counts": ("d27_people_counts", "person_hash n", ""),
    "keyword_counts": ("i8_keyword_counts", "keyword n", ""),
}


def analysis_sql() -> str:
    """All rows of the ten tables as (part, line), from the texts of the single queries."""
    out = []
    for part, (name, plain, arrays) in ANALYSIS.items():
        body = ORACLES[name].removeprefix(WITH)
        if part.startswith("owner"):
            body = body.replace("creator_department", "owner_department").replace("creator_hash", "owner_hash")
        cells = ", ".join(f"coalesce(cast({c} as varchar), '-')" for c in f"{plain} {arrays}".split())
        out.append(f"select '{part}' as part, concat_ws('|', {cells}) as line from ({WITH}{body})")
    return " union all ".join(out)


@query("j22_workitem_analysis", analysis_sql())
def _(spark, sf):
    tables_of = workitem_analysis(work(spark, sf), directory(spark, sf))
    lines = []
    for part, (_, plain, arrays) in ANALYSIS.items():
        cells = [F.col(c).cast("string") for c in plain.split()] + [joined(c) for c in arrays.split()]
        line = F.concat_ws("|", *[F.coalesce(c, F.lit("-")) for c in cells])
        lines.append(tables_of[part].select(F.lit(part).alias("part"), line.alias("line")))
    return reduce(DataFrame.unionByName, lines)


# ---- text functions ------------------------------------------------------------------------------


@query(
    "i3_i5_person_names",
    "select c_custkey, 'customer ' || substr(c_name, 10) || ' lodz' as normalized, sha256('person::customer ' || substr(c_name, 10) || ' lodz') as person_hash, substr(c_name, 10) || ' customer lodz' as tokens_key from customer",
)
def _(spark, sf):
    norm = names.norm_person(F.concat(F.lit("  "), F.col("c_name"), F.lit(" Łódź ")))
    return inputs.table(spark, sf, "customer").select(
        "c_custkey", norm.alias("normalized"), names.person_hash(norm).alias("person_hash"), names.tokens_key(norm).alias("tokens_key")
    )


@query(
    "i6_logins",
    "select c_custkey, 'kowal' || cast(c_custkey as varchar) || 'j' as login, 'kowal' || cast(c_custkey as varchar) || 'j,kowal' || cast(c_custkey as varchar) || 'ja,janzk,janzko' as candidates from customer",
)
def _(spark, sf):
    surname_first = F.concat(F.lit("Kowal"), F.col("c_custkey").cast("string"), F.lit("-Nowak  Janz"))
    return inputs.table(spark, sf, "customer").select(
        "c_custkey",
        names.default_login(F.concat(F.lit("Kowal"), F.col("c_custkey").cast("string"), F.lit("-Nowak Jan"))).alias("login"),
        F.array_join(names.login_candidates(surname_first), ",").alias("candidates"),
    )


@query(
    "i7_norm_summary",
    "select p_partkey, p_name || ' fault v2' as summary from part",
)
def _(spark, sf):
    raw = F.concat(F.lit("ABC-12 "), F.upper("p_name"), F.lit(" Fâult! WI #4711 v2 20250101"))
    return inputs.table(spark, sf, "part").select("p_partkey", names.norm_summary(raw).alias("summary"))


@query(
    "i9_mask_names",
    f"""{WITH} select o_orderkey as work_item_id, 'seen by ' || case when pe.name is not null then {HASH.format('pe.name')} else lower(c_name) end || ' today' as work_item
 from orders join customer on c_custkey = o_custkey left join pe on pe.id = c_custkey""",
)
def _(spark, sf):
    orders = inputs.table(spark, sf, "orders").join(inputs.table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    texts = orders.select(
        F.col("o_orderkey").alias("work_item_id"), F.concat(F.lit("seen by "), F.lower("c_name"), F.lit(" today")).alias("work_item")
    )
    return people_ops.mask_names(texts, "work_item", directory(spark, sf))


@query(
    "i10_case_key",
    "select p_partkey, case p_partkey % 3 when 0 then lower(p_name) when 1 then p_name || ' t' else sha256('{\"p_name\":\"' || p_name || '\",\"p_size\":' || cast(p_size as varchar) || '}') end as case_key from part",
)
def _(spark, sf):
    m = F.col("p_partkey") % 3
    summary = F.when(m == 0, F.concat(F.lit(" "), F.upper("p_name")))
    title = F.when(m == 1, F.concat(F.col("p_name"), F.lit(" (T)"))).otherwise(F.lit(" "))
    part = inputs.table(spark, sf, "part")
    return part.select("p_partkey", names.case_key(summary, title, F.struct("p_name", "p_size")).alias("case_key"))


@query(
    "e19_repair_people",
    f"""{WITH}, d as (select id, name, department from pe union all select id + 1000, name, department from pe),
 k as (select name, department, case when id % 2 = 0 then id + 1000 else id end as id from pe)
 select id, name, department, lower(replace(name, '#', ' ')) as normalized_name from k""",
)
def _(spark, sf):
    base = inputs.people(spark, sf).withColumn("person_hash", names.person_hash(names.norm_person("name")))
    broken = base.withColumns(
        {
            "name": F.concat(F.lit(" "), F.col("name")),
            "person_hash": F.when(F.col("id") % 2 == 0, F.lit("old")).otherwise(F.col("person_hash")),
        }
    )
    copies = base.withColumn("id", F.col("id") + 1000).withColumn("department", F.lower("department"))
    return people_ops.repair_people(broken.unionByName(copies)).select("id", "name", "department", "normalized_name")


# ---- keyed tables --------------------------------------------------------------------------------


@query(
    "a9_latest_wins",
    "select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1",
)
def _(spark, sf):
    rows = inputs.table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return tables.latest_wins(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "a9_upsert",
    "select c_custkey, case when c_mktsegment = 'BUILDING' then 'changed' else c_name end as c_name from customer union all select c_custkey + 1000000, 'new' from customer where c_mktsegment = 'BUILDING'",
)
def _(spark, sf):
    customer = inputs.table(spark, sf, "customer")
    table = customer.select("c_custkey", "c_name")
    third = customer.filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    changes = third.withColumn("c_name", F.lit("changed")).unionByName(
        third.select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit("new").alias("c_name"))
    )
    return tables.upsert(table, changes, ["c_custkey"])


@query(
    "a10_delete_and_rename",
    "select case when c_mktsegment = 'BUILDING' then c_custkey + 2000000 else c_custkey end as c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')",
)
def _(spark, sf):
    customer = inputs.table(spark, sf, "customer")
    table = customer.select("c_custkey", "c_name")
    gone = inputs.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").selectExpr("o_custkey as c_custkey")
    renames = customer.filter("c_mktsegment = 'BUILDING'").selectExpr("c_custkey as old", "c_custkey + 2000000 as new")
    return tables.rename_key(tables.delete_keys(table, gone, ["c_custkey"]), "c_custkey", renames)


@query("c10_decided", "select 'k' || cast(c_custkey as varchar) as case_key, c_nationkey as saved from customer where c_custkey in (select o_custkey from orders)")
def _(spark, sf):
    decisions = inputs.table(spark, sf, "customer").selectExpr("concat('k', c_custkey) as case_key", "c_nationkey as saved")
    cases = inputs.table(spark, sf, "orders").selectExpr("concat(' K', o_custkey, ' ') as case_key")
    return tables.decided(cases, decisions)


@query("c10_undecided", "select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey < 12)")
def _(spark, sf):
    decisions = inputs.table(spark, sf, "customer").filter("c_nationkey < 12").selectExpr("cast(c_custkey as string) as case_key")
    cases = inputs.table(spark, sf, "orders").selectExpr("cast(o_custkey as string) as case_key", "o_orderkey", "o_custkey")
    return tables.undecided(cases, decisions).select("o_orderkey", "o_custkey")


@query(
    "c11_accept_created",
    "select c_custkey, 'candidate' as decision_status, case when c_custkey % 3 = 1 then 'uri ' || cast(c_custkey as varchar) else 'id ' || cast(c_custkey as varchar) end as ll_candidate_id from customer where c_custkey % 3 <> 2",  # the third kind has no identifier and is dropped
)
def _(spark, sf):
    customer = inputs.table(spark, sf, "customer")
    created = customer.selectExpr(
        "concat('k', c_custkey) as case_key",
        "case when c_custkey % 3 = 0 then concat(' id  ', c_custkey) end as identifier",
        "case when c_custkey % 3 = 1 then concat('uri ', c_custkey) else ' ' end as resource_uri",
    )
    cases = customer.selectExpr("concat('k', c_custkey) as case_key", "c_custkey")
    return tables.accept_created(cases, created).select("c_custkey", "decision_status", "ll_candidate_id")
