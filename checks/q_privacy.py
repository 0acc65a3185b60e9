"""Privacy, reference workbooks, review cases and HTML tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampertrace.functions import privacy as P
from ampertrace.functions.text import position_number  # noqa: F401
from ampertrace.operators import benchmark as B
from ampertrace.operators import privacy as ops
from ampertrace.operators import review
from ampertrace.operators.report_sessions import defect_refs
from ampertrace.sources import html
from checks import inputs
from checks.q_workitems import ITEMS, STOP
from checks.registry import query


def documents(spark, sf):
    return inputs.table(spark, sf, "documents").select("doc_id", "text")


@query("i19_emails", "select doc_id, array_to_string(regexp_extract_all(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+[.][a-zA-Z0-9.-]+'), '|') as emails from documents where regexp_matches(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+[.][a-zA-Z0-9.-]+')")
def _(spark, sf):
    found = documents(spark, sf).withColumn("emails", P.emails("text")).filter(F.size("emails") > 0)
    return found.select("doc_id", F.array_join("emails", "|").alias("emails"))


@query("i20_phones")
def _(spark, sf):
    found = documents(spark, sf).withColumn("phones", P.phones("text")).filter(F.size("phones") > 0)
    return found.select("doc_id", F.array_join("phones", "|").alias("phones"))


# Main path: a plain number, a date and an identifier in one sentence.
@query("i20_phones_in_sentences", "select c_custkey, '+48 600 700 ' || cast(100 + c_custkey % 900 as varchar) as phones from customer")
def _(spark, sf):
    k = F.col("c_custkey")
    text = F.concat(
        F.lit("STM-4764956 on 2024-01-31, call +48 600 700 "), (k % 900 + 100).cast("string"), F.lit(" or item PVA-"), (k + 100000).cast("string")
    )
    return inputs.table(spark, sf, "customer").select("c_custkey", F.array_join(P.phones(text), "|").alias("phones"))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def clients(spark, sf):
    """Market segments as client names, each with a hyphenated alias."""
    segments = inputs.table(spark, sf, "customer").select("c_mktsegment").distinct()
    return segments.select(
        F.lit("").alias("id"), F.col("c_mktsegment").alias("canonical"),
        F.array(F.concat(F.col("c_mktsegment"), F.lit("-Werk")), F.lower("c_mktsegment")).alias("aliases"),
        F.array(F.lit("")).alias("patterns"), F.lit(True).alias("case_insensitive"), F.lit("approved").alias("status"),
    )


@query(
    "i21_clients_in_text",
    "select c_custkey, case when c_custkey % 3 <> 2 then c_mktsegment else '' end as clients from customer",
)
def _(spark, sf):
    k = F.col("c_custkey") % 3
    name = (
        F.when(k == 0, F.concat(F.substring("c_mktsegment", 1, 4), F.lit("­"), F.expr("substring(c_mktsegment, 5)")))
        .when(k == 1, F.concat(F.lower("c_mktsegment"), F.lit(" – werk"))).otherwise(F.concat(F.lit("x"), F.col("c_mktsegment")))
    )
    texts = inputs.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("for "), name, F.lit(".")).alias("text"))
    found = ops.find_clients(texts, ops.norm_clients(clients(spark, sf)))
    return found.select("c_custkey", F.array_join("clients", "|").alias("clients"))


@query("i22_person_like", "select c_custkey, case when c_custkey % 2 = 0 then 'Kowal Anna|Polach, Karin' else 'Edis Wagner|Meier-Huber, Jan' end as persons from customer")
def _(spark, sf):
    text = F.when(F.col("c_custkey") % 2 == 0, F.lit("Polach ,\nKarin and KowalAnna; Name, Vorname")).otherwise(
        F.lit("by EdisWagner, later Meier-Huber, Jan")
    )
    return inputs.table(spark, sf, "customer").select("c_custkey", F.array_join(P.person_like(text), "|").alias("persons"))


@query("i24_preclean", "select c_custkey, 'small Ring ' || cast(c_custkey as varchar) || ' and more' as cleaned from customer")
def _(spark, sf):
    text = F.concat(F.lit(" • smallRing   "), F.col("c_custkey").cast("string"), F.lit(" \r\n  and\n\n more "))
    return inputs.table(spark, sf, "customer").select("c_custkey", P.preclean(text).alias("cleaned"))


@query(
    "i23_replace_pii",
    "select c_custkey, 'no ' || c_custkey || ': Name wrote mail@mail.com, tel phone number, for ' || case when c_custkey % 3 = 0 then 'x' || lower(c_mktsegment) else 'Client' end as masked from customer",
)
def _(spark, sf):
    k = F.col("c_custkey").cast("string")
    end = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("x"), F.lower("c_mktsegment"))).otherwise(F.concat(F.lower("c_mktsegment"), F.lit("-werk")))
    text = F.concat(
        F.lit("no "), k, F.lit(": Polach, Karin wrote a.b"), k, F.lit("@ex-ample.org, tel +48 600 700 "),
        (F.col("c_custkey") % 900 + 100).cast("string"), F.lit(", for "), end,
    )
    texts = inputs.table(spark, sf, "customer").select("c_custkey", text.alias("text"))
    return ops.anonymize(texts, ops.norm_clients(clients(spark, sf))).select("c_custkey", F.col("anonymized").alias("masked"))


@query("j21_anonymize")
def _(spark, sf):
    return ops.anonymize(documents(spark, sf), ops.norm_clients(clients(spark, sf))).select("doc_id", "anonymized")


@query("d33_client_hits", "select cast(sum(len(regexp_extract_all(lower(text), 'the'))) as bigint) as matches from documents")
def _(spark, sf):
    record = {"canonical": "\u0001", "aliases": [], "patterns": ["the"], "case_insensitive": True}
    return ops.client_hits(documents(spark, sf), record)


@query(
    "i30_norm_clients",
    "select distinct substr(c_mktsegment || '_co__ltd_with_a_very_long_name', 1, 32) as id, c_mktsegment || ' co. ltd with a very long name' as canonical, c_mktsegment || '|B' as aliases, 'approved' as status from customer",
)
def _(spark, sf):
    name = F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" co. ltd with a very long name "))
    raw = inputs.table(spark, sf, "customer").select("c_mktsegment").distinct().select(
        F.lit(None).cast("string").alias("id"), name.alias("canonical"),
        F.array(F.col("c_mktsegment"), F.lower("c_mktsegment"), F.lit(" B "), F.lit(" ")).alias("aliases"),
        F.array(F.lit("x"), F.lit("X")).alias("patterns"), F.lit(None).cast("boolean").alias("case_insensitive"), F.lit("").alias("status"),
    )
    clean = ops.norm_clients(raw)
    return clean.select(
        "id", "canonical", F.array_join("aliases", "|").alias("aliases"), "status"
    )


@query("b15_select_pages", "select event_id, cast(user_id % 9 + 1 as bigint) as page_no from events where user_id % 9 + 1 in (1, 2, 3, 5)")
def _(spark, sf):
    pages = inputs.table(spark, sf, "events").select("event_id", (F.col("user_id") % 9 + 1).alias("page_no"))
    return ops.select_pages(pages, "1-3, 5,99")


# ---- reference workbooks -------------------------------------------------------------------------

CELLS = """
select l_orderkey, l_linenumber, case l_suppkey % 3 when 0 then '0854_086' when 1 then '0854_108' else '0900_001' end as project_number,
 concat('book', cast(l_suppkey % 4 as string), '.xlsx') as file,
 case l_partkey % 6 when 0 then 'CHARGING 0 -100 %' when 1 then 'NFC' when 2 then 'FOD' when 3 then 'WLC' when 4 then 'RFID Protection' else 'RFID Protection_2' end as sheet,
 6 + l_linenumber as col_no,
 case l_orderkey % 9 when 0 then 'status 3' when 1 then 'Status 4, state 15' when 2 then ' OK ' when 3 then 'NO OK' when 4 then 'Defect ID: X-12'
  when 5 then 'toggling status' when 6 then '12,5 % at 47 C' when 7 then 'Test not required' else '-' end as text,
 case l_suppkey % 5 when 0 then 'FF00B050' when 1 then 'FFFFCC00' when 2 then 'FFFF4B4B' end as fill_rgb
from {lineitem}
"""
CELL_SQL = f"""ce as ({inputs.plain(CELLS)}),
cl as (select *, l_orderkey % 9 as k, case when l_orderkey % 9 = 8 then null when l_orderkey % 9 = 7 then 'skip'
  when sheet = 'NFC' then case l_orderkey % 9 when 2 then 'pass' when 3 then 'not_ok' when 4 then 'defect' end
  when sheet in ('CHARGING 0 -100 %', 'WLC') then case l_orderkey % 9 when 0 then 'pass' when 1 then 'not_ok' when 4 then 'defect' when 5 then 'not_ok' end
  when sheet = 'FOD' then case when fill_rgb = 'FFFF4B4B' then 'defect' when fill_rgb = 'FFFFCC00' then 'not_ok' when fill_rgb = 'FF00B050' then 'pass'
     when l_orderkey % 9 = 6 then 'not_ok' when l_orderkey % 9 = 1 then 'pass' when l_orderkey % 9 = 0 then 'not_ok' end
  else case l_orderkey % 9 when 4 then 'defect' when 1 then 'pass' when 5 then 'not_ok' when 0 then 'not_ok' end end as category from ce),
bp as (select *, col_no - case sheet when 'FOD' then 9 when 'WLC' then 7 else 6 end + 1 as position_number,
  case sheet when 'CHARGING 0 -100 %' then 'charging' when 'NFC' then 'nfc' when 'FOD' then 'fod' when 'WLC' then 'wlc' when 'RFID Protection' then 'rfid_primary' else 'rfid_secondary' end as scenario_code from cl),
bc as (select * from bp where category is not null and position_number >= 1)"""
COUNTS = "count(*) filter (where category = 'pass') as pass_count, count(*) filter (where category = 'not_ok') as not_ok_count, count(*) filter (where category = 'defect') as defect_count, count(*) filter (where category = 'skip') as skip_count"
RATES = "round((not_ok_count + defect_count) / nullif(pass_count + not_ok_count + defect_count, 0), 6) as bad_rate, round(defect_count / nullif(pass_count + not_ok_count + defect_count, 0), 6) as defect_rate"


def cells(spark, sf):
    return inputs.project(spark, sf, CELLS)


@query("i25_classify_cell", f"with {CELL_SQL} select l_orderkey, l_linenumber, sheet, fill_rgb, category from cl")
def _(spark, sf):
    kind = B.classify_cell("sheet", "text", "fill_rgb")["category"]
    return cells(spark, sf).select("l_orderkey", "l_linenumber", "sheet", "fill_rgb", kind.alias("category"))


@query(
    "i26_numbers_in_cells",
    f"with {CELL_SQL} select l_orderkey, case k when 0 then '3' when 1 then '15,4' else '' end as codes, case when k = 6 then 12.5::double end as percent, case when k = 6 then 47.0::double end as temperature from cl",
)
def _(spark, sf):
    return cells(spark, sf).select(
        "l_orderkey", F.array_join(B.status_codes("text"), ",").alias("codes"), B.percent("text").alias("percent"),
        B.temperature("text").alias("temperature"),
    )


@query("i27_defect_refs", "select p_partkey, 'AB-' || cast(p_partkey as varchar) || '|' || cast(p_partkey + 5000 as varchar) || '|Z 1' as refs from part")
def _(spark, sf):
    k = F.col("p_partkey")
    text = F.concat(
        F.lit("Defect ID: AB-"), k.cast("string"), F.lit(" then defect #"), (k + 5000).cast("string"), F.lit(", defect ab-"), k.cast("string"),
        F.lit(' {"defect_id": " Z 1. "}'),
    )
    return inputs.table(spark, sf, "part").select("p_partkey", F.array_join(defect_refs(text), "|").alias("refs"))


@query(
    "d19_benchmark_by_scenario",
    f"""with {CELL_SQL}, g as (select project_number, scenario_code, count(distinct file) as file_count, count(distinct position_number) as position_count, {COUNTS} from bc group by 1, 2),
 st as (select project_number, scenario_code, unnest(case k when 0 then ['3'] when 1 then ['4', '15'] else []::varchar[] end) as s from bc),
 sn as (select project_number, scenario_code, s, count(*) as n from st group by 1, 2, 3),
 ts as (select project_number, scenario_code, string_agg(s || ':' || cast(n as varchar), ',' order by n desc, s) as top_statuses from sn group by 1, 2)
 select project_number, scenario_code, file_count, position_count, pass_count, not_ok_count, defect_count, skip_count, {RATES}, top_statuses from g left join ts using (project_number, scenario_code)""",
)
def _(spark, sf):
    rows = B.benchmark_by_scenario(cells(spark, sf))
    top = F.array_join(F.transform("top_statuses", lambda x: F.concat_ws(":", x["value"], x["n"].cast("string"))), ",")
    return rows.select(
        "project_number", "scenario_code", "file_count", "position_count", "pass_count", "not_ok_count", "defect_count", "skip_count",
        F.round("bad_rate", 6).alias("bad_rate"), F.round("defect_rate", 6).alias("defect_rate"), top.alias("top_statuses"),
    )


POSITIONS = f"g as (select project_number, position_number, count(distinct scenario_code) as scenario_count, {COUNTS} from bc group by 1, 2)"


@query(
    "d19_benchmark_by_position",
    f"with {CELL_SQL}, {POSITIONS} select project_number, position_number, scenario_count, pass_count, not_ok_count, defect_count, skip_count, {RATES} from g",
)
def _(spark, sf):
    rows = B.benchmark_by_position(cells(spark, sf))
    return rows.withColumns({c: F.round(c, 6) for c in ("bad_rate", "defect_rate")})


@query(
    "c9_j14_compare_benchmark",
    f"""with {CELL_SQL}, {POSITIONS}, r as (select project_number, position_number, (not_ok_count + defect_count) / nullif(pass_count + not_ok_count + defect_count, 0) as b, defect_count / nullif(pass_count + not_ok_count + defect_count, 0) as d from g),
 lv as (select * from r where project_number = '0854_108'), be as (select project_number, position_number + 1 as position_number, b, d from r where project_number = '0854_086')
 select coalesce(lv.position_number, be.position_number) as position_number, case when lv.b is null or be.b is null then 'neutral' when coalesce(lv.d, 0) - coalesce(be.d, 0) > 0.03 or lv.b - be.b > 0.12 then 'critical'
  when lv.b - be.b > 0.05 then 'warn' when lv.b - be.b < -0.08 then 'ok' else 'neutral' end as verdict_class from lv full join be on lv.position_number = be.position_number""",
)
def _(spark, sf):
    rows = B.benchmark_by_position(cells(spark, sf))
    live = rows.filter("project_number = '0854_108'")
    # one position further on, so that each side has a position that the other has not
    reference = rows.filter("project_number = '0854_086'").withColumn("position_number", F.col("position_number") + 1)
    return B.compare_benchmark(live, reference).select("position_number", "verdict_class")


@query("b14_infer_project", f"with {CELL_SQL} select max(project_number) as project_number from ce where project_number = '0854_086'")
def _(spark, sf):
    rows = cells(spark, sf)
    return B.infer_project(rows.filter("project_number = '0854_086'"), rows)


# ---- review cases --------------------------------------------------------------------------------


@query(
    "i29_norm_cases",
    "select 'T' || cast(p_partkey as varchar) as test_case_id, p_name as case_title, '' as department, cast(p_size as varchar) as tags from part where p_partkey % 4 <> 0",
)
def _(spark, sf):
    k = F.col("p_partkey").cast("string")
    good = F.concat(
        F.lit('{"test_case_id":" T'), k, F.lit(' ","case_title":"'), F.col("p_name"), F.lit('  ","department":null,"tags":"'),
        F.col("p_size").cast("string"), F.lit('"}'),
    )
    raw = inputs.table(spark, sf, "part").select(
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit('["'), k, F.lit('"]'))).otherwise(good).alias("case_json")
    )
    return review.norm_cases(raw).select("test_case_id", "case_title", "department", "tags")


_WORDS = """list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip_accents(replace(lower({0}), 'ß', '')),
 '\\b[a-z]{{1,4}}-[0-9]+\\b', ' ', 'g'), '\\b(wi|id)\\s*[:#-]?\\s*[0-9]+\\b', ' ', 'g'), '\\b[0-9]{{4,}}\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '),
 lambda w: length(w) >= 4 and not regexp_matches(w, '^[0-9]+$') and w not in (""" + STOP + ")))"


_CLASS = "array_to_string(list_sort({0}), ' ')"
_PROBLEMS = f"""select p_partkey as problem_id, {_WORDS.format("p_name || ' ' || p_type")} as w from part"""
_ALL_CASES = f"""select item_id as case_id, {_WORDS.format('text')} as w from benchmark union all
 select 1000 + p_partkey, {_WORDS.format("p_name || ' ' || p_type || ' ' || p_brand")} from part"""


@query(
    "j23_coverage_candidates",
    f"""with pr as ({_PROBLEMS}), all_cases as (select item_id as case_id, {_WORDS.format('text')} as w from benchmark union all
  select 1000 + min(p_partkey), {_WORDS.format('p_type')} from part group by p_type),
 pa as (select problem_id, case_id, len(list_intersect(pr.w, all_cases.w)) as shared from pr join all_cases on list_has_any(pr.w, all_cases.w)),
 re as (select problem_id, case_id, cast(shared as int) as shared, 'B' as coverage from pa where shared >= 2)
 select * from re union all select problem_id, null, 0, 'C' from pr where problem_id not in (select problem_id from re)""",
)
def _(spark, sf):
    part = inputs.table(spark, sf, "part")
    problems = part.selectExpr("p_partkey as problem_id", "concat(p_name, ' ', p_type) as text")
    cases = inputs.table(spark, sf, "benchmark").selectExpr("item_id as case_id", "text").unionByName(
        part.groupBy("p_type").agg(F.min("p_partkey").alias("k")).selectExpr("1000 + k as case_id", "p_type as text")
    )
    return review.coverage_candidates(problems, cases)


def all_cases(spark, sf):
    """Problems and cases of all parts."""
    part = inputs.table(spark, sf, "part")
    problems = part.selectExpr("p_partkey as problem_id", "concat(p_name, ' ', p_type) as text")
    cases = inputs.table(spark, sf, "benchmark").selectExpr("item_id as case_id", "text").unionByName(
        part.selectExpr("1000 + p_partkey as case_id", "concat(p_name, ' ', p_type, ' ', p_brand) as text")
    )
    return problems, cases


@query(
    "j23_coverage_classes",
    f"""with pr as ({_PROBLEMS}), ca as ({_ALL_CASES}),
 pc as (select distinct {_CLASS.format('w')} as problem_words, w from (select distinct list_sort(w) as w from pr)), cc as (select distinct {_CLASS.format('w')} as case_words, w from (select distinct list_sort(w) as w from ca)),
 re as (select problem_words, case_words, cast(len(list_intersect(pc.w, cc.w)) as int) as shared from pc join cc on list_has_any(pc.w, cc.w) where len(list_intersect(pc.w, cc.w)) >= 2)
 select problem_id, null::bigint as case_id, {_CLASS.format('w')} as problem_words, null::varchar as case_words, null::int as shared, null::varchar as coverage from pr
 union all select null, case_id, null, {_CLASS.format('w')}, null, null from ca
 union all select null, null, problem_words, case_words, shared, 'B' from re
 union all select null, null, problem_words, null, 0, 'C' from pc where problem_words not in (select problem_words from re)""",
)
def _(spark, sf):
    """All parts as cases, in classes of equal words."""
    return review.coverage_classes(*all_cases(spark, sf))


@query(
    "j23_top_cases",
    f"""with pr as ({_PROBLEMS}), ca as ({_ALL_CASES}), cc as (select distinct {_CLASS.format('w')} as case_words from ca),
 po as (select case_words, unnest(string_split(case_words, ' ')) as word from cc where case_words <> ''),
 we as (select word, (select count(distinct case_words) from po) * 100 // count(*) as weight from po group by word),
 pc as (select distinct {_CLASS.format('w')} as problem_words from pr), pw as (select problem_words, unnest(string_split(problem_words, ' ')) as word from pc where problem_words <> ''),
 sc as (select problem_words, case_words, cast(sum(weight) as bigint) as score from pw join po using (word) join we using (word) group by 1, 2),
 rk as (select *, rank() over (partition by problem_words order by score desc) as place from sc)
 select problem_id, case_words, score, cast(place as int) as place from pr join rk on {_CLASS.format('w')} = problem_words where place <= 3""",
)
def _(spark, sf):
    return review.top_cases(*all_cases(spark, sf))


@query(
    "a13_html_rows",
    f"select work_item_id as page_id, project, type, owner, creator, cast(work_item_id as varchar) as work_item_id, work_item, 'https://rs.example/items/' || cast(work_item_id as varchar) as work_item_url from ({ITEMS})",
)
def _(spark, sf):
    wid = F.col("work_item_id").cast("string")
    cell = lambda c: F.concat(F.lit("<td> "), c, F.lit("</td>"))
    head = "<p>x</p><table><tr><td>menu</td></tr></table><table><thead><tr>{}</tr></thead><tbody><tr>"
    names = ("Work Item", "Owned by", "Created by", "Project area", "Type", "Work item ID")
    link = F.concat(F.lit("<td><a href='/items/"), wid, F.lit("'>"), F.col("work_item"), F.lit("</a></td>"))
    page = F.concat(
        F.lit(head.format("".join(f"<th>{n}</th>" for n in names))), link, cell(F.col("owner")), cell(F.col("creator")),
        cell(F.col("project")), cell(F.col("type")), cell(wid), F.lit("</tr><tr><td>short</td></tr></tbody></table>"),
    )
    pages = inputs.work_items(spark, sf).select(F.col("work_item_id").alias("page_id"), page.alias("html"))
    return html.html_rows(pages, "https://rs.example/").drop("row_no")


@query("a13_html_rows_in_pages")
def _(spark, sf):
    return html.html_rows(inputs.table(spark, sf, "pages"), "https://rs.example")
