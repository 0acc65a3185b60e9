"""References to standards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampertrace.functions import standards as S
from ampertrace.operators import standards as ops
from ampertrace.plans.standards_check import check_standards
from checks import inputs
from checks.registry import query

DOCS = inputs.plain(inputs.STD_DOCS)
INDEX = inputs.plain(inputs.STD_INDEX)
WEB = "https://files/svn"

# What the generated texts contain: prefix and number, a year in every third, one EU directive.
REF = """case p_partkey % 5 when 0 then 'ISO ' when 1 then 'DIN EN ' when 2 then 'MBN ' when 3 then 'VDA ' else 'SAE J' end || cast(10000 + p_partkey % 60 as varchar)
 || case when p_partkey % 3 = 0 then ':' || cast(2010 + p_size % 10 as varchar) else '' end"""
PATH_SQL = f"""ix as ({INDEX}), k as (select path, mtime, split_part(path, '/', 2) as pre, regexp_extract(path, '_([0-9]{{5}})_', 1) as num,
 cast(regexp_extract(path, '_([0-9]{{4}})-', 1) as int) * 100 + cast(regexp_extract(path, '-([0-9]{{2}})_', 1) as int) as ver, contains(path, '_EN.') as en from ix),
 fk as (select *, pre || ' ' || num as base, pre || ' ' || num || ' ' || cast(ver // 100 as varchar) as full_ref from k)"""


def docs(spark, sf):
    return inputs.project(spark, sf, inputs.STD_DOCS)


def paths(spark, sf):
    return inputs.project(spark, sf, inputs.STD_INDEX)


@query("i11_i13_std_refs", f"select p_partkey as doc_id, {REF} as ref from part union all select p_partkey, '2011.65.EU' from part union all select p_partkey, '2011_65_EU' from part")
def _(spark, sf):
    return ops.document_refs(docs(spark, sf)).select("doc_id", "ref")


@query("i12_norm_ref", "select s_suppkey, case s_suppkey % 3 when 0 then 'MBN ' || cast(51000 + s_suppkey as varchar) when 1 then 'ISO 26262-' || cast(s_suppkey as varchar) else 'GB/T ' || cast(s_suppkey as varchar) end as ref from supplier")
def _(spark, sf):
    k, m = F.col("s_suppkey"), F.col("s_suppkey") % 3
    raw = (
        F.when(m == 0, F.concat(F.lit("mbn"), (k + 51000).cast("string")))
        .when(m == 1, F.concat(F.lit("iso_26262–"), k.cast("string"))).otherwise(F.concat(F.lit("gb / t  "), k.cast("string")))
    )
    return inputs.table(spark, sf, "supplier").select("s_suppkey", S.norm_ref(raw).alias("ref"))


@query(
    "i13_accept_ref",
    "select s_suppkey, s_suppkey % 8 in (1, 3, 4, 6, 7) as accepted from supplier",
)
def _(spark, sf):
    kinds = ("IATF 16949", "PV 1200-1", "PV 12A", "ASTM 123", "AA 12345", "AB 12", "A 123456", "ISO 9001")
    picked = F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("s_suppkey") % 8).cast("int"))
    return inputs.table(spark, sf, "supplier").select("s_suppkey", S.accept_ref(picked).alias("accepted"))


@query(
    "i14_eu_cfr_refs",
    "select s_suppkey, '2011.' || cast(s_suppkey as varchar) || '.EU,2011_' || cast(s_suppkey as varchar) || '_EU' as eu, '49.CFR.' || cast(s_suppkey as varchar) || '.108,49CFR' || cast(s_suppkey as varchar) || '.108' as cfr from supplier",
)
def _(spark, sf):
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("as in 2011/"), k, F.lit("/eu and 49 CFR "), k, F.lit(".108."))
    return inputs.table(spark, sf, "supplier").select(
        "s_suppkey", F.array_join(S.eu_refs(text), ",").alias("eu"), F.array_join(S.cfr_refs(text), ",").alias("cfr")
    )


@query(
    "i15_variant_keys",
    """with v as (select s_suppkey, 'DIN EN ' || cast(13000 + s_suppkey as varchar) as b, cast(13000 + s_suppkey as varchar) as n from supplier),
 s as (select s_suppkey, unnest([b || ':2010', b, 'DIN ' || n, 'EN ' || n, 'DINEN ' || n]) as k from v),
 g as (select s_suppkey, unnest([k, replace(k, ' ', ''), replace(k, ' ', '_')]) as k from s), u as (select s_suppkey, unnest([k, replace(k, '_', '.')]) as k from g)
 select s_suppkey, string_agg(distinct k, '|' order by k) as variants from u group by 1""",
)
def _(spark, sf):
    key = F.concat(F.lit("DIN EN "), (F.col("s_suppkey") + 13000).cast("string"), F.lit(":2010"))
    return inputs.table(spark, sf, "supplier").select(
        "s_suppkey", F.array_join(F.array_sort(S.variant_keys(key)), "|").alias("variants")
    )


@query(
    "i16_revision_version_language",
    f"with {PATH_SQL} select path, base, ver as version, en as is_en from fk",
)
def _(spark, sf):
    ref = F.regexp_replace(F.regexp_extract("path", r"([A-Z]+_\d+_\d{4})", 1), "_", " ")
    return paths(spark, sf).select(
        "path", S.strip_revision(ref).alias("base"), S.version_hint("path").alias("version"), S.is_en("path").alias("is_en")
    )


@query(
    "i17_links",
    f"with {PATH_SQL} select path, case when mtime % 4 = 0 then '{WEB}/a%20b/' else '{WEB}/a%20b/' || split_part(path, '/', 3) end as link from fk",
)
def _(spark, sf):
    name = F.element_at(F.split("path", "/"), -1)
    messy = F.concat(F.lit("/a b/"), F.when(F.col("mtime") % 4 == 0, F.lit("Amendment_")).otherwise(F.lit("")), name)
    return paths(spark, sf).select("path", S.adjust_link(S.web_link(messy, WEB + "/")).alias("link"))


@query("i18_ref_prefix", f"select p_partkey as doc_id, split_part(split_part({REF}, ' ', 1), 'J', 1) as label from part")
def _(spark, sf):
    first = F.get(S.std_refs("text"), F.lit(0))
    return docs(spark, sf).select("doc_id", S.ref_prefix(first).alias("label"))


@query(
    "a11_g3_build_index",
    f"""with {PATH_SQL} select path, split_part(path, '/', 3) as name, '.pdf' as ext, full_ref as std_key, mtime from fk
 union all select path || '/', split_part(path, '/', 3), '<DIR>', pre || '/' || full_ref, max(mtime) from fk group by path, pre, full_ref""",
)
def _(spark, sf):
    return ops.build_std_index(paths(spark, sf))


@query("a12_expand_dirs", f"with {PATH_SQL} select distinct path || '/' as path, split_part(path, '/', 3) as name, pre || '/' || full_ref as std_key from fk")
def _(spark, sf):
    return ops.expand_dirs(paths(spark, sf)).select("path", "name", "std_key")


INV = f"""{PATH_SQL}, ik as (select full_ref as std_key, * exclude (full_ref, base) from fk union select base, * exclude (full_ref, base) from fk),
 inv as (select std_key, arg_max(path, (ver, en, mtime, path)) as path from ik group by 1)"""


@query("d32_best_revision", f"with {INV} select std_key, path, '{WEB}/' || path as link from inv")
def _(spark, sf):
    return ops.best_revision(paths(spark, sf), WEB)


REFS = f"""d0 as (select p_partkey as doc_id, p_partkey % 5 as m, {REF} as ref, cast(10000 + p_partkey % 60 as varchar) as num from part),
 d1 as (select *, case m when 0 then ['ISO'] when 1 then ['DIN', 'EN'] when 2 then ['MBN'] when 3 then ['VDA'] else []::varchar[] end as pres from d0),
 px as (select doc_id, ref, unnest(pres) || ' ' || num as std_key from d1),
 lk as (select distinct doc_id, ref, '{WEB}/' || inv.path as link from px join inv using (std_key))"""


@query("c7_lookup_inventory", f"with {INV}, {REFS} select distinct ref, link from lk")
def _(spark, sf):
    return ops.lookup_inventory(ops.document_refs(docs(spark, sf)), ops.best_revision(paths(spark, sf), WEB))


@query(
    "c7_lookup_index",
    f"""with {PATH_SQL}, {REFS.split(' lk as')[0].rstrip().rstrip(',')},
 hit as (select px.ref, path, en, ver from px join fk on fk.base = px.std_key)
 select ref, '{WEB}/' || arg_max(path, (en, ver, -length(path), path)) as link from hit group by ref""",
)
def _(spark, sf):
    index = ops.file_rows(paths(spark, sf))
    return ops.lookup_index(ops.document_refs(docs(spark, sf)), index, WEB)


CHECK = f"""with {INV}, {REFS}, al as (select doc_id, ref from d0 union all select doc_id, '2011.65.EU' from d0 union all select doc_id, '2011_65_EU' from d0),
 nk as (select al.doc_id, al.ref, replace(replace(al.ref, '.', ' '), '_', ' ') as std_key, link from al left join lk on lk.doc_id = al.doc_id and lk.ref = al.ref)
 select doc_id, std_key, bool_or(link is not null) as found, coalesce(string_agg(distinct link, ',' order by link), '') as links from nk group by 1, 2"""


@query("d31_j20_check_standards", CHECK)
def _(spark, sf):
    out = check_standards(docs(spark, sf), paths(spark, sf), WEB)
    return out.select("doc_id", "std_key", "found", F.array_join("links", ",").alias("links"))
