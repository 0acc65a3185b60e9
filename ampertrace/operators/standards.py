"""Standards index, lookup of references and the check of whole documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampertrace.functions import standards as S
from ampertrace.operators.matching import substring_pairs
from ampertrace.session import spread


def _first_ref(c: Column, extra: Sequence[str]) -> Column:
    return F.get(S.std_refs(c, extra), F.lit(0))


def file_rows(paths: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Index rows of document files; the key comes from the file name, else from the whole path."""
    name = S.file_name("path")
    stem = F.translate(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "_", " ")
    return paths.filter(S.file_extension("path").isin(*S.DOCUMENT_EXTENSIONS)).select(
        "path", name.alias("name"), S.file_extension("path").alias("ext"),
        F.coalesce(_first_ref(stem, extra), _first_ref(F.col("path"), extra)).alias("std_key"), "mtime",
    )


def expand_dirs(paths: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Index rows for every path prefix whose text names a standard."""
    parts = F.split(F.regexp_replace("path", r"^/+|/+$", ""), r"[\\/]+")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    one = (
        paths.select(F.explode(prefixes).alias("_dir"), "mtime").filter(F.col("_dir") != "")
        .groupBy("_dir").agg(F.max("mtime").alias("mtime"))
    )
    return one.select(
        F.concat("_dir", F.lit("/")).alias("path"), S.file_name("_dir").alias("name"), F.lit("<DIR>").alias("ext"),
        _first_ref(F.col("_dir"), extra).alias("std_key"), "mtime",
    ).filter(F.col("std_key").isNotNull())


def build_std_index(paths: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """File rows and directory rows of a path listing (columns path, mtime)."""
    return file_rows(paths, extra).unionByName(expand_dirs(paths, extra))


def best_revision(paths: DataFrame, web_prefix: str = "", extra: Sequence[str] = ()) -> DataFrame:
    """Newest revision per key: by year and month, then English, then modification time, then path.

    A file is registered under each reference of its name (else its path) and under the reference
    without revision.
    """
    docs = paths.filter(S.file_extension("path").isin(*S.DOCUMENT_EXTENSIONS))
    by_name = S.std_refs(S.file_name("path"), extra)
    refs = F.when(F.size(by_name) > 0, by_name).otherwise(S.std_refs("path", extra))
    keyed = docs.select("path", "mtime", F.explode(refs).alias("_ref"))
    keys = keyed.select("path", "mtime", F.explode(F.array_distinct(F.array(S.norm_ref("_ref"), S.strip_revision("_ref")))).alias("std_key"))
    rank = F.struct(
        S.version_hint("path").alias("v"), S.is_en("path").alias("e"), F.col("mtime").alias("m"), F.col("path").alias("p")
    )
    return keys.groupBy("std_key").agg(F.max_by("path", rank).alias("path")).withColumn("link", S.web_link("path", web_prefix))


def inventory_prefixes(inventory: DataFrame, limit: int = 10_000) -> list[str]:
    """Leading letters (at most six) of the inventory keys. Every key starts with a known prefix, so they are few."""
    rows = (
        inventory.select(F.regexp_extract("std_key", "^([A-Z]{1,6})", 1).alias("p")).filter("p <> ''").distinct().limit(limit + 1)
    ).collect()
    if len(rows) > limit:
        raise ValueError("the inventory has too many different prefixes")
    return sorted(r["p"] for r in rows)


def _variants(refs: DataFrame) -> DataFrame:
    """Distinct references with their variants and the rank of each: the key itself, longer first, text."""
    exploded = refs.select("ref").distinct().withColumn("_key", S.norm_ref("ref")).filter(F.col("_key") != "").select(
        "ref", "_key", F.explode(S.variant_keys("_key")).alias("variant")
    )
    rank = F.struct((F.col("variant") != F.col("_key")).alias("a"), (-F.length("variant")).alias("b"), F.col("variant").alias("c"))
    return exploded.withColumn("_rank", rank)


def lookup_inventory(refs: DataFrame, inventory: DataFrame) -> DataFrame:
    """(ref, link) by exact variant keys; EU and CFR references without a hit are searched in the paths."""
    variants = _variants(refs)
    exact = variants.join(inventory.select(F.col("std_key").alias("variant"), "link"), "variant").select("ref", "link").distinct()
    token = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    left = (
        variants.join(exact.select("ref").distinct(), "ref", "left_anti")
        .groupBy("ref").agg(F.max(S.is_eu_or_cfr(F.col("variant"))).alias("_eu"), F.collect_set(token("variant")).alias("_tokens"))
        .filter("_eu").select("ref", F.explode("_tokens").alias("_token"))
    )
    paths = inventory.select("link", token("path").alias("_path")).distinct()
    loose = substring_pairs(paths, "_path", left, "_token").select("ref", "link").distinct()
    return exact.unionByName(loose).withColumn("link", S.adjust_link("link")).distinct()


def _best_for_variants(variants: DataFrame, index: DataFrame, column: str, fold: bool) -> DataFrame:
    """(ref, path): best index row of the best-ranked variant that occurs in the column."""
    rank = F.struct(
        S.is_en("path").alias("e"), S.version_hint("path").alias("v"), (-F.length("path")).alias("l"), F.col("path").alias("p")
    )
    text = F.lower(column) if fold else F.col(column)
    term = F.lower("variant") if fold else F.col("variant")
    best = index.filter(F.col(column).isNotNull()).groupBy(text.alias("_text")).agg(F.max(rank).alias("_best"))
    terms = variants.select(term.alias("_term")).distinct()
    found = substring_pairs(best, "_text", terms, "_term").groupBy("_term").agg(F.max("_best").alias("_best"))
    hits = variants.withColumn("_term", term).join(found, "_term")
    return hits.groupBy("ref").agg(F.min_by("_best", "_rank").alias("_b")).select("ref", F.col("_b.p").alias("path"))


def lookup_index(refs: DataFrame, index: DataFrame, web_prefix: str) -> DataFrame:
    """(ref, link) by variants contained in index keys, else in index paths (ignoring case)."""
    variants = _variants(refs)
    by_key = _best_for_variants(variants, index, "std_key", fold=False)
    rest = variants.join(by_key, "ref", "left_anti")
    by_path = _best_for_variants(rest, index, "path", fold=True)
    return by_key.unionByName(by_path).select("ref", S.adjust_link(S.web_link("path", web_prefix)).alias("link"))


def document_refs(docs: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return spread(docs).select("doc_id", F.explode(S.std_refs("text", extra)).alias("ref")).withColumn("label", S.ref_prefix("ref"))


def refs_by_file(refs: DataFrame, links: DataFrame) -> DataFrame:
    """Per document and normalised reference: found flag and distinct links."""
    joined = refs.join(links, "ref", "left").withColumn("std_key", S.norm_ref("ref")).filter(F.col("std_key") != "")
    return joined.groupBy("doc_id", "std_key").agg(
        F.min("label").alias("label"),
        F.max(F.col("link").isNotNull()).alias("found"),
        F.array_sort(F.collect_set("link")).alias("links"),
    )
