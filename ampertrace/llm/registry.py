"""Queries of the operators over the given tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampertrace.llm import bpe, exact, jaccard, langid, licenses, lines, packing, quality, rules, secrets, spelling, toxicity, whitening

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_secret_scans")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(quality.fold(F.col("doc_id")) != 0)
    scored = quality.score_documents(documents(spark, sf_dir), labels)
    return scored.select(
        "doc_id", (quality.fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = langid.remainder(F.col("doc_id"), 3) == 1
    found = langid.identify(docs, langid.fit(docs, held_out=held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), TOKENIZER)


@query("op5_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(documents(spark, sf_dir), TOKENIZER)


@query("op6_exact_dedup", """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.report(exact.dedup_files(spark, f"{sf_dir}/documents.parquet"))


@query("op7_license_scans")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


@query("op8_line_dedup", r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as p from documents),
 w as (select doc_id, p, line, row_number() over (partition by doc_id order by p) - 1 as k from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
 v as (select doc_id, k, line as l1, lead(line) over o as l2, lead(line, 2) over o as l3 from w window o as (partition by doc_id order by k)),
 r as (select doc_id, k, row_number() over (partition by l1, l2, l3 order by doc_id, k) as n from v where l3 is not null),
 c as (select distinct doc_id, unnest([k, k + 1, k + 2]) as k from r where n > 1),
 t as (select l.doc_id, string_agg(l.line, chr(10) order by l.p) filter (c.k is null) as clean, count(w.k) as n_lines, count(c.k) as n_removed
       from l left join w using (doc_id, p) left join c on c.doc_id = w.doc_id and c.k = w.k group by l.doc_id)
select doc_id, n_lines, n_removed, coalesce(clean, '') as clean_text from t
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(documents(spark, sf_dir))


@query("op9_ngram_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(documents(spark, sf_dir))


@query("op10_quality_rules", r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
 w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, string_split(t, chr(10)) as l from d),
 m as (select doc_id, t, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars, len(l) as n_lines,
  length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols, length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) as n_capitals,
  len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as n_dup_lines
  from w),
 g as (select doc_id, i, [w[i], w[i + 1], w[i + 2]] as x from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
 q as (select doc_id, i, count(*) over (partition by doc_id, x) as n from g),
 r as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from q where n > 1) group by doc_id),
 a as (select m.*, coalesce(r.n_repeat_words, 0) as n_repeat_words from m left join r using (doc_id)),
 b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 not (base_failed or 10 * n_symbols > 3 * n_words or 10 * n_capitals > 4 * word_chars or word_chars > 15 * n_words or 10 * n_dup_lines > 5 * n_lines) as kept
from b
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir))


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op12_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), toxicity.fold(F.col("doc_id")) == 2
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_documents(docs, toxicity.fit(docs.filter(~held), labels.filter(~held)))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))
