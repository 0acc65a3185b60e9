"""Client dictionary, page selection and anonymisation of document tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import batched

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampertrace.functions import privacy as P
from ampertrace.functions.text import strip, text_or_blank
from ampertrace.session import spread

#: free patterns tried in one pass over a text
PATTERN_BLOCK = 500


def _first_seen(values: Column, fold: bool) -> Column:
    """Trimmed non-blank values without repeats (ignoring case when ``fold``), in order."""
    kept = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), strip), lambda v: v != "")
    keys = F.transform(kept, F.lower) if fold else kept
    return F.filter(kept, lambda v, i: F.array_position(keys, F.lower(v) if fold else v) == i + 1)


def norm_clients(df: DataFrame) -> DataFrame:
    """Canonical client records; rows without a name are dropped."""
    name = strip(text_or_blank("canonical"))
    source = F.coalesce(F.nullif(F.col("id"), F.lit("")), name)
    clean = F.regexp_replace(F.regexp_replace(source, "[^A-Za-z0-9_-]", "_"), "^_+|_+$", "")
    status = F.coalesce(F.nullif("status", F.lit("")), F.lit("approved"))
    aliases = _first_seen(F.col("aliases"), fold=True)
    return df.filter(name != "").select(
        F.substring(F.coalesce(F.nullif(clean, F.lit("")), F.lit("client")), 1, 32).alias("id"),
        name.alias("canonical"),
        aliases.alias("aliases"),
        _first_seen(F.col("patterns"), fold=False).alias("patterns"),
        F.coalesce("case_insensitive", F.lit(True)).alias("case_insensitive"),
        status.alias("status"),
        F.array_distinct(F.transform(F.concat(F.array(name), aliases), P.client_marker)).alias("markers"),
    )


def _approved() -> Column:
    return (F.coalesce(F.nullif("status", F.lit("")), F.lit("approved")) == "approved") & (strip(text_or_blank("canonical")) != "")


def _record(name: Column, ending: bool) -> Column:
    return F.struct(
        F.col("canonical"), name.alias("name"), F.coalesce("case_insensitive", F.lit(True)).alias("fold"), F.lit(ending).alias("ending")
    ).alias("_n")


def client_terms(clients: DataFrame) -> DataFrame:
    """``_word _n``: each name of an approved client, and the last part of each client's name, under its longest word."""
    all_names = F.array_distinct(F.transform(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>"))), strip))
    names = clients.filter(_approved()).withColumn("_name", F.explode(all_names)).select(_record(F.col("_name"), False))
    parts = F.filter(F.split("canonical", r"[\s-]+"), lambda p: p != "")
    endings = clients.withColumn("_parts", parts).filter(F.size("_parts") > 1).select(_record(F.try_element_at("_parts", F.lit(-1)), True))
    longest = F.array_max(F.transform(P.folded_words("_n.name"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    return names.unionByName(endings).filter("_n.name is not null and _n.name <> ''").select(longest["w"].alias("_word"), "_n").distinct()


def client_patterns(clients: DataFrame) -> Iterator[list[tuple[str, re.Pattern]]]:
    """Free patterns, and names made of signs only, in blocks. They have no word to join on, so all texts are read for each block."""
    free = clients.filter(_approved()).select(
        "canonical", F.explode("patterns").alias("p"), F.coalesce("case_insensitive", F.lit(True)).alias("fold"), F.lit(False).alias("literal")
    )
    signs = client_terms(clients).filter("_word is null and not _n.ending").select("_n.canonical", F.col("_n.name").alias("p"), "_n.fold", F.lit(True).alias("literal"))
    rows = free.unionByName(signs).withColumn("p", strip("p")).filter("p <> ''").distinct().toLocalIterator()
    for block in batched(rows, PATTERN_BLOCK):
        yield [(r["canonical"], P.pattern_of(r["p"], r["fold"], r["literal"])) for r in block]


def with_candidates(docs: DataFrame, clients: DataFrame) -> DataFrame:
    """Adds ``_names``, the names whose longest word stands in the text, and ``_hits`` of the free patterns.

    Texts and names meet in a join on words, whatever the size of the dictionary. Texts are told apart by a hash; a
    shared hash only brings candidates that are then not found.
    """
    persons = P.folded_words(F.array_join(P.person_like(P.without_soft_hyphens("text")), " "))
    words = F.array_union(P.folded_words("text"), persons)
    probes = docs.select(F.xxhash64("text").alias("_hash"), F.explode(words).alias("_word"))
    per_text = probes.join(client_terms(clients), "_word").groupBy("_hash").agg(F.collect_set("_n").alias("_names"))
    out = docs.withColumn("_hash", F.xxhash64("text")).join(per_text, "_hash", "left").drop("_hash")
    hits = F.array().cast("array<struct<start:int,end:int,canonical:string>>")
    for block in client_patterns(clients):
        hits = F.concat(hits, P.pattern_hits(F.col("text"), block))
    return out.withColumn("_hits", hits)


def find_clients(docs: DataFrame, clients: DataFrame) -> DataFrame:
    """Adds ``clients``, the sorted names of the clients found in each text."""
    by_name = F.coalesce(P.named_clients(F.col("text"), F.col("_names")), F.array().cast("array<string>"))
    found = F.array_sort(F.array_union(by_name, F.transform("_hits", lambda h: h["canonical"])))
    return with_candidates(spread(docs), clients).withColumn("clients", found).drop("_names", "_hits")


def client_hits(docs: DataFrame, record: dict) -> DataFrame:
    """How often the names and patterns of one client match in all texts together."""
    fold = record.get("case_insensitive", True)
    given = [record["canonical"], *(record.get("aliases") or [])]
    names = [{"canonical": record["canonical"], "name": n, "fold": fold, "ending": False} for n in given if n and n.strip()]
    free = [(record["canonical"], P.pattern_of(p.strip(), fold, False)) for p in record.get("patterns") or [] if p.strip()]
    return spread(docs).agg(F.coalesce(F.sum(P.span_count(F.col("text"), names, free)), F.lit(0)).alias("matches"))


def select_pages(df: DataFrame, spec: str, total: int | None = None) -> DataFrame:
    """Rows of the pages in a list such as ``1-3,5``. With ``total``, pages beyond it are an error."""
    wanted: list[Column] = []
    for part in (p.strip() for p in spec.split(",")):
        if not part:
            continue
        first, _, last = part.partition("-")
        low, high = int(first), int(last or first)
        if total is not None and not 1 <= low <= high <= total:
            raise ValueError(f"page {part} is out of range")
        wanted.append(F.col("page_no").between(low, high))
    if not wanted:
        raise ValueError("no pages specified")
    condition = wanted[0]
    for more in wanted[1:]:
        condition = condition | more
    return df.filter(condition)


def anonymize(docs: DataFrame, clients: DataFrame) -> DataFrame:
    """Adds ``anonymized`` to documents with a ``text``: e-mails, phones, clients and persons replaced by marks.

    Finds are made in the text without soft hyphens and without line breaks after hyphens, and take the mark's place with
    whatever lay inside them. A null text stays null.
    """
    persons = P.person_like(P.without_soft_hyphens("text"))
    masked = P.replace_pii(F.col("text"), persons, F.col("_names"), F.col("_hits"))
    return with_candidates(spread(docs), clients).withColumn("anonymized", masked).drop("_names", "_hits")
