"""Keyed tables: latest row wins, deletes, renames, decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampertrace.functions.names import collapse


def latest_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest in ``order``. A combinable aggregate, not a window, so no key is hot."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Table after applying the changes; rows of ``changes`` replace rows with the same key."""
    tagged = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest_wins(tagged, keys, ["_new"]).drop("_new")


def delete_keys(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def rename_key(df: DataFrame, key: str, renames: DataFrame) -> DataFrame:
    """Give rows a new key (columns ``old``, ``new``); an existing or doubly used new key is an error."""
    moved = renames.filter(F.col("old") != F.col("new"))
    taken = moved.join(df.select(F.col(key).alias("new")), "new", "left_semi").select("new")
    twice = moved.groupBy("new").count().filter("count > 1").select("new")
    if not taken.unionByName(twice).limit(1).isEmpty():
        raise ValueError(f"the new {key} is already in use")
    joined = df.join(renames.select(F.col("old").alias(key), F.col("new").alias("_new")), key, "left")
    return joined.withColumn(key, F.coalesce("_new", key)).select(*df.columns)


def clean_key(c: str) -> Column:
    return F.lower(collapse(c))


def decided(cases: DataFrame, decisions: DataFrame, key: str = "case_key") -> DataFrame:
    """Saved decisions for the given cases."""
    return decisions.join(cases.select(clean_key(key).alias(key)).distinct(), key, "left_semi")


def undecided(cases: DataFrame, decisions: DataFrame, key: str = "case_key") -> DataFrame:
    return cases.join(decisions.select(key).distinct(), key, "left_anti")


def accept_created(cases: DataFrame, created: DataFrame) -> DataFrame:
    """Cases with the candidate created for them; items without an identifier are dropped."""
    candidate = F.coalesce(F.nullif(collapse("identifier"), F.lit("")), F.nullif(collapse("resource_uri"), F.lit("")))
    made = created.select(
        "case_key", candidate.alias("ll_candidate_id"), collapse("resource_uri").alias("ll_candidate_uri")
    ).filter(F.col("ll_candidate_id").isNotNull())
    made = latest_wins(made, ["case_key"], ["ll_candidate_id", "ll_candidate_uri"])
    return cases.join(made, "case_key").withColumn("decision_status", F.lit("candidate"))
