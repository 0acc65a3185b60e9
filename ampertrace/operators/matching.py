"""Set-containment and substring joins through an index key, never through a cross join.

Every term is looked up under one key only, which any match must contain, so the equi join on it finds all matches; the
exact test follows. Sets are keyed by their rarest token. Strings are keyed by half of themselves or more: their first or last
2^k characters, for the largest 2^k that fits, whichever fewer terms share. Texts are cut into windows of the lengths in
use, at most one for each power of two, so a key is met hardly anywhere but in true matches, and the work grows with the
texts plus the matches, not with texts times terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: characters of a text that are cut into windows together
PIECE = 256


def _rarest(terms: DataFrame, parts: Column) -> DataFrame:
    """Adds ``_key``: the part of each term that fewest terms share. Terms carry ``_term_id``."""
    exploded = terms.select("_term_id", F.explode(F.array_distinct(parts)).alias("_key"))
    counts = exploded.groupBy("_key").agg(F.count("*").alias("_n"))
    best = exploded.join(counts, "_key").groupBy("_term_id").agg(F.min_by("_key", F.struct("_n", "_key")).alias("_key"))
    return terms.join(best, "_term_id")


def subset_pairs(sets: DataFrame, set_tokens: str, terms: DataFrame, term_tokens: str) -> DataFrame:
    """Join rows of ``sets`` with the ``terms`` all of whose tokens they contain. Token columns are arrays."""
    keyed = _rarest(
        terms.filter(F.size(term_tokens) > 0).withColumn("_term_id", F.to_json(F.struct(*terms.columns))),
        F.col(term_tokens),
    ).drop("_term_id")
    probes = sets.withColumn("_key", F.explode(F.array_distinct(set_tokens)))
    return (
        probes.join(keyed, "_key").filter(F.size(F.array_except(term_tokens, set_tokens)) == 0).drop("_key")
    )


def _windows(text: Column, width: Column) -> Column:
    """All substrings of ``width`` characters. Pieces first: a substring is found by counting from the start."""
    size = F.length(text)
    pieces = F.transform(F.sequence(F.lit(1), size - width + 1, F.lit(PIECE)), lambda at: F.substr(text, at, width + (PIECE - 1)))
    cut = lambda piece: F.transform(F.sequence(F.lit(1), F.length(piece) - width + 1), lambda i: F.substr(piece, i, width))
    return F.when(size >= width, F.flatten(F.transform(pieces, cut))).otherwise(F.array().cast("array<string>"))


def _width(length: Column) -> Column:
    """The largest power of two that is not above a length of one or more."""
    return F.pow(F.lit(2), F.length(F.bin(length)) - 1).cast("int")


def substring_candidates(texts: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """``_text_id`` (a hash of the text) with the ``terms`` whose key occurs in it."""
    distinct = terms.filter(F.length(term) > 0).withColumn("_term_id", F.to_json(F.struct(*terms.columns)))
    width = _width(F.length(term))
    ends = F.array(F.xxhash64(F.substr(F.col(term), F.lit(1), width)), F.xxhash64(F.substr(F.col(term), F.length(term) - width + 1, width)))
    keyed = _rarest(distinct, ends).drop("_term_id")
    widths = distinct.agg(F.collect_set(width).alias("_widths"))
    # the texts themselves are not copied for each window
    probes = (
        texts.select(F.xxhash64(text).alias("_text_id"), F.col(text).alias("_text")).crossJoin(F.broadcast(widths))
        .select("_text_id", F.explode(F.flatten(F.transform("_widths", lambda w: F.array_distinct(F.transform(_windows(F.col("_text"), w), lambda x: F.xxhash64(x)))))).alias("_key"))
    )
    return probes.join(keyed, "_key").drop("_key").distinct()


def substring_pairs(texts: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """Join rows of ``texts`` with the ``terms`` that occur in them literally."""
    # a shared hash, of texts or of windows, is settled by the exact test
    return (
        texts.withColumn("_text_id", F.xxhash64(text))
        .join(substring_candidates(texts, text, terms, term), "_text_id")
        .filter(F.contains(F.col(text), F.col(term)))
        .drop("_text_id")
    )
