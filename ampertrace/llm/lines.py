"""Line deduplication over windows of three consecutive lines.

Lines with a word are numbered within their document; every three consecutive ones are a window. A window that occurs
more than once in the corpus keeps its first occurrence, by document and line; the lines of the others are covered. All
covered lines are removed, so that overlapping windows merge to whole passages. Lines without a word stay where they are.

Windows are two 64-bit hashes, summed up before and after the shuffle: a window that very many documents share is one
row per task. The first occurrences are written and joined back to the windows; no aggregate stands in the stage of that join, so
that Spark can split a hot window over tasks.

Defined results: a null text stays null, a text with fewer than three lines with a word is unchanged. Rows with the same identifier and
the same text are one document. The smallest identifier comes first, null before all. A table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampertrace.llm.arrays import column, let, spare, whole
from ampertrace.session import cut_lineage

WINDOW = 3
WORD = r"[^\x20\x09-\x0D]"


def windows(text: Column, n: int = WINDOW) -> Column:
    """``at h1 h2`` of each window: the place of its first line among the lines with a word, and its hashes."""

    def hashed(lines: Column) -> Column:
        def one(i: Column) -> Column:
            part = [lines[i + k] for k in range(n)]
            return F.struct(i.alias("at"), F.xxhash64(*part).alias("h1"), F.xxhash64(F.lit(n), *reversed(part)).alias("h2"))

        return F.when(F.size(lines) >= n, F.transform(F.sequence(F.lit(0), F.size(lines) - n), one))

    return let(F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)), hashed)


def without(text: Column, covered: Column) -> Column:
    """The text without the lines with a word whose numbers are in ``covered``; linear in the lines."""

    def kept(lines: Column) -> Column:
        places = F.filter(F.transform(lines, lambda line, i: F.when(line.rlike(WORD), i)), lambda i: i.isNotNull())
        gone = let(places, lambda p: F.transform(covered, lambda n: p[n]))
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: lines[i])

    return F.array_join(let(F.split(text, "\n"), kept), "\n")


def covered_lines(docs: DataFrame) -> DataFrame:
    """``_id _hash covered``: for each document with repeated windows the sorted numbers of the lines to remove."""
    found = cut_lineage(docs.select("_id", "_hash", F.explode(windows(F.col("_t"))).alias("w")).select("_id", "_hash", "w.*"))
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("_id", "_hash", "at")).alias("first"), F.max(F.struct("_id", "_hash", "at")).alias("last"))
    repeated = cut_lineage(first.filter("first <> last").select("h1", "h2", "first"))
    later = found.join(repeated, ["h1", "h2"]).filter(~F.struct("_id", "_hash", "at").eqNullSafe(F.col("first"))).select("_id", "_hash", "at")
    lines = later.distinct().groupBy("_id", "_hash").agg(F.collect_list("at").alias("at"))
    spread = F.flatten(F.transform("at", lambda i: F.array(*[i + k for k in range(WINDOW)])))
    return lines.select("_id", "_hash", F.sort_array(F.array_distinct(spread)).alias("covered"))


def dedup_lines(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with repeated passages removed from their texts; all rows and columns stay. Adds the array ``_covered``, null where nothing went."""
    t = column(docs, text)
    slim = docs.select(column(docs, id_).alias("_id"), F.xxhash64(whole(t)).alias("_hash"), whole(t).alias("_t"))
    own, gone_id, gone_hash, covered = spare(docs, "_hash", "_gone_id", "_gone_hash", "_covered")
    gone = cut_lineage(covered_lines(slim)).toDF(gone_id, gone_hash, covered)
    marked = docs.withColumn(own, F.xxhash64(whole(t)))
    # one plan at every size: texts are dealt by key once, whether or not the covered lines would fit a broadcast
    both = marked.join(gone.hint("merge"), F.col(f"`{id_}`").eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_hash)), "left")
    new = F.when(F.col(covered).isNotNull(), without(F.col(f"`{text}`"), F.col(covered))).otherwise(F.col(f"`{text}`"))
    return both.withColumn(text, new).select(*[F.col(f"`{c}`") for c in docs.columns], covered)


def report(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id n_lines n_removed clean_text`` of every document; ``n_lines`` counts lines with a word before."""
    before = F.size(F.filter(F.split(whole(f"{text}_before"), "\n"), lambda line: line.rlike(WORD))).cast("long")
    slim = docs.select(column(docs, id_).alias("doc_id"), column(docs, text).alias("text"), column(docs, text).alias("text_before"))
    return dedup_lines(slim).select(
        "doc_id", before.alias("n_lines"), F.coalesce(F.size("_covered"), F.lit(0)).cast("long").alias("n_removed"), F.col("text").alias("clean_text")
    )
