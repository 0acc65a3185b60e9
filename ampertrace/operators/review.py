"""Review cases and their coverage of problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampertrace.functions.names import keywords, norm_summary
from ampertrace.functions.text import strip, text_or_blank
from ampertrace.session import cut_lineage

CASE_FIELDS = ("test_case_id", "case_title", "department", "assigning_category")


def norm_cases(raw: DataFrame, column: str = "case_json") -> DataFrame:
    """Review cases out of JSON texts: fields trimmed, anything but an object dropped."""
    text = F.when(strip(column).startswith("{"), F.col(column))
    parsed = F.from_json(text, "map<string,string>")
    return raw.withColumn("_case", parsed).filter(F.col("_case").isNotNull()).select(
        *[strip(text_or_blank(F.col("_case")[f])).alias(f) for f in CASE_FIELDS],
        F.coalesce(F.col("_case")["tags"], F.lit("")).alias("tags"),
    )


def topic_words(c: Column | str) -> Column:
    """Distinct topic words of a text."""
    return F.array_distinct(keywords(norm_summary(c)))


def _word_classes(texts: DataFrame, id_: str, name: str) -> DataFrame:
    """Each row's identifier with its class: the sorted topic words in one text."""
    return texts.select(id_, F.array_join(F.array_sort(topic_words("text")), " ").alias(name))


def _class_pairs(asked: DataFrame, offered: DataFrame, min_shared: int) -> DataFrame:
    """``problem_words case_words shared`` for the classes that share at least ``min_shared`` words.

    Prefix filter: a class of cases that shares n words must share one of all but its n-1 most frequent words, so the
    most frequent words never become join keys. Candidate pairs are made unique and then counted exactly.
    """
    words = lambda name: F.filter(F.split(name, " "), lambda w: w != "")
    asked = asked.select("problem_words").distinct()
    offered = offered.select("case_words").distinct()
    each = offered.select("case_words", F.explode(words("case_words")).alias("_word"))
    frequency = each.groupBy("_word").agg(F.count("*").alias("_f"))
    ranked = each.join(frequency, "_word").groupBy("case_words").agg(F.array_sort(F.collect_list(F.struct("_f", "_word"))).alias("_r"))
    prefix = F.slice(F.transform("_r", lambda x: x["_word"]), 1, F.greatest(F.size("_r") - (min_shared - 1), F.lit(0)))
    keys = ranked.select("case_words", F.explode(prefix).alias("_word"))
    probes = asked.select("problem_words", F.explode(words("problem_words")).alias("_word"))
    pairs = probes.join(keys, "_word").select("problem_words", "case_words").distinct()
    shared = F.size(F.array_intersect(words("problem_words"), words("case_words")))
    return pairs.withColumn("shared", shared).filter(F.col("shared") >= min_shared)


def coverage_candidates(problems: DataFrame, cases: DataFrame, min_shared: int = 2) -> DataFrame:
    """Cases that share at least ``min_shared`` topic words with a problem (class B), else class C.

    ``problems``: problem_id, text; ``cases``: case_id, text. Texts of equal words are compared once. Every pair is
    listed, so the result may grow with problems times cases; ``coverage_classes`` states the same without that.
    """
    asked = _word_classes(problems, "problem_id", "problem_words")
    offered = _word_classes(cases, "case_id", "case_words")
    pairs = cut_lineage(_class_pairs(asked, offered, min_shared))
    related = asked.join(pairs, "problem_words").join(offered, "case_words").select(
        "problem_id", "case_id", "shared", F.lit("B").alias("coverage")
    )
    alone = asked.join(pairs.select("problem_words").distinct(), "problem_words", "left_anti").select(
        "problem_id", F.lit(None).cast(cases.schema["case_id"].dataType).alias("case_id"), F.lit(0).alias("shared"),
        F.lit("C").alias("coverage"),
    )
    return related.unionByName(alone)


def coverage_classes(problems: DataFrame, cases: DataFrame, min_shared: int = 2) -> DataFrame:
    """The coverage of ``coverage_candidates`` by classes of equal topic words, with the members of the classes.

    Rows with ``problem_id`` or ``case_id`` say to which class (``problem_words``, ``case_words``) a text belongs. Rows
    without state the coverage of a class of problems: B with each class of cases and the number of shared words, else C.
    """
    asked = _word_classes(problems, "problem_id", "problem_words")
    offered = _word_classes(cases, "case_id", "case_words")
    pairs = cut_lineage(_class_pairs(asked, offered, min_shared))
    related = pairs.withColumn("coverage", F.lit("B"))
    alone = asked.select("problem_words").distinct().join(pairs.select("problem_words").distinct(), "problem_words", "left_anti")
    parts = (asked, offered, related, alone.withColumns({"shared": F.lit(0), "coverage": F.lit("C")}))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select("problem_id", "case_id", "problem_words", "case_words", "shared", "coverage")


def top_cases(problems: DataFrame, cases: DataFrame, n: int = 3) -> DataFrame:
    """The best cases of each problem by the weights of the shared topic words, ties of the last place included.

    ``problem_id case_words score place``: cases of equal words are one row. A word weighs 100 times the number of such rows over
    those that have it, in whole numbers. Problems without a shared word have no row.

    Two passes over the postings of the words, after the threshold algorithm: the cases of a problem's heaviest word give a score that
    the n-th best case reaches at least. The words of the problem are then taken by falling weight as long as the weights that are left
    could still reach that score; a case that has none of these words cannot be among the best. So the words that most
    cases have become join keys only where nothing better is there, and the result grows with the problems.
    """
    split = lambda name: F.filter(F.split(name, " "), lambda w: w != "")
    asked = _word_classes(problems, "problem_id", "problem_words")
    postings = cut_lineage(_word_classes(cases, "case_id", "case_words").select("case_words").distinct().select("case_words", F.explode(split("case_words")).alias("word")))
    number = postings.agg(F.count_distinct("case_words").alias("_n"))
    weights = postings.groupBy("word").agg(F.count("*").alias("_f")).crossJoin(F.broadcast(number)).select("word", F.expr("_n * 100 div _f").alias("weight"))
    own = asked.select("problem_words").distinct().select("problem_words", F.explode(split("problem_words")).alias("word")).join(weights, "word")
    by_weight = Window.partitionBy("problem_words").orderBy(F.col("weight").desc(), "word")
    rest = by_weight.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    terms = cut_lineage(own.withColumns({"turn": F.row_number().over(by_weight), "left": F.sum("weight").over(rest)}))
    weighed = cut_lineage(terms.groupBy("problem_words").agg(F.collect_list(F.struct("word", "weight")).alias("_w")))

    def scored(pairs: DataFrame) -> DataFrame:
        # a shared word counts with the problem's weight of it
        hit = lambda x: F.array_contains(split("case_words"), x["word"])
        total = F.aggregate(F.filter("_w", hit), F.lit(0).cast("bigint"), lambda acc, x: acc + x["weight"])
        return pairs.join(weighed, "problem_words").select("problem_words", "case_words", total.alias("score"))

    best = Window.partitionBy("problem_words").orderBy(F.col("score").desc())
    first = scored(terms.filter("turn = 1").join(postings, "word").select("problem_words", "case_words"))
    reached = first.withColumn("_p", F.row_number().over(best)).filter(F.col("_p") == n).select("problem_words", F.col("score").alias("least"))
    bounded = terms.join(reached, "problem_words", "left").withColumn("least", F.coalesce("least", F.lit(0)))
    pairs = bounded.filter("left >= least").join(postings, "word").select("problem_words", "case_words", "least").distinct()
    good = scored(pairs).join(reached, "problem_words", "left").filter("score >= coalesce(least, 0)")
    places = good.withColumn("place", F.rank().over(best)).filter(F.col("place") <= n)
    return asked.join(places, "problem_words").select("problem_id", "case_words", "score", "place")
