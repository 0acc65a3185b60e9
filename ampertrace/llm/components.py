"""Connected components of a table of links, in rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampertrace.session import cut_lineage


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """Hang the larger (or the smaller and itself) neighbours of each node on its least neighbour.

    The least neighbour is a combinable aggregate joined back, so a node with very many links is not gathered.
    """
    if larger:
        sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = sides.join(least, "a")
    if larger:
        hung = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hung = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return hung.filter("a <> b").distinct()


def _done(now: DataFrame) -> bool:
    """Whether every node hangs on one other and nothing hangs on it; then further rounds change nothing."""
    ends = now.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), "b").unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(None).cast(now.schema["b"].dataType).alias("b")))
    seen = ends.groupBy("node").agg(F.min("hangs").alias("l"), F.max("hangs").alias("h"), F.min("b").alias("low"), F.max("b").alias("high"))
    return seen.filter("l <> h or low <> high").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node root`` for every node that has a link (columns ``a``, ``b``); the root is the component's least node.

    Links of a node to itself and repeated links do not matter. The rounds end when only stars are left; their
    number grows with the logarithm of the longest chain.
    """
    now = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _done(now):
        now = cut_lineage(_stars(_stars(now, True), False))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
