"""Exact interpolated quantiles for groups of any size.

``percentile`` keeps every distinct value of a group in one aggregation buffer. Here a mergeable
sketch first brackets the wanted ranks; only values inside the bracket (about one percent of a big
group) are then counted and ranked exactly. Sketch and counts combine on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ACCURACY = 10_000
_MARGIN = 0.005
_SMALL = 1_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], values: dict[str, str], q: float = 0.5) -> DataFrame:
    """One row per key combination with the ``q`` quantile of each value column (NULLs ignored).

    Keys must not be NULL. Key combinations without any non-null value are absent.
    """
    pairs = F.explode(
        F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value")) for n, c in values.items()])
    )
    long = (
        df.select(*keys, pairs.alias("_p"))
        .select(*keys, F.col("_p.name").alias("_name"), F.col("_p.value").alias("_value"))
        .filter(F.col("_value").isNotNull())
    )
    group = [*keys, "_name"]
    # the margin is many ranks wide once a group has _SMALL rows, and fifty times the error of the sketch
    sketch = F.percentile_approx("_value", [max(0.0, q - _MARGIN), min(1.0, q + _MARGIN)], _ACCURACY)
    bracket = long.groupBy(*group).agg(
        F.count("*").alias("_n"),
        F.when(F.count("*") < _SMALL, F.array(F.min("_value"), F.max("_value"))).otherwise(sketch).alias("_range"),
    )
    counted = (
        long.join(bracket, group)
        .filter(F.col("_value") <= F.col("_range")[1])
        .withColumn("_value", F.when(F.col("_value") >= F.col("_range")[0], F.col("_value")))
        .groupBy(*group, "_n", "_value")
        .agg(F.count("*").alias("_c"))
    )
    ranked = counted.withColumn(
        "_cum",
        F.sum("_c").over(
            Window.partitionBy(*group)
            .orderBy(F.col("_value").asc_nulls_first())
            .rowsBetween(Window.unboundedPreceding, 0)
        ),
    )
    rank = F.lit(q) * (F.col("_n") - 1)
    picked = ranked.groupBy(*group, "_n").agg(
        F.min(F.when(F.col("_cum") > F.floor(rank), F.col("_value"))).alias("_low"),
        F.min(F.when(F.col("_cum") > F.ceil(rank), F.col("_value"))).alias("_high"),
    )
    result = F.when(
        F.col("_low").isNull() | F.col("_high").isNull(), F.raise_error(F.lit("quantile outside its bracket"))
    ).otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) * (rank - F.floor(rank)))
    return (
        picked.withColumn("_result", result)
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col("_name") == n, F.col("_result"))).alias(n) for n in values])
    )
