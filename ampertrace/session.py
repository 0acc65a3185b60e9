"""Session settings and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Event times carry no zone; UTC keeps arithmetic on them free of daylight-saving jumps."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # estimates come from the size of compressed files: a column of keys alone takes up to 50 times that as a hash table, and the
    # driver builds and keeps all tables of a job. So a table that grows past this is joined by a shuffle, unless its rows are
    # measured at run time and found to be few
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256KB")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "2MB")
    # joins with small per-slot tables: hash instead of merge where every build partition is seen to be small
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; local runs without it get a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="ampertrace-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    The result is computed once, survives lost executors, and later steps read only the columns they
    need. ``checkpoint()`` would compute the rows twice and keep them as opaque rows.
    """
    path = f"{shared_folder(df.sparkSession)}/ampertrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Redistribute small input over all cores before row-local work that is heavy on CPU.

    A table of fewer than one split per core would leave cores idle. The size is the optimizer's
    estimate; larger input keeps its partitions and is not shuffled.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * split else df
