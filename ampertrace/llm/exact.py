"""Exact deduplication as a stateful stream.

Files of documents arrive as a stream. The state is a streaming aggregation without watermark, kept by RocksDB on the
executors' disks and saved to the shared folder: for each content digest the number of rows, and the row that stays
(largest identifier) with its content locator, the file and the place in the file where its bytes lie. Nothing
expires, so a later run over the same checkpoint continues where the last one ended and meets all earlier digests.

A digest only nominates. Rows of digests that were hit more than once are read again by their locators, and their full
texts are compared: grouped by digest and text, with partial sums before the shuffle, so that a text which holds a
third of all rows meets as one row per task. Digests with more than one text are resolved by the text itself.

Defined results: a null text equals an empty one. Texts are compared as they are. The row with the largest identifier
stays (null is smallest; of rows with the same identifier and text, one stays). A table without rows gives none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ampertrace.llm.arrays import column, spare, whole
from ampertrace.session import cut_lineage, shared_folder

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    # else each state partition reserves megabytes for its manifest
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: bytes of files in one micro-batch
BATCH_BYTES = str(64 << 30)
#: where the bytes of a row lie
LOCATOR = ("_file", "_row")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def located(source: DataFrame, id_: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    t = whole(column(source, text))
    return source.select(
        column(source, id_).alias("_id"), digest(t).alias("_digest"), F.length(F.to_binary(t, F.lit("utf-8"))).alias("_bytes"),
        F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"), t.alias("_text"),
    )


def keyed(rows: DataFrame) -> DataFrame:
    """One row of state per digest."""
    return rows.groupBy("_digest").agg(F.max(F.struct("_id", "_file", "_row")).alias("_keep"), F.count("*").alias("_size"))


def run_stream(spark: SparkSession, path: str, schema: StructType, id_: str, text: str, state: str, digest=sha256) -> DataFrame:
    """Bring the state in ``state`` up to date with all files of ``path``; the state's rows.

    Each micro-batch writes the digests it touched; the newest row of a digest is its state. A batch that is repeated
    after a failure writes the same folder again.
    """
    out = f"{state}/changed"

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    # a bracket pattern lets the source take a single file as well as a folder
    arrivals = spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(f"{path[:-1]}[{path[-1]}]")
    with settings(spark, STATE):
        query = (
            keyed(located(arrivals, id_, text, digest)).writeStream.outputMode("update").foreachBatch(save)
            .option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    kind = "_digest string, _keep struct<_id: {0}, _file: bigint, _row: bigint>, _size bigint, _batch int".format(schema[id_].dataType.simpleString())
    changed = spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(out)
    return changed.groupBy("_digest").agg(F.max_by(F.struct("_keep", "_size"), "_batch").alias("_s")).select("_digest", "_s.*")


def resolve(rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The groups of two rows and more, byte for byte: by digest, and by text for digests that hold several texts."""
    hits = state.filter("_size > 1").select("_digest")
    narrow = rows.select("_digest", *LOCATOR).join(hits, "_digest", "left_semi").select(*LOCATOR)
    suspects = rows.select("_digest", "_id", "_text", *LOCATOR).join(narrow.hint("shuffle_hash"), list(LOCATOR), "left_semi")
    sums = suspects.groupBy("_digest", "_text").agg(F.max(F.struct("_id", *LOCATOR)).alias("_keep"), F.count("*").alias("_size"))
    # the text itself is no longer needed where a digest stands for one text
    checked = cut_lineage(
        sums.groupBy("_digest").agg(F.count("*").alias("_texts"), F.max("_keep").alias("_keep"), F.sum("_size").alias("_size"))
    )
    groups = checked.filter("_texts = 1").select("_digest", "_keep", "_size")
    mixed = checked.filter("_texts > 1").select("_digest")
    if mixed.isEmpty():
        return groups, None
    return groups, cut_lineage(sums.join(mixed, "_digest", "left_semi"))


def dedup_files(spark: SparkSession, path: str, id_: str = "doc_id", text: str = "text", state: str | None = None, digest=sha256) -> DataFrame:
    """One row per row of the files: ``_id _file _row _digest _keep _size`` with the group's staying row in ``_keep``."""
    state = state or f"{shared_folder(spark)}/exact-{uuid.uuid4().hex}"
    source = spark.read.parquet(path)
    rows = located(source, id_, text, digest)
    groups, mixed = resolve(rows, run_stream(spark, path, source.schema, id_, text, state, digest))
    flat = ["_id", *LOCATOR, "_digest"]
    own = F.struct("_id", *LOCATOR)
    if mixed is None:
        found = rows.select(*flat).join(groups, "_digest", "left")
    else:
        several = mixed.select("_digest").distinct().withColumn("_several", F.lit(True))
        marked = rows.select(*flat, "_text").join(several, "_digest", "left").withColumn("_text", F.when(F.col("_several"), F.col("_text")))
        both = groups.withColumn("_text", F.lit(None).cast("string")).unionByName(mixed)
        found = marked.alias("m").join(
            both.alias("g"), (F.col("m._digest") == F.col("g._digest")) & F.col("m._text").eqNullSafe(F.col("g._text")), "left"
        ).select(*[f"m.{c}" for c in flat], "_keep", "_size")
    return found.select(*flat, F.coalesce("_keep", own).alias("_keep"), F.coalesce("_size", F.lit(1)).cast("long").alias("_size"))


def report(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("_id").alias("doc_id"), F.col("_keep._id").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("_keep") == F.struct("_id", *LOCATOR)).alias("kept"), F.col("_digest").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of equal texts, all columns as they were."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    docs.write.parquet(path)
    found = dedup_files(spark, path, id_, text)
    # rows that go are few in most corpora; the others keep their place
    gone = found.filter(~(F.col("_keep") == F.struct("_id", *LOCATOR))).select(*LOCATOR)
    landed = spark.read.parquet(path)
    file, row = spare(docs, *LOCATOR)
    named = landed.withColumns({file: F.xxhash64("_metadata.file_path"), row: F.col("_metadata.row_index")})
    gone = gone.select(F.col("_file").alias(file), F.col("_row").alias(row)).hint("shuffle_hash")
    return named.join(gone, [file, row], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
