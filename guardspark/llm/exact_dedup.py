"""Exact deduplication as a stateful stream (operator 3).

A stream of ``(doc_id, digest, locator)`` records is folded into keyed state that never expires and
lives in RocksDB, on disk: per digest the stable identifier (largest doc_id), the content locator of
that row (file and row index) and the number of rows. The fold is a streaming aggregate, so Spark
combines records map-side before they are dealt by digest and a group holding a third of all rows
reaches its state as one record a task. Texts never enter the state.

Hits, the digests of two rows and more, are then checked on their full bytes: the text at the stored locator
is fetched and all texts of the digest must be that string (combined map-side; texts that are alone with
their digest are not compared, nor dealt while the hits are few enough to be broadcast). Digests that
fail are regrouped by digest *and* text, so the result is exact even for a weak digest. Rows take their group's result by
digest; groups of more than a thousandth of all rows are broadcast for that, so that they never meet in one task.

Defined cases: a null text counts as empty and equals ''; of equal texts the row with the largest
doc_id stays (null ids lowest, then the largest locator, so repeated rows leave one); an empty
table gives an empty result; extra columns are ignored, whatever their names (``_metadata`` included), and kept by
:func:`drop_copies`; very long texts are hashed and compared whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import agreed, column, conf, documents, fresh, join_by_group, located, saved, shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: A store reserves 4 MB of disk for its manifest unless told not to; there is one store a partition.
STATE_CONF = {PROVIDER: ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def fold(stream: DataFrame) -> DataFrame:
    """The stateful step, for any streaming frame of ``doc_id, digest, locator``: the state of each digest."""
    return stream.groupBy("digest").agg(
        F.max(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("group_size")
    )


def stream_state(spark: SparkSession, records: str, schema, max_files: int | None = None) -> DataFrame:
    """Run the stream over the record files until all are taken; return the final state of each digest.

    ``foreachBatch`` writes each micro-batch's updates to a folder of its own, overwritten if the
    batch is run again after a failure; the update with the highest batch number is the state.
    """
    base = shared_dir(spark, "dedup-stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/updates/n={number}")

    with conf(spark, **STATE_CONF):
        reader = spark.readStream.schema(schema)
        stream = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(records)
        query = (
            fold(stream).writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True).foreachBatch(put).start()
        )
        query.awaitTermination()
    last = query.lastProgress
    several = last is not None and last["batchId"] > 0
    shape = f"digest binary, keep struct<doc_id:{dict(schema_types(schema))['doc_id']},locator:string>, group_size bigint, batch int"
    updates = spark.read.schema(shape).option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    state = updates.parquet(f"{base}/updates") if last is not None else spark.createDataFrame([], shape)
    if several:
        state = state.groupBy("digest").agg(F.max_by(F.struct("keep", "group_size"), "batch").alias("s")).select("digest", "s.*")
    return state.select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.locator").alias("keep_at"), "group_size")


def schema_types(schema) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, max_files: int | None = None, place: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, locator, digest, keep_id, group_size, kept. ``place`` names a row alike in every scan."""
    spark = docs.sparkSession
    docs, place = located(docs) if place is None else (docs, place)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", digest(text).alias("digest"), place.alias("locator"))
    records = shared_dir(spark, "dedup-records")
    keyed.write.parquet(records)
    keyed = spark.read.schema(keyed.schema).parquet(records)
    state = saved(stream_state(spark, records, keyed.schema, max_files), "dedup-state")

    hits = state.where("group_size > 1")
    texts = docs.select(digest(text).alias("digest"), place.alias("locator"), text.alias("text"))
    same = saved(agreed(texts, hits, "digest", "keep_at", "locator"), "dedup-agreed")
    clash = saved(hits.select("digest").join(same, "digest", "left_anti"), "dedup-clash")
    total = keyed.count()
    columns = ["doc_id", "locator", "digest", "keep_id", "keep_at", "group_size"]
    if clash.isEmpty():
        rows = join_by_group(keyed, state, "digest", "group_size", total).select(*columns)
    else:
        # A digest that stands for different texts: its rows are grouped by their whole text instead.
        apart = docs.select("doc_id", digest(text).alias("digest"), place.alias("locator"), text.alias("text")).join(clash, "digest", "left_semi")
        exact = apart.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        exact = exact.select("digest", "text", F.col("keep.doc_id").alias("keep_id"), F.col("keep.locator").alias("keep_at"), "group_size")
        apart = apart.join(exact, ["digest", "text"]).select(*columns)
        clear = join_by_group(keyed.join(clash, "digest", "left_anti"), state.join(clash, "digest", "left_anti"), "digest", "group_size", total).select(*columns)
        rows = clear.unionByName(apart)
    kept = F.col("keep_id").eqNullSafe(F.col("doc_id")) & (F.col("keep_at") == F.col("locator"))
    return rows.select("doc_id", "locator", "digest", "keep_id", "group_size", kept.alias("kept"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    names = docs.columns
    docs, place = located(docs)
    at = fresh("_at", docs)
    stay = exact_dedup(docs, place=place).where("kept").select(F.col("locator").alias(at))
    rows = docs.select(*[column(c) for c in names], place.alias(at))
    return rows.join(stay, at, "left_semi").select(*[column(c) for c in names])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup(documents(spark, sf_dir))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
