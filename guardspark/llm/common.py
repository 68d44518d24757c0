"""Shared plumbing of the training-data operators: shared folder, materialising, Arrow batches, hot keys.

Intermediate tables are written below the folder named by ``spark.checkpoint.dir``, which the driver
and every executor see, so a lost executor costs a reread and never the job. The setting is taken
from the session; only where it is unset and the master is this machine (tests) a temporary folder is used.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of one Arrow batch handed to Python. Texts may be very long, so batches are kept small.
ARROW_ROWS = 512
#: A key is hot if it holds more than this share of all rows; so there are at most ``1 / HOT_SHARE`` of them.
HOT_SHARE = 0.001
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small enough for very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name in the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="guardspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def conf(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings that hold inside the block; ``__`` stands for a dot."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    The shuffle files of the write go with it, as the table stands for them from here on.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    with conf(spark, **{CLEANUP: "true"}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`saved` wrote and nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t._saved_at)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with as many underscores behind it as it takes to clash with no column."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def located(docs: DataFrame) -> tuple[DataFrame, Column]:
    """``docs`` and an expression that names each of its rows alike in every scan.

    A file scan names rows by file and row index; any other plan, and one with a column named
    ``_metadata``, is written out first with a number for each row (an extra column of a name of its own).
    """
    place = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    if "_metadata" not in {c.lower() for c in docs.columns}:
        try:
            docs.select(place)
            return docs, place
        except AnalysisException:
            pass
    name = fresh("_row", docs)
    return saved(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), F.col(name).cast("string")


def as_written(docs: DataFrame) -> DataFrame:
    """The rows of a table in the order in which a sorted frame was written to it: by number of its part, file and place in the file.

    Spark packs files into tasks by their size, so a scan alone has another order. Rows that are no scan of files stay as they come.
    """
    if "_metadata" in {c.lower() for c in docs.columns}:
        return docs
    file = F.col("_metadata.file_name")
    places = [F.regexp_extract(file, r"^part-(\d+)", 1).try_cast("long"), file, F.col("_metadata.row_index")]
    try:
        return docs.orderBy(*places)
    except AnalysisException:
        return docs


def with_text(
    rows: DataFrame, added: str, make: Callable[[], Callable[[list[str | None]], dict[str, list]]], text: str = "text", keep_text: bool = False
) -> DataFrame:
    """The columns of ``rows`` (but ``text``) as they are, and those of the DDL ``added`` as computed from the texts.

    Only texts become Python objects: ids and all other columns stay in Arrow, so no type is changed. ``make``
    runs once a task and returns the function of a list of texts.
    """
    kept = [f for f in rows.schema.fields if f.name != text or keep_text]
    new = StructType.fromDDL(added)
    types = to_arrow_schema(new)
    names = [f.name for f in rows.schema.fields]
    at, stay = names.index(text), [k for k, f in enumerate(rows.schema.fields) if f.name != text or keep_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            found = work(batch.column(at).to_pylist())
            columns = [batch.column(k) for k in stay] + [pa.array(found[f.name], f.type) for f in types]
            yield pa.RecordBatch.from_arrays(columns, [*(names[k] for k in stay), *types.names])

    return rows.mapInArrow(run, StructType([*kept, *new.fields]))


def text_batches(batches: Iterator, *columns: str) -> Iterator[tuple[list, ...]]:
    """Columns of pandas batches as lists; null texts stay None."""
    for pdf in batches:
        yield tuple([None if v is None or v != v else v for v in pdf[c].tolist()] for c in columns)


def join_by_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the row of ``groups`` (one a ``key``, never null) of the same key; ``size`` counts a group's rows of ``total``.

    Groups that hold more than ``HOT_SHARE`` of all rows, at most ``1 / HOT_SHARE`` of them, are broadcast, so their rows
    never meet in one task; the others meet by key. ``how`` is inner or left.
    """
    least = max(1.0, HOT_SHARE * total)
    hot = F.broadcast(groups.where(F.col(size) > least))
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(groups.where(F.col(size) <= least), key, how))


def agreed(texts: DataFrame, groups: DataFrame, key: str, at: str, place: str, most: int = 1_000_000) -> DataFrame:
    """``key`` of the ``groups`` (``key``, ``at``: the place of a group's first text) whose texts are all the text at that place.

    ``texts`` has ``key``, ``place`` and ``text``, and only texts of ``groups`` are compared: whole, as the least, the greatest and the
    one at the place, combined before they are dealt. Up to ``most`` groups (their number is counted first) are broadcast
    as two 64-bit hashes; more meet the texts by those. Hashes that meet by chance only compare a text too many.
    """
    few = groups.select(F.xxhash64(key).alias("_k"), F.xxhash64(at).alias("_p"))
    few = F.broadcast(few) if few.count() <= most else few
    met = texts.withColumn("_k", F.xxhash64(key)).join(few, "_k")
    own = F.max(F.when(F.xxhash64(place) == F.col("_p"), F.col("text")))
    seen = met.groupBy(key).agg(F.min("text").alias("_a"), F.max("text").alias("_b"), own.alias("_c"))
    return seen.where((F.col("_a") == F.col("_c")) & (F.col("_b") == F.col("_c"))).select(key)
