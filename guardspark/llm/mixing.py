"""Mixing sources to target weights by a time-varying curriculum (operator 9). DataFrame and SQL only.

* **Targets.** Sources in code-point order (null last) weigh 5, 2, 1, repeating; together they share
  ``SHARE`` of all words. A target stops at ``REPEAT`` times its source's words and the excess is
  shared again by weight: the level ``x`` with ``sum(min(cap, x * weight)) = total`` is found in closed form
  over the sources sorted by ``cap / weight``.
* **Curriculum.** Source s draws at the rate ``1 + slope * (2t - 1)`` of its mean over training time t
  in [0, 1]; heavy sources fade (slope < 0) and light ones grow. The integral of the schedule times
  the target is the cumulative token demand ``D(t)``. A document lies at ``c`` in its source's stream, so
  its training position is the inverse ``D(t) = c``, a quadratic solved in closed form. Documents come
  out range-sorted by position.
* **Stream order.** By md5 of the doc_id, so reruns agree. The stream passes over the source up to
  ``REPEAT`` times and stops at the target; ``taken`` is what falls before the stop.

A source may hold a third of all rows, so running sums never put one source in one task: md5 order is
cut into buckets of about ``BUCKET_ROWS`` rows a source, totals of buckets and of blocks of buckets are summed
first and rows only inside their bucket.

Defined cases: null text has size 0; a null source is a source, the last; a null doc_id counts as an empty one in the
stream's order; a source with no words has target 0; an empty table gives an empty result; rows that repeat a
doc_id are ordered by size and then by place in the files; very long texts count whole; extra columns are
ignored by the query and kept by :func:`mixed_documents`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, documents, fresh, located, saved

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEAT = 2
#: Slope of the draw rate over training time, by weight class.
SLOPES = (-0.5, 0.0, 0.5)
BUCKET_ROWS = 4096
WORDS = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, n_rows, source_size`` to these with ``weight, slope, target``: one row a source."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(F.col("rank"), F.lit(len(values))) + 1).cast("int"))
    t = sizes.withColumn("rank", rank).withColumn("weight", pick(WEIGHTS)).withColumn("slope", pick(SLOPES))
    t = t.withColumn("cap", F.lit(float(REPEAT)) * F.col("source_size"))
    up = W.orderBy(F.col("cap") / F.col("weight"), F.col("rank")).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    t = t.withColumn("total", F.lit(SHARE) * F.sum("source_size").over(every))
    left = F.col("total") - F.coalesce(F.sum("cap").over(up), F.lit(0.0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up), F.lit(0.0))
    # The level if this source and all with a higher cap for their weight were free to grow.
    t = t.withColumn("level", left / weights)
    t = t.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level").alias("x")))).over(every)["x"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return t.select("source", "n_rows", "source_size", "weight", "slope", target.alias("target"))


def position(share: Column, slope: Column) -> Column:
    """Training time at which a source has drawn ``share`` of its target: the inverse of (1-k)t + kt²."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    return F.when(slope == 0, share).otherwise((root - (1 - slope)) / (2 * slope))


def before_it(rows: DataFrame, within: list[str], by: str, value: str, into: str) -> DataFrame:
    """``rows`` (one a ``within`` and ``by``) with the sum of ``value`` over the lesser ``by`` of the same ``within``."""
    upto = W.partitionBy(*within).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(into, F.coalesce(F.sum(value).over(upto), F.lit(0)))


def mix(docs: DataFrame, name: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source, source_size, target, taken, starts, positions.

    ``first_at`` is the training position of the first reading, ``again_at`` that of the second; each is
    null where the stream stops before the document. ``name`` (of a row) comes back as ``row``, and ``order`` is the
    md5 that the stream goes by. Texts are read once: what the mix needs of them is written as a narrow table.
    """
    unnamed = F.lit(None).cast("string")
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), (unnamed if name is None else name).alias("row"))
    rows = saved(rows.withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))), "mix-sizes")
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    targets = saved(source_targets(sizes), "mix-targets")
    # Joined by a key that is never null; one row a source.
    rows, targets = rows.withColumn("key", F.to_json(F.struct("source"))), targets.withColumn("key", F.to_json(F.struct("source")))
    buckets = F.ceil(F.col("n_rows") / BUCKET_ROWS)
    unit = F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / float(2**32)
    # Dealt by source and bucket: the join's own deal by source alone would otherwise serve the window below,
    # and a large source would meet in one task.
    rows = rows.join(targets.drop("source"), "key").withColumn("bucket", F.floor(unit * buckets)).repartition("key", "bucket")
    # Totals of buckets, then of blocks of as many buckets: no running sum is over more than BUCKET_ROWS rows, but that over
    # a source's blocks, of BUCKET_ROWS squared rows each.
    totals = rows.groupBy("key", "bucket").agg(F.sum("size").alias("in_bucket")).withColumn("block", F.floor(F.col("bucket") / BUCKET_ROWS))
    blocks = before_it(totals.groupBy("key", "block").agg(F.sum("in_bucket").alias("in_block")), ["key"], "block", "in_block", "before_block")
    inside = before_it(totals, ["key", "block"], "bucket", "in_bucket", "before_bucket")
    base = inside.join(blocks.select("key", "block", "before_block"), ["key", "block"]).select("key", "bucket", (F.col("before_block") + F.col("before_bucket")).alias("base"))
    upto = W.partitionBy("key", "bucket").orderBy("order", "size", "row").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(upto), F.lit(0))).join(base, ["key", "bucket"])
    rows = rows.withColumn("start", F.col("base") + F.col("inner"))
    stop = F.round("target").cast("long")
    part = lambda begin: F.greatest(F.lit(0), F.least(stop - begin, F.col("size")))
    again = F.col("source_size") + F.col("start")
    at = lambda begin: F.when((begin < stop) & (F.col("target") > 0), position(F.least(F.lit(1.0), begin / F.col("target")), F.col("slope")))
    return rows.select(
        "doc_id", "row", "order", "source", "size", "source_size", "target", (part(F.col("start")) + part(again)).cast("long").alias("taken"),
        at(F.col("start")).alias("first_at"), at(again).alias("again_at"),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix reads them, range-sorted by training position: a document appears once, twice or
    not at all. Readings that begin before the target's end are whole, so a source exceeds its target by
    less than one document. Rows that repeat a doc_id are rows of their own, each with its readings.

    A table that is written and read again needn't come in this order; ``common.as_written`` brings it back.
    """
    names = docs.columns
    docs, place = located(docs)
    row, at, order = (fresh(n, docs) for n in ("_row_", "_at", "_order"))
    plan = mix(docs, place).where("first_at is not null").select(F.col("row").alias(row), F.col("order").alias(order), F.explode(F.array_compact(F.array("first_at", "again_at"))).alias(at))
    out = docs.select(*[column(c) for c in names], place.alias(row)).join(plan, row).orderBy(at, order)
    return out.select(*[column(c) for c in names])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir))
    values = (F.round("target", 6).alias("target"), "taken", F.round("first_at", 9).alias("first_at"), F.round("again_at", 9).alias("again_at"))
    # Documents that are not read have no position: the order of the stream spreads them over the ranges.
    return mixed.select("doc_id", "size", "source_size", *values, "order").orderBy("first_at", "order").drop("order")


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(r % 3 + 1)::INT] AS weight, [-0.5::DOUBLE, 0.0, 0.5][(r % 3 + 1)::INT] AS k, 2.0::DOUBLE * source_size AS cap FROM s),
fill AS (
  SELECT 0 AS i, r, weight, cap, false AS full_, (SELECT 1.5::DOUBLE * sum(source_size) FROM s) * weight / sum(weight) OVER () AS share FROM w
  UNION ALL
  SELECT i + 1, r, weight, cap, full_ OR share >= cap,
    CASE WHEN full_ OR share >= cap THEN cap
         ELSE ((SELECT 1.5::DOUBLE * sum(source_size) FROM s) - coalesce(sum(cap) FILTER (WHERE full_ OR share >= cap) OVER (), 0))
              * weight / sum(weight) FILTER (WHERE NOT (full_ OR share >= cap)) OVER () END
  FROM fill WHERE i < (SELECT count(*) FROM s)),
t AS (SELECT w.*, f.share AS target FROM w JOIN fill f USING (r) WHERE f.i = (SELECT count(*) FROM s)),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.k, round(t.target)::BIGINT AS stop,
    (coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, greatest(0, least(stop - b, size)) + greatest(0, least(stop - b - source_size, size)) AS taken,
  CASE WHEN b < stop THEN least(1.0, b / target) END AS x, CASE WHEN b + source_size < stop THEN least(1.0, (b + source_size) / target) END AS y FROM c)
SELECT doc_id, size, source_size, round(target, 6) AS target, taken::BIGINT AS taken,
  round(CASE WHEN k = 0 THEN x ELSE (sqrt((1 - k) * (1 - k) + 4 * k * x) - (1 - k)) / (2 * k) END, 9) AS first_at,
  round(CASE WHEN k = 0 THEN y ELSE (sqrt((1 - k) * (1 - k) + 4 * k * y) - (1 - k)) / (2 * k) END, 9) AS again_at
FROM p
"""
