"""Which texts to have labelled: a weighted reservoir of the most uncertain ones.

A row draws the key ``ln(u) / w`` from its id (``u`` in (0, 1) by hash, ``w`` its uncertainty); the ``k`` greatest keys of a stratum are a
weighted sample without replacement. The greatest of parts contain the greatest of all, so reservoirs are merged by taking the greatest
again: each task keeps ``k`` rows a stratum before anything is shuffled, nothing is sorted globally and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def entropy(p: Column) -> Column:
    """Uncertainty of a score from 0 to 1, in nats."""
    part = lambda x: F.when(x > 0, -x * F.log(x)).otherwise(0.0)
    return part(p) + part(1 - p)


def margin(p: Column) -> Column:
    """1 where a score can't decide, 0 where it is sure."""
    return 1 - F.abs(2 * p - 1)


def unit(identity: Column, seed: int) -> Column:
    """A number in (0, 1) by hash."""
    digits = F.substring(F.md5(F.concat(F.coalesce(identity.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def with_keys(df: DataFrame, identity: str, weight: Column, seed: int = 0) -> DataFrame:
    """``df`` with ``reservoir_key``; rows that weigh nothing, or have no weight, are out."""
    df = df.withColumn("_w", weight).where("_w > 0")
    return df.withColumn("reservoir_key", F.log(unit(F.col(identity), seed)) / F.col("_w")).drop("_w")


def reservoir(keyed: DataFrame, k: int, identity: str, *strata: str) -> DataFrame:
    """The ``k`` rows of each stratum with the greatest keys, and their ``rank``. Reservoirs united and taken again give the reservoir of all."""
    order = W.partitionBy(*strata).orderBy(F.desc("reservoir_key"), identity)
    return keyed.drop("rank").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
