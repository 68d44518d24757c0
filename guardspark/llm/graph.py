"""Connected components by rounds of joins, and runs of sorted rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def components(links: DataFrame) -> DataFrame:
    """node, comp: the least node reachable from each node of ``links`` (a, b), by alternating stars."""
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        # Large star: every greater neighbour of u, on either side, goes to u's least neighbour (or u).
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its lesser neighbours go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, edges = edges, saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(before)
        now = edges.agg(F.count(F.lit(1)), F.sum("v"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
            out._saved_at = edges._saved_at
            return out
        state = now


def sorted_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of rows that are sorted by ``keys`` (no nulls), across batch borders."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[keys].to_numpy()
        if held and (held[-1][keys].to_numpy()[-1] != k[0]).any():
            yield pd.concat(held, ignore_index=True)
            held = []
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
            if a and held:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(pdf.iloc[a:b])
    if held:
        yield pd.concat(held, ignore_index=True)
