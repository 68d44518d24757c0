"""Merkle trees over audit chains: one root a chain, proofs that an event is in it, and the place where a chain was changed.

A chain's events are numbered in ``seq`` order. Leaves and inner nodes are hashed under different marks; an odd last node moves up as it is.
``HEIGHT`` levels are built at once inside a row, from a block of at most 2^HEIGHT nodes, so a chain of n events needs one shuffle for every
factor of 2^HEIGHT and no task ever holds a chain. The blocks are a table: a proof reads one of each height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from guardspark.streaming.stateful import work_dir

HEIGHT = 10
STEPS = "array<struct<left: boolean, hash: string>>"


def saved(df: DataFrame, name: str) -> DataFrame:
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(events: DataFrame) -> DataFrame:
    """chain, seq, hash and ``leaf``: the event's number in its chain, from 0. Ranges of (chain, seq) are numbered side by side, then shifted."""
    rows = events.select("chain", "seq", "hash").repartitionByRange("chain", "seq").sortWithinPartitions("chain", "seq")
    rows = saved(rows.withColumn("_at", F.monotonically_increasing_id()), "leaves").withColumn("_part", F.shiftright("_at", 33))
    # A row a range and chain: what stands before it in its chain.
    runs = rows.groupBy("chain", "_part").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("chain").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("chain").alias("_chain"), "_part", "_from", before.alias("_before"))
    rows = rows.join(F.broadcast(runs) if runs.count() <= 1_000_000 else runs, (F.col("chain").eqNullSafe(F.col("_chain"))) & (rows["_part"] == runs["_part"]))
    return rows.select("chain", "seq", "hash", (F.col("_at") - F.col("_from") + F.col("_before")).alias("leaf"))


def leaf_hash(h: Column) -> Column:
    return F.sha2(F.concat(F.lit("leaf:"), F.coalesce(h, F.lit(""))), 256)


def node_hash(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.lit("node:"), left, F.lit(":"), right), 256)


def above(nodes: Column) -> Column:
    """The next level of a row of nodes."""
    pair = lambda k: F.when(2 * k + 1 < F.size(nodes), node_hash(F.get(nodes, 2 * k), F.get(nodes, 2 * k + 1))).otherwise(F.get(nodes, 2 * k))
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(nodes) / 2).cast("int") - 1), pair)


def trees(events: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """chain, height, block, levels: the nodes of each block, lowest level first; its last level is one node of the next height. ``leaves``: the events as :func:`numbered` before."""
    nodes = (numbered(events) if leaves is None else leaves).select("chain", F.col("leaf").alias("node"), leaf_hash(F.col("hash")).alias("hash"))
    done, height = None, 0
    while True:
        blocks = nodes.groupBy("chain", F.shiftright("node", HEIGHT).alias("block")).agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("nodes"))
        lowest = F.transform("nodes", lambda x: x["hash"])
        levels = F.aggregate(F.sequence(F.lit(1), F.lit(HEIGHT)), F.array(lowest), lambda acc, _: F.concat(acc, F.array(above(F.element_at(acc, -1)))))
        part = saved(blocks.select("chain", F.lit(height).alias("height"), "block", levels.alias("levels")), "merkle")
        done = part if done is None else done.unionByName(part)
        if not part.where("block > 0").limit(1).count():
            return done
        nodes = part.select("chain", F.col("block").alias("node"), F.get(F.element_at("levels", -1), F.lit(0)).alias("hash"))
        height += HEIGHT


def roots(built: DataFrame) -> DataFrame:
    """chain, root: the last level of the block at each chain's top."""
    return built.where("block = 0").groupBy("chain").agg(F.max_by(F.get(F.element_at("levels", -1), F.lit(0)), "height").alias("root"))


def proofs(built: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (chain, leaf, ...) with ``steps``: the sibling at each level, and whether it stands to the left. A node that moved up has none.

    A block's leaves meet it as one row and go up to its top side by side, as a row a leaf would carry the whole block; the steps from there on are those
    of the block, found the same way among the blocks.
    """
    top = built.agg(F.max("height")).first()[0] or 0
    return climbed(built, wanted, "leaf", 0, top)


def climbed(built: DataFrame, wanted: DataFrame, node: str, height: int, top: int) -> DataFrame:
    """``wanted`` with the steps of its nodes of ``height``."""
    names = wanted.columns
    rows = wanted.withColumn("_block", F.shiftright(node, HEIGHT)).groupBy("chain", "_block").agg(F.collect_list(F.struct(*names)).alias("_rows"))
    blocks = built.where(F.col("height") == height).select("chain", F.col("block").alias("_block"), "levels")
    if height < top:
        higher = climbed(built, rows.select("chain", F.col("_block").alias("_node")), "_node", height + HEIGHT, top)
        blocks = blocks.join(higher.select("chain", F.col("_node").alias("_block"), F.col("steps").alias("_above")), ["chain", "_block"])
    else:
        blocks = blocks.withColumn("_above", F.array().cast(STEPS))
    own = lambda at: F.array_compact(F.array(*[sibling(F.shiftright(at, k), k) for k in range(HEIGHT)]))
    steps = lambda r: F.concat(F.coalesce(own((r[node] % (1 << HEIGHT)).cast("int")), F.array().cast(STEPS)), F.coalesce("_above", F.array().cast(STEPS)))
    found = F.transform("_rows", lambda r: F.struct(*[r[n].alias(n) for n in names], steps(r).alias("steps")))
    return rows.join(blocks, ["chain", "_block"], "left").select(F.inline(found))


def sibling(at: Column, level: int) -> Column:
    """The node beside node ``at`` of a block's level, null if it has none."""
    left = at % 2 == 1
    hash_ = F.get(F.get("levels", F.lit(level)), F.when(left, at - 1).otherwise(at + 1))
    return F.when(hash_.isNotNull(), F.struct(left.alias("left"), hash_.alias("hash")))


def proven(event_hash: Column, steps: Column, root: Column) -> Column:
    """Whether the steps lead from the event's hash to the root."""
    up = lambda h, s: F.when(s["left"], node_hash(s["hash"], h)).otherwise(node_hash(h, s["hash"]))
    return F.aggregate(steps, leaf_hash(event_hash), up) == root
