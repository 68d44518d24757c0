"""Near-duplicate components by HyperMinHash (operator 7).

A document's set holds its distinct 5-word shingles (ASCII lower case, words between ASCII white
space). Documents are linked when ``100 * |A & B| >= 85 * |A | B|`` (the contract's :data:`CONTRACT`; the
pipeline's stage links from 80 on, :data:`STAGE`); components are the classes of the links.

1. **Sketch.** Every shingle's 64-bit hash falls into one of 128 buckets; a bucket keeps its least hash as
   a 16-bit register: leading-zero count (6 bits) and the 10 mantissa bits after the leading one. A
   bucket that no shingle hit borrows the register of the first hit bucket on its own fixed probe
   order, so short texts band like long ones.
2. **Collapse.** Documents with equal sets are one representative, found map-side first. Its number is its own; the
   smallest doc_id of its documents only finds its text and names its component.
3. **Band.** 25 bands of 5 registers; a pair at similarity 0.85 shares no band with probability 8e-7. For
   0.8 there are 27 bands of 4 registers, with probability (1 - .8 ** 4) ** 27 = 7e-7. A band's *hub* is its
   smallest representative; the other members are paired with the hub. Bands that very many share are broadcast to their
   members with their size.
4. **Estimate, then verify.** Pairs of registers that agree, less the collisions that sets of these sizes
   make by chance, estimate the similarity; pairs below ``prune`` (five standard deviations under the
   limit) go. The rest are confirmed on the full sets, which are built once for the documents that have a
   promising partner.
5. **Components** by alternating large-star and small-star steps, each written out.
6. **Nothing lost.** Members of one band that are still in different components met their hub only. All
   such pairs are compared as well, in blocks of ``BLOCK_ROWS`` a side that hold the full sets: the members
   outside of the band's largest component against all its members, so a family that its hub has joined costs
   nothing more and one with few strays is read a few times. A block gives the links that join its components, at
   most one fewer than its members, and never its pairs. The components are then formed again. Likewise only members
   that don't promise to be linked with the hub look for a partner among all (step 4).

Defined cases: null or empty text, or one without words, has an empty set, is linked with nothing and
is its own component; with fewer than 5 words the whole sequence is the one shingle; very long texts are read whole; a row with null
doc_id takes the component of the documents with its set, or null and stays; rows that repeat a
doc_id come back each, under the component of their own text, whose name another one may share where a
doc_id is the smallest of both; an empty table gives an empty result; extra columns are
ignored, and kept by :func:`drop_near_copies`, whatever their names. Ids of any type stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, fresh, join_by_group, saved, session, with_text
from .graph import components, sorted_groups
from .simhash import WordHashes, finish

SHINGLE = 5
BUCKETS = 128
MANTISSA = 10
BLOCK_ROWS = 256
PROBES = 256
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


@dataclass(frozen=True)
class Limit:
    """Least similarity of a link (``numerator / denominator``), its bands of ``rows`` registers and the least estimate."""

    numerator: int
    denominator: int
    bands: int
    rows: int
    prune: float


#: Five standard deviations of the estimate (sqrt(.85 * .15 / 128) = .032) under the limit.
CONTRACT = Limit(85, 100, 25, 5, 0.69)
#: Five standard deviations of the estimate at 0.8 (.045 for sets of few shingles, simulated) under the limit.
STAGE = Limit(80, 100, 27, 4, 0.57)


def shingles(text: str | None, words: WordHashes) -> np.ndarray:
    """The set of a text: ascending 64-bit hashes of its shingles."""
    hashes = words.of((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not len(hashes):
        return hashes
    width = min(SHINGLE, len(hashes))
    n = len(hashes) - width + 1
    x = np.full(n, width, np.uint64)
    for k in range(width):
        x = (x ^ hashes[k : k + n]) * FACTORS[k]
        x ^= x >> np.uint64(31)
    return np.unique(finish(x))


@cache
def probes() -> np.ndarray:
    """By bucket a fixed order of other buckets, each first choice uniform; all buckets occur."""
    draw = np.random.Generator(np.random.PCG64(20)).integers(0, BUCKETS, (BUCKETS, PROBES))
    rest = np.array([np.roll(np.arange(BUCKETS), -k) for k in range(BUCKETS)])
    return np.concatenate((draw, rest), 1)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The 128 registers of a non-empty set."""
    bucket = (hashes >> np.uint64(57)).astype(np.int64)
    rest = (hashes << np.uint64(7)) | np.uint64(127)
    # Ascending hashes: the first of each bucket is its least.
    first = np.concatenate(([True], bucket[1:] != bucket[:-1]))
    bucket, least = bucket[first], rest[first]
    top = least.astype(np.float64)
    zeros = np.minimum(63 - np.floor(np.log2(top)).astype(np.int64), 53)
    zeros += (least >> (np.uint64(63) - zeros.astype(np.uint64))) == 0
    tail = (least << zeros.astype(np.uint64)) << np.uint64(1)
    value = (zeros << MANTISSA) | (tail >> np.uint64(64 - MANTISSA)).astype(np.int64)
    out = np.zeros(BUCKETS, np.int64)
    hit = np.zeros(BUCKETS, bool)
    out[bucket], hit[bucket] = value, True
    if not hit.all():
        table = probes()[~hit]
        out[~hit] = out[table[np.arange(len(table)), hit[table].argmax(1)]]
    return out.astype(np.uint16)


def collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that registers of disjoint sets of n and m shingles agree: the sum over register values of the product
    of both sets' chances to have it. Sizes are rounded to eighths of a power of two and looked up."""
    steps = lambda x: np.minimum(np.round(8 * np.log2(np.maximum(x, 1))).astype(np.int64), 8 * 32)
    a, b = steps(n), steps(m)
    pairs, at = np.unique(np.stack((a, b), 1), axis=0, return_inverse=True)
    return np.array([(register_odds(int(x)) * register_odds(int(y))).sum() for x, y in pairs])[at.ravel()]


@cache
def register_odds(step: int) -> np.ndarray:
    """Chance of each register value for a set of 2 ** (step / 8) shingles dealt over the buckets."""
    zeros = np.arange(40)[:, None]
    cell = np.arange(2**MANTISSA)[None, :]
    low = 2.0 ** -(zeros + 1) * (1 + cell / 2**MANTISSA)
    high = low + 2.0 ** -(zeros + 1) / 2**MANTISSA
    each = max(1.0, 2 ** (step / 8) / BUCKETS)
    return ((1 - low) ** each - (1 - high) ** each).ravel()


def estimate(agree: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity from the share of agreeing registers, corrected for chance collisions."""
    chance = collisions(n, m)
    return (agree / BUCKETS - chance) / (1 - chance)


def matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, BUCKETS)


def key_of(items: bytes) -> bytes | None:
    """128-bit digest of a packed set; none of an empty one."""
    return hashlib.blake2b(items, digest_size=16).digest() if items else None


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit digest of the set), registers of every row."""

    def make():
        words = WordHashes()

        def work(texts: list[str | None]) -> dict[str, list]:
            sets = [shingles(t, words) for t in texts]
            return {
                "n_shingles": [len(s) for s in sets], "set_key": [key_of(s.tobytes()) for s in sets],
                "registers": [registers(s).tobytes() if len(s) else None for s in sets],
            }

        return work

    return with_text(docs.select("doc_id", "text"), "n_shingles bigint, set_key binary, registers binary", make)


def bands(reps: DataFrame, limit: Limit) -> DataFrame:
    """band (a key), k (its number), rep: the bands of each representative."""
    cut = [F.struct(F.lit(k).alias("k"), F.substring("registers", 2 * limit.rows * k + 1, 2 * limit.rows).alias("r")) for k in range(limit.bands)]
    keyed = F.array(*[F.struct(F.xxhash64(c).alias("band"), c["k"].alias("k")) for c in cut])
    return reps.select("rep", F.explode(keyed).alias("_b")).select("_b.band", "_b.k", "rep")


def in_blocks(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of a band dealt to pairs of blocks (i, j), sorted: its minor rows (``left``) of block i against all its rows of block j.

    ``rows`` has band, rep, minor, and the band's sizes n and n_minor. A band holds as many tasks as it needs, so one that
    many documents share never meets in one; without minor rows it has none, and with few its rows go out a few times.
    """
    blocks = lambda size: F.ceil(F.col(size) / BLOCK_ROWS).cast("int")
    rows = rows.where("n_minor > 0").withColumn("_l", blocks("n_minor")).withColumn("_r", blocks("n"))
    own = lambda size: F.pmod(F.xxhash64("rep"), F.col(size)).cast("int")
    numbers = lambda size: F.sequence(F.lit(0), F.col(size) - 1)
    to = lambda left, i, j: F.struct(F.lit(left).alias("left"), i.alias("i"), j.alias("j"))
    right = F.transform(numbers("_l"), lambda i: to(False, i, own("_r")))
    left = F.when(F.col("minor"), F.transform(numbers("_r"), lambda j: to(True, own("_l"), j))).otherwise(F.array().cast("array<struct<left:boolean,i:int,j:int>>"))
    rows = rows.withColumn("_to", F.explode(F.concat(right, left))).select("band", "_to.i", "_to.j", "_to.left", "rep", *columns)
    return rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")


def block_pairs(group: pd.DataFrame, registers_: np.ndarray, n: np.ndarray, limit: Limit, other=None) -> Iterator[tuple[int, np.ndarray]]:
    """(left row k, right rows that promise to be linked with it); ``other(k, rows)`` may leave some out first."""
    left, rep = group["left"].to_numpy(bool), group["rep"].to_numpy()
    right = np.flatnonzero(~left)
    for k in np.flatnonzero(left):
        at = right[rep[right] != rep[k]]
        at = at if other is None else at[other(k, at)]
        # Cheap bounds first: the sizes, then the registers that agree before chance is taken off.
        at = at[limit.denominator * np.minimum(n[at], n[k]) >= limit.numerator * np.maximum(n[at], n[k])]
        agree = (registers_[at] == registers_[k]).sum(1)
        near = agree >= limit.prune * BUCKETS
        at, agree = at[near], agree[near]
        if len(at):
            at = at[promising(agree, np.full(len(at), n[k]), n[at], limit)]
        if len(at):
            yield int(k), at


def promising(agree: np.ndarray, n: np.ndarray, m: np.ndarray, limit: Limit) -> np.ndarray:
    """Whether the corrected estimate and the set sizes leave the limit within reach."""
    return (estimate(agree, n, m) >= limit.prune) & (limit.denominator * np.minimum(n, m) >= limit.numerator * np.maximum(n, m))


def with_partner(multi: DataFrame, stars: DataFrame, reps: DataFrame, limit: Limit) -> DataFrame:
    """rep: those with a promising partner in one of their bands. ``stars`` are the promising pairs (a: the hub, b).

    A row that promises to be linked with its band's hub has its partner; only the others, the minor rows, look at all rows.
    """
    rows = multi.join(stars.select(F.col("a").alias("hub"), F.col("b").alias("rep"), F.lit(True).alias("_met")), ["hub", "rep"], "left")
    rows = rows.select("band", "n", "rep", (F.col("_met").isNull() & (F.col("rep") != F.col("hub"))).alias("minor"))
    # Of two rows the only pair has been looked at.
    size = rows.where("minor and n > 2").groupBy("band").agg(F.count(F.lit(1)).alias("n_minor"))
    rows = rows.join(size, "band").join(reps.select("rep", "registers", "n_shingles"), "rep")

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in sorted_groups(batches, ["band", "i", "j"]):
            hit = np.zeros(len(g), bool)
            for k, at in block_pairs(g, matrix(g["registers"]), g["n_shingles"].to_numpy(), limit):
                hit[at] = hit[k] = True
            if hit.any():
                yield pd.DataFrame({"rep": g["rep"].to_numpy()[hit]})

    looked = in_blocks(rows, "registers", "n_shingles").mapInPandas(pick, "rep bigint")
    return looked.unionByName(stars.select(F.explode(F.array("a", "b")).alias("rep"))).distinct()


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, items: the whole sets of the wanted representatives (rep, doc_id, set_key), packed."""

    def make():
        words = WordHashes()

        def work(texts: list[str | None]) -> dict[str, list]:
            items = [shingles(t, words).tobytes() for t in texts]
            return {"set_key": [key_of(x) for x in items], "items": items}

        return work

    texts = docs.select("doc_id", "text").join(wanted.select("doc_id"), "doc_id", "left_semi").select("text")
    # Rows that repeat a doc_id may hold other sets, so keys decide.
    found = with_text(texts, "set_key binary, items binary", make).dropDuplicates(["set_key"])
    return found.join(wanted.select("set_key", "rep"), "set_key").select("rep", "items")


def linked(x: bytes, y: bytes, limit: Limit) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return limit.denominator * both >= limit.numerator * (len(a) + len(b) - both)


def likely(pairs: DataFrame, reps: DataFrame, limit: Limit) -> DataFrame:
    """The pairs ``a, b`` whose registers promise enough."""
    regs = lambda side: reps.select(F.col("rep").alias(side), F.col("registers").alias(f"r{side}"), F.col("n_shingles").alias(f"n{side}"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                agree = (matrix(pdf["ra"]) == matrix(pdf["rb"])).sum(1)
                yield pdf.loc[promising(agree, pdf["na"].to_numpy(), pdf["nb"].to_numpy(), limit), ["a", "b"]]

    return pairs.join(regs("a"), "a").join(regs("b"), "b").mapInPandas(run, "a bigint, b bigint")


def confirmed(pairs: DataFrame, items: DataFrame, limit: Limit) -> DataFrame:
    """The pairs ``a, b`` that the full sets confirm."""
    side = lambda x: items.select(F.col("rep").alias(x), F.col("items").alias(f"s{x}"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [linked(x, y, limit) for x, y in zip(pdf["sa"], pdf["sb"], strict=True)]
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a bigint, b bigint")


def first_band(x: np.ndarray, ys: np.ndarray, rep: int, reps: np.ndarray, limit: Limit) -> np.ndarray:
    """The one of a pair's shared bands in which it is compared: the next after a band drawn from both ids."""
    n, rows = limit.bands, limit.rows
    same = (ys[:, : n * rows].reshape(-1, n, rows) == x[: n * rows].reshape(n, rows)).all(2)
    turn = (np.arange(n) + ((rep + reps) % n)[:, None]) % n
    return np.take_along_axis(turn, np.take_along_axis(same, turn, 1).argmax(1)[:, None], 1).ravel()


def joining(multi: DataFrame, reps: DataFrame, items: DataFrame, comps: DataFrame, limit: Limit) -> DataFrame:
    """Links (a, b) between different components of one band, enough of them to join all that are linked.

    Rows outside of the band's largest component are its minor rows: a pair of different components has at least one.
    """
    known = multi.select("band", "k", "rep").join(items.select("rep"), "rep", "left_semi").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("band", "k", "rep", F.coalesce("comp", "rep").alias("comp"))
    parts = known.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("m"))
    mixed = parts.groupBy("band").agg(F.sum("m").alias("n"), F.max(F.struct("m", "comp")).alias("top"), F.count(F.lit(1)).alias("c")).where("c > 1")
    mixed = mixed.select("band", "n", (F.col("n") - F.col("top.m")).alias("n_minor"), F.col("top.comp").alias("major"))
    rows = known.join(mixed, "band").withColumn("minor", F.col("comp") != F.col("major"))
    rows = rows.join(reps.select("rep", "registers", "n_shingles"), "rep").join(items, "rep")

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in sorted_groups(batches, ["band", "i", "j"]):
            reg, n, rep, items_, band = matrix(g["registers"]), g["n_shingles"].to_numpy(), g["rep"].to_numpy(), g["items"].tolist(), int(g["k"].iloc[0])
            comp = np.unique(g["comp"].to_numpy(), return_inverse=True)[1]
            out = []
            for k, at in block_pairs(g, reg, n, limit, lambda k, at: comp[at] != comp[k]):
                for other in at[first_band(reg[k], reg[at], rep[k], rep[at], limit) == band]:
                    if comp[other] != comp[k] and linked(items_[k], items_[other], limit):
                        out.append((min(rep[k], rep[other]), max(rep[k], rep[other])))
                        comp[comp == comp[other]] = comp[k]
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return in_blocks(rows, "k", "comp", "registers", "n_shingles", "items").mapInPandas(links, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, limit: Limit = CONTRACT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``."""
    session(docs.sparkSession)
    sketched = saved(sketch(docs), "sketches")
    total = sketched.count()
    # Rows of a set hold the same registers. Numbers are final once written.
    sets = sketched.where("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_docs"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("registers").alias("registers")
    )
    reps = saved(sets.where("doc_id is not null").select(F.monotonically_increasing_id().alias("rep"), "doc_id", "set_key", "n_docs", "n_shingles", "registers"), "representatives")

    banded = bands(reps, limit)
    hubs = saved(banded.groupBy("band").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"), "hubs")
    multi = saved(join_by_group(banded, hubs, "band", "n", limit.bands * total), "bands")
    stars = saved(likely(multi.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), reps, limit), "stars")
    wanted = with_partner(multi, stars, reps, limit).join(reps.select("rep", "doc_id", "set_key"), "rep")
    items = saved(full_sets(docs, saved(wanted, "wanted")), "sets")
    comps = components(confirmed(stars, items, limit))
    more = saved(joining(multi, reps, items, comps, limit), "links")
    if not more.isEmpty():
        before, comps = comps, components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more))
        discard(before)
    discard(hubs, multi, stars, items, more)
    # A component's least node stands on the right only.
    members = comps.select(F.col("node").alias("rep"), "comp").unionByName(comps.select(F.col("comp").alias("rep"), "comp")).distinct().join(reps.select("rep", "doc_id"), "rep")
    named = members.select("rep", "comp").join(members.groupBy("comp").agg(F.min("doc_id").alias("name")), "comp").select("rep", "name")
    found = saved(reps.join(named, "rep", "left").select("set_key", F.coalesce("name", "doc_id").alias("comp"), "n_docs"), "components")
    # Rows without a set meet nobody; the rows of very common sets don't meet in one task.
    rows = sketched.select("doc_id", "n_shingles", "set_key")
    alone = rows.where("set_key is null").withColumn("comp", F.col("doc_id"))
    some = join_by_group(rows.where("set_key is not null"), found, "set_key", "n_docs", total, "left").select(*rows.columns, "comp")
    comp = F.coalesce("comp", "doc_id")
    return some.unionByName(alone).select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, comp.isNull()).alias("kept"))


def drop_near_copies(docs: DataFrame, limit: Limit = STAGE) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component, with its columns."""
    key = fresh("_id", docs)
    kept = near_duplicates(docs, limit).where("kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept[key]), "left_semi").select(*[docs["`" + c.replace("`", "``") + "`"] for c in docs.columns])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), CONTRACT)


#: Shingles as text; pairs by the shingles that they share; components by reaching smaller doc_ids until nothing changes.
OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1:k + 5], ' ') AS x FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b USING (x) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * both_ >= 85 * (p.n + q.n - both_)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS top FROM e UNION SELECT e.b, r.top FROM r JOIN e ON e.a = r.doc_id WHERE r.top < e.b),
c AS (SELECT doc_id, min(top) AS top FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(top, doc_id) AS component_id, coalesce(top, doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
