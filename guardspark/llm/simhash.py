"""SimHash document fingerprints (operator 6).

A text's terms are its runs of ``SHINGLE`` white-space words (ASCII case folded; the whole sequence if
it is shorter). Each distinct term has a 128-bit hash and the weight ``1 + ln(count)``; every hash bit
votes with the weight's sign and the signs of the sums are the fingerprint. Two fingerprints at
Hamming distance h estimate the cosine of the weighted term vectors as ``cos(pi * h / 128)``, which is
the likeness (0 if negative).

**Search.** :func:`with_classes` finds all fingerprints within a Hamming radius r of one another: the
128 bits are cut into r + 2 blocks; two fingerprints within r agree on at least two blocks, so each
table permutes one pair of blocks to the front, and fingerprints that share a table's front are
compared in full. Equal fingerprints are one row with their documents counted. Fronts shared by more
than ``BLOCK_ROWS`` fingerprints are compared block against block in separate tasks. What comes out is each fingerprint's
number of documents within the radius (a pair counts in its first common table) and links that join, never pairs: they give the
class that steps within the radius join, and its size.

**The next document.** Documents are range-partitioned and sorted by doc_id; each task keeps one text
back, so only the last text of a partition needs a text from elsewhere: the first of the next
partition with rows, joined by partition number.

Defined cases: null text is empty; an empty text has the fingerprint of zeros and its likeness to
another empty text is 1, to any other text 0; a null doc_id comes first; rows that repeat a doc_id
come in the order of their texts; an empty table gives an empty result; a single row is its own next
document; ids stay as they are; very long texts are read whole, their terms voting a slice at a time; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import discard, documents, join_by_group, saved, session, with_text
from .graph import components, sorted_groups

BITS = 128
SHINGLE = 3
RADIUS = 6
#: Fingerprints of 16 bytes in a block, and terms whose votes are counted at once.
BLOCK_ROWS, VOTERS = 16384, 16384
#: Pairs that are compared at once.
TILE = 1 << 20
#: Words in a worker's cache, and the longest that it keeps.
CACHE_WORDS, CACHED_LENGTH = 400_000, 64
EMPTY = "0" * (BITS // 4)
LIKENESS = [max(0.0, math.cos(math.pi * h / BITS)) for h in range(BITS + 1)]
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class WordHashes(dict):
    """64-bit hashes of words, bounded."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[3]
    x = (x ^ (x >> np.uint64(27))) * MIX[4]
    return x ^ (x >> np.uint64(31))


def votes(hashes: np.ndarray) -> str:
    """Fingerprint of a text from the hashes of its words."""
    if not len(hashes):
        return EMPTY
    n = max(1, len(hashes) - SHINGLE + 1)
    term = np.full(n, len(hashes) if len(hashes) < SHINGLE else SHINGLE, np.uint64)
    for k in range(min(SHINGLE, len(hashes))):
        term = (term ^ hashes[k : k + n]) * MIX[k % 3] + MIX[(k + 1) % 3]
        term ^= term >> np.uint64(29)
    term, count = np.unique(term, return_counts=True)
    ones, total = np.zeros(BITS), 0.0
    # A slice of the terms at a time: their bits take 640 bytes a term. Equal terms give the same sums in the same order.
    for at in range(0, len(term), VOTERS):
        part = term[at : at + VOTERS]
        bits = np.unpackbits(np.stack((finish(part), finish(part ^ MIX[2])), 1).view(np.uint8), axis=1)
        weight = (1 + np.log(count[at : at + VOTERS])).astype(np.float32)
        ones += weight @ bits.astype(np.float32)
        total += float(weight.sum())
    # One bits vote +weight, zero bits -weight.
    return np.packbits(2 * ones > total).tobytes().hex()


def fingerprint(text: str, cache: WordHashes) -> str:
    return votes(cache.of(text.encode("utf-8", "surrogatepass").lower().split()))


def likeness(a: str, b: str) -> float:
    if EMPTY in (a, b):
        return float(a == b)
    return LIKENESS[(int(a, 16) ^ int(b, 16)).bit_count()]


def edited(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


FIELDS = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def compare(text: str, own: str, following: str, other: str, cache: WordHashes) -> tuple:
    new = edited(text, following)
    mark = fingerprint(new, cache)
    return len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own, mark, likeness(own, mark), likeness(own, other)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``FIELDS``."""
    spark = session(docs.sparkSession)
    ordered = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    walked_type = StructType([*StructType.fromDDL("kind string, part int").fields, docs.schema["doc_id"], *StructType.fromDDL(f"text string, {FIELDS}").fields])
    shape = to_arrow_schema(walked_type)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, cache, held = TaskContext.get().partitionId(), WordHashes(), None
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mark = fingerprint(text, cache)
                if held is None:
                    out.append(("head", part, i, text, *[None] * len(NAMES)))
                else:
                    out.append(("row", part, held[0], None, *compare(held[1], held[2], text, mark, cache)))
                held = i, text, mark
            yield table(out)
        if held is not None:
            yield table([("tail", part, held[0], held[1], *[None] * len(NAMES))])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(shape)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    walked = saved(ordered.mapInArrow(walk, walked_type), "fingerprints")
    # The part after each part, the first after the last: numbers alone, one a partition.
    parts = walked.where("kind = 'head'").select("part")
    following = parts.select("part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy())).alias("next_part"))
    heads = walked.where("kind = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    tails = walked.where("kind = 'tail'").select("part", "doc_id", "text").join(following, "part").join(heads, "next_part")

    def make():
        cache = WordHashes()

        def close(pairs: list[dict]) -> dict[str, list]:
            found = [compare(p["text"], fingerprint(p["text"], cache), p["following"], fingerprint(p["following"], cache), cache) for p in pairs]
            return dict(zip(NAMES, zip(*found, strict=True), strict=True)) if found else {n: [] for n in NAMES}

        return close

    ends = with_text(tails.select("doc_id", F.struct("text", "following").alias("pair")), FIELDS, make, text="pair")
    return walked.where("kind = 'row'").select("doc_id", *NAMES).unionByName(saved(ends, "fingerprint-ends"))


def block_bounds(radius: int) -> list[tuple[int, int]]:
    """``radius + 2`` blocks of hex digits (from, to)."""
    edges = [round(k * BITS / 4 / (radius + 2)) for k in range(radius + 3)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def near_marks(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Of the distinct fingerprints ``mark`` (a number), ``fingerprint``, ``n_docs``: mark, near, a, b.

    Rows with ``mark`` say that ``near`` more documents have a fingerprint within ``radius``; they add up. Rows with ``a`` and ``b`` are
    links, enough of them to join all that are within ``radius``: a group of n fingerprints gives n - 1 at most and never its pairs.
    """
    bounds = block_bounds(radius)
    tables = list(combinations(range(len(bounds)), 2))
    block = [F.substring("fingerprint", a + 1, b - a) for a, b in bounds]
    fronts = F.array(*[F.struct(F.xxhash64(F.lit(t), block[x], block[y]).alias("front"), F.lit(t).alias("table")) for t, (x, y) in enumerate(tables)])
    rows = marks.select("mark", "n_docs", F.unhex("fingerprint").alias("bits"), F.explode(fronts).alias("_f")).select("_f.front", "_f.table", "mark", "n_docs", "bits")
    shared = rows.groupBy("front").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = join_by_group(rows, shared, "front", "n", marks.count() * len(tables)).withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("mark"), F.col("blocks")).cast("int"))
    # Block pairs (i, j), i <= j: each fingerprint goes to every pair that has its block.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("front", "table", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "mark", "n_docs", "bits")
    keys = ["front", "table", "i", "j"]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in sorted_groups(batches, keys):
            raw = np.frombuffer(b"".join(g["bits"]), ">u8").astype(np.uint64).reshape(-1, BITS // 64)
            own, mark, weight, cross = g["own"].to_numpy(), g["mark"].to_numpy(), g["n_docs"].to_numpy(), g["i"].iloc[0] != g["j"].iloc[0]
            near = neighbours(raw, weight, own if cross else None, tables[g["table"].iloc[0]], bounds, radius)
            hit = np.flatnonzero(near)
            if len(hit):
                none = [None] * len(hit)
                yield pd.DataFrame({"mark": mark[hit], "near": near[hit], "a": none, "b": none}).astype("Int64")
            links = joins(raw, own, cross, radius)
            if links:
                a, b = np.array(links).T
                none = [None] * len(links)
                yield pd.DataFrame({"mark": none, "near": none, "a": mark[a], "b": mark[b]}).astype("Int64")

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(look, "mark bigint, near bigint, a bigint, b bigint")


def neighbours(raw: np.ndarray, weight: np.ndarray, own: np.ndarray | None, table: tuple[int, int], bounds: list[tuple[int, int]], radius: int) -> np.ndarray:
    """By row: the weight of the rows within ``radius``, of the other block only if ``own`` names two.

    A pair counts in the first table that it shares alone: that of the first two blocks in which it agrees.
    """
    x, y = table
    parts = []
    for z in (z for z in range(y) if z != x):
        mask = ((1 << 4 * (bounds[z][1] - bounds[z][0])) - 1) << (BITS - 4 * bounds[z][1])
        masked = raw & np.array([mask >> 64, mask & (2**64 - 1)], np.uint64)
        parts.append(np.unique(masked, axis=0, return_inverse=True)[1].ravel().astype(np.int32))
    left = np.arange(len(raw)) if own is None else np.flatnonzero(own == own.min())
    right = left if own is None else np.flatnonzero(own != own.min())
    near, weight = np.zeros(len(raw)), weight.astype(np.float64)
    step = max(1, TILE // max(1, len(right)))
    for at in range(0, len(left), step):
        p = left[at : at + step]
        apart = np.bitwise_count(raw[p, :1] ^ raw[right, 0]) + np.bitwise_count(raw[p, 1:] ^ raw[right, 1])
        hit = apart <= radius
        if own is None:
            hit[np.arange(len(p)), p] = False
        if hit.any():
            for part in parts:
                hit &= part[p, None] != part[right]
            near[p] += hit @ weight[right]
            if own is not None:
                near[right] += weight[p] @ hit
    return near.astype(np.int64)


def joins(raw: np.ndarray, own: np.ndarray, cross: bool, radius: int) -> list[tuple[int, int]]:
    """Pairs of rows within ``radius`` that join all such rows; across two blocks only pairs of both, if ``cross``."""
    part, parts, links = np.arange(len(raw)), len(raw), []
    for k in range(len(raw) - 1):
        if parts == 1:
            break
        at = np.flatnonzero(part[k + 1 :] != part[k]) + k + 1
        at = at[own[at] != own[k]] if cross else at
        at = at[np.bitwise_count(raw[at] ^ raw[k]).sum(1) <= radius]
        # One row of each part that is near.
        near, first = np.unique(part[at], return_index=True)
        if len(near):
            links += [(k, int(x)) for x in at[first]]
            part[np.isin(part, near)] = part[k]
            parts -= len(near)
    return links


def with_classes(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``rows`` (doc_id and fingerprint, of a scan) with near_class, class_size and n_near.

    ``n_near`` is the number of other rows whose fingerprint is within ``radius``. ``near_class`` is the smallest doc_id that can be reached from
    fingerprint to fingerprint in such steps, ``class_size`` the number of its rows. Texts without words have a class of their own.
    """
    session(rows.sparkSession)
    marks = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_docs"))
    marks = saved(marks.select(F.monotonically_increasing_id().alias("mark"), "fingerprint", "first", "n_docs"), "marks")
    found = saved(near_marks(marks.where(F.col("fingerprint") != EMPTY), radius), "near-marks")
    counts = found.where("mark is not null").groupBy("mark").agg(F.sum("near").alias("near"))
    comps = components(found.where("a is not null").select("a", "b"))
    # A class's least mark stands on the right only.
    members = comps.select(F.col("node").alias("mark"), "comp").unionByName(comps.select(F.col("comp").alias("mark"), "comp")).distinct()
    named = members.join(marks.select("mark", "first", "n_docs"), "mark")
    named = members.join(named.groupBy("comp").agg(F.min("first").alias("name"), F.sum("n_docs").alias("size")), "comp").select("mark", "name", "size")
    whole = marks.join(named, "mark", "left").join(counts, "mark", "left")
    n_near = F.coalesce("near", F.lit(0)) + F.col("n_docs") - 1
    whole = whole.select("fingerprint", "n_docs", F.coalesce("name", "first").alias("near_class"), F.coalesce("size", "n_docs").alias("class_size"), n_near.alias("n_near"))
    whole = saved(whole, "classes")
    discard(found, comps, marks)
    return join_by_group(rows, whole, "fingerprint", "n_docs", rows.count()).select(*rows.columns, "near_class", "class_size", "n_near")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_classes(fingerprints(documents(spark, sf_dir)))
