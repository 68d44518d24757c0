"""Product codes of vectors by exact k-means with a kd-tree a codebook (operator 13).

Vectors become integers ``floor(1024 * x)`` and are cut into ``PARTS`` consecutive parts. Each part has a codebook of
``ENTRIES`` entries that starts as that part of the vectors with the smallest ids.

1. **Broadcast.** Every round a kd-tree of each codebook is broadcast: at most ``PARTS * ENTRIES`` entries, however many
   vectors there are.
2. **Search.** A task walks a batch of parts through the tree at once, the nearer child first. A node is skipped only where its
   box is further away than the best entry so far; one just as far is visited, as it may hold a lower index at the same
   distance. All distances are integers, so ties are exact.
3. **Update.** Each task sums the integer components of the parts that fell to each entry; the sums of all tasks are added by
   Spark (part, entry, position) and only they reach the driver, which divides them down. An unused entry stays.

Sums travel as ``LIMBS`` of 32 bits each, so they are exact at any number of vectors. Components so large that squared distances
don't fit 64 bits are computed with Python's integers by the same code.

Defined cases: a vector that is null or holds null or non-finite components is dropped; fewer than ``ENTRIES`` vectors give as many
entries; no vectors give no rows. All vectors count as long as the longest, rounded up to a multiple of ``PARTS``: shorter ones, the empty
one too, end in zeros. Rows that repeat a vec_id are rows of their own; among the first vectors they are ordered by their components, and a null
vec_id comes last. Null labels are one label. ``error`` and ``label_error`` stop at 2^63 - 1. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import join_by_group, saved, session

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Entries in a leaf of the tree.
LEAF = 8
#: Bits of a limb, and the greatest component (after scaling) of the 64-bit path: a squared distance of 2^15 such positions fits.
LIMB_BITS, NARROW = 32, 1 << 22
MOST = (1 << 63) - 1


@dataclass
class Node:
    """Box (``low``, ``high``) of the entries below; a leaf has ``entries``, another node two children."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray | None = None
    left: Node | None = None
    right: Node | None = None


class KdTree:
    """Nearest entries of a codebook (rows of integers), ties to the lower index."""

    def __init__(self, book: np.ndarray) -> None:
        self.book = book
        self.root = self.grow(np.arange(len(book)))

    def grow(self, at: np.ndarray) -> Node:
        rows = self.book[at]
        node = Node(rows.min(0), rows.max(0))
        if len(at) <= LEAF:
            # In the order of indices: the first of equal distances is the lowest.
            node.entries = np.sort(at)
            return node
        axis = int(np.argmax(node.high - node.low))
        order = at[np.argsort(rows[:, axis], kind="stable")]
        node.left, node.right = self.grow(order[: len(order) // 2]), self.grow(order[len(order) // 2 :])
        return node

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, and its squared distance."""
        best = np.full(len(parts), len(self.book), np.int64)
        least = np.full(len(parts), -1, parts.dtype)
        self.visit(self.root, parts, np.arange(len(parts)), best, least)
        return best, least

    def visit(self, node: Node, parts: np.ndarray, rows: np.ndarray, best: np.ndarray, least: np.ndarray) -> None:
        """Walk the queries ``rows`` through ``node``; ``least`` is -1 as long as a query has met no entry."""
        if not len(rows):
            return
        if node.entries is not None:
            apart = parts[rows][:, None, :] - self.book[node.entries][None]
            far = (apart * apart).sum(2)
            first = far.argmin(1)
            far, index = far[np.arange(len(rows)), first], node.entries[first]
            won = (least[rows] < 0) | (far < least[rows]) | ((far == least[rows]) & (index < best[rows]))
            best[rows[won]], least[rows[won]] = index[won], far[won]
            return
        left, right = box_distance(node.left, parts[rows]), box_distance(node.right, parts[rows])
        near_left = left <= right
        self.visit(node.left, parts, rows[near_left], best, least)
        self.visit(node.right, parts, rows[~near_left], best, least)
        # Equal bounds are visited as well: a lower index may be there.
        later = near_left & (right <= least[rows])
        self.visit(node.right, parts, rows[later], best, least)
        later = ~near_left & (left <= least[rows])
        self.visit(node.left, parts, rows[later], best, least)


def box_distance(node: Node, parts: np.ndarray) -> np.ndarray:
    """Least squared distance of each row to the node's box."""
    zero = parts.dtype.type(0) if parts.dtype != object else 0
    apart = np.maximum(np.maximum(node.low - parts, parts - node.high), zero)
    return (apart * apart).sum(1)


def integers(vectors: pa.Array, width: int, wide: bool) -> np.ndarray:
    """``floor(SCALE * x)`` of a batch of lists, each ended with zeros up to ``width``."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.asarray(vectors.value_lengths().to_pylist(), np.int64)
    if wide:
        # A double's product with 1024 is exact, but may pass the greatest double.
        values = np.array([whole(x) for x in flat.tolist()], object)
    else:
        values = np.floor(flat * SCALE).astype(np.int64)
    out = np.zeros((len(sizes), width), values.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def whole(x: float) -> int:
    over, under = x.as_integer_ratio()
    return over * SCALE // under


def limbs(value: int, count: int) -> list[int]:
    """``value`` in digits of 32 bits, lowest first; the last one has the sign."""
    mask = (1 << LIMB_BITS) - 1
    return [value >> LIMB_BITS * k & mask for k in range(count - 1)] + [value >> LIMB_BITS * (count - 1)]


@dataclass(frozen=True)
class Shape:
    """What a pass over the vectors has to know: width of all vectors, whether integers pass 64 bits, and limbs of a task's sums."""

    width: int
    wide: bool
    limbs: int


def usable(vectors: DataFrame, name: str) -> DataFrame:
    """Rows whose vector has only finite components, the vector as doubles."""
    v = F.col(name).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vectors.withColumn(name, v).where(F.col(name).isNotNull() & F.forall(name, finite))


def shape_of(rows: DataFrame) -> Shape:
    greatest = F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))
    width, most = rows.agg(F.max(F.size("v")), F.max(greatest)).first()
    width = -(-max(width or 0, PARTS) // PARTS) * PARTS
    bits = (int(most or 0) * SCALE).bit_length() + 1
    # A task sums fewer than 2^31 rows.
    return Shape(width, int(most or 0) * SCALE >= NARROW, -(-(bits + 31) // LIMB_BITS) + 1)


def first_books(rows: DataFrame, shape: Shape) -> list[np.ndarray]:
    """Codebooks of the vectors with the smallest ids: a top-``ENTRIES`` that Spark gathers."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    table = integers(pa.array([r["v"] for r in first], pa.list_(pa.float64())), shape.width, shape.wide)
    return np.split(table, PARTS, axis=1)


def assigned(batch: pa.Array, trees: list[KdTree], shape: Shape) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    parts = np.split(integers(batch, shape.width, shape.wide), PARTS, axis=1)
    return parts, [tree.nearest(np.ascontiguousarray(p)) for tree, p in zip(trees, parts, strict=True)]


def update(rows: DataFrame, books: list[np.ndarray], shape: Shape) -> list[np.ndarray]:
    """The codebooks after a round: means of what falls to each entry, divided down."""
    context = rows.sparkSession.sparkContext
    trees = context.broadcast([KdTree(b) for b in books])
    fields = ["part int, entry int, at int, n bigint", *(f"limb{k} bigint" for k in range(shape.limbs))]
    names = [f.split()[0] for f in ", ".join(fields).split(", ")]
    deep = shape.width // PARTS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = object if shape.wide else np.int64
        sums = [np.zeros((len(b), deep), kind) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            parts, found = assigned(batch.column(0), trees.value, shape)
            for p, (part, (entry, _)) in enumerate(zip(parts, found, strict=True)):
                np.add.at(sums[p], entry, part)
                counts[p] += np.bincount(entry, minlength=len(counts[p]))
        out = [
            (p, int(e), k, int(counts[p][e]), *limbs(int(sums[p][e, k]), shape.limbs))
            for p in range(PARTS) for e in np.flatnonzero(counts[p]) for k in range(deep)
        ]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i < 3 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names)

    total = rows.select("v").mapInArrow(add, ", ".join(fields)).groupBy("part", "entry", "at").agg(*[F.sum(n).alias(n) for n in names[3:]])
    books = [b.copy() for b in books]
    # One row an entry's position: as many as the codebooks have.
    for r in total.collect():
        books[r["part"]][r["entry"], r["at"]] = sum(r[f"limb{k}"] << LIMB_BITS * k for k in range(shape.limbs)) // r["n"]
    trees.unpersist()
    return books


def digest_of(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def train(rows: DataFrame, shape: Shape, rounds: int = ROUNDS) -> list[np.ndarray]:
    """``PARTS`` codebooks of integers learned from all ``rows`` (vec_id, v)."""
    books = first_books(rows, shape)
    for _ in range(rounds if len(books[0]) else 0):
        books = update(rows, books, shape)
    return books


def coded(rows: DataFrame, books: list[np.ndarray], shape: Shape) -> DataFrame:
    """``rows`` (with the vector ``v``, which goes) with ``code`` and ``error``. The other columns stay in Arrow."""
    trees = rows.sparkSession.sparkContext.broadcast([KdTree(b) for b in books])
    kept = [f for f in rows.schema.fields if f.name != "v"]
    at = [f.name for f in rows.schema.fields].index("v")
    schema = StructType([*kept, *StructType.fromDDL("code string, error bigint").fields])
    names = to_arrow_schema(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, found = assigned(batch.column(at), trees.value, shape)
            code = np.stack([entry for entry, _ in found], 1).astype(np.uint8)
            error = np.minimum(sum(far.astype(object) for _, far in found), MOST).astype(np.int64) if shape.wide else sum(far for _, far in found)
            new = [pa.array([row.tobytes().hex() for row in code], pa.string()), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != at), *new], names)

    return rows.mapInArrow(run, schema)


def capped(total: Column) -> Column:
    return F.least(total, F.lit(MOST).cast("decimal(38,0)")).cast("long")


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``vectors`` (vec_id, embedding, label) as vec_id, code, error, label_error, codebooks_sha256."""
    session(vectors.sparkSession)
    rows = usable(vectors.select("vec_id", F.col("embedding").alias("v"), F.to_json(F.struct("label")).alias("kind")), "v")
    shape = shape_of(rows)
    books = train(rows, shape, rounds)
    if not len(books[0]):
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    out = saved(coded(rows, books, shape), "codes")
    sums = out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), capped(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"))
    joined = join_by_group(out, sums, "kind", "n", out.count())
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def rounds_sql(rounds: int) -> str:
    """A round as SQL: the nearest entry of every part, then the means divided down."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT p.vec_id, p.part, p.v, min({{'d': list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': b.entry}}) AS best
  FROM parts p JOIN b{k} b USING (part) GROUP BY p.vec_id, p.part, p.v)""")
        if k < rounds:
            steps.append(f"""
m{k} AS MATERIALIZED (
  SELECT part, entry, list({{'rest': (s % n + n) % n, 's': s, 'n': n}} ORDER BY pos) AS sums FROM (
    SELECT part, best.e AS entry, pos, sum(v[pos])::BIGINT AS s, count(*)::BIGINT AS n FROM a{k}, range(1, len(v) + 1) t(pos) GROUP BY ALL) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (
  SELECT part, entry, CASE WHEN m.sums IS NULL THEN b.v ELSE list_transform(m.sums, lambda x: (x.s - x.rest) // x.n) END AS v FROM b{k} b LEFT JOIN m{k} m USING (part, entry))""")
    return ",".join(steps)


OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, part, v[(part * (len(v) // {PARTS}) + 1):((part + 1) * (len(v) // {PARTS}))] AS v FROM kept, range({PARTS}) t(part)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {ENTRIES}),
b0 AS MATERIALIZED (SELECT part, entry, v FROM parts JOIN first USING (vec_id)),{rounds_sql(ROUNDS)},
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS sha FROM b{ROUNDS}),
codes AS (SELECT vec_id, string_agg(printf('%02x', best.e::INT), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, sha AS codebooks_sha256
FROM kept JOIN codes USING (vec_id), book
"""
