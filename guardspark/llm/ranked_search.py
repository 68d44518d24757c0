"""Ranked lexical search by variable-block-max WAND (operator 12).

Terms are runs of digits, ASCII letters (lower-cased) and characters beyond ASCII. A document's score for an item sums the term weight
times the term's impact in the document over the item's distinct terms; all of it is integers, so ties are exact.

1. **Postings.** One narrow pass reads every document whole and writes how many terms it has and which of the items' terms, how often.
   The number of documents, their length and each term's number of documents follow from that table. Items are searched in blocks of about
   ``QUERY_TERMS`` terms (their number is counted first), which is the proven bound of what is broadcast.
2. **Index.** A task cuts its rows into shards of at most ``SHARD_POSTINGS`` postings (and one document more). In a shard, documents are numbered
   by length, so neighbours have like impacts. Each posting list is cut into blocks by dynamic programming: over chunks of ``GRAIN``
   postings, the borders minimise the sum of the bound's error (block maximum less impact, over all postings) and ``BLOCK_COST`` a block.
3. **Search.** The borders of an item's blocks cut the shard into intervals; the bound of one is the sum of the weighted maxima of the blocks
   that lie over it. As in WAND, documents are scored only where that sum reaches the score to beat, here for all documents between two borders
   at once and from the highest bound down; blocks without such documents aren't read. An interval whose bound equals the score to beat is read
   as well, as a smaller doc_id may be there. So each shard's ``TOP`` are exact.
4. **Merge.** The tops of the shards meet by item, first in salted groups.

Defined cases: a text that is null or without terms gives no row and doesn't count in N and L; an item without terms gives no rows; rows that repeat an
item_id are items of their own; rows that repeat a doc_id are documents of their own; equal scores go by doc_id, a null one last, and rows that agree in both are
interchangeable; an empty table on either side gives an empty result; very long texts are read whole, a slice at a time; extra columns
are ignored, whatever their names. Ids of any type that Spark orders stay as they are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import discard, documents, saved, session

TOP = 10
#: Terms of the items of one block, which are broadcast.
QUERY_TERMS = 200_000
SHARD_POSTINGS = 2_000_000
#: Postings of a chunk, chunks of a block at most, and the error that a block more must save.
GRAIN, MOST_CHUNKS, BLOCK_COST = 8, 64, 2_000_000
#: Documents of the first look, and how many times as many the next one takes.
FIRST_LOOK, GROWTH = 64, 8
SALTS = 32
#: Bytes of a text that become words at once.
SLICE = 1 << 20
#: Every byte to itself in lower case, or to a space between terms.
FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() or b >= 128 else 32 for b in range(128)) + bytes(range(128, 256))


def term_slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a slice at a time; slices end between terms."""
    folded = text.translate(FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + SLICE) if len(folded) - at > SLICE else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def weight(documents_with: int, n_documents: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * documents_with + 1)))


@dataclass
class Corpus:
    """N and L of all documents, and weights by term number (0 is no term)."""

    documents: int
    length: int
    weights: np.ndarray

    def lengths(self, sizes: list[int]) -> np.ndarray:
        """m of documents with so many terms; in Python's integers, as the product may pass 64 bits."""
        return np.array([10 + 90 * n * self.documents // self.length for n in sizes], np.int64)


def block_borders(impacts: np.ndarray) -> np.ndarray:
    """Borders of a posting list's blocks, 0 and the length included: the least error and cost over all cuts between chunks."""
    chunks = np.arange(0, len(impacts), GRAIN)
    if len(chunks) == 1:
        return np.array([0, len(impacts)])
    edges = np.append(chunks, len(impacts))
    top = np.maximum.reduceat(impacts, chunks)
    total = np.concatenate(([0], np.cumsum(impacts)))[edges]
    cost = np.zeros(len(edges), np.int64)
    back = np.zeros(len(edges), np.int64)
    highest = np.zeros(len(edges), np.int64)
    for j in range(1, len(edges)):
        i = max(0, j - MOST_CHUNKS)
        # Maximum of the chunks from each start to this one.
        np.maximum(highest[i:j], top[j - 1], out=highest[i:j])
        found = cost[i:j] + highest[i:j] * (edges[j] - edges[i:j]) - (total[j] - total[i:j])
        best = int(found.argmin())
        cost[j], back[j] = found[best] + BLOCK_COST, i + best
    cuts = [len(edges) - 1]
    while cuts[-1]:
        cuts.append(int(back[cuts[-1]]))
    return edges[cuts[::-1]]


@dataclass
class Shard:
    """Inverted index of some documents: postings by term, then by document; blocks by term."""

    size: int
    doc: np.ndarray
    impact: np.ndarray
    first_block: np.ndarray
    low: np.ndarray
    high: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    most: np.ndarray
    #: Place of each document's id among the shard's ids, and its row.
    id_rank: np.ndarray
    row: np.ndarray
    read: int = field(default=0)

    @classmethod
    def build(cls, ids: pa.Array, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, n_terms: int) -> Shard:
        """``sizes`` says how many of ``terms`` (with ``counts``) each document has."""
        by_length = np.argsort(lengths, kind="stable")
        number = np.empty(len(lengths), np.int64)
        number[by_length] = np.arange(len(lengths))
        row = np.repeat(np.arange(len(lengths)), sizes)
        order = np.lexsort((number[row], terms))
        row, terms, counts = row[order], terms[order], counts[order]
        impact = 1_000_000_000 * counts // (1000 * counts + 8 * lengths[row])
        starts = np.searchsorted(terms, np.arange(n_terms + 1))
        low, first_block = [], np.zeros(n_terms + 1, np.int64)
        for t in range(n_terms):
            a, b = starts[t], starts[t + 1]
            if b > a:
                low.append(block_borders(impact[a:b])[:-1] + a)
            first_block[t + 1] = first_block[t] + (len(low[-1]) if b > a else 0)
        low = np.concatenate(low) if low else np.zeros(0, np.int64)
        high = np.append(low[1:], len(impact)) if len(low) else low
        doc = number[row]
        rank = np.empty(len(lengths), np.int64)
        rank[pc.array_sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(lengths))
        most = np.maximum.reduceat(impact, low) if len(low) else low
        return cls(len(lengths), doc, impact, first_block, low, high, doc[low], doc[high - 1] + 1, most, rank[by_length], by_length)

    def search(self, terms: np.ndarray, weights: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the ``top`` best documents for the distinct ``terms``, highest first."""
        blocks = [np.arange(self.first_block[t], self.first_block[t + 1]) for t in terms]
        own = np.repeat(weights[terms], [len(b) for b in blocks])
        block = np.concatenate(blocks) if blocks else np.zeros(0, np.int64)
        none = np.zeros(0, np.int64)
        if not len(block):
            return none, none
        begin, end, bound = self.begin[block], self.end[block], own * self.most[block]
        border, place = np.unique(np.concatenate((begin, end)), return_inverse=True)
        change = np.zeros(len(border), np.int64)
        np.add.at(change, place, np.concatenate((bound, -bound)))
        bounds = np.cumsum(change)[:-1]
        downward = np.argsort(-bounds, kind="stable")
        falling, documents_in = -bounds[downward], np.cumsum((border[1:] - border[:-1])[downward])
        best, scores, taken, look = none, none, 0, FIRST_LOOK
        while True:
            to_beat = scores[-1] if len(scores) == top else 1
            cut = min(max(np.searchsorted(documents_in, look), taken) + 1, np.searchsorted(falling, -to_beat, side="right"))
            if cut <= taken:
                break
            part = downward[taken:cut]
            live = np.zeros(self.size + 1, np.int64)
            np.add.at(live, border[part], 1)
            np.add.at(live, border[part + 1], -1)
            live = np.cumsum(live)[:-1] > 0
            upto = np.concatenate(([0], np.cumsum(live)))
            hit = upto[end] > upto[begin]
            found, score = self.score(block[hit], own[hit], live)
            best, scores = np.concatenate((best, found)), np.concatenate((scores, score))
            order = np.lexsort((self.id_rank[best], -scores))[:top]
            best, scores, taken, look = best[order], scores[order], cut, look * GROWTH
        return self.row[best], scores

    def score(self, block: np.ndarray, own: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of ``live`` with their scores, from the postings of ``block`` alone."""
        low, sizes = self.low[block], self.high[block] - self.low[block]
        at = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        self.read += len(at)
        doc = self.doc[at]
        stay = live[doc]
        total = np.zeros(self.size, np.int64)
        np.add.at(total, doc[stay], (self.impact[at] * np.repeat(own, sizes))[stay])
        found = np.flatnonzero(total)
        return found, total[found]


def binary(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.binary()).to_pylist()


def item_terms(items: DataFrame) -> DataFrame:
    """``item`` (a number of its own for each row), item_id and the distinct ``terms`` of the items that have any."""
    schema = StructType([*items.select(F.lit(0).cast("long").alias("item"), "item_id").schema.fields, *StructType.fromDDL("terms array<binary>").fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted({w for part in term_slices(t or b"") for w in part}) for t in binary(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.binary()))], names)

    rows = items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text").mapInArrow(run, schema)
    return saved(rows.where(F.size("terms") > 0), "item-terms")


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, ``n`` terms, and the numbers (from 1) and counts of those of ``terms``; documents without any term of their own are left out."""
    known = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms, 1)})
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("n bigint, terms array<int>, counts array<bigint>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            size, numbers, counts = [], [], []
            for text in binary(batch.column(1)):
                n, seen = 0, Counter()
                for words in term_slices(text or b""):
                    n += len(words)
                    seen.update(filter(None, map(get, words)))
                size.append(n)
                numbers.append(list(seen))
                counts.append(list(seen.values()))
            columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(numbers, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return saved(docs.select("doc_id", "text").mapInArrow(run, schema).where("n > 0"), "postings")


def shards(batches: Iterator[pa.RecordBatch], corpus: Corpus) -> Iterator[tuple[pa.Array, Shard]]:
    """The rows of a task as shards, each with its ids."""
    held: list[pa.RecordBatch] = []
    n = 0

    def index() -> tuple[pa.Array, Shard]:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, size, terms, counts = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns)
        flat = lambda a: a.flatten().to_numpy().astype(np.int64)
        sizes = terms.value_lengths().to_numpy()
        return ids, Shard.build(ids, corpus.lengths(size.to_pylist()), sizes, flat(terms), flat(counts), len(corpus.weights))

    for batch in batches:
        sizes = batch.column(2).value_lengths().to_numpy().astype(np.int64)
        at = 0
        while at < len(sizes):
            room = np.searchsorted(np.cumsum(sizes[at:]), SHARD_POSTINGS - n) + 1
            held.append(batch.slice(at, room))
            n += int(sizes[at : at + room].sum())
            at += room
            if n >= SHARD_POSTINGS:
                yield index()
                held.clear()
                n = 0
    if held:
        yield index()


def tops(rows: DataFrame, queries: list[tuple[int, np.ndarray]], corpus: Corpus, top: int) -> DataFrame:
    """``item, doc_id, score, salt``: the best documents of every shard."""
    told = rows.sparkSession.sparkContext.broadcast((queries, corpus))
    schema = StructType([*StructType.fromDDL("item bigint").fields, rows.schema["doc_id"], *StructType.fromDDL("score bigint, salt int").fields])
    id_type = to_arrow_schema(schema).field(1).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (queries, corpus), salt = told.value, TaskContext.get().partitionId() % SALTS
        for ids, shard in shards(batches, corpus):
            items, places, scores = [], [], []
            for item, terms in queries:
                row, score = shard.search(terms, corpus.weights, top)
                items.append(np.full(len(row), item))
                places.append(row)
                scores.append(score)
            place = np.concatenate(places).astype(np.int64)
            columns = [pa.array(np.concatenate(items).astype(np.int64)), ids.take(pa.array(place)).cast(id_type), pa.array(np.concatenate(scores).astype(np.int64)), pa.array(np.full(len(place), salt, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)


def best(rows: DataFrame, *keys: str, top: int) -> DataFrame:
    """The ``top`` rows of each group with their ``rank``; Spark keeps as many of each task's rows before it deals them."""
    order = W.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(items: DataFrame, docs: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents of each row of ``items`` (item_id, text) among ``docs`` (doc_id, text): item_id, rank, doc_id, score."""
    spark = session(docs.sparkSession)
    wanted = item_terms(items)
    blocks = -(-(wanted.agg(F.sum(F.size("terms"))).first()[0] or 0) // QUERY_TERMS)
    found = None
    for k in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).select("item", "terms").collect()
        if not block:
            continue
        terms = sorted({bytes(t) for r in block for t in r["terms"]})
        number = {t: n for n, t in enumerate(terms, 1)}
        queries = [(r["item"], np.array([number[bytes(t)] for t in r["terms"]], np.int64)) for r in block]
        rows = postings(docs, terms)
        n, length = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n:
            break
        # A row a term of the block.
        with_term = dict(rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        weights = np.array([0, *(weight(with_term.get(t, 0), n) for t in range(1, len(terms) + 1))], np.int64)
        part = best(tops(rows, queries, Corpus(n, length, weights), top), "item", "salt", top=top).drop("rank")
        part = saved(best(part, "item", top=top).select("item", "rank", "doc_id", "score"), "search-top")
        discard(rows)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.select(F.lit(0).cast("long").alias("item"), F.lit(1).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score")).where("false")
    return wanted.select("item", "item_id").join(found, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), documents(spark, sf_dir))


OP12_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM d GROUP BY doc_id),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM n),
m AS (SELECT doc_id, 100 - 90 + ((90 * n * docs) // length) AS m FROM n, c),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM d GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), c),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""
