"""Token-id files with a minimal perfect hash index (operator 10).

Documents are range-partitioned by doc_id, so every task writes one ascending run of shards. A store is a folder:

=========================== ==================================================================================
place                       content
=========================== ==================================================================================
``ids/part-P-seq-S.bin``    a shard's payload, raw: ids as little-endian unsigned integers, documents back to back; they have 16 bits
                            where the whole vocabulary fits into them, 32 otherwise
``shards/``                 Parquet, a row a shard: part, seq, n_docs, n_tokens; ``keys`` and ``ends``: doc_id and end (in ids) of
                            each document in order, as little-endian 64-bit integers
``index/bucket-B.bin``      minimal perfect hash of the keys of one bucket: number of keys and of levels, the bit array of each
                            level with its length in front, then a ``SLOT`` for each hash value
``meta.json``               number of buckets, and bytes of an id
=========================== ==================================================================================

A key's bucket is a hash of it, its hash value in the bucket the rank of its bit in the first level where it was
alone (keys that collide go on to the next level), and the slot holds a fingerprint of the key, the shard, the offset and the
number of ids. So a lookup reads the levels of one bucket (of about ``BUCKET_KEYS`` keys, whatever the store's size) and one
slot, compares the fingerprint and reads one slice of one payload file: no scan and no Spark job. A shard is cut at
``SHARD_IDS`` ids, so neither writer nor reader ever holds more than that and one document.

Files are written under a name of their own and renamed, and a task that runs again writes the same bytes, so lost executors
and repeated tasks leave a whole store. The folder must be one that pyarrow opens (file, hdfs, s3, gs).

Tokenising caches the library's ids by pre-token, bounded and shared by a worker's tasks. Texts within
Latin-1 are cut into pre-tokens by the tokenizer's own split pattern; others, and texts with the marks
of special tokens, go by white-space chunk through the whole tokenizer, whose pattern never joins
characters across a space, tab or line feed. Tests compare both with whole texts.

Defined cases: null text is empty and has the end id alone; documents with a null doc_id come first, and the
index names none of them; rows that repeat a doc_id stay separate documents, adjacent in the store in the order of their texts, and the
index names the first; ids are whole numbers of 64 bits; very long texts are one document, whole; an empty table gives an empty
store; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import CLEANUP, conf, documents, session, shared_dir
from .graph import sorted_groups

END_ID = 1
SHARD_IDS = 1 << 18
#: Strings in a worker's cache, and the longest that it keeps.
CACHE_PIECES, CACHED_LENGTH = 250_000, 64
#: Stands in the shards for a null doc_id; their number of null ones tells it from the least id.
NULL_KEY = -(2**63)
GAMMA = 1.5
BUCKET_KEYS = 1 << 16
SHARDS = "part int, seq int, n_docs bigint, n_null bigint, n_tokens bigint, keys binary, ends binary"
SLOT = np.dtype([("mark", "<u4"), ("part", "<u4"), ("seq", "<u4"), ("n", "<u4"), ("offset", "<u8")])
SPACES = re.compile("[ \t\n]+")
#: The tokenizer's split pattern, its letter and number classes spelled out for Latin-1 in lower case.
LETTER, NUMBER = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\\s{LETTER}{NUMBER}]+")
#: Texts on which lower case, composition and white space are the same here as in the library.
PLAIN = re.compile("[\t-\r -~\x85\xa0-\xff]*")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of keys under a seed."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: one bit array a level, ranks by counting bits."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        sums = np.cumsum([0] + [int(b.sum()) for b in levels])
        self.ranks = [np.concatenate(([0], np.cumsum(b))).astype(np.int64) + s for b, s in zip(levels, sums[:-1], strict=True)]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        left = keys.astype(np.int64).view(np.uint64)
        while len(left):
            size = max(1, int(GAMMA * len(left)))
            at = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Hash values; -1 for some keys that aren't in the set (fingerprints tell the others)."""
        keys = keys.astype(np.int64).view(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for n, bits in enumerate(self.levels):
            at = (mixed(keys[left], n) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.ranks[n][at[hit]]
            left = left[~hit]
        return out

    def pack(self) -> bytes:
        return b"".join(np.uint32(len(b)).tobytes() + np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def unpack(cls, data: bytes) -> PerfectHash:
        levels, at = [], 0
        while at < len(data):
            n = int(np.frombuffer(data, "<u4", 1, at)[0])
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at + 4), count=n).astype(bool))
            at += 4 + (n + 7) // 8
        return cls(levels)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.astype(np.int64).view(np.uint64), 977) >> np.uint64(32)).astype(np.uint32)


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256, 257, ... in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Pieces(dict):
    """Ids of strings as little-endian 32-bit bytes, by ``find``; bounded."""

    def __init__(self, find: Callable[[str], list[int]]):
        self.find = find

    def __missing__(self, text: str) -> bytes:
        value = np.array(self.find(text), "<u4").tobytes()
        if len(text) <= CACHED_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[text] = value
        return value


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, with the end id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        model, letters = tokenizer.model, str.maketrans(byte_letters())
        # A pre-token goes straight to the library's model, a chunk through the whole tokenizer.
        self.pieces = Pieces(lambda t: [x.id for x in model.tokenize(t.encode().decode("latin-1").translate(letters))])
        self.chunks = Pieces(lambda t: tokenizer.encode(t, add_special_tokens=False).ids)
        self.end = np.uint32(END_ID).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if "<|" not in text and PLAIN.fullmatch(text):
            return b"".join(map(self.pieces.__getitem__, PIECE.findall(text.lower()))) + self.end
        return b"".join(map(self.chunks.__getitem__, SPACES.split(text))) + self.end


def id_bytes(path: str) -> int:
    """Bytes that an id of the tokenizer's vocabulary takes: 2 or 4."""
    from tokenizers import Tokenizer

    most = max([END_ID, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()])
    return 2 if most < 1 << 16 else 4


@cache
def encoder_at(path: str) -> Encoder:
    """One encoder a worker."""
    return Encoder(path)


class Folder:
    """Raw files below a store's folder."""

    def __init__(self, uri: str):
        from pyarrow.fs import FileSystem

        self.system, self.base = FileSystem.from_uri(uri)

    def write(self, name: str, data: bytes) -> None:
        path = f"{self.base}/{name}"
        own = f"{path}.{uuid.uuid4().hex}"
        self.system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with self.system.open_output_stream(own) as out:
            out.write(data)
        self.system.move(own, path)

    def read(self, name: str, at: int = 0, n: int | None = None) -> bytes:
        with self.system.open_input_file(f"{self.base}/{name}") as file:
            file.seek(at)
            return file.read(n)


def ids_file(part: int, seq: int) -> str:
    return f"ids/part-{part:06d}-seq-{seq:06d}.bin"


def bucket_file(bucket: int) -> str:
    return f"index/bucket-{bucket:08d}.bin"


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys.astype(np.int64).view(np.uint64), 31) % np.uint64(buckets)).astype(np.int64)


class Bucket:
    """One bucket of the index, as bytes and back."""

    HEAD = 8

    @staticmethod
    def pack(keys: np.ndarray, places: np.ndarray) -> bytes:
        """``places`` are SLOT rows of distinct keys; their marks are filled in."""
        table = PerfectHash.build(keys)
        slots = np.zeros(len(keys), SLOT)
        at = table.find(keys)
        slots[at] = places
        slots["mark"][at] = fingerprints(keys)
        levels = table.pack()
        return np.array([len(keys), len(levels)], "<u4").tobytes() + levels + slots.tobytes()

    def __init__(self, folder: Folder, bucket: int):
        self.folder, self.name = folder, bucket_file(bucket)
        self.n, self.size = np.frombuffer(folder.read(self.name, 0, self.HEAD), "<u4").tolist()
        self.table = PerfectHash.unpack(folder.read(self.name, self.HEAD, self.size))

    def slot(self, key: int) -> np.void | None:
        """Place of one key: one read of one slot."""
        keys = np.array([key], np.int64)
        at = int(self.table.find(keys)[0])
        if at < 0:
            return None
        slot = np.frombuffer(self.folder.read(self.name, self.HEAD + self.size + at * SLOT.itemsize, SLOT.itemsize), SLOT)[0]
        return slot if slot["mark"] == fingerprints(keys)[0] else None

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys that are all there."""
        every = np.frombuffer(self.folder.read(self.name, self.HEAD + self.size, self.n * SLOT.itemsize), SLOT)
        at = self.table.find(keys)
        if (at < 0).any() or (every["mark"][at] != fingerprints(keys)).any():
            raise ValueError(f"{self.name} lacks keys of its shards")
        return every[at]


def write_store(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write the store of ``docs`` into the folder ``path``; on a cluster the tokenizer's file is on every machine."""
    spark = session(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY))
    # Rows that repeat an id are dealt by their texts' beginnings.
    order = ("named", "key")
    ordered = docs.select(key.alias("key"), "text", F.col("doc_id").isNotNull().alias("named"))
    ordered = ordered.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, folder, part, seq = encoder_at(tokenizer), Folder(path), TaskContext.get().partitionId(), 0
        keys: list[int] = []
        ids: list[bytes] = []
        held = nameless = 0

        def written() -> pa.RecordBatch:
            folder.write(ids_file(part, seq), np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}").tobytes())
            ends = np.cumsum([len(b) // 4 for b in ids]).astype("<i8")
            row = {"part": part, "seq": seq, "n_docs": len(keys), "n_null": nameless, "n_tokens": int(ends[-1]), "keys": np.array(keys, "<i8").tobytes(), "ends": ends.tobytes()}
            return pa.RecordBatch.from_pylist([row], shape)

        for batch in batches:
            for k, text, named in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys.append(k)
                nameless += not named
                ids.append(encoder.encode(text))
                held += len(ids[-1]) // 4
                if held >= SHARD_IDS:
                    yield written()
                    seq, keys, ids, held, nameless = seq + 1, [], [], 0, 0
        if keys:
            yield written()

    shape, width = to_arrow_schema(StructType.fromDDL(SHARDS)), id_bytes(tokenizer)
    with conf(spark, **{CLEANUP: "true"}):
        ordered.mapInArrow(shards, SHARDS).write.parquet(f"{path}/shards")
    buckets = write_index(spark, path)
    Folder(path).write("meta.json", json.dumps({"buckets": buckets, "id_bytes": width}).encode())


def write_index(spark: SparkSession, path: str) -> int:
    """Build the index of the shards in ``path``; its number of buckets. Of rows that repeat a key the first is named."""
    rows = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    n_docs = rows.agg(F.sum("n_docs")).first()[0] or 0
    buckets = max(1, -(-n_docs // BUCKET_KEYS))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in pdf.itertuples(index=False):
                keys, first, ends = firsts_of(s)
                slots = np.zeros(len(first), SLOT)
                slots["part"], slots["seq"], slots["offset"], slots["n"] = s.part, s.seq, ends[first], ends[first + 1] - ends[first]
                keys = keys[first]
                for b, at in by_bucket(keys, buckets):
                    yield pd.DataFrame({"bucket": [b], "keys": [keys[at].astype("<i8").tobytes()], "slots": [slots[at].tobytes()]})

    dealt = rows.select("part", "seq", "n_null", "keys", "ends").mapInPandas(places, "bucket bigint, keys binary, slots binary").repartition("bucket").sortWithinPartitions("bucket")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder = Folder(path)
        for g in sorted_groups(batches, ["bucket"]):
            keys, slots = np.frombuffer(b"".join(g["keys"]), "<i8").astype(np.int64), np.frombuffer(b"".join(g["slots"]), SLOT)
            # A key that goes on in the next shard is there more than once: its first place counts.
            order = np.lexsort((slots["offset"], slots["seq"], slots["part"], keys))
            keys, slots = keys[order], slots[order]
            new = np.concatenate(([True], keys[1:] != keys[:-1]))
            folder.write(bucket_file(int(g["bucket"].iloc[0])), Bucket.pack(keys[new], slots[new]))
            yield pd.DataFrame({"bucket": g["bucket"].iloc[:1], "n_keys": [int(new.sum())]})

    with conf(spark, **{CLEANUP: "true"}):
        dealt.mapInPandas(build, "bucket bigint, n_keys bigint").write.parquet(f"{path}/buckets")
    return buckets


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys in ``keys``)."""
    bucket = bucket_of(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for at in np.split(order, cuts):
        if len(at):
            yield int(bucket[at[0]]), at


def firsts_of(s) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a shard's documents, those documents that are its first of their key, and the documents' borders in ids. Documents without an id come first and are no key's."""
    keys = np.frombuffer(s.keys, "<i8").astype(np.int64)
    own = keys[s.n_null :]
    first = s.n_null + np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))[: len(own)])
    return keys, first, np.concatenate(([0], np.frombuffer(s.ends, "<i8").astype(np.int64)))


class TokenStore:
    """Reads a store: whole, or by key."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = session(spark), path, Folder(path)
        self.shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
        meta = json.loads(self.folder.read("meta.json"))
        self.buckets, self.id_bytes = meta["buckets"], meta["id_bytes"]

    def starts(self) -> DataFrame:
        """Per shard the number of ids before it: sums of parts, then sums inside a part."""
        sizes = self.shards.select("part", "seq", "n_tokens")
        parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
        before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))
        inside = F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
        return sizes.withColumn("inside", inside).join(before, "part").select("part", "seq", (F.col("part_start") + F.col("inside")).alias("shard_start"))

    def placed(self) -> DataFrame:
        """part, seq, slots: the places in each shard that the index gives for all keys of the store."""
        path, buckets = self.path, self.buckets

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for s in pdf.itertuples(index=False):
                    keys = np.unique(np.frombuffer(s.keys, "<i8").astype(np.int64)[s.n_null :])
                    for b, at in by_bucket(keys, buckets):
                        yield pd.DataFrame({"bucket": [b], "keys": [keys[at].astype("<i8").tobytes()]})

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            folder = Folder(path)
            for g in sorted_groups(batches, ["bucket"]):
                keys = np.unique(np.frombuffer(b"".join(g["keys"]), "<i8").astype(np.int64))
                slots = Bucket(folder, int(g["bucket"].iloc[0])).slots(keys)
                slots = slots[np.lexsort((slots["seq"], slots["part"]))]
                cuts = np.flatnonzero((np.diff(slots["part"].astype(np.int64)) != 0) | (np.diff(slots["seq"].astype(np.int64)) != 0)) + 1
                parts = np.split(slots, cuts)
                yield pd.DataFrame({"part": [int(x["part"][0]) for x in parts], "seq": [int(x["seq"][0]) for x in parts], "slots": [x.tobytes() for x in parts]})

        dealt = self.shards.select("n_null", "keys").mapInPandas(send, "bucket bigint, keys binary").repartition("bucket").sortWithinPartitions("bucket")
        return dealt.mapInPandas(find, "part int, seq int, slots binary").groupBy("part", "seq").agg(F.collect_list("slots").alias("slots"))

    def documents(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of every document, each found through the index and sliced from its payload file."""
        path, width = self.path, self.id_bytes

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            folder = Folder(path)
            for pdf in batches:
                for s in pdf.itertuples(index=False):
                    yield rows_of(s, folder, width)

        rows = self.shards.select("part", "seq", "n_null", "keys", "ends").join(self.placed(), ["part", "seq"], "left")
        out = rows.mapInPandas(read, "part int, seq int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
        return out.join(self.starts(), ["part", "seq"]).select(
            "doc_id", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
        )

    def lookup(self, key: int) -> list[int] | None:
        """The ids of one document; None if the key isn't there."""
        bucket = int(bucket_of(np.array([key], np.int64), self.buckets)[0])
        try:
            slot = Bucket(self.folder, bucket).slot(key)
        except FileNotFoundError:  # a bucket without keys has no file
            return None
        if slot is None:
            return None
        data = self.folder.read(ids_file(int(slot["part"]), int(slot["seq"])), self.id_bytes * int(slot["offset"]), self.id_bytes * int(slot["n"]))
        return np.frombuffer(data, f"<u{self.id_bytes}").tolist()


def rows_of(s, folder: Folder, width: int) -> pd.DataFrame:
    """A shard's documents: the first of each key where the index says, rows that repeat a key where the one before ends."""
    keys, _, ends = firsts_of(s)
    begin, n = ends[:-1].copy(), np.diff(ends)
    slots = np.frombuffer(b"".join(s.slots) if s.slots is not None else b"", SLOT)
    at = np.searchsorted(begin, slots["offset"].astype(np.int64))
    if (at >= len(keys)).any() or (begin[at] != slots["offset"]).any() or (n[at] != slots["n"]).any():
        raise ValueError(f"the index and shard {s.part}, {s.seq} disagree")
    payload = np.frombuffer(folder.read(ids_file(s.part, s.seq)), f"<u{width}").astype("<u4").tobytes()
    crc = [zlib.crc32(payload[4 * a : 4 * (a + m)]) for a, m in zip(begin.tolist(), n.tolist(), strict=True)]
    named = pd.array(keys, "Int64")
    named[: s.n_null] = pd.NA
    return pd.DataFrame({"part": s.part, "seq": s.seq, "doc_id": named, "inside": begin, "n_tokens": n, "ids_crc32": crc})


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-store")
    write_store(documents(spark, sf_dir), path, tokenizer_path())
    return TokenStore(spark, path).documents()
