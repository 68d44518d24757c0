"""Quality classifier by attention-based multiple-instance learning (operator 4).

A document is a bag of passages of ``PASSAGE`` words. A passage is described by how its character classes
follow one another (transition frequencies of ten classes), by how often a word recurs 1 to 8 words
later, and by word lengths; a learned layer encodes it as ``h = tanh(W x + b)``. Gated attention gives each
passage the weight ``softmax(w . (tanh(V h) * sigmoid(U h)))`` inside its document, and the document's score
is ``sigmoid(c . sum(weight * h) + d)``. Only document labels are known: the loss is the cross entropy of the
document score, and its gradient trains encoder, attention and output together (Adam, full batches).

Training takes a sample of at most about ``LABELLED`` labelled documents (all of them, if there are fewer),
drawn by the hash of doc_id, and all passages of each; their features (440 bytes for 40 words) go to the driver. Scoring is one narrow pass over all texts, whole. Nothing but the
text is an input.

Defined cases: null text counts as empty; an empty text is a bag of one passage of zeros, so it has a
score too; rows with null quality teach nothing; with no labels all scores are 0.5, with labels of
one kind all are the share of ones; rows that repeat come back each; an empty table gives an empty
result; extra columns are ignored, whatever their names; very long texts are scored whole, a few MB at a time; ids stay
as they are (they never leave Arrow).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, session, text_batches, with_text

PASSAGE = 40
LAGS = 8
CLASSES = 10
FEATURES = CLASSES * CLASSES + LAGS + 2
#: Labelled documents that training takes, about, and passages of one of them at most: what bounds the driver's share.
LABELLED = 3000
HIDDEN, ATTENTION = 24, 12
STEPS, RATE, DECAY = 150, 0.02, 1e-4
THRESHOLD = 0.7
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def class_table() -> np.ndarray:
    """Character class of every byte: control 0, lower 1, upper 2, digit 3, space 4, line feed 5, sentence marks 6, quotes and brackets 7, other signs 8, beyond ASCII 9."""
    table = np.zeros(256, np.int64)
    groups = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:?!", b"\"'()[]{}<>", b"#$%&*+-/=@\\^_`|~")
    for k, members in enumerate(groups, 1):
        table[list(members)] = k
    table[128:] = 9
    return table


TABLE = class_table()


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of ``texts`` in a row, and the number of passages of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    size = np.array([len(r) for r in raw])
    begin = np.cumsum(size) - size
    kind = TABLE[data]
    space = (kind == 4) | (kind == 5)
    word_at = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    doc_of_word = np.searchsorted(begin, word_at, "right") - 1
    n_words = np.bincount(doc_of_word, minlength=len(texts))
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    base = np.cumsum(n_passages) - n_passages
    first_word = np.cumsum(n_words) - n_words
    rank = np.arange(len(word_at)) - first_word[doc_of_word]
    passage_of_word = base[doc_of_word] + rank // PASSAGE
    total = int(n_passages.sum())
    # Each byte belongs to the passage of the last word that began before it, in its own text.
    head = np.zeros(len(data), np.int64)
    head[begin] = np.diff(np.concatenate(([0], base)))
    jump = np.flatnonzero(rank > 0)
    jump = jump[passage_of_word[jump] != passage_of_word[jump - 1]]
    head[word_at[jump]] += 1
    if len(begin) > 1:
        head[begin[1:]] = base[1:] - (base[:-1] + np.maximum(n_passages[:-1] - 1, 0))
    place = np.cumsum(head)
    step = kind[:-1] * CLASSES + kind[1:]
    inner = np.ones(len(step), bool)
    inner[begin[1:] - 1] = False
    x = np.zeros((total, FEATURES), np.float32)
    count = np.bincount(place[:-1][inner] * CLASSES * CLASSES + step[inner], minlength=total * CLASSES * CLASSES).reshape(total, -1)
    x[:, : CLASSES * CLASSES] = count / np.maximum(1, count.sum(1, keepdims=True))
    if len(word_at):
        end = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
        length = end - word_at
        offset = np.arange(len(data)) - np.repeat(np.concatenate(([0], word_at)), np.diff(np.concatenate(([0], word_at, [len(data)]))))
        lower = np.where(kind == 2, data | 32, data).astype(np.uint64)
        mixed = (lower + np.uint64(1) + (offset.astype(np.uint64) << np.uint64(8))) * MIX[0]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * MIX[1]
        mixed[space] = 0
        word = np.add.reduceat(mixed, word_at)
        held = np.bincount(passage_of_word, minlength=total)
        words = np.maximum(1, held)
        for lag in range(1, LAGS + 1):
            same = np.flatnonzero((word[lag:] == word[:-lag]) & (doc_of_word[lag:] == doc_of_word[:-lag])) + lag
            x[:, CLASSES * CLASSES + lag - 1] = np.bincount(passage_of_word[same], minlength=total) / words
        x[:, -2] = np.bincount(passage_of_word, length, total) / words / 10
        x[:, -1] = held / PASSAGE
    return x, n_passages


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionMil:
    """Gated-attention pooling over encoded passages; plain arrays, so it travels to executors as it is."""

    NAMES = ("W", "b", "V", "U", "w", "c", "d")

    def __init__(self, seed: int = 7):
        draw = np.random.Generator(np.random.PCG64(seed)).normal
        self.W = draw(0, FEATURES**-0.5, (FEATURES, HIDDEN)).astype(np.float32)
        self.b = np.zeros(HIDDEN, np.float32)
        self.V = draw(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)).astype(np.float32)
        self.U = draw(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)).astype(np.float32)
        self.w = draw(0, ATTENTION**-0.5, ATTENTION).astype(np.float32)
        self.c = draw(0, HIDDEN**-0.5, HIDDEN).astype(np.float32)
        self.d = np.zeros(1, np.float32)
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.constant: float | None = None

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        first = np.cumsum(counts) - counts
        bag = np.repeat(np.arange(len(counts)), counts)
        h = np.tanh(x @ self.W + self.b)
        t, g = np.tanh(h @ self.V), sigmoid(h @ self.U)
        e = (t * g) @ self.w
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return {"first": first, "bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "p": sigmoid(z @ self.c + self.d)}

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        f = self.forward(x, counts)
        out = (f["p"] - y) / len(y)
        dz = out[:, None] * self.c
        dzb = dz[f["bag"]]
        da = (dzb * f["h"]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["first"])[f["bag"]])
        dt, dg = de[:, None] * self.w * f["g"] * (1 - f["t"] ** 2), de[:, None] * self.w * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dzb + dt @ self.V.T + dg @ self.U.T) * (1 - f["h"] ** 2)
        return {
            "W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": ((f["t"] * f["g"]) * de[:, None]).sum(0),
            "c": (out[:, None] * f["z"]).sum(0), "d": out.sum(keepdims=True),
        }

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> AttentionMil:
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        m = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        v = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        for step in range(1, STEPS + 1):
            for k, g in self.gradients(x, counts, y).items():
                p = getattr(self, k)
                g = g.astype(np.float32) + DECAY * p
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                setattr(self, k, p - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant if self.constant is not None else 0.5)
        x, counts = passages(texts)
        return self.forward(np.clip((x - self.mean) / self.scale, -6, 6), counts)["p"].astype(np.float64)


def learn(docs: DataFrame, labels: DataFrame) -> AttentionMil:
    """Train on a bounded sample of ``labels`` (doc_id, quality) and their texts in ``docs``."""
    session(docs.sparkSession)
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # At most about LABELLED rows of two numbers, whatever the size of the table: safe to broadcast.
    sample = F.broadcast(known.where(unit < LABELLED / max(n, LABELLED)))
    rows = docs.select("doc_id", "text").join(sample, "doc_id")

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, counts = passages(next(text_batches([pdf], "text"))[0])
                bags = np.split(x, np.cumsum(counts)[:-1])
                yield pd.DataFrame({"doc_id": pdf["doc_id"].astype(str), "quality": pdf["quality"].astype(float), "x": [b.tobytes() for b in bags]})

    bags = sorted((r.doc_id, r.quality, bytes(r.x)) for r in rows.mapInPandas(describe, "doc_id string, quality double, x binary").collect())
    x = np.frombuffer(b"".join(b for _, _, b in bags), np.float32).reshape(-1, FEATURES)
    counts = np.array([len(b) // (4 * FEATURES) for _, _, b in bags], np.int64)
    return AttentionMil().fit(x, counts, np.array([y for _, y, _ in bags], np.float32))


def score(docs: DataFrame, model: AttentionMil, *keep: Column) -> DataFrame:
    """doc_id, the columns ``keep``, score of every row."""
    session(docs.sparkSession)

    def work(texts: list[str | None]) -> dict[str, np.ndarray]:
        # A few MB of text at a time.
        cuts = np.cumsum([len(t or "") for t in texts]) // 2_000_000
        found = [model.score([t for t, c in zip(texts, cuts, strict=True) if c == k]) for k in np.unique(cuts)]
        return {"score": np.concatenate(found) if found else np.zeros(0)}

    return with_text(docs.select("doc_id", *keep, "text"), "score double", lambda: work)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, learn(docs, labels.where(~held_out())), held_out().alias("held_out"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
