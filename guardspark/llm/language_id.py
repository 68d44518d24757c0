"""Language identification by rank-order profiles (operator 5).

A text's profile is the list of its most frequent character n-grams (1 to 3 letters inside words,
words padded with a space) in descending order of frequency, equal counts by code points. A
document is compared with each language's profile by the out-of-place distance: the sum over its
n-grams of how far each stands from its place in the language's list, ``PROFILE`` for an n-gram that
isn't there. The nearest language wins; equal distances go to the first name in code-point order.

The language profiles come from every training row (no sample): each task counts n-grams by language,
and the partial counts are summed by ``(lang, n-gram)``. Only the ``PROFILE`` most frequent of each
language, a few hundred numbers, reach the driver.

``score`` is 1 minus the distance over the largest possible one. A text is ``und`` with score 0 if it
is null or has no letter, or if there is nothing to learn from. Rows with null lang teach nothing;
rows that repeat count again; extra columns are ignored; an empty table gives an empty result; very long texts
are profiled whole; ids stay as they are (they never leave Arrow). Letters are the code points of Unicode's letter
categories (``str.isalpha``), so combining vowel signs part words; all texts are treated alike in this.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, session, text_batches, with_text

PROFILE = 300
#: Below this score a text is taken for none of the languages by :func:`known_language`.
LEAST_SCORE = 0.2
BITS = np.uint64(21)


@cache
def letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1- to 3-grams as packed code points, ascending, and their counts."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = letters()[code] if len(code) else np.zeros(0, bool)
    if not letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # Other characters become one space; runs of them collapse.
    keep = letter | np.concatenate(([True], letter[:-1]))
    code = np.where(letter, code, 32)[keep].astype(np.uint64)
    code = np.concatenate((np.array([32], np.uint64), code, np.array([32], np.uint64)))
    code = code[np.concatenate(([True], (code[1:] != 32) | (code[:-1] != 32)))]
    space = code == 32
    two = (code[:-1] << BITS) | code[1:]
    three = (two[:-1] << BITS) | code[2:]
    grams = np.concatenate((code[~space], two, three[~space[1:-1]]))
    return np.unique(grams, return_counts=True)


def profile(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent n-grams, in rank order."""
    return grams[np.argsort(-counts, kind="stable")[:PROFILE]]


def count_grams(rows: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of ``lang, text``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for langs, texts in text_batches(batches, "lang", "text"):
            got: dict[str, list] = {}
            for lang, text in zip(langs, texts, strict=True):
                got.setdefault(lang, []).append(ngrams(text))
            for lang, parts in got.items():
                parts = [*parts, held.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))]
                grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                held[lang] = grams, np.bincount(at, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)
        for lang, (grams, n) in held.items():
            yield pd.DataFrame({"lang": lang, "gram": grams.astype(np.int64), "n": n})

    return rows.mapInPandas(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(rows: DataFrame) -> dict[str, list[int]]:
    """Profile of each language from all rows of ``lang, text`` with a language."""
    session(rows.sparkSession)
    counts = count_grams(rows.where("lang is not null").select("lang", "text"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= PROFILE)
    profiles: dict[str, list[int]] = {}
    for r in sorted(ranked.select("lang", "rank", "gram").collect()):
        profiles.setdefault(r.lang, []).append(r.gram)
    return profiles


class Ranks:
    """All profiles as one sorted list of n-grams with their places by language."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.names = sorted(profiles)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.uint64))
        self.place = np.full((len(self.names), len(self.grams) + 1), -1, np.int64)
        for k, name in enumerate(self.names):
            self.place[k, np.searchsorted(self.grams, np.array(profiles[name], np.uint64))] = np.arange(len(profiles[name]))

    def nearest(self, text: str | None) -> tuple[str, float]:
        own = profile(*ngrams(text))
        if not len(own) or not self.names:
            return "und", 0.0
        at = np.searchsorted(self.grams, own)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != own] = len(self.grams)
        place = self.place[:, at]
        distance = np.where(place < 0, PROFILE, np.abs(place - np.arange(len(own)))).sum(1)
        best = int(distance.argmin())
        return self.names[best], float(1 - distance[best] / (PROFILE * len(own)))


def identify(docs: DataFrame, profiles: dict[str, list[int]], *keep: Column, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """doc_id, the columns ``keep``, the language and the score (named by ``into``) of every row."""
    return identified(docs.select("doc_id", *keep, "text"), profiles, into)


def identified(rows: DataFrame, profiles: dict[str, list[int]], into: tuple[str, str] = ("lang_pred", "score"), keep_text: bool = False) -> DataFrame:
    """``rows`` with the language and the score of ``text``, which stays if ``keep_text`` says so."""
    session(rows.sparkSession)

    def make():
        ranks = Ranks(profiles)

        def work(texts: list[str | None]) -> dict[str, list]:
            found = [ranks.nearest(t) for t in texts]
            return {into[0]: [x for x, _ in found], into[1]: [x for _, x in found]}

        return work

    return with_text(rows, f"`{into[0]}` string, `{into[1]}` double", make, keep_text=keep_text)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, learn(docs.where(~held_out())), held_out().alias("held_out"))
