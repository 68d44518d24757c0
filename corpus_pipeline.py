"""Corpus pipeline: language ID, exact dedup, MinHash near-dedup, source mixing, SentencePiece ids.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next
one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardspark.llm import common, exact_dedup, language_id, minhash, mixing, sentencepiece_codec

#: What SQL can't express (language profiles, Viterbi); tests compare with brute force.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts whose language is recognised: the profiles come from all rows with a language, and texts
    without letters (``und``) or further than ``LEAST_SCORE`` allows from every profile go."""
    profiles = language_id.learn(docs)
    lang, score = common.fresh("_lang", docs), common.fresh("_score", docs)
    found = language_id.identified(docs, profiles, (lang, score), keep_text=True)
    known = found.where((F.col(lang) != "und") & (F.col(score) >= language_id.LEAST_SCORE))
    return known.select(*[common.column(c) for c in docs.columns])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one text of each component of texts at a similarity of 0.8 or more."""
    return minhash.drop_near_copies(docs, minhash.STAGE)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the curriculum reads them; their order is its outcome."""
    return mixing.mixed_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids, in the order in which the mixing stage's result was written, whatever the order in which its files are read."""
    return sentencepiece_codec.encoded_ids(docs, sentencepiece_codec.model_path())


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("minhash_near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encode_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    before = None
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), name)
        if before is not None:
            common.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
