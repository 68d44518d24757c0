"""Drift of what is said: token distributions as sketches that add up, and their distance from a baseline.

A sketch is a histogram of the tokens' hashes over ``BUCKETS`` buckets, one row a key and bucket that occurs. Sketches of parts are merged by
adding them, so Spark combines them before the shuffle, a stream can add micro-batches to a table of them, and a conversation's is as
small as its words are few. Distances smooth every bucket by one; the buckets that a key lacks are dealt with in closed form.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.functions import lexicons as L
from guardspark.functions import text as T

BUCKETS = 256
#: A token is common if it makes up at least this share of the baseline; so there are at most ``1 / COMMON_SHARE`` of them.
COMMON_SHARE = 1e-4
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def bucket(token: Column) -> Column:
    return (F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long") % BUCKETS).cast("int")


def counted(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Keys, token, n: how often each token occurs."""
    return df.select(*keys, F.explode(tokens(F.col(text))).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """The sketch of several ones."""
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.sum("rare").alias("rare"))


@dataclass
class Baseline:
    """Smoothed shares by bucket, tokens that are common, and mean sentiment."""

    shares: DataFrame
    common: DataFrame
    sentiment: float
    #: Sums over all buckets of ln q and q ln q.
    logs: tuple[float, float]

    @classmethod
    def of(cls, df: DataFrame, text: str = "text") -> Baseline:
        spark = df.sparkSession
        words = counted(df, text=text).withColumn("bucket", bucket(F.col("token")))
        # At most BUCKETS rows.
        found = {r.bucket: r.n for r in words.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
        total = sum(found.values())
        q = [(found.get(b, 0) + 1) / (total + BUCKETS) for b in range(BUCKETS)]
        shares = spark.createDataFrame(list(enumerate(q)), "bucket int, q double")
        common = words.where(F.col("n") >= COMMON_SHARE * total).select("token", F.lit(True).alias("common"))
        pos, neg = df.agg(F.sum(T.count_any(F.col(text), L.POSITIVE)), F.sum(T.count_any(F.col(text), L.NEGATIVE))).first()
        return cls(shares, common, pos / (pos + neg) if pos or neg else 0.5, (sum(map(math.log, q)), sum(x * math.log(x) for x in q)))

    def sketch(self, df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
        """Keys, bucket, n, rare: occurrences of tokens, and of those that aren't common in the baseline."""
        words = df.select(*keys, F.explode(tokens(F.col(text))).alias("token")).join(F.broadcast(self.common), "token", "left")
        return words.groupBy(*keys, bucket(F.col("token")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("common").isNull()).alias("rare"))

    def distances(self, sketches: DataFrame, *keys: str) -> DataFrame:
        """Keys, n_tokens, kl, psi, rare_ratio. A key without tokens has no row."""
        rows = sketches.join(F.broadcast(self.shares), "bucket")
        # At most BUCKETS cells a key.
        rows = rows.groupBy(*keys).agg(F.sum("n").alias("n_tokens"), F.sum("rare").alias("rare"), F.count(F.lit(1)).alias("present"), F.collect_list(F.struct("n", "q")).alias("cells"))
        size = (F.col("n_tokens") + BUCKETS).cast("double")
        p, p0 = lambda c: (c["n"] + 1) / size, 1 / size
        over = lambda f: F.aggregate("cells", F.lit(0.0), lambda a, c: a + f(c))
        absent = F.lit(float(BUCKETS)) - F.col("present")
        log_absent = self.logs[0] - over(lambda c: F.log(c["q"]))
        kl = over(lambda c: p(c) * F.log(p(c) / c["q"])) + p0 * (absent * F.log(p0) - log_absent)
        # The same from the baseline's side: its absent buckets weigh what is left of it.
        left, left_log = 1 - over(lambda c: c["q"]), self.logs[1] - over(lambda c: c["q"] * F.log(c["q"]))
        back = over(lambda c: c["q"] * F.log(c["q"] / p(c))) + left_log - left * F.log(p0)
        return rows.select(*keys, "n_tokens", kl.alias("kl"), (kl + back).alias("psi"), (F.col("rare") / F.col("n_tokens")).alias("rare_ratio"))


def sentiment(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Keys, sentiment: the share of positive words among those that judge, 0.5 without any."""
    rows = df.groupBy(*keys).agg(F.sum(T.count_any(F.col(text), L.POSITIVE)).alias("pos"), F.sum(T.count_any(F.col(text), L.NEGATIVE)).alias("neg"))
    return rows.select(*keys, F.when(F.col("pos") + F.col("neg") > 0, F.try_divide("pos", F.col("pos") + F.col("neg"))).otherwise(0.5).alias("sentiment"))


def drift(df: DataFrame, baseline: Baseline, *keys: str, text: str = "text", limit: float = 0.7) -> DataFrame:
    """Keys, n_tokens, kl, psi, rare_ratio, sentiment_shift, score, drifted; the score weighs divergence 0.4, sentiment and rare tokens 0.3 each."""
    far = baseline.distances(baseline.sketch(df, *keys, text=text), *keys)
    rows = far.join(sentiment(df, *keys, text=text), list(keys)).withColumn("sentiment_shift", F.abs(F.col("sentiment") - baseline.sentiment)).drop("sentiment")
    score = 0.4 * (1 - F.exp(-F.col("kl"))) + 0.3 * F.col("sentiment_shift") + 0.3 * F.col("rare_ratio")
    return rows.withColumn("score", score).withColumn("drifted", F.col("score") > limit)
