"""Ordered context over a stream's chunks, in batch: windows by stream and sequence number.

Chunks of one stream meet in one task, as their order demands; streams spread over all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


@dataclass(frozen=True)
class ContextConfig:
    """``context_chunks`` = 0: all that the buffer holds."""

    context_chunks: int = 3
    max_buffer_size: int = 100
    delimiter: str = " "

    @classmethod
    def entire(cls) -> ContextConfig:
        return cls(0, 1000)

    @classmethod
    def none(cls) -> ContextConfig:
        return cls(1, 10)

    @classmethod
    def window(cls, n: int) -> ContextConfig:
        return cls(n, max(n, 100))

    @property
    def rows(self) -> int:
        return min(self.context_chunks or self.max_buffer_size, self.max_buffer_size)


def ordered(stream: str, seq: str) -> WindowSpec:
    return W.partitionBy(stream).orderBy(seq)


def context(chunk: Column, config: ContextConfig, stream: str = "stream_id", seq: str = "seq") -> Column:
    """The chunks that a classifier sees with this one, joined."""
    return F.array_join(F.collect_list(chunk).over(ordered(stream, seq).rowsBetween(-(config.rows - 1), 0)), config.delimiter)


def buffered(config: ContextConfig, stream: str = "stream_id", seq: str = "seq") -> Column:
    """How many chunks the buffer holds after this one."""
    return F.least(F.row_number().over(ordered(stream, seq)), F.lit(config.max_buffer_size))


def prefix(chunk: Column, stream: str = "stream_id", seq: str = "seq") -> Column:
    """All chunks so far without a delimiter."""
    return F.array_join(F.collect_list(chunk).over(ordered(stream, seq).rowsBetween(W.unboundedPreceding, 0)), "")


def token_window(token: Column, n: int, stream: str = "stream_id", seq: str = "seq") -> Column:
    return F.collect_list(token).over(ordered(stream, seq).rowsBetween(-(n - 1), 0))


def held_back(df: DataFrame, text: str, hold: int, stream: str = "stream_id", seq: str = "seq") -> DataFrame:
    """``released``: what leaves when this row arrives (``hold`` rows late); ``n_releasable``: how many have left by then."""
    n = F.row_number().over(ordered(stream, seq))
    released = F.lag(text, hold).over(ordered(stream, seq)) if hold else F.col(text)
    return df.withColumns({"n_releasable": F.greatest(n - hold, F.lit(0)), "released": released})


def flushed(df: DataFrame, text: str, hold: int, stream: str = "stream_id", seq: str = "seq") -> DataFrame:
    """The rows still held when each stream ends."""
    from_end = F.row_number().over(W.partitionBy(stream).orderBy(F.desc(seq)))
    return df.withColumn("_r", from_end).where(F.col("_r") <= hold).drop("_r")


def over_capacity(capacity: int, stream: str = "stream_id", seq: str = "seq") -> Column:
    """Error text for the rows that a buffer of this capacity refuses."""
    n = F.row_number().over(ordered(stream, seq))
    return F.when(n > capacity, F.format_string(f"buffer capacity exceeded: {capacity}"))


def cutoff(df: DataFrame, stop: str, text: str, stream: str = "stream_id", seq: str = "seq") -> DataFrame:
    """Rows before a stream's first stop pass, the stopping one is redacted, later ones are dropped."""
    first = F.min(F.when(F.col(stop), F.col(seq))).over(W.partitionBy(stream))
    out = df.withColumn("_first", first).where(F.col("_first").isNull() | (F.col(seq) <= F.col("_first")))
    return out.withColumn("output", F.when(F.col("_first") == F.col(seq), "[REDACTED]").otherwise(F.col(text))).drop("_first")
