"""Midstream holdback: tokens leave only once the text around them has been judged.

Every ``interval`` tokens (and at a stream's end) the held tokens are judged, together with ``hold`` tokens that have left already, so
that a match which began there is still seen whole. What a redaction rule matches is hidden, wherever the token borders lie: the token in
which a match begins shows the replacement, the others what lies outside of the match. Then all but the last ``hold`` tokens leave. A stop
ends the stream: its held tokens never leave, and the stop's message stands in their place.

A match is seen if it spans at most ``hold + 1`` tokens, so nothing of it has left before it is judged. What has to be kept of a stream is
``2 * hold + interval`` tokens, however long it is. In batch that is one frame of a window, in a stream the state; both give the same rows
(a *window*: stream, check and tokens), and the judgement is a projection over them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from guardspark.functions import text as T
from guardspark.operators import policy
from guardspark.operators.phases import REDACTED, Plan, judged, over
from guardspark.sources.config import Policy, Trigger

STOPPED = "[STOPPED]"
PARTS = "array<struct<k:bigint,seq:bigint,token:string>>"
WINDOW = f"stream_id bigint, check bigint, final boolean, parts {PARTS}"


@dataclass(frozen=True)
class Holdback:
    """Tokens held back, and how many come between two judgements."""

    hold: int = 16
    interval: int = 8

    @property
    def kept(self) -> int:
        """Tokens that a judgement sees at most."""
        return 2 * self.hold + self.interval

    def oldest(self, check: int | Column) -> int | Column:
        """Number of the first token that a check sees, or less."""
        return (check - 1) * self.interval - 2 * self.hold + 1

    def leaves(self, check: int | Column) -> tuple:
        """Numbers after the last token that had left before a check, and after the last that leaves with it if it isn't the final one."""
        return (check - 1) * self.interval - self.hold, check * self.interval - self.hold


def windows(tokens: DataFrame, h: Holdback, token: str = "token", stream: str = "stream_id", seq: str = "seq") -> DataFrame:
    """The windows of whole streams, ``WINDOW``; null tokens are empty.

    The tokens between two checks are one row before a frame looks back over them, so no token has a window of its own.
    """
    order = W.partitionBy("stream_id").orderBy("seq")
    rows = tokens.select(F.col(stream).cast("long").alias("stream_id"), F.col(seq).cast("long").alias("seq"), F.coalesce(token, F.lit("")).alias("token"))
    rows = rows.withColumn("k", F.row_number().over(order).cast("long")).withColumn("check", F.ceil(F.col("k") / h.interval))
    # Grouped by what the window is partitioned by and more: no further shuffle.
    rows = rows.groupBy("stream_id", "check").agg(F.sort_array(F.collect_list(F.struct("k", "seq", "token"))).alias("own"))
    order = W.partitionBy("stream_id").orderBy("check")
    rows = rows.withColumn("final", F.lead("check").over(order).isNull())
    rows = rows.withColumn("parts", F.flatten(F.collect_list("own").over(order.rowsBetween(-((h.kept - 1) // h.interval), 0))))
    return rows.select("stream_id", "check", "final", F.filter("parts", lambda p: p["k"] >= h.oldest(F.col("check"))).alias("parts"))


def alternatives(triggers: list[Trigger]) -> list[str]:
    """The patterns below triggers, each with its own case rule."""
    found = dict.fromkeys(x for t in triggers for x in policy.patterns(t))
    return [f"(?iu:{p})" if insensitive else f"(?:{p})" for p, insensitive in found]


def hidden_pattern(policies: list[Policy]) -> str | None:
    """What the enabled redaction rules match, as one alternation: the leftmost match counts, and of those that of the first rule."""
    rules = [r.trigger for p in policies for r in p.rules if r.enabled and any(a.type == "redact" for a in r.actions)]
    parts = alternatives(rules)
    return "(?U)" + "|".join(parts) if parts else None


def with_offsets(parts: Column) -> Column:
    """Parts with ``at``: the characters of the window before each."""
    lengths = F.transform(parts, lambda p: F.length(p["token"]))
    return F.transform(parts, lambda p, i: p.withField("at", F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, x: a + x)))


def shown(part: Column, text: Column, spans: Column, replacement: str) -> Column:
    """A part's token without what ``spans`` (characters of the window's ``text``) hide."""
    end = part["at"] + F.length(part["token"])
    own = F.filter(spans, lambda s: (s["start"] < end) & (s["end"] > part["at"]))
    piece = lambda a, b: F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))

    def before(s: Column, i: Column) -> Column:
        open_ = F.when(i == 0, part["at"]).otherwise(F.get(own, i - 1)["end"])
        return F.concat(piece(open_, s["start"]), F.when(s["start"] >= part["at"], replacement).otherwise(""))

    last = F.coalesce(F.try_element_at(own, F.lit(-1))["end"], part["at"])
    return F.when(F.size(own) == 0, part["token"]).otherwise(F.concat(F.array_join(F.transform(own, before), ""), piece(last, end)))


def judge(wins: DataFrame, h: Holdback, plan: Plan, replacement: str = REDACTED) -> DataFrame:
    """Windows with ``stop``, ``message`` and ``leaving`` (seq and output of each token that leaves): a narrow projection.

    The egress pipeline and the policies judge a window's text; a score above the chunk threshold stops as well.
    """
    df = wins.withColumn("held", F.array_join(F.transform("parts", lambda p: p["token"]), ""))
    df = judged(df, plan.egress, plan.policies, "held", "held")
    stop = F.col("outcome.should_stop") | over(F.col("final_score"), plan.chunk_threshold)
    pattern = hidden_pattern(plan.policies)
    # Most windows have nothing to hide, and places are dear to count.
    hit = F.lit(False) if pattern is None else F.col("held").rlike(pattern)
    df = df.withColumns({"stop": stop, "message": F.coalesce("outcome.stop_message", F.lit(STOPPED)), "hit": hit})
    none = F.array().cast(T.SPAN)
    spans = none if pattern is None else F.when(F.col("hit"), T.all_spans(F.col("held"), pattern, length=F.length)).otherwise(none)
    placed = F.when(F.col("hit"), with_offsets(F.col("parts"))).otherwise(F.transform("parts", lambda p: p.withField("at", F.lit(0))))
    df = df.withColumns({"spans": spans, "placed": placed})
    low, high = h.leaves(F.col("check"))
    leaving = F.filter("placed", lambda p: (p["k"] > low) & (F.col("final") | (p["k"] <= high)))
    out = F.transform(leaving, lambda p: F.struct(p["seq"].alias("seq"), shown(p, F.col("held"), F.col("spans"), replacement).alias("output")))
    return df.select("stream_id", "check", F.get("parts", F.size("parts") - 1)["seq"].alias("last_seq"), "stop", "message", out.alias("leaving"))


def released(df: DataFrame, first_stop: str = "first_stop") -> DataFrame:
    """Rows that leave: every token that leaves before its stream's first stop (null if there is none), and the stop's message at the check's last token."""
    df = df.where(F.col(first_stop).isNull() | (F.col("check") <= F.col(first_stop)))
    stopped = F.coalesce(F.col("check") == F.col(first_stop), F.lit(False))
    rows = F.when(stopped, F.array(F.struct(F.col("last_seq").alias("seq"), F.col("message").alias("output")))).otherwise(F.col("leaving"))
    return df.select("stream_id", "check", stopped.alias("stopped"), F.explode(rows).alias("row")).select("stream_id", "row.seq", "check", "stopped", "row.output")


def release(tokens: DataFrame, h: Holdback, plan: Plan, token: str = "token", stream: str = "stream_id", seq: str = "seq") -> DataFrame:
    """stream_id, seq, check, stopped, output of whole streams."""
    df = judge(windows(tokens, h, token, stream, seq), h, plan)
    first = F.min(F.when(F.col("stop"), F.col("check"))).over(W.partitionBy("stream_id"))
    return released(df.withColumn("first_stop", first))
