"""The three phases: ingress (prompt), midstream (chunk with context) and egress (whole response)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from guardspark.sources.config import Policy

from . import context as C
from . import modify, policy, resume
from .pipelines import Pipeline, final, score_map

SAFETY, CHUNK = 0.7, 0.8
REDACTED = "[REDACTED]"


@dataclass
class Plan:
    """What a tenant runs: pipelines by phase, policies and thresholds."""

    ingress: Pipeline | None = None
    midstream: Pipeline | None = None
    egress: Pipeline | None = None
    policies: list[Policy] = field(default_factory=list)
    safety_threshold: float = SAFETY
    chunk_threshold: float = CHUNK
    context: C.ContextConfig = field(default_factory=lambda: C.ContextConfig(5, 100))
    tenant: str = "default"


def judged(df: DataFrame, pipeline: Pipeline | None, policies: list[Policy], classified: str, judged_text: str) -> DataFrame:
    """Adds results, scores, final_score, triggered and outcome. Scores are those that aggregation left."""
    df = (pipeline or Pipeline()).run(df, classified)
    df = df.withColumn("scores", score_map(F.col("results"))).withColumn("final_score", final(F.col("results"))["score"])
    df = policy.with_evaluation(df, policies, judged_text, "scores")
    return df.withColumn("outcome", policy.outcome(F.col("triggered")))


def over(score: Column, threshold: float) -> Column:
    """Strictly above; no score never is."""
    return F.coalesce(score > threshold, F.lit(False))


def ingress(df: DataFrame, plan: Plan, text: str = "text") -> DataFrame:
    df = judged(df, plan.ingress, plan.policies, text, text)
    return df.withColumn("blocked", F.col("outcome")["should_stop"] | over(F.col("final_score"), plan.safety_threshold))


def midstream(df: DataFrame, plan: Plan, chunk: str = "chunk", stream: str = "stream_id", seq: str = "seq") -> DataFrame:
    """Classifiers see the context, policy patterns only the chunk."""
    return midstream_judged(df.withColumn("context", C.context(F.col(chunk), plan.context, stream, seq)), plan, chunk)


def midstream_judged(df: DataFrame, plan: Plan, chunk: str = "chunk") -> DataFrame:
    """As :func:`midstream`, over rows that have their ``context`` already."""
    df = judged(df, plan.midstream, plan.policies, "context", chunk)
    out = F.col("outcome")
    redacted = out["should_stop"] | (F.size(out["modifications"]) > 0) | over(F.col("final_score"), plan.chunk_threshold)
    return df.withColumn("redacted", redacted).withColumn("output", F.when(redacted, REDACTED).otherwise(F.col(chunk)))


def egress(df: DataFrame, plan: Plan, text: str = "text") -> DataFrame:
    df = judged(df, plan.egress, plan.policies, text, text)
    df = df.withColumn("modified", modify.apply_service(F.col(text), F.col("outcome")["modifications"]))
    changed = F.size(F.col("outcome")["modifications"]) > 0
    return df.withColumn("finish_reason", F.when(changed, "content_filter"))


def stream_egress(df: DataFrame, plan: Plan, chunk: str = "chunk", stream: str = "stream_id", seq: str = "seq") -> DataFrame:
    """Midstream, then egress on the growing prefix of the chunks that midstream let through; output stops at the first stop.

    A chunk that midstream redacts is part of the prefix but isn't judged itself. The prefix is scanned from a small state (``resume``), so a stream
    costs its length; only for classifiers or patterns that can't be resumed does each row get its whole prefix.
    """
    df = midstream(df, plan, chunk, stream, seq).withColumn("mid_redacted", F.col("redacted"))
    df = df.drop("results", "scores", "final_score", "triggered", "outcome", "output")
    try:
        egress_scan = resume.scan_for(plan.egress, plan.policies)
    except ValueError:
        df = df.withColumn("prefix", C.prefix(F.col(chunk), stream, seq))
        df = judged(df, plan.egress, plan.policies, "prefix", "prefix").withColumn("stop", F.col("outcome")["should_stop"])
    else:
        df = egress_scan.verdict(resume.scanned(df, egress_scan.scan, chunk, stream, seq))
    df = df.withColumn("stop", ~F.col("mid_redacted") & F.col("stop"))
    return C.cutoff(df, "stop", chunk, stream, seq).withColumn("output", F.when(F.col("mid_redacted"), REDACTED).otherwise(F.col("output")))


def for_tenants(df: DataFrame, plans: dict[str, Plan], phase: Callable[[DataFrame, Plan], DataFrame], tenant: str = "tenant") -> DataFrame:
    """Each tenant's rows through ``phase`` under its own plan; rows of a tenant without one under ``default``.

    The plans are side by side in one query, each a narrow projection behind a filter.
    """
    named = [t for t in plans if t != "default"]
    rest = df.where(~F.coalesce(F.col(tenant).isin(named), F.lit(False)))
    parts = [phase(rest, plans["default"]), *[phase(df.where(F.col(tenant) == t), plans[t]) for t in named]]
    return reduce(DataFrame.unionByName, parts)


def blocked_response(out: Column, model: Column) -> Column:
    """status and JSON body of a refusal, with the default texts."""
    message = F.coalesce(out["stop_message"], F.concat(F.lit("Request for model '"), model, F.lit("' blocked due to safety policies.")))
    body = F.to_json(F.struct(F.struct(message.alias("message"), F.lit("policy_violation").alias("type")).alias("error")))
    return F.struct(F.coalesce(out["stop_status"], F.lit(403)).alias("status"), message.alias("message"), body.alias("body"))


def end_to_end(turns: DataFrame, plan: Plan, model: str = "model-1") -> DataFrame:
    """Each user turn with the assistant turn that follows: ingress; if it passes, egress on the response."""
    order = W.partitionBy("conv_id").orderBy("turn")
    pairs = turns.withColumn("response", F.lead("text").over(order)).withColumn("next_role", F.lead("role").over(order))
    pairs = pairs.where((F.col("role") == "user") & (F.col("next_role") == "assistant")).select("conv_id", "turn", F.col("text").alias("prompt"), "response")
    first = ingress(pairs, plan, "prompt").withColumn("refusal", blocked_response(F.col("outcome"), F.lit(model)))
    first = first.select("conv_id", "turn", "response", F.col("blocked"), "refusal")
    done = egress(first, plan, "response")
    return done.select(
        "conv_id", "turn", "blocked", F.when(F.col("blocked"), F.col("refusal.status")).otherwise(200).alias("status"),
        F.when(F.col("blocked"), F.col("refusal.message")).otherwise(F.col("modified")).alias("output"),
        F.when(~F.col("blocked"), F.col("finish_reason")).alias("finish_reason"),
    )


def last_prompt(turns: DataFrame) -> DataFrame:
    """The last user turn of each conversation, null if there is none."""
    return turns.groupBy("conv_id").agg(F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("prompt"))


PlanFor = Callable[[str], Plan]
