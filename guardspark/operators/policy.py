"""Policies as Column expressions: triggers, rules, and the outcome of their actions.

All enabled rules of all policies are judged, in declaration order; there is no first match. A rule that
fires is a ``FIRED`` struct; an outcome is what the fired rules' actions add up to.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.functions import text as T
from guardspark.sources.config import Action, Policy, Trigger

MODIFICATION = "struct<kind:string,content:string,position:string,span_start:int,span_end:int>"
AUDIT = "struct<rule:string,policy:string,category:string,severity:string,context:string>"
ADAPTATION = "struct<parameter:string,value:double,reason:string>"
USED = "array<struct<classifier:string,score:double>>"
FIRED = (
    f"struct<rule:string,policy:string,score:double,matched:string,classifier_scores:{USED},stop:boolean,stop_message:string,stop_status:int,"
    f"modifications:array<{MODIFICATION}>,audits:array<{AUDIT}>,adaptations:array<{ADAPTATION}>,logs:array<struct<level:string,message:string>>>"
)
SEVERITY = {"low": "info", "medium": "warning", "high": "high", "critical": "critical"}


class Verdict:
    """A compiled trigger: whether it holds, its score, what it matched and the classifier scores it read."""

    def __init__(self, holds: Column, score: Column, matched: Column, used: list[Column]):
        self.holds, self.score, self.matched, self.used = holds, score, matched, used


def no_match() -> Column:
    return F.lit(None).cast("string")


#: First matches that are columns already, by (pattern, case_insensitive).
Hits = dict[tuple[str, bool], Column]


def first_match(text: Column, pattern: str, case_insensitive: bool) -> Column:
    return T.first_if_any(text, pattern, "(?iuU)" if case_insensitive else "(?U)")


def pattern_trigger(text: Column, pattern: str, case_insensitive: bool, hits: Hits | None = None) -> Verdict:
    """A regular expression; one that the dialect rejects is looked for as a literal, which names no match."""
    if usable(pattern):
        hit = (hits or {}).get((pattern, case_insensitive))
        hit = first_match(text, pattern, case_insensitive) if hit is None else hit
        return Verdict(hit.isNotNull(), hit.isNotNull().cast("double"), hit, [])
    found = F.lower(text).contains(pattern.lower()) if case_insensitive else text.contains(pattern)
    return Verdict(found, found.cast("double"), F.when(found, F.lit(pattern)), [])


def usable(pattern: str) -> bool:
    """Whether the linear-time dialect would compile the pattern."""
    import re

    if T.REJECTED.search(pattern):
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def classifier_trigger(scores: Column | None, name: str, threshold: float) -> Verdict:
    """A score that is missing is 0 and false, and still counts in a composite's mean."""
    if scores is None:
        return Verdict(F.lit(False), F.lit(0.0), no_match(), [])
    score = F.try_element_at(scores, F.lit(name))
    used = F.when(score.isNotNull(), F.struct(F.lit(name).alias("classifier"), score.alias("score")))
    return Verdict(F.coalesce(score >= threshold, F.lit(False)), F.coalesce(score, F.lit(0.0)), no_match(), [used])


def context_trigger(text: Column, field: str, value: str) -> Verdict:
    """The literal ``field:value`` anywhere in the text, in any case."""
    found = F.lower(text).contains(f"{field}:{value}".lower())
    return Verdict(found, found.cast("double"), no_match(), [])


def combine(operator: str, parts: list[Verdict]) -> Verdict:
    """Every part is judged; the score is the mean over all, the match that of the last part with one."""
    if not parts:
        return Verdict(F.lit(False), F.lit(0.0), no_match(), [])
    holds = reduce((lambda a, b: a & b) if operator == "and" else (lambda a, b: a | b), [p.holds for p in parts])
    score = reduce(lambda a, b: a + b, [p.score for p in parts]) / float(len(parts))
    return Verdict(holds, score, F.coalesce(*[p.matched for p in reversed(parts)]), [u for p in parts for u in p.used])


def compile_trigger(t: Trigger, text: Column, scores: Column | None, hits: Hits | None = None) -> Verdict:
    if t.type == "pattern":
        return pattern_trigger(text, t.pattern, t.case_insensitive, hits)
    if t.type == "classifier":
        return classifier_trigger(scores, t.classifier, t.threshold)
    if t.type == "context":
        return context_trigger(text, t.field, t.value)
    return combine(t.operator, [compile_trigger(x, text, scores, hits) for x in t.triggers])


def modification(kind: str, content: str, position: str | None, spanned: Column) -> Column:
    at = F.when(spanned, 0)
    return F.struct(F.lit(kind).alias("kind"), F.lit(content).alias("content"), F.lit(position).cast("string").alias("position"), at.alias("span_start"), at.alias("span_end"))


def fired(rule: str, policy: str, actions: Iterable[Action], v: Verdict) -> Column:
    """What a rule's actions amount to. The last stop's message counts, even if it has none."""
    actions = list(actions)
    stops = [a for a in actions if a.type == "stop"]
    mods = [
        modification("redact", a.replacement, None, v.matched.isNotNull()) if a.type == "redact" else modification("inject", a.content, a.position, F.lit(False))
        for a in actions if a.type in ("redact", "inject")
    ]
    audits = [F.struct(F.lit(rule).alias("rule"), F.lit(policy).alias("policy"), F.lit(a.category).alias("category"), F.lit(a.severity).alias("severity"), v.matched.alias("context")) for a in actions if a.type == "audit"]
    adapts = [F.struct(F.lit(a.parameter.replace("_", "")).alias("parameter"), F.lit(float(a.value)).alias("value"), F.lit(f"Rule '{rule}' adaptation").alias("reason")) for a in actions if a.type == "adapt"]
    logs = [F.struct(F.lit(a.level).alias("level"), F.lit(a.message).alias("message")) for a in actions if a.type == "log"]
    used = F.array_compact(F.array(*v.used)) if v.used else F.array()
    return F.struct(
        F.lit(rule).alias("rule"), F.lit(policy).alias("policy"), v.score.alias("score"), v.matched.alias("matched"), used.cast(USED).alias("classifier_scores"),
        F.lit(bool(stops)).alias("stop"), F.lit(stops[-1].message if stops else None).cast("string").alias("stop_message"), F.lit(stops[-1].status_code if stops else None).cast("int").alias("stop_status"),
        F.array(*mods).cast(f"array<{MODIFICATION}>").alias("modifications"), F.array(*audits).cast(f"array<{AUDIT}>").alias("audits"),
        F.array(*adapts).cast(f"array<{ADAPTATION}>").alias("adaptations"), F.array(*logs).cast("array<struct<level:string,message:string>>").alias("logs"),
    )


def patterns(t: Trigger) -> list[tuple[str, bool]]:
    """The patterns below a trigger that the dialect takes."""
    if t.type == "composite":
        return [p for x in t.triggers for p in patterns(x)]
    return [(t.pattern, t.case_insensitive)] if t.type == "pattern" and usable(t.pattern) else []


def triggers(policies: Iterable[Policy]) -> list[Trigger]:
    """Those of the enabled rules."""
    return [r.trigger for p in policies for r in p.rules if r.enabled]


def classifiers(wanted: Iterable[Trigger]) -> set[str]:
    """The classifiers whose scores triggers read; a score that none reads need not be computed."""
    return {c for t in wanted for c in ([t.classifier] if t.type == "classifier" else classifiers(t.triggers) if t.type == "composite" else [])}


def with_evaluation(df: DataFrame, policies: list[Policy], text: str, scores: str | None, into: str = "triggered") -> DataFrame:
    """``df`` with :func:`evaluate` as ``into``. The first match of each distinct pattern is a column of its own, so it is looked for once a row."""
    wanted = dict.fromkeys(x for p in policies for r in p.rules if r.enabled for x in patterns(r.trigger))
    names = {x: f"_hit_{k}" for k, x in enumerate(wanted)}
    df = df.withColumns({n: first_match(F.col(text), *x) for x, n in names.items()}) if names else df
    found = evaluate(policies, F.col(text), None if scores is None else F.col(scores), {x: F.col(n) for x, n in names.items()})
    return df.withColumn(into, found).drop(*names.values())


def evaluate(policies: list[Policy], text: Column, scores: Column | None = None, hits: Hits | None = None) -> Column:
    """array<FIRED>: every enabled rule that holds, in order. Disabled rules never reach the plan."""
    rows = []
    for p in policies:
        for r in p.rules:
            if r.enabled:
                v = compile_trigger(r.trigger, text, scores, hits)
                rows.append(F.when(v.holds, fired(r.name, p.name, r.actions, v)))
    return (F.array_compact(F.array(*rows)) if rows else F.array()).cast(f"array<{FIRED}>")


def with_token_evaluation(df: DataFrame, policies: list[Policy], tokens: str, scores: str | None, into: str = "triggered") -> DataFrame:
    """As :func:`with_evaluation`, over tokens (structs with ``text``) joined without a separator, once a row."""
    joined = F.array_join(F.transform(tokens, lambda t: t["text"]), "")
    return with_evaluation(df.withColumn("_joined", joined), policies, "_joined", scores, into).drop("_joined")


def outcome(triggered: Column) -> Column:
    """Merge of the fired rules: the last stop with a message gives the message, the last stop the status; lists append."""
    stops = F.filter(triggered, lambda r: r["stop"])
    spoken = F.filter(stops, lambda r: r["stop_message"].isNotNull())
    return F.struct(
        (F.size(stops) > 0).alias("should_stop"), F.try_element_at(spoken, F.lit(-1))["stop_message"].alias("stop_message"),
        F.try_element_at(stops, F.lit(-1))["stop_status"].alias("stop_status"), F.flatten(F.transform(triggered, lambda r: r["modifications"])).alias("modifications"),
        F.flatten(F.transform(triggered, lambda r: r["audits"])).alias("audits"), F.flatten(F.transform(triggered, lambda r: r["adaptations"])).alias("adaptations"),
    )


class Engine:
    """Policies that are judged together, and what their fired rules add up to."""

    def __init__(self, policies: Iterable[Policy] = ()):
        self.policies = list(policies)

    def add(self, policy: Policy) -> Engine:
        self.policies.append(policy)
        return self

    def judge(self, df: DataFrame, text: str = "text", scores: str | None = None) -> DataFrame:
        """``df`` with ``triggered`` and ``outcome``."""
        df = with_evaluation(df, self.policies, text, scores)
        return df.withColumn("outcome", outcome(F.col("triggered")))


def has_actions(out: Column) -> Column:
    return out["should_stop"] | (F.size(out["modifications"]) > 0) | (F.size(out["audits"]) > 0) | (F.size(out["adaptations"]) > 0)


def severity(policy_severity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), policy_severity)
