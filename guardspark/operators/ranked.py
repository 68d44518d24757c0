"""Ranked rules as Column expressions: priority, first match, shadow mode and variables.

Rules are looked at in their order. One that fires ends the search unless it goes on; a shadow rule is only recorded and ends nothing; a
disabled one never reaches the plan. What counts adds up to the same outcome as the rules of plain policies.
"""

from __future__ import annotations

import re
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.operators import policy
from guardspark.sources.config import Policy
from guardspark.sources.inherit import RankedRule

VARIABLE = re.compile(r"\$\{(\w+)\}")


def rendered(text: Column, variables: dict[str, Column]) -> Column:
    """``text`` with ``${name}`` replaced; unknown names stay, null values become empty."""
    return reduce(lambda t, v: F.replace(t, F.lit("${" + v[0] + "}"), F.coalesce(v[1].cast("string"), F.lit(""))), variables.items(), text)


def with_ranked(df: DataFrame, rules: list[RankedRule], text: str, scores: str | None, phase: str | None = None, variables: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with ``triggered`` (what counts), ``shadowed`` (shadow rules that fired before the search ended) and ``outcome``.

    ``variables`` fill ``${...}`` in stop messages, injected content and log lines, beside ``rule_name`` and ``score`` of the rule itself.
    """
    live = [r for r in rules if r.mode != "disabled" and (phase is None or r.phase in (phase, "all"))]
    by_name = {r.rule.name: r for r in live}
    df = policy.with_evaluation(df, [Policy(r.policy, (replace(r.rule, enabled=True),)) for r in live], text, scores, "_all")
    named = lambda which: F.array(*[F.lit(n) for n, r in by_name.items() if which(r)]).cast("array<string>")
    ends = named(lambda r: r.mode == "enforce" and not r.goes_on)
    shadow = named(lambda r: r.mode == "shadow")
    # Rows of ``_all`` are in the order of the rules: the first that ends the search is the last that is looked at.
    df = df.withColumn("_end", F.array_position(F.transform("_all", lambda x: F.array_contains(ends, x["rule"])), True))
    df = df.withColumn("_seen", F.when(F.col("_end") > 0, F.slice("_all", F.lit(1), F.col("_end").cast("int"))).otherwise(F.col("_all")))
    df = df.withColumns({
        "triggered": F.filter("_seen", lambda x: ~F.array_contains(shadow, x["rule"])),
        "shadowed": F.transform(F.filter("_seen", lambda x: F.array_contains(shadow, x["rule"])), lambda x: x["rule"]),
    })
    if any(VARIABLE.search(t or "") for r in live for a in r.rule.actions for t in (a.message, a.content)):
        df = df.withColumn("triggered", F.transform("triggered", lambda x: filled(x, variables or {})))
    return df.withColumn("outcome", policy.outcome(F.col("triggered"))).drop("_all", "_end", "_seen")


def filled(x: Column, variables: dict[str, Column]) -> Column:
    """A fired rule with its texts rendered."""
    own = {**variables, "rule_name": x["rule"], "score": x["score"]}
    x = x.withField("stop_message", rendered(x["stop_message"], own))
    x = x.withField("modifications", F.transform(x["modifications"], lambda m: m.withField("content", rendered(m["content"], own))))
    return x.withField("logs", F.transform(x["logs"], lambda m: m.withField("message", rendered(m["message"], own))))
