"""The demo rule set: content evaluation and request records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from guardspark.functions import lexicons as L
from guardspark.functions import text as T

ISSUE = "struct<issue_type:string,classifier:string,score:double,matched_text:string>"
VERDICT = f"struct<issues:array<{ISSUE}>,rules:array<string>,action:string>"


def issue(kind: str, classifier: str, score: Column, matched: Column) -> Column:
    return F.struct(F.lit(kind).alias("issue_type"), F.lit(classifier).alias("classifier"), score.alias("score"), matched.cast("string").alias("matched_text")).cast(ISSUE)


def base(text: Column) -> dict[str, Column]:
    """First matches by kind and the number of toxic words: what issues, rules and action are made of."""
    low = F.lower(text)
    one = lambda patterns: F.coalesce(*[T.first_if_any(text, p.removeprefix("(?i)"), "(?iuU)" if p.startswith("(?i)") else "(?U)") for p in patterns])
    return {
        **{f"pii_{k}": T.first_if_any(text, p, "(?U)") for k, p in L.DEMO_PII},
        "injection": one(L.DEMO_INJECTION), "advice": one(L.DEMO_ADVICE), "n_toxic": T.count_true([low.contains(w) for w in L.DEMO_TOXIC]),
    }


def with_evaluation(df: DataFrame, text: str, into: str) -> DataFrame:
    """``df`` with :func:`evaluate` as ``into``; its base is columns of their own, so each pattern is looked for once a row."""
    names = {k: f"_{into}_{k}" for k in base(F.col(text))}
    df = df.withColumns({names[k]: v for k, v in base(F.col(text)).items()})
    return df.withColumn(into, evaluate({k: F.col(n) for k, n in names.items()})).drop(*names.values())


def evaluate(b: dict[str, Column]) -> Column:
    """issues, rules, action from the base: PII redacts, an injection blocks whatever else, strong toxicity blocks what would pass, advice is only noted."""
    pii = [(k, b[f"pii_{k}"]) for k, _ in L.DEMO_PII]
    injection, advice, n_toxic = b["injection"], b["advice"], b["n_toxic"]
    score = F.least(n_toxic * 0.2, F.lit(1.0))
    strong = score > 0.8
    issues = [F.when(m.isNotNull(), issue(k, "pii_detector", F.lit(0.95), m)) for k, m in pii]
    issues.append(F.when(injection.isNotNull(), issue("prompt_injection", "prompt_injection_detector", F.lit(0.9), injection)))
    issues.append(F.when(n_toxic > 0, issue("toxicity", "toxicity_detector", score, F.lit(None))))
    issues.append(F.when(advice.isNotNull(), issue("financial_advice", "financial_advice_detector", F.lit(0.85), advice)))
    rules = [F.when(m.isNotNull(), "pii-detection") for _, m in pii]
    rules += [F.when(injection.isNotNull(), "prompt-injection-defense"), F.when(strong, "toxicity-filter"), F.when(advice.isNotNull(), "financial-advice-detection")]
    any_pii = F.coalesce(*[m for _, m in pii]).isNotNull()
    action = F.when(injection.isNotNull(), "block").when(any_pii, "redact").when(strong, "block").otherwise("pass")
    return F.struct(F.array_compact(F.array(*issues)).cast(f"array<{ISSUE}>").alias("issues"), F.array_compact(F.array(*rules)).alias("triggered_rules"), action.alias("action"))


def requests(turns: DataFrame) -> DataFrame:
    """Record of each user turn that an assistant turn follows: the conversation's user texts so far at ingress, the response at egress."""
    order = W.partitionBy("conv_id").orderBy("turn")
    user = F.when(F.col("role") == "user", F.col("text"))
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    rows = turns.withColumns({
        "asked": F.array_join(F.collect_list(user).over(so_far), " "), "previews": F.array_join(F.collect_list(F.substring(user, 1, 100)).over(so_far), " "),
        "response": F.lead("text").over(order), "next_role": F.lead("role").over(order),
    }).where("role = 'user' and next_role = 'assistant'")
    rows = with_evaluation(rows, "asked", "i").withColumn("blocked", F.col("i.action") == "block")
    rows = with_evaluation(rows, "response", "e")
    action = F.when(F.col("i.action") != "pass", F.col("i.action")).otherwise(F.col("e.action"))
    both = lambda f: F.when(F.col("blocked"), F.col(f"i.{f}")).otherwise(F.concat(f"i.{f}", f"e.{f}"))
    return rows.select(
        "conv_id", "turn", action.alias("action"), F.when(F.col("blocked"), "ingress").otherwise("egress").alias("phase"), both("issues").alias("issues"),
        both("triggered_rules").alias("triggered_rules"), F.col("previews").alias("request_preview"), F.when(~F.col("blocked"), F.substring("response", 1, 100)).alias("response_preview"),
    )


def listed(requests_: DataFrame, limit: int = 100, action: str | None = None, issue_type: str | None = None) -> DataFrame:
    """Newest first; the limit comes before the filters."""
    rows = requests_.orderBy(F.desc("ts"), F.desc("id")).limit(limit)
    if action:
        rows = rows.where(F.lower("action").contains(action.lower()))
    if issue_type:
        rows = rows.where(F.exists("issues", lambda x: F.lower(x["issue_type"]).contains(issue_type.lower())))
    return rows
