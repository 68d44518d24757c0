"""Queries: triggers, policies, actions, modification appliers and the three phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardspark.operators import classifiers as C
from guardspark.operators import modify, phases
from guardspark.operators import pipelines as P
from guardspark.operators import policy as R
from guardspark.plans import fixtures as X
from guardspark.plans import oracle as O
from guardspark.plans.catalog import query
from guardspark.plans.shipped import CONSUMER_DUTY, DEFAULT, PIPELINES
from guardspark.sources.config import Action, Policy, Rule, Trigger

TOX = Trigger("classifier", classifier="toxicity", threshold=0.35)
NONE = Trigger("classifier", classifier="nobody", threshold=0.1)
GREAT = Trigger("pattern", pattern="great|wonderful")
LOOSE = Trigger("pattern", pattern="SYSTEM|you are", case_insensitive=True)
LITERAL = Trigger("pattern", pattern="(?=isa)", case_insensitive=True)
LENGTH = Trigger("context", field="response_length", value=">200")


SCORERS = ("toxicity", "sentiment", "pii_detector", "prompt-injection", "financial-advice")


def scored(spark: SparkSession, sf: str, triggers: list[Trigger] | None = None) -> DataFrame:
    """Guard texts with a map of the scores of all five classifiers, or of those that ``triggers`` read."""
    known = C.built_in()
    read = SCORERS if triggers is None or "_final" in R.classifiers(triggers) else R.classifiers(triggers)
    p = P.Pipeline().sequential("s", [(k, known[k]) for k in SCORERS if k in read])
    df = p.run(X.guard(spark, sf))
    return df.withColumn("scores", P.score_map(F.col("results"))).drop("results")


def verdict(spark: SparkSession, sf: str, t: Trigger) -> DataFrame:
    v = R.compile_trigger(t, F.col("text"), F.col("scores"))
    return scored(spark, sf, [t]).select("text_id", v.holds.alias("holds"), F.round(v.score, 6).alias("score"), v.matched.alias("matched"))


def triggered_sql(holds: str, score: str, matched: str) -> str:
    return X.sql("guard", f", {O.SCORED} SELECT text_id, {holds} AS holds, round({score}, 6)::DOUBLE AS score, {matched} AS matched FROM scored")


_GREAT, _LOOSE = O.first("text", "great|wonderful"), O.first("text", "(?i)SYSTEM|you are")
_TRIGGERS = {
    "trg_pattern": (LOOSE, f"{_LOOSE} IS NOT NULL", f"({_LOOSE} IS NOT NULL)::INT", _LOOSE),
    "trg_pattern_literal": (LITERAL, "contains(lower(text), '(?=isa)')", "contains(lower(text), '(?=isa)')::INT", "CASE WHEN contains(lower(text), '(?=isa)') THEN '(?=isa)' END"),
    "trg_classifier": (TOX, "tox >= 0.35", "tox", "NULL::VARCHAR"),
    "trg_classifier_missing": (NONE, "false", "0.0", "NULL::VARCHAR"),
    "trg_context": (LENGTH, "contains(lower(text), 'response_length:>200')", "contains(lower(text), 'response_length:>200')::INT", "NULL::VARCHAR"),
    "trg_and": (Trigger("composite", operator="and", triggers=(TOX, LOOSE, NONE)), "false", f"(tox + ({_LOOSE} IS NOT NULL)::INT) / 3", _LOOSE),
    "trg_or": (Trigger("composite", operator="or", triggers=(GREAT, TOX, LOOSE)), f"({_GREAT} IS NOT NULL OR tox >= 0.35 OR {_LOOSE} IS NOT NULL)", f"(({_GREAT} IS NOT NULL)::INT + tox + ({_LOOSE} IS NOT NULL)::INT) / 3", f"coalesce({_LOOSE}, {_GREAT})"),
    "trg_nested": (Trigger("composite", operator="or", triggers=(LENGTH, Trigger("composite", operator="and", triggers=(GREAT, TOX)))), f"(contains(lower(text), 'response_length:>200') OR ({_GREAT} IS NOT NULL AND tox >= 0.35))", f"(contains(lower(text), 'response_length:>200')::INT + (({_GREAT} IS NOT NULL)::INT + tox) / 2) / 2", _GREAT),
    "trg_empty": (Trigger("composite", operator="and"), "false", "0.0", "NULL::VARCHAR"),
    "agg_composite_score": (Trigger("composite", operator="and", triggers=(TOX, LENGTH)), "(tox >= 0.35 AND contains(lower(text), 'response_length:>200'))", "(tox + contains(lower(text), 'response_length:>200')::INT) / 2", "NULL::VARCHAR"),
}
for _name, (_t, _holds, _score, _matched) in _TRIGGERS.items():
    query(_name, triggered_sql(_holds, _score, _matched))(lambda spark, sf, t=_t: verdict(spark, sf, t))


def rule(name: str, trigger: Trigger, *actions: Action, enabled: bool = True) -> Rule:
    return Rule(name, trigger, tuple(actions), enabled=enabled)


#: A policy that uses every action.
ALL = Policy("all", (
    rule("r1", GREAT, Action("log", message="nice"), Action("inject", content="<< ", position="before"), Action("adapt", parameter="top_p", value=0.5)),
    rule("r2", LOOSE, Action("stop", message="no", status_code=451), Action("audit", category="role", severity="critical")),
    rule("r3", TOX, Action("stop"), Action("redact", replacement="[x]"), Action("audit", category="toxic", severity="low")),
    rule("r4", Trigger("pattern", pattern="idiot"), Action("inject", content=" >>"), Action("redact")),
    rule("r5", GREAT, Action("stop", message="never", status_code=418), enabled=False),
    rule("r6", Trigger("pattern", pattern="pirate"), Action("inject", content="replaced", position="replace"), Action("adapt", parameter="temperature", value=0.1)),
))
_R = {"r1": f"{_GREAT} IS NOT NULL", "r2": f"{_LOOSE} IS NOT NULL", "r3": "tox >= 0.35", "r4": "contains(text, 'idiot')", "r6": "contains(text, 'pirate')"}


def listed(values: list[str]) -> str:
    return f"list_filter([{', '.join(values)}], lambda x: x IS NOT NULL)"


def when(r: str, value: str) -> str:
    return f"CASE WHEN {_R[r]} THEN {value} END"


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    df = R.with_evaluation(scored(spark, sf, R.triggers([ALL])), [ALL], "text", "scores", "t")
    return df.withColumn("o", R.outcome(F.col("t")))


def policy_sql(select: str) -> str:
    return X.sql("guard", f", {O.SCORED} SELECT text_id, {select} FROM scored")


_FIRED = f"array_to_string({listed([when(r, X.literal(r)) for r in _R])}, '|')"


@query("pol_eval_text", policy_sql(f"{_FIRED} AS rules, len({listed([when(r, X.literal(r)) for r in _R])})::BIGINT AS n"))
def pol_eval_text(spark: SparkSession, sf: str) -> DataFrame:
    return evaluated(spark, sf).select("text_id", F.array_join("t.rule", "|").alias("rules"), F.size("t").cast("long").alias("n"))


@query("pol_eval_tokens", X.sql("texts", f"SELECT text_id, {O.rx('text', '(?i)SYSTEM|you are')} AS fired FROM texts"))
def pol_eval_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Texts cut into tokens of five characters and judged as tokens."""
    tokens = F.transform(F.regexp_extract_all("text", F.lit("(?s).{1,5}"), F.lit(0)), lambda t: F.struct(t.alias("text")))
    df = X.texts(spark, sf).select("text_id", tokens.alias("tokens"))
    df = R.with_token_evaluation(df, [Policy("p", (rule("r", LOOSE, Action("redact")),))], "tokens", None, "fired")
    return df.select("text_id", (F.size("fired") > 0).alias("fired"))


@query("pol_enabled", policy_sql("false AS disabled_fired"))
def pol_enabled(spark: SparkSession, sf: str) -> DataFrame:
    return evaluated(spark, sf).select("text_id", F.exists("t", lambda r: r["rule"] == "r5").alias("disabled_fired"))


@query("pol_scores", policy_sql("CASE WHEN tox >= 0.35 THEN 'toxicity=' || round(tox, 6) END AS used"))
def pol_scores(spark: SparkSession, sf: str) -> DataFrame:
    used = F.flatten(F.transform("t", lambda r: r["classifier_scores"]))
    text = F.array_join(F.transform(used, lambda u: F.concat_ws("=", u["classifier"], F.round(u["score"], 6).cast("string"))), "|")
    return evaluated(spark, sf).select("text_id", F.nullif(text, F.lit("")).alias("used"))


@query("jn_scores", X.sql("guard", f""", {O.SCORED}, rules AS (SELECT * FROM (VALUES ('a', 'toxicity', 0.35), ('b', 'sentiment', 0.9), ('c', 'pii_detector', 0.5)) AS r(rule, classifier, threshold)),
long AS (SELECT text_id, 'toxicity' AS classifier, tox AS score FROM scored UNION ALL SELECT text_id, 'sentiment', sent FROM scored UNION ALL SELECT text_id, 'pii_detector', pii FROM scored)
SELECT rule, count(*) AS n, count(*) FILTER (WHERE score >= threshold) AS fired FROM long JOIN rules USING (classifier) GROUP BY rule"""))  # fmt: skip
def jn_scores(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame([("a", "toxicity", 0.35), ("b", "sentiment", 0.9), ("c", "pii_detector", 0.5)], "rule string, classifier string, threshold double")
    # The outer form: Spark infers no filter from it, which would hold all that the scores are made of once more.
    long = scored(spark, sf).select(F.explode_outer("scores").alias("classifier", "score"))
    return long.join(rules, "classifier").groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= F.col("threshold")).alias("fired"))


_STOP = f"({_R['r2']} OR {_R['r3']})"


@query("act_stop", policy_sql(f"{_STOP} AS should_stop, CASE WHEN {_R['r2']} THEN 'no' END AS message, CASE WHEN {_R['r3']} THEN 403 WHEN {_R['r2']} THEN 451 END::INT AS status"))
def act_stop(spark: SparkSession, sf: str) -> DataFrame:
    return evaluated(spark, sf).select("text_id", "o.should_stop", F.col("o.stop_message").alias("message"), F.col("o.stop_status").alias("status"))


query("act_merge", policy_sql(f"""{_STOP} AS should_stop, CASE WHEN {_R['r2']} THEN 'no' END AS message, CASE WHEN {_R['r3']} THEN 403 WHEN {_R['r2']} THEN 451 END::INT AS status,
  len({listed([when('r1', '1'), when('r3', '1'), when('r4', '1'), when('r4', '2'), when('r6', '1')])})::BIGINT AS n_mods, len({listed([when('r2', '1'), when('r3', '1')])})::BIGINT AS n_audits"""))(
    lambda spark, sf: evaluated(spark, sf).select(
        "text_id", "o.should_stop", F.col("o.stop_message").alias("message"), F.col("o.stop_status").alias("status"), F.size("o.modifications").cast("long").alias("n_mods"), F.size("o.audits").cast("long").alias("n_audits")
    )
)


@query("act_redact", policy_sql(f"array_to_string({listed([when('r3', X.literal('[x]:')), when('r4', X.literal('[REDACTED]:0-0'))])}, '|') AS redactions"))
def act_redact(spark: SparkSession, sf: str) -> DataFrame:
    mods = F.filter("o.modifications", lambda m: m["kind"] == "redact")
    text = F.transform(mods, lambda m: F.concat(m["content"], F.lit(":"), F.coalesce(F.concat_ws("-", m["span_start"].cast("string"), F.when(m["span_start"].isNotNull(), m["span_end"].cast("string"))), F.lit(""))))
    return evaluated(spark, sf).select("text_id", F.array_join(text, "|").alias("redactions"))


@query("act_inject", policy_sql(f"array_to_string({listed([when('r1', X.literal('before:<< ')), when('r4', X.literal('after: >>')), when('r6', X.literal('replace:replaced'))])}, '|') AS injections"))
def act_inject(spark: SparkSession, sf: str) -> DataFrame:
    mods = F.filter("o.modifications", lambda m: m["kind"] == "inject")
    return evaluated(spark, sf).select("text_id", F.array_join(F.transform(mods, lambda m: F.concat_ws(":", m["position"], m["content"])), "|").alias("injections"))


@query("act_adapt", policy_sql(f"array_to_string({listed([when('r1', X.literal('topp=0.5')), when('r6', X.literal('temperature=0.1'))])}, '|') AS adaptations"))
def act_adapt(spark: SparkSession, sf: str) -> DataFrame:
    return evaluated(spark, sf).select("text_id", F.array_join(F.transform("o.adaptations", lambda a: F.concat_ws("=", a["parameter"], a["value"].cast("string"))), "|").alias("adaptations"))


_AUDIT_R2 = f"'r2:role:critical:' || {_LOOSE}"


@query("act_audit", policy_sql(f"array_to_string({listed([when('r2', _AUDIT_R2), when('r3', X.literal('r3:toxic:low:'))])}, '|') AS audits"))
def act_audit(spark: SparkSession, sf: str) -> DataFrame:
    text = F.transform("o.audits", lambda a: F.concat_ws(":", a["rule"], a["category"], a["severity"], F.coalesce(a["context"], F.lit(""))))
    return evaluated(spark, sf).select("text_id", F.array_join(text, "|").alias("audits"))


@query("act_log", policy_sql(f"{when('r1', X.literal('info:nice'))} AS logs"))
def act_log(spark: SparkSession, sf: str) -> DataFrame:
    logs = F.flatten(F.transform("t", lambda r: r["logs"]))
    return evaluated(spark, sf).select("text_id", F.nullif(F.array_join(F.transform(logs, lambda x: F.concat_ws(":", x["level"], x["message"])), "|"), F.lit("")).alias("logs"))


@query("act_has", policy_sql("(" + " OR ".join(_R.values()) + ") AS has_actions"))
def act_has(spark: SparkSession, sf: str) -> DataFrame:
    return evaluated(spark, sf).select("text_id", R.has_actions(F.col("o")).alias("has_actions"))


def spans() -> Column:
    """Modifications with real spans by text_id: a redaction of bytes 2..5 (or none, or invalid) and injections."""
    m = lambda kind, content, position, a, b: F.struct(F.lit(kind).alias("kind"), F.lit(content).alias("content"), F.lit(position).cast("string").alias("position"), a.cast("int").alias("span_start"), b.cast("int").alias("span_end"))
    k = F.pmod(F.col("text_id"), F.lit(4))
    some = lambda x: F.when(k < 3, x)
    a, b = some(F.when(k == 1, 9_000_000).otherwise(2)), some(F.when(k == 1, 9_000_001).otherwise(5))
    return F.array(m("inject", "<", "before", F.lit(None), F.lit(None)), m("redact", "#", None, a, b), m("inject", ">", "after", F.lit(None), F.lit(None))).cast(f"array<{R.MODIFICATION}>")


_ASCII = "ascii AS (SELECT text_id, regexp_replace(text, '[^ -~]', '_', 'g') AS text FROM texts)"


def ascii_texts(spark: SparkSession, sf: str) -> DataFrame:
    return X.texts(spark, sf).withColumn("text", F.regexp_replace("text", "[^ -~]", "_"))


@query("str_apply_lib", X.sql("texts", f""", {_ASCII} SELECT text_id, CASE WHEN text_id % 4 IN (0, 2) AND length(text) > 3 THEN '<' || text[1:1] || '#' || text[5:] || '>' ELSE '<' || text || '>' END AS output FROM ascii"""))
def str_apply_lib(spark: SparkSession, sf: str) -> DataFrame:
    return ascii_texts(spark, sf).select("text_id", modify.apply_library(F.col("text"), spans()).alias("output"))


@query("str_apply_proxy", X.sql("texts", f""", {_ASCII} SELECT text_id, CASE WHEN text_id % 4 IN (0, 2) AND length(text) > 3 THEN '<' || text[1:1] || '#' || text[5:] || '>' ELSE '#>' END AS output FROM ascii"""))
def str_apply_proxy(spark: SparkSession, sf: str) -> DataFrame:
    return ascii_texts(spark, sf).select("text_id", modify.apply_service(F.col("text"), spans()).alias("output"))


@query("srt_mods", "SELECT doc_id AS text_id, CASE WHEN doc_id % 2 = 0 THEN 'b|a|c' ELSE 'a|b|c' END AS ordered FROM documents")
def srt_mods(spark: SparkSession, sf: str) -> DataFrame:
    """Spans 1, 7, 1 sort to 7, 1, 1; with a missing span the order stays."""
    m = lambda name, at: F.struct(F.lit("redact").alias("kind"), F.lit(name).alias("content"), F.lit(None).cast("string").alias("position"), at.cast("int").alias("span_start"), (at + 1).cast("int").alias("span_end"))
    even = F.col("text_id") % 2 == 0
    mods = F.array(m("a", F.lit(1)), m("b", F.when(even, 7)), m("c", F.lit(1))).cast(f"array<{R.MODIFICATION}>")
    return X.texts(spark, sf).select("text_id", F.array_join(modify.by_span(mods)["content"], "|").alias("ordered"))


def shown(df: DataFrame) -> DataFrame:
    return df.select("text_id", F.array_join("triggered.rule", "|").alias("rules"), "outcome.should_stop", F.col("outcome.stop_message").alias("message"), F.col("outcome.stop_status").alias("status"), F.array_join("outcome.audits.category", "|").alias("audits"), F.size("outcome.modifications").cast("long").alias("n_mods"))


def judged(spark: SparkSession, sf: str, policies: list[Policy]) -> DataFrame:
    df = R.with_evaluation(scored(spark, sf, R.triggers(policies)), policies, "text", "scores")
    return df.withColumn("outcome", R.outcome(F.col("triggered")))


_INJ = O.rx("text", "(?i)(ignore|disregard|forget).*(previous|above|instruction)")
_SENS = "(" + O.rx("text", r"\b\d{3}-\d{2}-\d{4}\b") + " OR " + O.rx("text", r"\b\d{16}\b") + ")"


@query("pol_default", policy_sql(f"""array_to_string({listed(["CASE WHEN pii >= 0.9 THEN 'pii-detection' END", "CASE WHEN tox >= 0.8 THEN 'toxicity-filter' END", f"CASE WHEN {_INJ} THEN 'prompt-injection-defense' END", f"CASE WHEN {_SENS} THEN 'sensitive-patterns' END"])}, '|') AS rules,
  (tox >= 0.8 OR {_INJ}) AS should_stop, CASE WHEN {_INJ} THEN 'Request cannot be processed' WHEN tox >= 0.8 THEN 'Content blocked due to policy violation' END AS message, CASE WHEN {_INJ} THEN 403 WHEN tox >= 0.8 THEN 451 END::INT AS status,
  array_to_string({listed(["CASE WHEN pii >= 0.9 THEN 'pii_exposure' END", "CASE WHEN tox >= 0.8 THEN 'toxicity' END", f"CASE WHEN {_SENS} THEN 'sensitive_data' END"])}, '|') AS audits, ((pii >= 0.9)::INT + {_SENS}::INT)::BIGINT AS n_mods"""))  # fmt: skip
def pol_default(spark: SparkSession, sf: str) -> DataFrame:
    return shown(judged(spark, sf, [DEFAULT]))


_DUTY = {
    "vulnerability-detection": (O.rx("text", "(?i)(can't pay|struggling|bereaved|disabled|anxious|depressed|confused|lost job|redundant)"), "vulnerability_detected", 1),
    "fee-transparency": (O.rx("text", "(?i)(fee|charge|cost|price|commission)"), "fee_disclosure", 0),
    "prevent-misleading-claims": (O.rx("text", "(?i)(guaranteed return|risk-free|can't lose|always profitable)"), "misleading_claim_prevented", 2),
    "ensure-risk-warnings": ("(" + O.rx("text", "(?i)(invest|portfolio|stocks|shares|bonds|crypto|trading)") + " AND contains(lower(text), 'response_length:>200'))", "risk_warning_injected", 1),
    "product-information-completeness": (O.rx("text", "(?i)(ISA|pension|SIPP|bond|fund|ETF|structured product)"), "product_disclosure", 1),
    "foreseeable-harm-prevention": (O.rx("text", "(?i)(borrow to invest|take loan for trading|max out credit card)"), "harm_prevented", 0),
    "pii-redaction": ("pii >= 0.9", "pii_exposure_prevented", 1),
}
_HARM = _DUTY["foreseeable-harm-prevention"][0]


@query("pol_consumer_duty", policy_sql(f"""array_to_string({listed([f"CASE WHEN {t} THEN '{r}' END" for r, (t, _, _) in _DUTY.items()])}, '|') AS rules, {_HARM} AS should_stop,
  CASE WHEN {_HARM} THEN 'I cannot provide guidance that may lead to financial harm. Please consult a qualified financial advisor.' END AS message, CASE WHEN {_HARM} THEN 451 END::INT AS status,
  array_to_string({listed([f"CASE WHEN {t} THEN '{c}' END" for t, c, _ in _DUTY.values()])}, '|') AS audits, ({' + '.join(f'({t})::INT * {n}' for t, _, n in _DUTY.values())})::BIGINT AS n_mods"""))  # fmt: skip
def pol_consumer_duty(spark: SparkSession, sf: str) -> DataFrame:
    return shown(judged(spark, sf, [CONSUMER_DUTY]))


def default_plan() -> phases.Plan:
    basic = P.from_config("basic-safety", PIPELINES["basic-safety"])
    return phases.Plan(basic, basic, basic, [DEFAULT], tenant="default")


#: Scores that basic-safety leaves to policies: the largest only, the last on ties.
_BASIC = """basic AS (SELECT *, greatest(tox, sent, pii) AS final, CASE WHEN pii >= greatest(tox, sent) THEN 'pii' WHEN sent >= tox THEN 'sentiment' ELSE 'toxicity' END AS winner FROM scored)"""
_TOXWINS = "(winner = 'toxicity' AND tox >= 0.8)"


@query("ph_ingress", X.sql("guard", f", {O.SCORED}, {_BASIC} SELECT text_id, winner, round(final, 6) AS score, ({_TOXWINS} OR {_INJ} OR final > 0.7) AS blocked, ({_TOXWINS} OR {_INJ}) AS stopped FROM basic"))
def ph_ingress(spark: SparkSession, sf: str) -> DataFrame:
    df = phases.ingress(X.guard(spark, sf), default_plan())
    return df.select("text_id", F.try_element_at("results", F.lit(-1))["classifier"].alias("winner"), F.round("final_score", 6).alias("score"), "blocked", F.col("outcome.should_stop").alias("stopped"))


@query("ph_egress", X.sql("guard", f""", {O.SCORED}, {_BASIC} SELECT text_id, ({_TOXWINS} OR {_INJ}) AS stopped, CASE WHEN {_SENS} THEN '[REDACTED]' ELSE text END AS modified, CASE WHEN {_SENS} THEN 'content_filter' END AS finish_reason FROM basic"""))
def ph_egress(spark: SparkSession, sf: str) -> DataFrame:
    df = phases.egress(X.guard(spark, sf), default_plan())
    return df.select("text_id", F.col("outcome.should_stop").alias("stopped"), "modified", "finish_reason")


def response_sql(t: str) -> str:
    """Whether ingress blocks text ``t`` under the default plan, and what it says."""
    return f"""{O.tox(t)} AS tox, {O.sent(t)} AS sent, {O.pii(t)} AS pii, {_INJ.replace('text', t)} AS inj"""


@query("ph_end2end", X.sql("turns", f""", p AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS response, lead(role) OVER w AS nr FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT conv_id, turn, response, {response_sql('text')} FROM p WHERE role = 'user' AND nr = 'assistant'),
b AS (SELECT *, (tox >= 0.8 AND tox > greatest(sent, pii)) AS toxstop FROM s),
d AS (SELECT *, toxstop OR inj OR greatest(tox, sent, pii) > 0.7 AS blocked, {_SENS.replace('text', 'response')} AS sens FROM b)
SELECT conv_id, turn, blocked, CASE WHEN NOT blocked THEN 200 WHEN inj THEN 403 WHEN toxstop THEN 451 ELSE 403 END::INT AS status,
  CASE WHEN NOT blocked THEN CASE WHEN sens THEN '[REDACTED]' ELSE response END WHEN inj THEN 'Request cannot be processed' WHEN toxstop THEN 'Content blocked due to policy violation' ELSE 'Request for model ''model-1'' blocked due to safety policies.' END AS output,
  CASE WHEN NOT blocked AND sens THEN 'content_filter' END AS finish_reason FROM d"""))  # fmt: skip
def ph_end2end(spark: SparkSession, sf: str) -> DataFrame:
    return phases.end_to_end(X.turns(spark, sf), default_plan())


@query("ph_denied", policy_sql(f"""CASE WHEN {_R['r3']} THEN 403 WHEN {_R['r2']} THEN 451 ELSE 403 END::INT AS status,
  '{{"error":{{"message":"' || CASE WHEN {_R['r2']} THEN 'no' ELSE 'Request for model ''m'' blocked due to safety policies.' END || '","type":"policy_violation"}}}}' AS body"""))  # fmt: skip
def ph_denied(spark: SparkSession, sf: str) -> DataFrame:
    refusal = phases.blocked_response(F.col("o"), F.lit("m"))
    return evaluated(spark, sf).select("text_id", refusal["status"].alias("status"), refusal["body"].alias("body"))


@query("req_prompt", X.sql("turns", "SELECT conv_id, max_by(text, turn) FILTER (WHERE role = 'user') AS prompt FROM turns GROUP BY conv_id"))
def req_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return phases.last_prompt(X.turns(spark, sf))


