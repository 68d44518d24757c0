"""Queries: classifiers, stages, conditions, aggregations and the six pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardspark.functions import lexicons as L
from guardspark.functions.text import any_of
from guardspark.operators import classifiers as C
from guardspark.operators import demo
from guardspark.operators import pipelines as P
from guardspark.plans import fixtures as X
from guardspark.plans import oracle as O
from guardspark.plans.catalog import query
from guardspark.plans.shipped import PIPELINES

THREE = [("toxicity", "tox"), ("sentiment", "sent"), ("pii", "pii")]


def classified(df: DataFrame, c: C.Classifier) -> DataFrame:
    return C.with_results(df, {"r": c}, "text")


def rounded(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")


def values(extra: Column, key: str) -> Column:
    return F.array_join(F.transform(F.filter(extra, lambda e: e["k"] == key), lambda e: e["v"]), "|")


LABELLED = [("insult", "idiot"), ("insult", "bastard"), ("praise", "wonderful"), ("money", "isa")]


@query("clf_pattern", X.sql("guard", f"""SELECT text_id,
  CASE lower({O.first('text', any_of([p for _, p in LABELLED]))}) WHEN 'idiot' THEN 'insult' WHEN 'bastard' THEN 'insult' WHEN 'wonderful' THEN 'praise' WHEN 'isa' THEN 'money' ELSE 'clean' END AS label,
  {O.rx('text', any_of([p for _, p in LABELLED]))}::INT::DOUBLE AS score, {O.hits('text', any_of([p for _, p in LABELLED]))}::BIGINT AS n_spans FROM guard"""))  # fmt: skip
def clf_pattern(spark: SparkSession, sf: str) -> DataFrame:
    df = classified(X.guard(spark, sf), C.Pattern("labelled", LABELLED))
    return df.select("text_id", "r.label", "r.score", F.size("r.spans").cast("long").alias("n_spans"))


def span_sql(pattern: str) -> str:
    m, before = O.first("text", pattern), f"split_part(text, {O.first('text', pattern)}, 1)"
    return f"CASE WHEN {m} IS NOT NULL THEN strlen({before}) || '-' || (strlen({before}) + strlen({m})) END"


_KINDS = ", ".join(f"CASE WHEN {O.rx('text', p)} THEN '{k}' END" for k, p in L.PII)
_SPANS = ", ".join(span_sql(p) for _, p in L.PII)


@query("clf_pii", X.sql("guard", f"""SELECT text_id, CASE WHEN {O.pii('text')} = 1 THEN 'pii_detected' ELSE 'no_pii' END AS label, {O.pii('text')} AS score,
  array_to_string(list_filter([{_KINDS}], lambda x: x IS NOT NULL), '|') AS kinds, array_to_string(list_filter([{_SPANS}], lambda x: x IS NOT NULL), ',') AS spans FROM guard"""))  # fmt: skip
def clf_pii(spark: SparkSession, sf: str) -> DataFrame:
    df = classified(X.guard(spark, sf), C.Pii())
    return df.select("text_id", "r.label", "r.score", values(F.col("r.extra"), "pii_type").alias("kinds"), spans_text(F.col("r.spans")).alias("spans"))


@query("clf_toxicity", X.sql("guard", f"SELECT text_id, CASE WHEN {O.tox('text')} > 0.5 THEN 'toxic' ELSE 'safe' END AS label, round({O.tox('text')}, 6) AS score, 'toxicity-lexicon' AS model FROM guard"))
def clf_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return classified(X.guard(spark, sf), C.Toxicity()).select("text_id", "r.label", rounded("r.score").alias("score"), "r.model")


@query("clf_sentiment", X.sql("guard", f"SELECT text_id, CASE WHEN {O.sent('text')} >= 0.5 THEN 'positive' ELSE 'negative' END AS label, round({O.sent('text')}, 6) AS score, round(1 - {O.sent('text')}, 6) AS negative FROM guard"))
def clf_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    df = classified(X.guard(spark, sf), C.Sentiment())
    return df.select("text_id", "r.label", rounded("r.score").alias("score"), rounded(F.col("r.all_scores")[0]["score"]).alias("negative"))


def cascade_sql(categories, label: str, score: str) -> str:
    found = "CASE" + "".join(f" WHEN {O.rx('text', any_of(c[-1]))} THEN array_to_string(list_transform(regexp_extract_all(text, {X.literal(any_of(c[-1]))}), lambda x: lower(x)), '|')" for c in categories) + " ELSE '' END"
    return f"SELECT text_id, {label} AS label, {score} AS score, {found} AS matched FROM guard"


@query("clf_injection", X.sql("guard", cascade_sql(L.INJECTION, O.inj("text", 0), O.inj("text"))))
def clf_injection(spark: SparkSession, sf: str) -> DataFrame:
    df = classified(X.guard(spark, sf), C.prompt_injection())
    return df.select("text_id", "r.label", "r.score", values(F.col("r.extra"), "matched_pattern").alias("matched"))


@query("clf_advice", X.sql("guard", cascade_sql(L.ADVICE, O.adv("text", 0), O.adv("text"))))
def clf_advice(spark: SparkSession, sf: str) -> DataFrame:
    df = classified(X.guard(spark, sf), C.financial_advice())
    return df.select("text_id", "r.label", "r.score", values(F.col("r.extra"), "matched_pattern").alias("matched"))


@query("clf_profanity", X.sql("guard", f"SELECT text_id, CASE WHEN {O.rx('text', any_of(L.PROFANITY))} THEN 'profanity' ELSE 'clean' END AS label, {O.rx('text', any_of(L.PROFANITY))}::INT::DOUBLE AS score FROM guard"))
def clf_profanity(spark: SparkSession, sf: str) -> DataFrame:
    return classified(X.guard(spark, sf), C.profanity()).select("text_id", "r.label", "r.score")


@query("clf_noop", X.sql("texts", "SELECT text_id, 'clean' AS label, 0.0::DOUBLE AS score FROM texts"))
def clf_noop(spark: SparkSession, sf: str) -> DataFrame:
    return classified(X.texts(spark, sf), C.Noop("readability")).select("text_id", "r.label", "r.score")


@query("clf_lexseq", X.sql("guard", f"SELECT text_id, CASE WHEN {O.sequence('text')} >= 0.6 THEN 'up' ELSE 'down' END AS label, round({O.sequence('text')}, 6)::DOUBLE AS score FROM guard"))
def clf_lexseq(spark: SparkSession, sf: str) -> DataFrame:
    return classified(X.guard(spark, sf), C.Sequence("seq", ["down", "up"], 0.6)).select("text_id", "r.label", rounded("r.score").alias("score"))


@query("clf_exceeds", X.sql("guard", f"SELECT text_id, {O.tox('text')} >= 0.7 AS exceeds FROM guard"))
def clf_exceeds(spark: SparkSession, sf: str) -> DataFrame:
    return classified(X.guard(spark, sf), C.Toxicity()).select("text_id", C.exceeds(F.col("r"), 0.7).alias("exceeds"))


def demo_sql(t: str) -> dict[str, str]:
    inj = "(" + " OR ".join(O.rx(t, p) for p in L.DEMO_INJECTION) + ")"
    any_pii = "(" + " OR ".join(O.rx(t, p) for _, p in L.DEMO_PII) + ")"
    n = "(" + " + ".join(f"contains(lower({t}), '{w}')::INT" for w in L.DEMO_TOXIC) + ")"
    adv = "(" + " OR ".join(O.rx(t, p) for p in L.DEMO_ADVICE) + ")"
    strong = f"least({n} * 0.2::DOUBLE, 1.0) > 0.8"
    kinds = [f"CASE WHEN {O.rx(t, p)} THEN '{k}' END" for k, p in L.DEMO_PII] + [f"CASE WHEN {inj} THEN 'prompt_injection' END", f"CASE WHEN {n} > 0 THEN 'toxicity' END", f"CASE WHEN {adv} THEN 'financial_advice' END"]
    rules = [f"CASE WHEN {O.rx(t, p)} THEN 'pii-detection' END" for _, p in L.DEMO_PII] + [f"CASE WHEN {inj} THEN 'prompt-injection-defense' END", f"CASE WHEN {strong} THEN 'toxicity-filter' END", f"CASE WHEN {adv} THEN 'financial-advice-detection' END"]
    join = lambda xs: f"list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL)"
    return {"issues": join(kinds), "rules": join(rules), "action": f"CASE WHEN {inj} THEN 'block' WHEN {any_pii} THEN 'redact' WHEN {strong} THEN 'block' ELSE 'pass' END"}


_D = demo_sql("text")


@query("dem_eval", X.sql("guard", f"SELECT text_id, array_to_string({_D['issues']}, '|') AS issues, array_to_string({_D['rules']}, '|') AS rules, {_D['action']} AS action FROM guard"))
def dem_eval(spark: SparkSession, sf: str) -> DataFrame:
    df = demo.with_evaluation(X.guard(spark, sf), "text", "e")
    return df.select("text_id", F.array_join("e.issues.issue_type", "|").alias("issues"), F.array_join("e.triggered_rules", "|").alias("rules"), "e.action")


_I, _E = demo_sql("asked"), demo_sql("response")


@query("dem_request", X.sql("turns", f"""
, p AS (SELECT conv_id, turn, role, string_agg(CASE WHEN role = 'user' THEN text END, ' ') OVER w AS asked, string_agg(CASE WHEN role = 'user' THEN text[1:100] END, ' ') OVER w AS request_preview,
    lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS response, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr FROM turns
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e AS (SELECT *, {_I['action']} AS ia, {_E['action']} AS ea, {_I['issues']} AS ii, {_E['issues']} AS ei FROM p WHERE role = 'user' AND nr = 'assistant')
SELECT conv_id, turn, CASE WHEN ia <> 'pass' THEN ia ELSE ea END AS action, CASE WHEN ia = 'block' THEN 'ingress' ELSE 'egress' END AS phase,
  array_to_string(CASE WHEN ia = 'block' THEN ii ELSE list_concat(ii, ei) END, '|') AS issues, request_preview, CASE WHEN ia <> 'block' THEN response[1:100] END AS response_preview FROM e"""))  # fmt: skip
def dem_request(spark: SparkSession, sf: str) -> DataFrame:
    r = demo.requests(X.turns(spark, sf))
    return r.select("conv_id", "turn", "action", "phase", F.array_join("issues.issue_type", "|").alias("issues"), "request_preview", "response_preview")


def run(spark: SparkSession, sf: str, pipeline: P.Pipeline) -> DataFrame:
    return pipeline.run(X.guard(spark, sf))


def shown(df: DataFrame) -> DataFrame:
    """text_id, names (stage:classifier in order), n, final label and score."""
    names = F.array_join(F.transform("results", lambda x: F.concat_ws(":", x["stage"], x["classifier"])), "|")
    last = P.final(F.col("results"))
    return df.select("text_id", names.alias("names"), F.size("results").cast("long").alias("n"), last["label"].alias("label"), rounded(last["score"]).alias("score"))


def three(agg) -> P.Pipeline:
    known = C.built_in()
    return P.Pipeline().parallel("s", [(k, known[k]) for k, _ in THREE], agg)


TOX_LABEL, SENT_LABEL, PII_LABEL = "CASE WHEN tox > 0.5 THEN 'toxic' ELSE 'safe' END", "CASE WHEN sent >= 0.5 THEN 'positive' ELSE 'negative' END", "CASE WHEN pii = 1 THEN 'pii_detected' ELSE 'no_pii' END"
INJ_LABEL, ADV_LABEL = O.inj("text", 0), O.adv("text", 0)


def agg_sql(body: str) -> str:
    return X.sql("guard", f", {O.SCORED} {body}")


_ALL3 = f"SELECT text_id, 's:toxicity|s:sentiment|s:pii' AS names, 3::BIGINT AS n, {PII_LABEL} AS label, pii AS score FROM scored"
_MAX = f"""SELECT text_id, CASE WHEN pii >= greatest(tox, sent) THEN 's:pii' WHEN sent >= tox THEN 's:sentiment' ELSE 's:toxicity' END AS names, 1::BIGINT AS n,
  CASE WHEN pii >= greatest(tox, sent) THEN {PII_LABEL} WHEN sent >= tox THEN {SENT_LABEL} ELSE {TOX_LABEL} END AS label, round(greatest(tox, sent, pii), 6) AS score FROM scored"""
_MIN = f"""SELECT text_id, CASE WHEN tox <= least(sent, pii) THEN 's:toxicity' WHEN sent <= pii THEN 's:sentiment' ELSE 's:pii' END AS names, 1::BIGINT AS n,
  CASE WHEN tox <= least(sent, pii) THEN {TOX_LABEL} WHEN sent <= pii THEN {SENT_LABEL} ELSE {PII_LABEL} END AS label, round(least(tox, sent, pii), 6) AS score FROM scored"""
_FIRST = f"""SELECT text_id, CASE WHEN tox >= 0.7 THEN 's:toxicity' WHEN sent >= 0.7 THEN 's:sentiment' WHEN pii >= 0.7 THEN 's:pii' ELSE 's:toxicity|s:sentiment|s:pii' END AS names,
  CASE WHEN greatest(tox, sent, pii) >= 0.7 THEN 1 ELSE 3 END::BIGINT AS n, CASE WHEN tox >= 0.7 THEN {TOX_LABEL} WHEN sent >= 0.7 THEN {SENT_LABEL} ELSE {PII_LABEL} END AS label,
  round(CASE WHEN tox >= 0.7 THEN tox WHEN sent >= 0.7 THEN sent ELSE pii END, 6) AS score FROM scored"""
_MEAN = "SELECT text_id, 's:toxicity' AS names, 1::BIGINT AS n, CASE WHEN (tox + sent + pii) / 3 >= 0.5 THEN 'positive' ELSE 'negative' END AS label, round((tox + sent + pii) / 3, 6) AS score FROM scored"

for _name, _agg, _sql in (
    ("agg_all", P.agg_all, _ALL3), ("agg_max", P.agg_max, _MAX), ("agg_min", P.agg_min, _MIN), ("agg_first_pos", P.agg_first_positive(0.7), _FIRST),
    ("agg_wavg", P.agg_weighted, _MEAN), ("stg_parallel", P.agg_max, _MAX), ("top_max", P.agg_max, _MAX),
):
    query(_name, agg_sql(_sql))(lambda spark, sf, agg=_agg: shown(run(spark, sf, three(agg))))


@query("agg_unanimous", agg_sql(f"SELECT text_id, 3::BIGINT AS n, {PII_LABEL} AS label, (tox >= 0.5 AND sent >= 0.5 AND pii >= 0.5) OR (tox < 0.5 AND sent < 0.5 AND pii < 0.5) AS unanimous FROM scored"))
def agg_unanimous(spark: SparkSession, sf: str) -> DataFrame:
    df = run(spark, sf, three(P.agg_unanimous))
    return df.select("text_id", F.size("results").cast("long").alias("n"), P.final(F.col("results"))["label"].alias("label"), P.is_unanimous(F.col("results")).alias("unanimous"))


@query("agg_final", agg_sql(f"SELECT text_id, {PII_LABEL} AS label, pii AS score FROM scored"))
def agg_final(spark: SparkSession, sf: str) -> DataFrame:
    last = P.final(F.col("results"))
    return run(spark, sf, three(P.agg_all)).select("text_id", last["label"].alias("label"), last["score"].alias("score"))


@query("stg_single", agg_sql(f"SELECT text_id, 'one:pii_detector' AS names, 1::BIGINT AS n, {PII_LABEL} AS label, pii AS score FROM scored"))
def stg_single(spark: SparkSession, sf: str) -> DataFrame:
    return shown(run(spark, sf, P.Pipeline().single("one", C.Pii())))


@query("stg_sequential", agg_sql(f"SELECT text_id, 'q:sentiment|q:toxicity' AS names, 2::BIGINT AS n, {TOX_LABEL} AS label, round(tox, 6) AS score FROM scored"))
def stg_sequential(spark: SparkSession, sf: str) -> DataFrame:
    return shown(run(spark, sf, P.Pipeline().sequential("q", [("sentiment", C.Sentiment()), ("toxicity", C.Toxicity())])))


def conditional(condition: P.Condition) -> P.Pipeline:
    known = C.built_in()
    return P.Pipeline().parallel("s", [(k, known[k]) for k in ("toxicity", "sentiment")]).conditional("c", C.Pii(), condition)


_COND = {
    "stg_conditional": (P.any_above(0.6), "tox > 0.6 OR sent > 0.6"), "cond_any": (P.any_above(0.5), "tox > 0.5 OR sent > 0.5"), "cond_all": (P.all_above(0.3), "tox > 0.3 AND sent > 0.3"),
    "cond_triggered": (P.triggered("toxicity"), "tox > 0.5"), "cond_always": (P.always(), "true"),
}
for _name, (_condition, _test) in _COND.items():
    _sql = f"""SELECT text_id, CASE WHEN {_test} THEN 's:toxicity|s:sentiment|c:pii_detector' ELSE 's:toxicity|s:sentiment' END AS names, CASE WHEN {_test} THEN 3 ELSE 2 END::BIGINT AS n,
  CASE WHEN {_test} THEN {PII_LABEL} ELSE {SENT_LABEL} END AS label, round(CASE WHEN {_test} THEN pii ELSE sent END, 6) AS score FROM scored"""
    query(_name, agg_sql(_sql))(lambda spark, sf, c=_condition: shown(run(spark, sf, conditional(c))))


@query("pl_execute", agg_sql(f"SELECT text_id, 'a:toxicity|b:toxicity|b:sentiment|c:pii' AS names, 4::BIGINT AS n, {PII_LABEL} AS label, pii AS score FROM scored"))
def pl_execute(spark: SparkSession, sf: str) -> DataFrame:
    tox = C.Toxicity()
    p = P.Pipeline().single("a", tox).sequential("b", [("toxicity", tox), ("sentiment", C.Sentiment())]).parallel("c", [("pii", C.Pii())])
    return shown(run(spark, sf, p))


@query("set_concat", agg_sql("SELECT text_id, round(tox, 6) || '|' || round(sent, 6) || '|' || pii AS scores FROM scored"))
def set_concat(spark: SparkSession, sf: str) -> DataFrame:
    scores = F.transform("results", lambda x: F.round(x["result"]["score"], 6).cast("string"))
    return run(spark, sf, P.Pipeline().sequential("a", [("toxicity", C.Toxicity())]).parallel("b", [("sentiment", C.Sentiment()), ("pii", C.Pii())])).select("text_id", F.array_join(scores, "|").alias("scores"))


@query("ext_scores", agg_sql("SELECT text_id, round(tox, 6) AS tox, round(sent, 6) AS sent, pii AS final, NULL::DOUBLE AS missing, 4::BIGINT AS n FROM scored"))
def ext_scores(spark: SparkSession, sf: str) -> DataFrame:
    p = P.Pipeline().sequential("a", [("toxicity", C.Sentiment())]).sequential("b", [("toxicity", C.Toxicity()), ("sentiment", C.Sentiment()), ("pii", C.Pii())])
    df = run(spark, sf, p).withColumn("m", P.score_map(F.col("results")))
    at = lambda k: F.try_element_at("m", F.lit(k))
    return df.select("text_id", rounded(at("toxicity")).alias("tox"), rounded(at("sentiment")).alias("sent"), at("_final").alias("final"), at("nobody").alias("missing"), F.size("m").cast("long").alias("n"))


_MAXIA = f"CASE WHEN adv >= inj THEN 'compliance-checks:financial-advice' ELSE 'compliance-checks:prompt-injection' END"
_ADVANCED = f"""SELECT text_id, CASE WHEN tox > 0.5 THEN 'initial-toxicity:toxicity|deep-toxicity-check:toxicity|' ELSE 'initial-toxicity:toxicity|' END || {_MAXIA} AS names, CASE WHEN tox > 0.5 THEN 3 ELSE 2 END::BIGINT AS n,
  CASE WHEN adv >= inj THEN {ADV_LABEL} ELSE {INJ_LABEL} END AS label, round(greatest(adv, inj), 6) AS score FROM scored"""
_TRIAGE = f"""SELECT text_id, CASE WHEN tox >= 0.7 THEN 'quick-checks:toxicity-distilled' WHEN inj >= 0.7 THEN 'quick-checks:prompt-injection' WHEN pii >= 0.7 THEN 'quick-checks:pii'
    ELSE 'quick-checks:toxicity-distilled|quick-checks:prompt-injection|quick-checks:pii' END AS names, CASE WHEN greatest(tox, inj, pii) >= 0.7 THEN 1 ELSE 3 END::BIGINT AS n,
  CASE WHEN tox >= 0.7 THEN {TOX_LABEL} WHEN inj >= 0.7 THEN {INJ_LABEL} ELSE {PII_LABEL} END AS label, round(CASE WHEN tox >= 0.7 THEN tox WHEN inj >= 0.7 THEN inj ELSE pii END, 6) AS score FROM scored"""
_SHIPPED = {
    "basic-safety": _MAX.replace("'s:", "'safety-check:"),
    "advanced-safety": _ADVANCED,
    "content-quality": "SELECT text_id, 'quality-analysis:sentiment|quality-analysis:readability' AS names, 2::BIGINT AS n, 'clean' AS label, 0.0::DOUBLE AS score FROM scored",
    "comprehensive-safety": f"SELECT text_id, 'all-safety-checks:toxicity|all-safety-checks:sentiment|all-safety-checks:prompt-injection|all-safety-checks:pii' AS names, 4::BIGINT AS n, {PII_LABEL} AS label, pii AS score FROM scored",
    "fast-triage": _TRIAGE,
    "weighted-analysis": "SELECT text_id, 'multi-signal:toxicity' AS names, 1::BIGINT AS n, CASE WHEN (tox + sent) / 3 >= 0.5 THEN 'positive' ELSE 'negative' END AS label, round((tox + sent) / 3, 6) AS score FROM scored",
}
for _name, _sql in _SHIPPED.items():
    query("pl_" + _name.replace("-", "_"), agg_sql(_sql))(lambda spark, sf, n=_name: shown(run(spark, sf, P.from_config(n, PIPELINES[n]))))


@query("label_confusion", X.sql("texts", f"SELECT toxic, {O.tox('text')} > 0.5 AS predicted, count(*) AS n FROM texts JOIN labels ON doc_id = text_id GROUP BY ALL"))
def label_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: predicted against labelled toxicity."""
    df = classified(X.texts(spark, sf), C.Toxicity()).join(X.table(spark, sf, "labels"), F.col("text_id") == F.col("doc_id"))
    return df.groupBy("toxic", (F.col("r.score") > 0.5).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
