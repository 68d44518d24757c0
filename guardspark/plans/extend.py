"""Queries: registries and loaders, models in Python, messages, errors and settings."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardspark import errors
from guardspark.operators import classifiers as C
from guardspark.operators import messages as M
from guardspark.operators import metrics, phases, tenants
from guardspark.operators import pipelines as P
from guardspark.operators import policy as R
from guardspark.operators import registry as G
from guardspark.plans import fixtures as X
from guardspark.plans import oracle as O
from guardspark.plans.catalog import query
from guardspark.plans.classify import shown
from guardspark.plans.govern import ALL, _R, listed, scored, when
from guardspark.plans.shipped import PIPELINES

MODELS = """
models:
  mood: {name: mood, source: {type: builtin, implementation: x}, architecture: {type: bert-sequence-classification, num_labels: 2}, inference: {threshold: 0.6}}
  feeling: {name: feeling, source: {type: builtin, implementation: x}, architecture: {type: custom, implementation: lexicon_sentiment}}
  vectors: {name: vectors, source: {type: huggingface, repo: some/encoder}, architecture: {type: sentence-transformer}, inference: {device: "cuda:1", quantization: none}}
  gone: {name: gone, source: {type: local, path: /no/such/model}, architecture: {type: distil-bert-sequence-classification, num_labels: 2}}
  lost: {name: lost, source: {type: huggingface, repo: nonexistent/model}, architecture: {type: roberta-sequence-classification, num_labels: 3}}
  coded: {name: coded, source: {type: builtin, implementation: x}, architecture: {type: custom, implementation: magic}}
"""


def lengths() -> C.VectorClassifier:
    """A model in Python: the longer, the surer."""

    def load():
        limit = 2000.0

        def score(texts: pd.Series) -> pd.DataFrame:
            s = (texts.str.len() / limit).clip(upper=1.0)
            return pd.DataFrame({"label": (s >= 0.5).map({True: "long", False: "short"}), "score": s})

        return score

    return C.VectorClassifier("lengths", load)


class Lengths:
    """A loader plugin with one model."""

    def load(self, name: str) -> C.Classifier:
        if name != "lengths":
            raise errors.ClassifierError(f"no model {name}")
        return lengths()

    def available(self) -> list[str]:
        return ["lengths"]


_LONG = "least(1.0::DOUBLE, length(text) / 2000.0::DOUBLE)"


@query("udf_classifier", X.sql("guard", f"SELECT text_id, CASE WHEN {_LONG} >= 0.5 THEN 'long' ELSE 'short' END AS label, round({_LONG}, 6) AS score, 'lengths' AS model FROM guard"))
def udf_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return C.with_results(X.guard(spark, sf), {"r": lengths()}, "text").select("text_id", "r.label", F.round("r.score", 6).alias("score"), "r.model")


def piped(spark: SparkSession, sf: str, registry: G.Registry, *names: str) -> DataFrame:
    spec = {"stages": [{"type": "sequential", "name": "s", "classifiers": list(names)}]}
    return shown(P.from_config("p", spec, registry, strict=True).run(X.guard(spark, sf)))


@query("udf_loader", X.sql("guard", f"SELECT text_id, 's:toxicity|s:lengths' AS names, 2::BIGINT AS n, CASE WHEN {_LONG} >= 0.5 THEN 'long' ELSE 'short' END AS label, round({_LONG}, 6) AS score FROM guard"))
def udf_loader(spark: SparkSession, sf: str) -> DataFrame:
    """A pipeline of a built-in classifier and one that a plugin loads."""
    return piped(spark, sf, G.Registry(Lengths()), "toxicity", "lengths")


_MOOD = O.sequence("text")


@query("udf_dynamic_registry", X.sql("guard", f"SELECT text_id, 's:toxicity|s:mood' AS names, 2::BIGINT AS n, CASE WHEN {_MOOD} >= 0.6 THEN 'positive' ELSE 'negative' END AS label, round({_MOOD}, 6)::DOUBLE AS score FROM guard"))
def udf_dynamic_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Settings of models, loaded when a pipeline names them; one is loaded before."""
    return piped(spark, sf, G.Registry(G.ModelLoader.from_yaml(MODELS), preload=("mood",)), "toxicity", "mood")


def outcome(load) -> str:
    try:
        return load().name
    except errors.GuardError as e:
        return str(e)


@query("udf_ml_plugin", X.sql("guard", f"SELECT text_id, {O.sent('text')} >= 0.5 AS positive, round({_MOOD}, 6)::DOUBLE AS mood FROM guard"))
def udf_ml_plugin(spark: SparkSession, sf: str) -> DataFrame:
    """Two loaded models side by side."""
    loader = G.ModelLoader.from_yaml(MODELS)
    df = C.with_results(X.guard(spark, sf), {"a": loader.load("feeling"), "b": loader.load("mood")}, "text")
    return df.select("text_id", (F.col("a.label") == "positive").alias("positive"), F.round("b.score", 6).alias("mood"))


@query("jn_registry", X.sql("guard", "SELECT text_id, 's:toxicity|s:nobody' AS names, 2::BIGINT AS n, 'clean' AS label, 0.0::DOUBLE AS score, 'classifier error: pipeline ''p'' needs classifier ''nobody'': classifier error: classifier ''nobody'' is not known' AS problem FROM guard"))
def jn_registry(spark: SparkSession, sf: str) -> DataFrame:
    """A stage with a name that nobody knows: an error for the strict builder, a no-op otherwise."""
    spec = {"stages": [{"type": "sequential", "name": "s", "classifiers": ["toxicity", "nobody"]}]}
    problem = outcome(lambda: P.from_config("p", spec, G.Registry(), strict=True))
    return shown(P.from_config("p", spec, G.Registry()).run(X.guard(spark, sf))).withColumn("problem", F.lit(problem))


@query("tok_build", X.sql("texts", """SELECT text_id, text[1:3] || text[4:8] AS text, 2::BIGINT AS n_tokens, (text_id % 50)::INT AS token_id, 'user' AS role, CASE WHEN text_id % 2 = 0 THEN 'stop' END AS finish_reason FROM texts"""))
def tok_build(spark: SparkSession, sf: str) -> DataFrame:
    tokens = F.array(M.token(F.substring("text", 1, 3)), M.token(F.substring("text", 4, 5), F.col("text_id") % 50, F.lit(-0.5)))
    made = M.answer_chunk(F.lit("c1"), F.lit("m1"), tokens, F.when(F.col("text_id") % 2 == 0, "stop"))
    rows = X.texts(spark, sf).select("text_id", made.alias("c"), M.message("user", F.col("text")).alias("m"))
    return rows.select("text_id", M.text_of(F.col("c.tokens")).alias("text"), F.size("c.tokens").cast("long").alias("n_tokens"), F.col("c.tokens")[1]["token_id"].alias("token_id"), "m.role", "c.finish_reason")


@query("dem_reset", X.sql("requests", "SELECT action, count(*) AS n FROM requests WHERE ts >= TIMESTAMP '2024-01-20 06:00:00' GROUP BY action"))
def dem_reset(spark: SparkSession, sf: str) -> DataFrame:
    """Counters after the last of two resets."""
    resets = spark.createDataFrame([("2024-01-10 00:00:00",), ("2024-01-20 06:00:00",)], "at string").select(F.col("at").cast("timestamp").alias("at"))
    return metrics.action_counts(metrics.since_reset(X.requests(spark, sf), resets))


@query("auth_admin", "SELECT event_id, event_id % 3 = 0 OR event_id % 3 = 1 AS allowed FROM events")
def auth_admin(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id") % 3
    header, bearer = F.when(e == 0, "s3cret").when(e == 2, "guess"), F.when(e == 1, "Bearer s3cret")
    return X.table(spark, sf, "events").select("event_id", tenants.admin_allowed(header, bearer, "s3cret").alias("allowed"))


@query("eng_misc", X.sql("guard", f", {O.SCORED} SELECT text_id, array_to_string({listed([when(r, X.literal(r)) for r in _R])}, '|') AS rules, 1::BIGINT AS n_policies FROM scored"))
def eng_misc(spark: SparkSession, sf: str) -> DataFrame:
    """The engine object: policies are added, then all are judged."""
    engine = R.Engine().add(ALL)
    df = engine.judge(scored(spark, sf), "text", "scores")
    return df.select("text_id", F.array_join("triggered.rule", "|").alias("rules"), F.lit(len(engine.policies)).cast("long").alias("n_policies"))


@query("ph_wrappers", X.sql("guard", f""", {O.SCORED} SELECT text_id, CASE text_id % 3 WHEN 0 THEN 'strict' WHEN 1 THEN 'lenient' ELSE 'nobody' END AS tenant,
  CASE text_id % 3 WHEN 0 THEN round(greatest(tox, sent, pii), 6) > 0.9 WHEN 1 THEN round(tox, 6) > 0.5 ELSE round(greatest(tox, sent, pii), 6) > 0.7 END AS blocked FROM scored"""))  # fmt: skip
def ph_wrappers(spark: SparkSession, sf: str) -> DataFrame:
    """Each tenant's rows under its own plan, an unknown tenant's under the default."""
    basic = P.from_config("basic-safety", PIPELINES["basic-safety"])
    plans = {
        "default": phases.Plan(basic), "strict": phases.Plan(basic, safety_threshold=0.9, tenant="strict"),
        "lenient": phases.Plan(P.from_config("q", {"stages": [{"type": "single", "name": "t", "classifier": "toxicity"}]}), safety_threshold=0.5, tenant="lenient"),
    }
    k = F.pmod(F.col("text_id"), F.lit(3))
    df = X.guard(spark, sf).withColumn("tenant", F.when(k == 0, "strict").when(k == 1, "lenient").otherwise("nobody"))
    return phases.for_tenants(df, plans, phases.ingress).select("text_id", "tenant", "blocked")


