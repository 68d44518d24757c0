"""Queries: what configuration, builders and registries amount to on the tables' rows."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from guardspark import errors
from guardspark.functions import lexicons as L
from guardspark.functions import text as T
from guardspark.operators import classifiers as C
from guardspark.operators import context as K
from guardspark.operators import pipelines as P
from guardspark.operators import policy as R
from guardspark.operators import registry as G
from guardspark.operators import tenants as N
from guardspark.plans import fixtures as X
from guardspark.plans import oracle as O
from guardspark.plans.catalog import query
from guardspark.plans.extend import MODELS, outcome
from guardspark.plans.govern import _INJ, _SENS, scored
from guardspark.plans.ledger import _RESOLVED, _TENANTS, http, tenant_rows
from guardspark.plans.shipped import DEFAULT_YAML, PIPELINES, PIPELINES_YAML
from guardspark.sources import adapters, config
from guardspark.sources import datagen as D
from guardspark.sources.config import Action, Policy, Rule, Trigger

Rows = list[tuple[tuple, Column]]


def tally(df: DataFrame, columns: str, rows: Rows) -> DataFrame:
    """A row of values for each condition, with ``n``: the rows of ``df`` for which it holds. One pass, combined before the shuffle."""
    names = [c.split()[0] for c in columns.split(", ")]
    one = df.agg(*[F.count_if(F.coalesce(condition, F.lit(False))).alias(f"_{k}") for k, (_, condition) in enumerate(rows)])
    cells = [F.struct(*[F.lit(v).alias(c) for c, v in zip(names, values, strict=True)], F.col(f"_{k}").alias("n")).cast(f"struct<{columns.replace(' ', ':').replace(',:', ',')},n:bigint>") for k, (values, _) in enumerate(rows)]
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def tally_sql(columns: str, source: str, rows: list[tuple[tuple, str]], before: str) -> str:
    """The same in SQL, after the CTEs ``before``."""
    names = [c.split() for c in columns.split(", ")]
    kinds = {"string": "VARCHAR", "double": "DOUBLE", "int": "INT", "bigint": "BIGINT"}
    cell = lambda v, kind: f"{'NULL' if v is None else X.literal(v) if isinstance(v, str) else v}::{kinds[kind]}"
    selects = ["SELECT " + ", ".join(f"{cell(v, k)} AS {n}" for v, (n, k) in zip(values, names, strict=True)) + f", count(*) FILTER (WHERE {condition}) AS n FROM {source}" for values, condition in rows]
    return X.sql("guard", before + " " + " UNION ALL ".join(selects))


def found(classifier: C.Classifier, least: float = 0.5) -> Column:
    """Whether a classifier's score on ``text`` is at least ``least``."""
    return C.exceeds(classifier.result(F.col("text"), False), least)


def flagged(df: DataFrame, classifiers: dict[str, C.Classifier], least: float) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with what each classifier finds, computed once a row for all names that it has, and by name whether its score is at least ``least``."""
    columns = {id(c): f"_c{k}" for k, c in enumerate({id(c): c for c in classifiers.values()}.values())}
    df = C.with_results(df, {columns[id(c)]: c for c in classifiers.values()}, "text", False)
    return df, {n: C.exceeds(F.col(columns[id(c)]), least) for n, c in classifiers.items()}


_SCORED = f", {O.SCORED}"
_SEQ = O.sequence("text")
_SAYS = {
    "toxicity": lambda x: f"tox >= {x}", "sentiment": lambda x: f"sent >= {x}", "pii": lambda x: f"pii >= {x}", "prompt-injection": lambda x: f"inj >= {x}",
    "financial-advice": lambda x: f"adv >= {x}", "readability": lambda x: f"0.0 >= {x}", "sequence": lambda x: f"{_SEQ} >= {x}", "sentence-transformer": lambda x: f"{_SEQ} >= {x}",
    "pattern": lambda x: O.rx("text", T.any_of(L.PROFANITY)),
}

# Tier by classifier, and its time in microseconds.
_TIERS = [
    ("pattern", "A", 2000), ("pii", "A", 2000), ("sentiment", "A", 2000), ("prompt-injection", "A", 2000), ("financial-advice", "A", 2000), ("readability", "A", 2000), ("toxicity", "B", 5000),
    ("sequence", "B", 5000), ("sentence-transformer", "C", 10000),
]


@query("clf_tier_budget", tally_sql("classifier string, tier string, budget_us int", "scored", [(t, _SAYS[t[0]](0.5)) for t in _TIERS], _SCORED))
def clf_tier_budget(spark: SparkSession, sf: str) -> DataFrame:
    """By classifier its tier and budget, and how many texts it flags."""
    words = C.Sequence()
    made = {**C.built_in(), "pattern": C.profanity(), "sequence": words, "sentence-transformer": words}
    df, says = flagged(X.guard(spark, sf), {n: made[n] for n in L.TIERS}, 0.5)
    return tally(df, "classifier string, tier string, budget_us int", [((n, t, L.TIER_BUDGET[t]), says[n]) for n, t in L.TIERS.items()])


_BUILT = [(n, "B" if n.startswith("toxicity") else "A") for n in ("financial-advice", "pii", "pii_detector", "profanity", "prompt-injection", "readability", "sentiment", "toxicity", "toxicity-distilled", "toxicity-gpu", "toxicity-metal")]
_ALIAS = {"pii_detector": "pii", "profanity": "pattern", "toxicity-distilled": "toxicity", "toxicity-gpu": "toxicity", "toxicity-metal": "toxicity"}


@query("clf_misc", tally_sql("classifier string, tier string", "scored", [(b, _SAYS[_ALIAS.get(b[0], b[0])](0.9)) for b in _BUILT], _SCORED))
def clf_misc(spark: SparkSession, sf: str) -> DataFrame:
    """Every built-in name, its tier, and the texts that it is sure of."""
    known = C.built_in()
    df, says = flagged(X.guard(spark, sf), known, 0.9)
    return tally(df, "classifier string, tier string", [((n, c.tier), says[n]) for n, c in known.items()])


@query("reg_misc", tally_sql("classifier string", "scored", [((n,), _SAYS[_ALIAS.get(n, n)](0.3)) for n in ("financial-advice", "pii", "prompt-injection", "readability", "sentiment", "toxicity", "toxicity-distilled")], _SCORED))
def reg_misc(spark: SparkSession, sf: str) -> DataFrame:
    """The classifiers that the shipped pipelines mention, and the texts that they have something against."""
    known = C.built_in()
    df, says = flagged(X.guard(spark, sf), {n: known[n] for n in G.referenced(PIPELINES)}, 0.3)
    return tally(df, "classifier string", [((n,), c) for n, c in says.items()])


_LOADED = {
    "coded": ("classifier error: custom architecture 'magic' needs code", "false"), "feeling": ("feeling", "sent >= 0.5"), "gone": ("classifier error: model path does not exist: /no/such/model", "false"),
    "lost": ("classifier error: repository not found: nonexistent/model", "false"), "mood": ("mood", f"{_SEQ} >= 0.6"), "other": ("classifier error: model 'other' is not in the registry", "false"), "vectors": ("vectors", f"{_SEQ} >= 0.5"),
}


@query("udf_generic_loader", tally_sql("model string, outcome string", "scored", [((n, o), c) for n, (o, c) in _LOADED.items()], _SCORED))
def udf_generic_loader(spark: SparkSession, sf: str) -> DataFrame:
    """What each of the configured models comes to, and a name that is none of them; and the texts that those which load call positive."""
    loader = G.ModelLoader.from_yaml(MODELS)
    rows: Rows = []
    for n in [*loader.available(), "other"]:
        said = outcome(lambda n=n: loader.load(n))
        rows.append(((n, said), loader.load(n).result(F.col("text"), False)["label"] == "positive" if said == n else F.lit(False)))
    return tally(X.guard(spark, sf), "model string, outcome string", rows)


_YAML = [("coded", "cpu", 0, "int8_dynamic", 0.5), ("feeling", "cpu", 0, "int8_dynamic", 0.5), ("gone", "cpu", 0, "int8_dynamic", 0.5), ("lost", "cpu", 0, "int8_dynamic", 0.5), ("mood", "cpu", 0, "int8_dynamic", 0.6), ("vectors", "cuda", 1, "none", 0.5)]
_MODEL = "model string, device string, device_number int, quantization string, threshold double"


@query("src_yaml_models", tally_sql(_MODEL, "scored", [(m, f"sent >= {m[-1]}") for m in _YAML], _SCORED))
def src_yaml_models(spark: SparkSession, sf: str) -> DataFrame:
    """The settings of a model registry, and the texts whose sentiment passes each threshold."""
    models = config.load_models(MODELS).items()
    return tally(X.guard(spark, sf), _MODEL, [((n, *m.accelerator, m.quantization, float(m.threshold)), found(C.Sentiment(), m.threshold)) for n, m in models])


_BUILDS = [("cpu", 512, 0.5, "int8_dynamic"), ("cuda:1", 128, 0.8, "none")]
_BUILD = "device string, max_length int, threshold double, quantization string"


@query("model_build", tally_sql(_BUILD, "scored", [(b, f"sent >= {b[2]} AND length(text) <= {b[1]}") for b in _BUILDS], _SCORED))
def model_build(spark: SparkSession, sf: str) -> DataFrame:
    """Settings built step by step, and the texts that fit their length and pass their threshold."""
    plain = config.ModelConfig("m")
    made = [plain, plain.with_(device="cuda:1", max_length=128).with_(threshold=0.8, quantization="none")]
    return tally(X.guard(spark, sf), _BUILD, [((m.device, m.max_length, m.threshold, m.quantization), found(C.Sentiment(), m.threshold) & (F.length("text") <= m.max_length)) for m in made])


_NORMAL = [(0, "", "negative|positive"), (1, "", "positive"), (2, "", "negative|positive"), (4, "", "label_0|label_1|label_2|label_3"), (2, "a|b", "a|b")]


@query("clf_label_norm", tally_sql("n_labels int, given string, labels string", "scored", [(r, f"{_SEQ} >= 0.5") for r in _NORMAL], _SCORED))
def clf_label_norm(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as they are normalised, and the texts that get the high one (the only one, where there is one)."""
    rows: Rows = []
    for n, given, _ in _NORMAL:
        labels = C.normalized_labels(n, given.split("|") if given else [])
        rows.append(((n, given, "|".join(labels)), C.Sequence("s", labels).result(F.col("text"), False)["label"] == (labels[1] if len(labels) > 1 else labels[0])))
    return tally(X.guard(spark, sf), "n_labels int, given string, labels string", rows)


_DEVICES = [("local", "cpu", None), ("huggingface", "cpu", "config error: models are not fetched"), ("local", "cuda:0", "classifier error: cuda is not available"), ("local", "metal:1", "classifier error: metal is not available")]


@query("udf_legacy_model_registry", tally_sql("source string, device string, problem string", "documents", [(d, f"doc_id % 4 = {k}") for k, d in enumerate(_DEVICES)], ""))
def udf_legacy_model_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Documents dealt to four set-ups, and why those refuse them."""
    return tally(X.texts(spark, sf), "source string, device string, problem string", [((s, d, G.device_problem(s, d)), F.col("text_id") % 4 == k) for k, (s, d, _) in enumerate(_DEVICES)])


_FILES = ["a.safetensors", "b.pt", "c.pth", "d.bin"]


@query("src_discover_models", tally_sql("file string", "documents", [((f,), f"doc_id % 4 = {k}") for k, f in enumerate(_FILES)], ""))
def src_discover_models(spark: SparkSession, sf: str) -> DataFrame:
    """The model files of a folder, and the documents that each would get if they were dealt out."""
    with tempfile.TemporaryDirectory() as folder:
        for name in [*_FILES, "e.txt", "f.onnx"]:
            Path(folder, name).touch()
        names = [p.name for p in config.discover_models(folder)]
    return tally(X.texts(spark, sf), "file string", [((n,), F.col("text_id") % len(names) == k) for k, n in enumerate(names)])


_THRESHOLDS = [("large", "refused", "false"), ("missing", "0.7", "final > 0.7"), ("overridden", "0.5", "final > 0.5"), ("read", "0.9", "final > 0.9")]


@query("src_config_guard", tally_sql("file string, safety_threshold string", "(SELECT greatest(tox, sent, pii) AS final FROM scored)", [((f, t), c) for f, t, c in _THRESHOLDS], _SCORED))
def src_config_guard(spark: SparkSession, sf: str) -> DataFrame:
    """A file beyond 1 MB, none at all, and one that is read, with and without an override; and what each threshold blocks."""
    with tempfile.TemporaryDirectory() as folder:
        large, good = Path(folder, "large"), Path(folder, "good")
        large.write_text("#" * (config.MAX_CONFIG_BYTES + 1))
        good.write_text("default: {safety_threshold: 0.9}")
        try:
            refused: float | None = config.ServiceConfig.load(large).safety_threshold
        except config.ConfigError:
            refused = None
        read = {"large": refused, "missing": config.ServiceConfig.load(Path(folder, "none")).safety_threshold, "overridden": config.ServiceConfig.load(good, safety_threshold=0.5).safety_threshold, "read": config.ServiceConfig.load(good).safety_threshold}
    df = P.from_config("basic-safety", PIPELINES["basic-safety"]).run(X.guard(spark, sf))
    over = lambda t: F.lit(False) if t is None else P.final(F.col("results"))["score"] > t
    return tally(df, "file string, safety_threshold string", [((f, "refused" if t is None else str(t)), over(t)) for f, t in read.items()])


_APPLIED = [
    ("service.safety_threshold", "0.7", "final > 0.7"), ("service.chunk_threshold", "0.8", "final > 0.8"), ("model.threshold", "0.5", "sent >= 0.5"), ("model.max_length", "512", "length(text) > 512"),
    ("action.replacement", "[REDACTED]", _SENS), ("service.max_buffer_capacity", "1000", "length(text) > 1000"),
]


@query("defaults", tally_sql("setting string, value string", "(SELECT *, greatest(tox, sent, pii) AS final FROM scored)", [((s, v), c) for s, v, c in _APPLIED], _SCORED))
def defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Settings that judge texts, at their defaults, and how many texts each concerns."""
    service, model, action = config.ServiceConfig(), config.ModelConfig("m"), config.Action("stop")
    rule = Rule("numbers", Trigger("composite", operator="or", triggers=(Trigger("pattern", pattern=r"\b\d{3}-\d{2}-\d{4}\b"), Trigger("pattern", pattern=r"\b\d{16}\b"))), (Action("redact", replacement=action.replacement),))
    df = P.from_config("basic-safety", PIPELINES["basic-safety"]).run(X.guard(spark, sf))
    df = R.with_evaluation(df, [Policy("p", (rule,))], "text", None)
    final = P.final(F.col("results"))["score"]
    return tally(df, "setting string, value string", [
        (("service.safety_threshold", str(service.safety_threshold)), final > service.safety_threshold), (("service.chunk_threshold", str(service.chunk_threshold)), final > service.chunk_threshold),
        (("model.threshold", str(model.threshold)), found(C.Sentiment(), model.threshold)), (("model.max_length", str(model.max_length)), F.length("text") > model.max_length),
        (("action.replacement", action.replacement), F.exists(F.flatten(F.transform("triggered", lambda r: r["modifications"])), lambda m: m["content"] == action.replacement)),
        (("service.max_buffer_capacity", str(service.max_buffer_capacity)), F.length("text") > service.max_buffer_capacity),
    ])


_RULES = [("pii-detection", "classifier", "redact|audit", "pii >= 0.9"), ("toxicity-filter", "classifier", "stop|audit", "tox >= 0.8"), ("prompt-injection-defense", "pattern", "log|stop", _INJ), ("sensitive-patterns", "composite", "redact|audit", _SENS)]


@query("src_yaml_policy", tally_sql("rule string, trigger string, actions string", "scored", [(r[:3], r[3]) for r in _RULES], _SCORED))
def src_yaml_policy(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of policies, one of them broken: the rules of those that can be read, and the texts on which each fires."""
    with tempfile.TemporaryDirectory() as folder:
        Path(folder, "a.yaml").write_text(DEFAULT_YAML)
        Path(folder, "b.yml").write_text("name: broken")
        policies = config.load_policies(folder)
    df = R.with_evaluation(scored(spark, sf), policies, "text", "scores")
    fired = lambda n: F.exists("triggered", lambda x: x["rule"] == n)
    return tally(df, "rule string, trigger string, actions string", [((r.name, r.trigger.type, "|".join(a.type for a in r.actions)), fired(r.name)) for p in policies for r in p.rules])


# Stages and the first stage's aggregation of each shipped pipeline. Beside them: how many results a text gets, and how many of the first stage.
_SHIPPED = [
    ("advanced-safety", 3, "none", "2 + (tox > 0.5)::INT", "1"), ("basic-safety", 1, "max_score", "1", "1"), ("comprehensive-safety", 1, "unanimous", "4", "4"), ("content-quality", 1, "none", "2", "2"),
    ("fast-triage", 1, "first_positive", "CASE WHEN greatest(tox, inj, pii) >= 0.7 THEN 1 ELSE 3 END", "CASE WHEN greatest(tox, inj, pii) >= 0.7 THEN 1 ELSE 3 END"), ("weighted-analysis", 1, "weighted_average", "1", "1"),
]


def of_stage(name: str) -> Callable[[Column], Column]:
    return lambda x: x["stage"] == name


def results_of(spark: SparkSession, sf: str, pipelines: dict, first: bool) -> DataFrame:
    """pipeline, n: the results that each pipeline gives over all texts, or those of its first stage; one pass."""
    known = C.built_in()
    df = P.run_all(X.guard(spark, sf), {f"r{k}": P.from_config(n, spec, known) for k, (n, spec) in enumerate(pipelines.items())})
    if first:
        df = df.withColumns({f"r{k}": F.filter(f"r{k}", of_stage(spec["stages"][0]["name"])) for k, spec in enumerate(pipelines.values())})
    one = df.agg(*[F.sum(F.size(f"r{k}")).alias(f"r{k}") for k in range(len(pipelines))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("pipeline"), F.col(f"r{k}").alias("n")) for k, n in enumerate(pipelines)])).alias("r")).select("r.*")


def shipped_sql(named: str, at: int, count: int) -> str:
    rows = [f"SELECT '{r[0]}' AS pipeline, {X.literal(r[at]) if isinstance(r[at], str) else r[at]} AS {named}, sum({r[count]})::BIGINT AS n FROM scored" for r in _SHIPPED]
    return X.sql("guard", f"{_SCORED} " + " UNION ALL ".join(rows))


def with_names(df: DataFrame, names: dict[str, object], into: str) -> DataFrame:
    return df.withColumn(into, F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("pipeline")))


@query("src_yaml_classifiers", shipped_sql("n_stages", 1, 3))
def src_yaml_classifiers(spark: SparkSession, sf: str) -> DataFrame:
    """Pipelines as the file has them: their stages, and the results that they give over all texts."""
    c = config.ClassifierConfig.from_yaml("pipelines:\n" + "".join(f"  {line}\n" for line in PIPELINES_YAML.splitlines()))
    rows = results_of(spark, sf, {n: c.pipelines[n] for n in c.pipeline_names()}, False)
    return with_names(rows, {n: len(c.pipelines[n]["stages"]) for n in c.pipeline_names()}, "n_stages")


@query("cfg_misc", shipped_sql("aggregation", 2, 4))
def cfg_misc(spark: SparkSession, sf: str) -> DataFrame:
    """The aggregation of each pipeline's first stage, as the configuration names it, and what it leaves of all texts' results."""
    named = lambda a: next(iter(a)) if isinstance(a, dict) else a or "none"
    return with_names(results_of(spark, sf, PIPELINES, True), {n: named(p["stages"][0].get("aggregation")) for n, p in PIPELINES.items()}, "aggregation")


@query("pl_misc", X.sql("guard", "SELECT 'p' AS pipeline, 2 AS n_stages, 'toxicity|sentiment' AS classifiers, 2 * count(*) AS n FROM guard"))
def pl_misc(spark: SparkSession, sf: str) -> DataFrame:
    """What a builder says of its pipeline, and the results that it gives."""
    p = P.Pipeline("p").single("a", C.Toxicity()).sequential("b", [("sentiment", C.Sentiment())])
    n = p.run(X.guard(spark, sf)).agg(F.sum(F.size("results")).alias("n"))
    return n.select(F.lit(p.name).alias("pipeline"), F.lit(p.stage_count).alias("n_stages"), F.lit("|".join(c.name for c in p.classifiers().values())).alias("classifiers"), "n")


_LEVELS = [("low", "great"), ("medium", "pirate"), ("high", "idiot"), ("critical", "invest")]


@query("sev_map", X.sql("guard", f", f AS (SELECT unnest([{', '.join(f'''CASE WHEN contains(text, '{p}') THEN '{s}' END''' for s, p in _LEVELS)}]) AS policy_severity FROM guard) SELECT policy_severity, CASE policy_severity WHEN 'low' THEN 'info' WHEN 'medium' THEN 'warning' ELSE policy_severity END AS severity, count(*) AS n FROM f WHERE policy_severity IS NOT NULL GROUP BY ALL"))
def sev_map(spark: SparkSession, sf: str) -> DataFrame:
    """Audits of rules of every severity, as the trail names them."""
    rules = tuple(Rule(s, Trigger("pattern", pattern=p), (Action("audit", category="c", severity=s),)) for s, p in _LEVELS)
    df = R.with_evaluation(X.guard(spark, sf), [Policy("p", rules)], "text", None)
    audits = df.select(F.explode_outer(R.outcome(F.col("triggered"))["audits"]).alias("a")).where("a is not null")
    return audits.groupBy(F.col("a.severity").alias("policy_severity"), R.severity(F.col("a.severity")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("err_map", "SELECT kind, CASE kind WHEN 'invalid_request' THEN 400 WHEN 'backend' THEN 502 WHEN 'policy_violation' THEN 403 ELSE 500 END AS status, count(*) AS n FROM (SELECT (['invalid_request', 'backend', 'policy_violation', 'internal'])[(event_id % 4 + 1)::INT] AS kind FROM events) GROUP BY ALL")
def err_map(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ["invalid_request", "backend", "policy_violation", "internal"])), (F.col("event_id") % 4).cast("int"))
    status = F.when(F.col("kind") == "invalid_request", 400).when(F.col("kind") == "backend", 502).when(F.col("kind") == "policy_violation", 403).otherwise(500)
    return X.table(spark, sf, "events").select(kind.alias("kind")).groupBy("kind", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


_ERRORS = [("classifier", 500), ("config", 400), ("internal", 500), ("policy", 403), ("stream", 502)]


@query("err_build", "SELECT kind, kind || ' error: ' || event_type AS message, status, count(*) AS n FROM (SELECT event_type, (" + X.listed(k for k, _ in _ERRORS) + ")[(event_id % 5 + 1)::INT] AS kind, ([500, 400, 500, 403, 502])[(event_id % 5 + 1)::INT] AS status FROM events) GROUP BY ALL")
def err_build(spark: SparkSession, sf: str) -> DataFrame:
    """Errors about events: kind, message and status of each class."""
    made = [e("{}") for e in (errors.ClassifierError, errors.ConfigError, errors.InternalError, errors.PolicyError, errors.StreamError)]
    e = F.get(F.array(*[F.struct(F.lit(x.kind).alias("kind"), F.lit(str(x)).alias("message"), F.lit(x.status).alias("status")) for x in made]), (F.col("event_id") % 5).cast("int"))
    rows = X.table(spark, sf, "events").select(e.alias("e"), "event_type").select("e.kind", F.replace(F.col("e.message"), F.lit("{}"), F.col("event_type")).alias("message"), "e.status")
    return rows.groupBy("kind", "message", "status").agg(F.count(F.lit(1)).alias("n"))


_SHARES = [("financial", 0.1), ("injection", 0.0), ("pii", 0.25), ("toxicity", 1.0)]


@query("dem_config", "WITH " + X.SQL["texts"] + " " + " UNION ALL ".join(f"SELECT '{k}' AS setting, {v}::DOUBLE AS value, count(*) FILTER (WHERE {O.planted('text', k, 'text_id', v, 5)} <> text) AS n FROM texts" for k, v in _SHARES))
def dem_config(spark: SparkSession, sf: str) -> DataFrame:
    """Synthetic issues at the configured shares, planted into documents."""
    c = config.DemoConfig().with_(pii=0.25, toxicity=1.0, financial=0.1)
    return tally(X.texts(spark, sf), "setting string, value double", [((k, float(getattr(c, k))), D.planted(F.col("text"), k, F.col("text_id"), getattr(c, k), 5) != F.col("text")) for k, _ in _SHARES])


_PRESETS = [("default", 3, 100), ("entire", 0, 1000), ("none", 1, 10), ("window_5", 5, 100), ("window_200", 200, 200)]


@query("ctx_presets", X.sql("chunks", ", k AS (SELECT row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS k FROM chunks) " + " UNION ALL ".join(f"SELECT '{n}' AS preset, {c} AS context_chunks, {b} AS max_buffer_size, sum(least(k, {min(c or b, b)}))::BIGINT AS n_seen, max(least(k, {min(c or b, b)}))::BIGINT AS longest FROM k" for n, c, b in _PRESETS)))
def ctx_presets(spark: SparkSession, sf: str) -> DataFrame:
    """Each preset over all chunks: the chunks that contexts hold, in all and at most."""
    presets = {"default": K.ContextConfig(), "entire": K.ContextConfig.entire(), "none": K.ContextConfig.none(), "window_5": K.ContextConfig.window(5), "window_200": K.ContextConfig.window(200)}
    seen = X.chunks(spark, sf).select(*[F.count(F.lit(1)).over(W.partitionBy("stream_id").orderBy("seq").rowsBetween(-(c.rows - 1), 0)).alias(n) for n, c in presets.items()])
    one = seen.agg(*[F.struct(F.lit(n).alias("preset"), F.lit(c.context_chunks).alias("context_chunks"), F.lit(c.max_buffer_size).alias("max_buffer_size"), F.sum(n).alias("n_seen"), F.max(n).alias("longest")).alias(n) for n, c in presets.items()])
    return one.select(F.explode(F.array(*presets)).alias("r")).select("r.*")


@query("ten_inherit", f"""{_RESOLVED.replace('WITH ', 'WITH resolved AS (WITH ', 1)})
SELECT tenant, coalesce(safety_threshold, 0.7::DOUBLE) AS safety_threshold, coalesce(stream_format, 'openai') AS stream_format, 0.8::DOUBLE AS chunk_threshold, count(*) AS n
FROM resolved LEFT JOIN (SELECT * FROM {_TENANTS}) t ON id = tenant GROUP BY ALL""")  # fmt: skip
def ten_inherit(spark: SparkSession, sf: str) -> DataFrame:
    """Requests by tenant with the settings that hold for them: the tenant's own, or what it inherits."""
    own = N.inherited(tenant_rows(spark), config.ServiceConfig()).select(F.col("id").alias("tenant"), "safety_threshold", "stream_format", "chunk_threshold")
    d = config.ServiceConfig()
    rows = N.resolve(http(spark, sf), tenant_rows(spark)).groupBy("tenant").agg(F.count(F.lit(1)).alias("n")).join(own, "tenant", "left")
    return rows.select("tenant", *[F.coalesce(F.col(c), F.lit(getattr(d, c))).alias(c) for c in ("safety_threshold", "stream_format", "chunk_threshold")], "n")


_ADAPTERS = [("anthropic", "text/event-stream"), ("lined", "application/x-ndjson"), ("lines", "application/x-ndjson"), ("openai", "text/event-stream"), ("other", "text/event-stream")]


@query("adapt_misc", X.sql("chunks", " " + " UNION ALL ".join(f"SELECT '{n}' AS adapter, '{t}' AS content_type, count(*) AS n FROM chunks" for n, t in _ADAPTERS)))
def adapt_misc(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks framed as each adapter reads them; a format that is no kind of lines is one of events."""
    j = lambda *c: F.to_json(F.struct(*c))
    plain = j(F.col("chunk").alias("response"))
    bodies = {
        "openai": j(F.array(F.struct(F.struct(F.col("chunk").alias("content")).alias("delta"))).alias("choices")), "anthropic": j(F.struct(F.col("chunk").alias("text")).alias("delta")),
        "lined": plain, "lines": plain, "other": plain,
    }
    made = [adapters.anthropic(), adapters.OpenAi(), *[adapters.Configured(n, f, "response", "[END]", [], "why") for n, f in (("lined", "ndjson"), ("lines", "jsonl"), ("other", "whatever"))]]
    parts = []
    for a in made:
        body = bodies[a.name] if a.content_type.endswith("ndjson") else F.concat(F.lit("event: content_block_delta\ndata: " if a.name == "anthropic" else "data: "), bodies[a.name], F.lit("\n\n"))
        frames = X.chunks(spark, sf).select("stream_id", "seq", body.alias("frame"))
        parts.append(adapters.parse_frames(frames, a).where("kind = 'content'").agg(F.count(F.lit(1)).alias("n")).select(F.lit(a.name).alias("adapter"), F.lit(a.content_type).alias("content_type"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
