"""Queries of mechanisms that the documentation describes: early exit, de-obfuscation, drift, inherited policies, provable audit, selection."""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardspark.operators import audit as A
from guardspark.operators import classifiers as C
from guardspark.operators import deobfuscate as D
from guardspark.operators import drift as R
from guardspark.operators import merkle as M
from guardspark.operators import ml
from guardspark.operators import pipelines as P
from guardspark.operators import ranked
from guardspark.operators import selection as S
from guardspark.plans import fixtures as X
from guardspark.plans import oracle as O
from guardspark.plans.catalog import query
from guardspark.plans.flow import _CHAIN
from guardspark.sources import inherit


def length_model() -> C.VectorClassifier:
    """A model in Python whose raw scores go from -5 to 5."""

    def load():
        return lambda texts: pd.DataFrame({"label": "raw", "score": texts.str.len() % 11 - 5.0})

    return C.VectorClassifier("length-model", load)


_EXIT = f"{O.tox('text')} AS tox, {O.inj('text')} AS inj, greatest(0.0, least(1.0, (length(text) % 11 - 5.0 + 4) / 8))::DOUBLE AS model"


@query("stg_exit", X.sql("guard", f""", s AS (SELECT text_id, {_EXIT} FROM guard)
SELECT text_id, CASE WHEN tox > 0 THEN 'toxicity' WHEN inj > 0.9 THEN 'toxicity|prompt-injection' ELSE 'toxicity|prompt-injection|length-model' END AS classifiers,
  round(CASE WHEN tox > 0 THEN tox WHEN inj > 0.9 THEN inj ELSE model END, 6) AS score FROM s"""))  # fmt: skip
def stg_exit(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with any toxicity leave first, then clear injections; only the rest reaches the model, whose scores are normalised."""
    spec = {"stages": [
        {"type": "single", "name": "terms", "classifier": "toxicity", "exit_on": "match"}, {"type": "single", "name": "rules", "classifier": "prompt-injection", "exit_on": "threshold", "threshold": 0.9},
        {"type": "single", "name": "model", "classifier": "length-model", "transform": {"type": "normalize", "min": -4, "max": 4}},
    ]}
    pipeline = P.from_config("exits", spec, C.built_in() | {"length-model": length_model()})
    df = pipeline.run(X.guard(spark, sf))
    return df.select("text_id", F.array_join("results.classifier", "|").alias("classifiers"), F.round(P.final(F.col("results"))["score"], 6).alias("score"))


# Hidden phrases that are appended by doc_id, and the terms that are looked for.
HIDDEN = [
    "nothing to see", "this is g u a r a n t e e d money", "g.u.a.r.a.n.t.e.e.d!", "gua\u200bran\u200bteed and risk\u200b free", "gսаrаntееd", "R1SK FR33 for you", "ｇｕａｒａｎｔｅｅｄ",
    "a b c d", "r_i_s_k free", "no ri5k fr3e, 6uaranteed", "G U A R A N T E E D",
]
TERMS = ["guaranteed", "risk free"]
_N = len(HIDDEN)


@query("adv_deobfuscate", f"""WITH t AS (SELECT doc_id AS text_id, coalesce(text, '') || ' ' || ({X.listed(HIDDEN)})[(doc_id % {_N} + 1)::INT] AS text FROM documents),
p AS (SELECT text_id, text, regexp_split_to_array(text, {X.literal(D.CUT)}) AS gaps, regexp_extract_all(text, {X.literal(D.CUT)}) AS cuts FROM t),
q AS (SELECT text_id, i, gaps[i] AS gap, coalesce(cuts[i], '') AS cut, (length(gaps[i]) = 1 AND length(gaps[i + 1]) = 1) IS TRUE OR NOT regexp_matches(coalesce(cuts[i], ''), '[^{D.ZERO_WIDTH}]') AS gone FROM p, range(1, len(gaps) + 1) r(i)),
f AS (SELECT text_id, translate(string_agg(gap || CASE WHEN gone THEN '' ELSE cut END, '' ORDER BY i), {X.literal(D.FROM)}, {X.literal(D.TO)}) AS folded FROM q GROUP BY text_id),
h AS (SELECT text_id, folded, regexp_extract_all(folded, 'guaranteed|risk free') AS hits, array_to_string(list_transform(list_zip(regexp_split_to_array(folded, 'guaranteed|risk free'), regexp_extract_all(folded, 'guaranteed|risk free')),
  lambda x: repeat('0', length(x[1])) || CASE WHEN x[2] IS NULL THEN '' ELSE '1' || repeat('2', length(x[2]) - 1) END), '') AS mask FROM f),
c AS (SELECT q.text_id, q.i, 0 AS part, j, substr(gap, j, 1) AS ch, true AS kept FROM q JOIN h USING (text_id), range(1, length(gap) + 1) r(j) WHERE len(hits) > 0
  UNION ALL SELECT q.text_id, q.i, 1, j, substr(cut, j, 1), NOT gone FROM q JOIN h USING (text_id), range(1, length(cut) + 1) r(j) WHERE len(hits) > 0),
n AS (SELECT *, sum(kept::INT) OVER (PARTITION BY text_id ORDER BY i, part, j) AS k FROM c),
m AS (SELECT n.*, substr(mask, k::BIGINT + CASE WHEN kept THEN 0 ELSE 1 END, 1) AS mark FROM n JOIN h USING (text_id)),
o AS (SELECT text_id, string_agg(CASE WHEN kept AND mark = '1' THEN '[REDACTED]' WHEN mark = '2' OR kept AND mark = '1' THEN '' ELSE ch END, '' ORDER BY i, part, j) AS protected FROM m GROUP BY text_id)
SELECT text_id, len(hits)::BIGINT AS n, array_to_string(hits, '|') AS hits, coalesce(protected, text) AS protected FROM t JOIN h USING (text_id) LEFT JOIN o USING (text_id)""")  # fmt: skip
def adv_deobfuscate(spark: SparkSession, sf: str) -> DataFrame:
    """Hidden terms in documents, redacted where they stand in the source."""
    phrase = F.get(F.array(*map(F.lit, HIDDEN)), F.pmod(F.col("text_id"), F.lit(_N)).cast("int"))
    texts = X.texts(spark, sf).select("text_id", F.concat_ws(" ", F.coalesce("text", F.lit("")), phrase).alias("text"))
    return D.protect(texts, TERMS).select("text_id", F.size("hits").cast("long").alias("n"), F.array_join("hits", "|").alias("hits"), "protected")


_TOKENS = "unnest(regexp_extract_all(lower(text), '" + R.TOKEN + "'))"
_BUCKET = f"(('0x' || md5(token)[1:8])::BIGINT % {R.BUCKETS})"


@query("adv_drift", f"""WITH said AS (SELECT conv_id, role, text FROM conversations),
bt AS (SELECT token, count(*) AS n FROM (SELECT {_TOKENS} AS token FROM said WHERE role = 'user') GROUP BY token),
total AS (SELECT sum(n) AS t FROM bt),
q AS (SELECT b AS bucket, (coalesce(n, 0) + 1) / (t + {R.BUCKETS}) AS q FROM range({R.BUCKETS}) r(b) LEFT JOIN (SELECT {_BUCKET} AS b, sum(n) AS n FROM bt GROUP BY 1) USING (b), total),
bs AS (SELECT sum({O.hits('text', O.any_of(O.L.POSITIVE))}) AS pos, sum({O.hits('text', O.any_of(O.L.NEGATIVE))}) AS neg FROM said WHERE role = 'user'),
a AS (SELECT conv_id, {_TOKENS} AS token FROM said WHERE role = 'assistant'),
s AS (SELECT conv_id, count(*) AS n_tokens, count(*) FILTER (WHERE n IS NULL OR n < {R.COMMON_SHARE} * t) AS rare FROM a LEFT JOIN bt USING (token), total GROUP BY conv_id),
h AS (SELECT conv_id, {_BUCKET} AS bucket, count(*) AS n FROM a GROUP BY ALL),
g AS (SELECT s.conv_id, (coalesce(h.n, 0) + 1) / (n_tokens + {R.BUCKETS}) AS p, q FROM s, q LEFT JOIN h ON h.conv_id = s.conv_id AND h.bucket = q.bucket),
d AS (SELECT conv_id, sum(p * ln(p / q)) AS kl, sum((p - q) * ln(p / q)) AS psi FROM g GROUP BY conv_id),
e AS (SELECT conv_id, sum({O.hits('text', O.any_of(O.L.POSITIVE))}) AS pos, sum({O.hits('text', O.any_of(O.L.NEGATIVE))}) AS neg FROM said WHERE role = 'assistant' GROUP BY conv_id),
f AS (SELECT conv_id, n_tokens, kl, psi, rare / n_tokens AS rare_ratio, abs(CASE WHEN e.pos + e.neg > 0 THEN e.pos / (e.pos + e.neg) ELSE 0.5 END - (SELECT CASE WHEN pos + neg > 0 THEN pos / (pos + neg) ELSE 0.5 END FROM bs)) AS shift
  FROM s JOIN d USING (conv_id) JOIN e USING (conv_id))
SELECT conv_id, n_tokens, round(kl, 6) AS kl, round(psi, 6) AS psi, round(rare_ratio, 6) AS rare_ratio, round(shift, 6) AS sentiment_shift,
  round(0.4 * (1 - exp(-kl)) + 0.3 * shift + 0.3 * rare_ratio, 6) AS score, round(0.4 * (1 - exp(-kl)) + 0.3 * shift + 0.3 * rare_ratio, 6) > 0.3 AS drifted FROM f""")  # fmt: skip
def adv_drift(spark: SparkSession, sf: str) -> DataFrame:
    """What assistants say in each conversation against what users say in all."""
    said = X.table(spark, sf, "conversations")
    rows = R.drift(said.where("role = 'assistant'"), R.Baseline.of(said.where("role = 'user'")), "conv_id")
    values = [F.round(c, 6).alias(c) for c in ("kl", "psi", "rare_ratio", "sentiment_shift", "score")]
    return rows.select("conv_id", "n_tokens", *values).withColumn("drifted", F.col("score") > 0.3)


_P = "(0.5 * pii + 0.5 * tox)"
_H = f"(CASE WHEN {_P} > 0 THEN -{_P} * ln({_P}) ELSE 0 END + CASE WHEN 1 - {_P} > 0 THEN -(1 - {_P}) * ln(1 - {_P}) ELSE 0 END)"


@query("adv_select", X.sql("guard", f""", {O.SCORED}, w AS (SELECT text_id, lang, {_H} AS w FROM scored JOIN documents ON doc_id = text_id),
k AS (SELECT text_id, lang, ln((('0x' || md5(text_id || ':9')[1:12])::BIGINT + 0.5::DOUBLE) / {1 << 48}) / w AS key FROM w WHERE w > 0)
SELECT lang, rank, text_id, round(key, 6) AS key FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY key DESC, text_id)::INT AS rank FROM k) WHERE rank <= 25"""))  # fmt: skip
def adv_select(spark: SparkSession, sf: str) -> DataFrame:
    """By language, 25 documents to have labelled, the likelier the less the classifiers can tell."""
    df = C.with_results(X.guard(spark, sf), {"t": C.Toxicity(), "p": C.Pii()}, "text", False)
    df = df.select("text_id", (0.5 * F.col("p.score") + 0.5 * F.col("t.score")).alias("p"))
    df = S.with_keys(df, "text_id", S.entropy(F.col("p")), 9).join(X.table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "lang"), "text_id")
    return S.reservoir(df, 25, "text_id", "lang").select("lang", "rank", "text_id", F.round("reservoir_key", 6).alias("key"))


# Three sets, the last extends the others.
SETS = {
    "base": """
name: base
defaults: {mode: enforce, priority: 50}
policies:
  - {name: toxic, priority: 90, trigger: {type: classifier, classifier: toxicity, threshold: 0.6}, action: {type: stop, message: "${rule_name} ${score} in ${text_id}", status_code: 451}}
  - {name: praise, trigger: {type: pattern, pattern: "great"}, action: {type: inject, content: " [${rule_name}]"}, continue: true}
  - {name: old, trigger: {type: pattern, pattern: "."}, action: stop}
""",
    "money": """
name: money
extends: base
defaults: {priority: 70, mode: shadow}
policies:
  - {name: promise, trigger: {type: pattern, pattern: "guaranteed", case_insensitive: true}, action: stop, message: no promises}
  - {name: invest, mode: enforce, trigger: {type: pattern, pattern: "invest"}, action: {type: redact}, continue: true}
""",
    "house": """
name: house
extends: [money, base]
policies:
  - {name: old, mode: disabled, trigger: {type: pattern, pattern: "."}, action: stop}
  - {name: pirates, priority: 70, trigger: {type: pattern, pattern: "pirate"}, action: stop, message: "no pirates"}
""",
}


@query("pol_inherited", X.sql("guard", f""", s AS (SELECT *, {O.tox('text')} AS tox FROM guard),
f AS (SELECT text_id, round(tox, 6) AS score, [CASE WHEN tox >= 0.6 THEN 'toxic' END, CASE WHEN {O.rx('text', '(?i)guaranteed')} THEN 'promise' END, CASE WHEN contains(text, 'invest') THEN 'invest' END, CASE WHEN contains(text, 'pirate') THEN 'pirates' END, CASE WHEN contains(text, 'great') THEN 'praise' END] AS fired FROM s),
v AS (SELECT text_id, score, CASE WHEN fired[1] IS NOT NULL THEN fired[1:1] WHEN fired[4] IS NOT NULL THEN fired[1:4] ELSE fired END AS seen FROM f)
SELECT text_id, array_to_string(list_filter(seen, lambda x: x IS NOT NULL AND x <> 'promise'), '|') AS rules, array_to_string(list_filter(seen, lambda x: x = 'promise'), '|') AS shadowed,
  list_has_any(seen, ['toxic', 'pirates']) AS should_stop, CASE WHEN list_contains(seen, 'pirates') THEN 'no pirates' WHEN list_contains(seen, 'toxic') THEN 'toxic ' || score || ' in ' || text_id END AS message,
  array_to_string(list_filter([CASE WHEN list_contains(seen, 'invest') THEN '[REDACTED]' END, CASE WHEN list_contains(seen, 'praise') THEN ' [praise]' END], lambda x: x IS NOT NULL), '|') AS content FROM v"""))  # fmt: skip
def pol_inherited(spark: SparkSession, sf: str) -> DataFrame:
    """Documents under a set that extends two others: priorities, first match, a shadow rule, an overridden one and variables."""
    rules = inherit.resolve("house", {n: inherit.PolicySet.from_yaml(t) for n, t in SETS.items()})
    df = C.with_results(X.guard(spark, sf), {"tox": C.Toxicity()}, "text", False)
    df = df.select("text_id", "text", F.create_map(F.lit("toxicity"), F.round("tox.score", 6)).alias("scores"))
    df = ranked.with_ranked(df, rules, "text", "scores", variables={"text_id": F.col("text_id")})
    return df.select("text_id", F.array_join("triggered.rule", "|").alias("rules"), F.array_join("shadowed", "|").alias("shadowed"), "outcome.should_stop", F.col("outcome.stop_message").alias("message"), F.array_join("outcome.modifications.content", "|").alias("content"))


_MERKLE = f""", {_CHAIN},
lv AS (SELECT chain, k - 1 AS i, 0 AS level, count(*) OVER (PARTITION BY chain) AS size, sha256('leaf:' || hash) AS h FROM c
  UNION ALL SELECT chain, i // 2, level + 1, max((size + 1) // 2), CASE WHEN count(*) = 2 THEN sha256('node:' || min_by(h, i) || ':' || max_by(h, i)) ELSE max(h) END FROM lv WHERE size > 1 GROUP BY chain, i // 2, level)"""


def merkle_sql(select: str) -> str:
    return X.sql("audit", f"{_MERKLE} {select}").replace("WITH ", "WITH RECURSIVE ", 1)


def hashed(spark: SparkSession, sf: str) -> DataFrame:
    """chain, seq, hash of the audit events; what a hash isn't made of stays away from Python."""
    return M.saved(A.chain(X.audit_events(spark, sf).select("chain", "seq", "event_type", "data", "ts")).select("chain", "seq", "hash"), "chained")


@query("aud_merkle", merkle_sql("SELECT l.chain, n, h AS root FROM lv l JOIN (SELECT chain, max(k) AS n FROM c GROUP BY chain) USING (chain) WHERE size = 1"))
def aud_merkle(spark: SparkSession, sf: str) -> DataFrame:
    """The root of each day's chain, and its number of events."""
    events = hashed(spark, sf)
    n = events.groupBy("chain").agg(F.count(F.lit(1)).alias("n"))
    return n.join(M.roots(M.trees(events)), "chain")


@query("aud_proof", merkle_sql("SELECT chain, seq, k - 1 AS leaf, true AS valid, false AS forged FROM c"))
def aud_proof(spark: SparkSession, sf: str) -> DataFrame:
    """Every event's proof against its chain's root; the same proof for another event's hash fails."""
    events = hashed(spark, sf)
    leaves = M.numbered(events)
    built = M.trees(events, leaves)
    rows = M.proofs(built, leaves.join(M.roots(built), "chain"))
    return rows.select("chain", "seq", "leaf", M.proven(F.col("hash"), F.col("steps"), F.col("root")).alias("valid"), M.proven(F.sha2("hash", 256), F.col("steps"), F.col("root")).alias("forged"))


@query("aud_tampered", X.sql("audit", "SELECT chain, seq FROM audit WHERE seq % 97 = 3"))
def aud_tampered(spark: SparkSession, sf: str) -> DataFrame:
    """Chains some of whose events were changed afterwards: where."""
    events = A.chain(X.audit_events(spark, sf))
    return A.breaks(events.withColumn("data", F.when(F.col("seq") % 97 == 3, F.concat("data", F.lit("x"))).otherwise(F.col("data"))))


@query("aud_report", X.sql("requests", """, x AS (SELECT action, unnest(CASE WHEN len(triggered_rules) = 0 THEN [NULL] ELSE triggered_rules END) AS rule FROM requests)
SELECT 'all' AS level, '*' AS action, '*' AS rule, (SELECT count(*) FROM requests) AS n, (SELECT count(rule) FROM x) AS n_triggers
UNION ALL SELECT 'action', action, '*', count(*), sum(len(triggered_rules))::BIGINT FROM requests GROUP BY action UNION ALL SELECT 'rule', action, rule, count(*), count(*) FROM x WHERE rule IS NOT NULL GROUP BY action, rule"""))  # fmt: skip
def aud_report(spark: SparkSession, sf: str) -> DataFrame:
    return A.compliance_report(X.requests(spark, sf))


_CLASSES, _DIMS = ("calm", "busy", "odd"), 64


@query("udf_ml_head", f"""WITH l AS (SELECT vec_id, list_transform(range(3), lambda k: list_sum(list_transform(range(1, {_DIMS + 1}), lambda d: coalesce(embedding[d], 0)::DOUBLE * cos(3 * (d - 1) + k))) + 0.1 * k) AS z FROM embeddings),
p AS (SELECT vec_id, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM l), q AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM p)
SELECT vec_id, CASE WHEN p[3] >= p[1] AND p[3] >= p[2] THEN 'odd' WHEN p[2] >= p[1] THEN 'busy' ELSE 'calm' END AS label, round(list_max(p), 6) AS score, 'head' AS model FROM q""")  # fmt: skip
def udf_ml_head(spark: SparkSession, sf: str) -> DataFrame:
    """A sequence head, read from its file of weights, over the vectors of ``embeddings``."""
    with tempfile.TemporaryDirectory() as folder:
        k, d = np.meshgrid(range(3), range(_DIMS), indexing="ij")
        np.savez(f"{folder}/head.npz", labels=np.array(_CLASSES), weights=np.cos(3 * d + k), bias=0.1 * np.arange(3))
        head = ml.SequenceHead.from_file(f"{folder}/head.npz")
    df = C.with_results(X.table(spark, sf, "embeddings").select("vec_id", "embedding"), {"r": ml.head_classifier("head", head)}, "embedding")
    return df.select("vec_id", "r.label", F.round("r.score", 6).alias("score"), "r.model")
