"""Queries: wire formats and synthetic data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardspark.plans import fixtures as X
from guardspark.plans import oracle as O
from guardspark.plans.catalog import query
from guardspark.sources import adapters as D
from guardspark.sources import datagen as G
from guardspark.sources.config import DemoConfig

SHOWN = ["stream_id", "seq", "pos", "kind", "text", "finish_reason"]


def framed(spark: SparkSession, sf: str) -> DataFrame:
    """Each chunk as a frame of six chat-completion lines."""
    j = lambda c: F.to_json(c)
    delta = lambda d: F.struct(F.lit("c1").alias("id"), F.lit("m").alias("model"), F.array(F.struct(F.lit(0).alias("index"), d.alias("delta"))).alias("choices"))
    content = delta(F.struct(F.col("chunk").alias("content")))
    lines = [F.concat(F.lit("data: "), j(content)), F.lit("data: {broken"), F.lit(": comment"), F.lit('data: {"choices":[{"delta":{"tool_calls":[1]}}]}'), F.lit('data: {"choices":[{"delta":{"content":"x"},"finish_reason":"stop"}]}'), F.lit("data: [DONE]")]
    return X.chunks(spark, sf).select("stream_id", "seq", F.concat_ws("\n", *lines).alias("frame"))


@query("src_openai_sse", X.sql("chunks", """, p AS (SELECT stream_id, seq, unnest([0, 1, 2, 3, 4])::INT AS pos, chunk FROM chunks)
SELECT stream_id, seq, pos, (['content', 'error', 'passthrough', 'done', 'done'])[pos + 1] AS kind, CASE WHEN pos = 0 THEN chunk END AS text, CASE WHEN pos = 3 THEN 'stop' END AS finish_reason FROM p"""))  # fmt: skip
def src_openai_sse(spark: SparkSession, sf: str) -> DataFrame:
    return D.parse_frames(framed(spark, sf), D.OpenAi()).select(*SHOWN)


def evented(spark: SparkSession, sf: str) -> DataFrame:
    body = F.to_json(F.struct(F.struct(F.col("chunk").alias("text")).alias("delta")))
    lines = [F.lit("event: ping"), F.lit('data: {"type":"ping"}'), F.lit(""), F.lit("event: content_block_delta"), F.concat(F.lit("data: "), body), F.lit('data: {"delta":{"text":7}}'), F.lit("data: {broken"), F.lit("event: message_stop"), F.lit('data: {"type":"message_stop"}')]
    return X.chunks(spark, sf).select("stream_id", "seq", F.concat_ws("\n", *lines).alias("frame"))


@query("src_anthropic", X.sql("chunks", """, p AS (SELECT stream_id, seq, unnest([0, 1, 2, 3])::INT AS pos, chunk FROM chunks)
SELECT stream_id, seq, pos, (['passthrough', 'content', 'done', 'done'])[pos + 1] AS kind, CASE WHEN pos = 1 THEN chunk END AS text, NULL::VARCHAR AS finish_reason FROM p"""))  # fmt: skip
def src_anthropic(spark: SparkSession, sf: str) -> DataFrame:
    return D.parse_frames(evented(spark, sf), D.anthropic()).select(*SHOWN)


@query("src_cfg_sse", X.sql("chunks", """, p AS (SELECT stream_id, seq, unnest([0, 1, 2])::INT AS pos, chunk FROM chunks)
SELECT stream_id, seq, pos, (['content', 'done', 'done'])[pos + 1] AS kind, CASE WHEN pos = 0 THEN chunk END AS text, CASE WHEN pos = 1 THEN 'length' END AS finish_reason, CASE WHEN pos = 0 THEN 'say' END AS event_type FROM p"""))  # fmt: skip
def src_cfg_sse(spark: SparkSession, sf: str) -> DataFrame:
    body = F.to_json(F.struct(F.array(F.struct(F.col("chunk").alias("t"))).alias("out")))
    lines = [F.lit("event: say"), F.concat(F.lit("data: "), body), F.lit("data: {}"), F.lit('data: {"why":"length","out":[{"t":"late"}]}'), F.lit("data: <end>")]
    frames = X.chunks(spark, sf).select("stream_id", "seq", F.concat_ws("\n", *lines).alias("frame"))
    a = D.Configured("c", "sse", "out[0].t", "<end>", [], "why")
    return D.parse_frames(frames, a).select(*SHOWN, F.col("meta.event_type").alias("event_type"))


@query("src_cfg_ndjson", X.sql("chunks", """, p AS (SELECT stream_id, seq, unnest([0, 1, 2])::INT AS pos, chunk FROM chunks)
SELECT stream_id, seq, pos, (['content', 'done', 'done'])[pos + 1] AS kind, CASE WHEN pos = 0 THEN chunk END AS text, CASE WHEN pos = 1 THEN 'stop' END AS finish_reason FROM p"""))  # fmt: skip
def src_cfg_ndjson(spark: SparkSession, sf: str) -> DataFrame:
    body = F.to_json(F.struct(F.col("chunk").alias("response")))
    frames = X.chunks(spark, sf).select("stream_id", "seq", F.concat_ws("\n", body, F.lit("nonsense"), F.lit('{"reason":"stop"}'), F.lit('{"done":true}')).alias("frame"))
    return D.parse_frames(frames, D.Configured("n", "ndjson", "response", '"done":true', [], "reason")).select(*SHOWN)


@query("src_path_extract", "SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN json_type(props, '$.k') = 'VARCHAR' THEN json_extract_string(props, '$.k') END AS text, 'v' || event_id AS deep FROM events")
def src_path_extract(spark: SparkSession, sf: str) -> DataFrame:
    e = X.table(spark, sf, "events")
    nested = F.to_json(F.struct(F.array(F.lit("z").alias("z"), F.concat(F.lit("v"), F.col("event_id"))).alias("a")))
    return e.select("event_id", F.get_json_object("props", D.json_path("k")).alias("k"), D.text_at(F.col("props"), "k").alias("text"), D.text_at(nested, "a[1]").alias("deep"))


@query("src_done_marker", X.sql("chunks", "SELECT stream_id, seq, seq % 3 = 0 AS openai, seq % 3 = 1 AS anthropic FROM chunks"))
def src_done_marker(spark: SparkSession, sf: str) -> DataFrame:
    line = F.when(F.col("seq") % 3 == 0, "  data: [DONE] ").when(F.col("seq") % 3 == 1, "event: message_stop").otherwise("data: {}")
    return X.chunks(spark, sf).select("stream_id", "seq", D.OpenAi().is_done(line).alias("openai"), D.anthropic().is_done(line).alias("anthropic"))


@query("src_adapter_registry", X.sql("chunks", """, f AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 'anthropic' ELSE 'unheard-of' END AS format FROM chunks)
SELECT stream_id, seq, format, count(*) FILTER (WHERE true) AS n FROM f, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE k <= CASE WHEN format = 'anthropic' THEN 4 ELSE 5 END GROUP BY ALL"""))  # fmt: skip
def src_adapter_registry(spark: SparkSession, sf: str) -> DataFrame:
    a, b = framed(spark, sf).where("seq % 2 = 1").withColumn("format", F.lit("unheard-of")), evented(spark, sf).where("seq % 2 = 0").withColumn("format", F.lit("anthropic"))
    return D.parse_mixed(a.unionByName(b), D.default_registry()).groupBy("stream_id", "seq", "format").agg(F.count(F.lit(1)).alias("n"))


@query("chunk_build", X.sql("chunks", "SELECT 'content' AS kind, count(*) AS n FROM chunks UNION ALL SELECT 'done', 2 * count(*) FROM chunks"))
def chunk_build(spark: SparkSession, sf: str) -> DataFrame:
    return D.parse_frames(framed(spark, sf), D.OpenAi()).where(F.col("kind").isin("content", "done")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_WORDS = r"list_filter(regexp_split_to_array(text, '[\s\x0B\x{85}\x{A0}]+'), lambda w: w <> '')"


@query("gen_chunker", X.sql("texts", f""", w AS (SELECT text_id, {_WORDS} AS w FROM texts), g AS (SELECT text_id, w, unnest(range(0, len(w), 3)) AS i FROM w)
SELECT text_id, (i // 3)::INT AS seq, array_to_string(w[i + 1:i + 3], ' ') || ' ' AS chunk FROM g"""))  # fmt: skip
def gen_chunker(spark: SparkSession, sf: str) -> DataFrame:
    return G.chunked(X.texts(spark, sf), "text")


_ROUTE = "CASE WHEN " + " OR ".join(f"contains(lower(prompt), '{w}')" for w in G.ROUTES[0][1]) + " THEN 'coding' WHEN " + " OR ".join(f"contains(lower(prompt), '{w}')" for w in G.ROUTES[1][1]) + " THEN 'creative' ELSE 'general' END"
_PROMPTS = [p for ps in G.PROMPTS.values() for _, p in ps]


def answer_sql(key: str) -> str:
    return "CASE route " + " ".join(f"WHEN '{name}' THEN {O.pick(texts, key, 11)}" for name, texts in G.ANSWERS.items()) + f" END || {O.pick(G.TAILS, key, 12)}"


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    prompt = F.get(F.array(*map(F.lit, _PROMPTS)), (F.col("event_id") % len(_PROMPTS)).cast("int"))
    return X.table(spark, sf, "events").select("event_id", prompt.alias("prompt"))


_ANSWERED = f"""WITH p AS (SELECT event_id, ({X.listed(_PROMPTS)})[(event_id % {len(_PROMPTS)} + 1)::INT] AS prompt FROM events), q AS (SELECT event_id, {_ROUTE} AS route FROM p),
a AS (SELECT event_id, route, {answer_sql('event_id')} AS content, {O.between('event_id', 13, 50, 500)}::INT AS tokens_used FROM q)"""


@query("gen_mock_llm", f"{_ANSWERED} SELECT event_id, route, content, 'stop' AS finish_reason, tokens_used FROM a")
def gen_mock_llm(spark: SparkSession, sf: str) -> DataFrame:
    return prompts(spark, sf).withColumn("a", G.completion(F.col("prompt"), F.col("event_id"))).select("event_id", G.route(F.col("prompt")).alias("route"), "a.*")


# What the mock model is set to plant.
ISSUES = DemoConfig(pii=0.3, toxicity=0.2, injection=0.5, financial=1.0)


def with_issues_sql(text: str) -> str:
    """The steps of planting as columns, one upon the other."""
    for n, kind in enumerate(("pii", "toxicity", "injection", "financial")):
        text = f"SELECT event_id, route, {O.planted('content', kind, 'event_id', getattr(ISSUES, kind), 20 * (n + 1))} AS content, tokens_used FROM ({text})"
    return text


@query("gen_mock_issues", f"{_ANSWERED} SELECT event_id, route, content, tokens_used FROM ({with_issues_sql('SELECT * FROM a')})")
def gen_mock_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Mock answers with issues, as a replay of traffic through the guard needs them."""
    made = G.completion(F.col("prompt"), F.col("event_id"), issues=ISSUES)
    return prompts(spark, sf).select("event_id", G.route(F.col("prompt")).alias("route"), made["content"].alias("content"), made["tokens_used"].alias("tokens_used"))


@query("gen_mock_stream", f"""{_ANSWERED}, w AS (SELECT event_id, string_split(content, ' ') AS w FROM a), g AS (SELECT event_id, w, unnest(range(0, len(w), 3)) AS i FROM w)
SELECT event_id, (i // 3)::INT AS seq, array_to_string(w[i + 1:i + 3], ' ') || ' ' AS chunk, CASE WHEN i + 3 >= len(w) THEN 'stop' END AS finish_reason FROM g""")  # fmt: skip
def gen_mock_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The mock answers as chunks of three words, the last with the reason."""
    answers = prompts(spark, sf).select("event_id", G.answer(F.col("prompt"), F.col("event_id")).alias("text"))
    last = F.floor((F.size(G.words_of(F.col("text"))) - 1) / 3)
    chunks = G.chunked(answers.withColumn("last", last), "text")
    return chunks.select("event_id", "seq", "chunk", F.when(F.col("seq") == F.col("last"), "stop").alias("finish_reason"))


_TEMPLATES = [(c, k, s, p) for c, ps in G.PROMPTS.items() for k, (s, p) in enumerate(ps)]
_TRAFFIC = f"""WITH t(category, k, system, prompt) AS (VALUES {", ".join(f"({X.literal(c)}, {k}, {X.literal(s)}, {X.literal(p)})" for c, k, s, p in _TEMPLATES)}),
r AS (SELECT id, {O.pick(list(G.PROMPTS), 'id', 3)} AS category, {O.drawn('id', 4, 2**31 - 1)} AS d FROM (SELECT event_id AS id FROM events)),
s AS (SELECT category, count(*) AS n FROM t GROUP BY category)
SELECT id, r.category, 'gpt-4' AS model, system, prompt FROM r JOIN s USING (category) JOIN t ON t.category = r.category AND t.k = r.d % s.n"""


@query("gen_traffic", _TRAFFIC)
def gen_traffic(spark: SparkSession, sf: str) -> DataFrame:
    """A request for each event."""
    return G.traffic_of(X.table(spark, sf, "events").select(F.col("event_id").alias("id")), seed=3)


def planted(kind: str) -> None:
    @query(f"gen_inject_{kind}", X.sql("texts", f", p AS (SELECT text_id, text AS old, {O.planted('text', kind, 'text_id', 0.5, 9)} AS text FROM texts) SELECT text_id, text, text <> old AS planted FROM p"))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        text = G.planted(F.col("text"), kind, F.col("text_id"), 0.5, 9)
        return X.texts(spark, sf).select("text_id", "text", text.alias("new")).select("text_id", F.col("new").alias("text"), (F.col("new") != F.col("text")).alias("planted"))


for _kind in ("pii", "toxicity", "injection", "financial"):
    planted(_kind)

for _kind in ("ssn", "cc", "email", "phone", "address", "name"):
    _name = "credit_card" if _kind == "cc" else _kind
    query(f"gen_fake_{_kind}", f"SELECT event_id, {O.fake(_name, 'event_id', 4)} AS value FROM events")(
        lambda spark, sf, k=_name: X.table(spark, sf, "events").select("event_id", G.fake(k, F.col("event_id"), 4).alias("value"))
    )
