"""Queries: ordered context, holdback, midstream, egress, and the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardspark.operators import audit as A
from guardspark.operators import context as K
from guardspark.operators import phases
from guardspark.operators import pipelines as P
from guardspark.plans import fixtures as X
from guardspark.plans import oracle as O
from guardspark.plans.catalog import query
from guardspark.plans.govern import _INJ, _SENS, default_plan
from guardspark.plans.shipped import PIPELINES
from guardspark.sources import adapters
from guardspark.streaming import stateful as S

W = "PARTITION BY stream_id ORDER BY seq"


def context_sql(rows: str, delimiter: str = " ") -> str:
    return X.sql("chunks", f"SELECT stream_id, seq, string_agg(chunk, '{delimiter}') OVER ({W} ROWS BETWEEN {rows} AND CURRENT ROW) AS context FROM chunks")


for _name, _config, _rows in (
    ("ctx_last_n", K.ContextConfig(3), "2 PRECEDING"), ("ctx_entire", K.ContextConfig(0, 4), "3 PRECEDING"), ("ctx_none", K.ContextConfig.none(), "0 PRECEDING"),
    ("ctx_window", K.ContextConfig.window(2), "1 PRECEDING"), ("ctx_all", K.ContextConfig.entire(), "999 PRECEDING"),
):
    query(_name, context_sql(_rows))(lambda spark, sf, c=_config: X.chunks(spark, sf).select("stream_id", "seq", K.context(F.col("chunk"), c).alias("context")))


@query("ctx_current", X.sql("chunks", f"SELECT stream_id, seq, chunk AS current, least(row_number() OVER ({W}), 4)::BIGINT AS held FROM chunks"))
def ctx_current(spark: SparkSession, sf: str) -> DataFrame:
    return X.chunks(spark, sf).select("stream_id", "seq", F.col("chunk").alias("current"), K.buffered(K.ContextConfig(3, 4)).cast("long").alias("held"))


@query("tok_window", X.sql("chunks", f"SELECT stream_id, seq, string_agg(chunk, '/') OVER ({W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS tokens FROM chunks"))
def tok_window(spark: SparkSession, sf: str) -> DataFrame:
    return X.chunks(spark, sf).select("stream_id", "seq", F.array_join(K.token_window(F.col("chunk"), 2), "/").alias("tokens"))


@query("tok_holdback", X.sql("chunks", f"SELECT stream_id, seq, greatest(row_number() OVER ({W}) - 3, 0)::BIGINT AS n_releasable, lag(chunk, 3) OVER ({W}) AS released FROM chunks"))
def tok_holdback(spark: SparkSession, sf: str) -> DataFrame:
    return K.held_back(X.chunks(spark, sf), "chunk", 3).select("stream_id", "seq", F.col("n_releasable").cast("long").alias("n_releasable"), "released")


@query("tok_flush", X.sql("chunks", "SELECT stream_id, seq, chunk FROM chunks QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY seq DESC) <= 3"))
def tok_flush(spark: SparkSession, sf: str) -> DataFrame:
    return K.flushed(X.chunks(spark, sf), "chunk", 3)


@query("tok_capacity", X.sql("chunks", f"SELECT stream_id, seq, CASE WHEN row_number() OVER ({W}) > 5 THEN 'buffer capacity exceeded: 5' END AS error FROM chunks"))
def tok_capacity(spark: SparkSession, sf: str) -> DataFrame:
    return X.chunks(spark, sf).select("stream_id", "seq", K.over_capacity(5).alias("error"))


_PREFIX = f"string_agg(chunk, '') OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("egr_prefix", X.sql("chunks", f"SELECT stream_id, seq, {_PREFIX} AS prefix FROM chunks"))
def egr_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return X.chunks(spark, sf).select("stream_id", "seq", K.prefix(F.col("chunk")).alias("prefix"))


@query("egr_cutoff", X.sql("chunks", f""", s AS (SELECT *, min(CASE WHEN {O.rx('chunk', '(?i)pirate|idiot')} THEN seq END) OVER (PARTITION BY stream_id) AS f FROM chunks)
SELECT stream_id, seq, CASE WHEN seq = f THEN '[REDACTED]' ELSE chunk END AS output FROM s WHERE f IS NULL OR seq <= f"""))  # fmt: skip
def egr_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    df = X.chunks(spark, sf).withColumn("stop", F.col("chunk").rlike("(?i)pirate|idiot"))
    return K.cutoff(df, "stop", "chunk").select("stream_id", "seq", "output")


_JUDGE = "greatest(tox, sent, pii) AS final, (tox >= 0.8 AND tox > greatest(sent, pii)) AS toxstop"
_MID = f"""ctx AS (SELECT *, string_agg(chunk, ' ') OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS context, {_PREFIX} AS prefix FROM chunks),
sc AS (SELECT *, {O.tox('context')} AS tox, {O.sent('context')} AS sent, {O.pii('context')} AS pii, {_INJ.replace('text', 'chunk')} AS inj, {_SENS.replace('text', 'chunk')} AS sens FROM ctx),
mid AS (SELECT stream_id, seq, chunk, prefix, toxstop OR inj OR sens OR final > 0.8 AS redacted FROM (SELECT *, {_JUDGE} FROM sc))"""


for _name in ("mid_redact", "ph_midstream"):

    @query(_name, X.sql("chunks", f", {_MID} SELECT stream_id, seq, redacted, CASE WHEN redacted THEN '[REDACTED]' ELSE chunk END AS output FROM mid"))
    def mid_redact(spark: SparkSession, sf: str) -> DataFrame:
        return phases.midstream(X.chunks(spark, sf), default_plan()).select("stream_id", "seq", "redacted", "output")


_GUARD = f"""{_MID}, eg AS (SELECT *, {O.tox('prefix')} AS tox, {O.sent('prefix')} AS sent, {O.pii('prefix')} AS pii, {_INJ.replace('text', 'prefix')} AS inj FROM mid),
st AS (SELECT *, NOT redacted AND ((tox >= 0.8 AND tox > greatest(sent, pii)) OR inj) AS stop FROM eg),
fs AS (SELECT *, min(CASE WHEN stop THEN seq END) OVER (PARTITION BY stream_id) AS f FROM st)
SELECT stream_id, seq, CASE WHEN redacted OR seq = f THEN '[REDACTED]' ELSE chunk END AS output FROM fs WHERE f IS NULL OR seq <= f"""


@query("ph_stream_egress", X.sql("chunks", f", {_GUARD}"))
def ph_stream_egress(spark: SparkSession, sf: str) -> DataFrame:
    return phases.stream_egress(X.chunks(spark, sf), default_plan()).select("stream_id", "seq", "output")


def table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream; the pattern makes a single file as good as a folder of files."""
    return spark.readStream.schema(spark.read.parquet(f"{sf}/{name}.parquet").schema).parquet(f"{sf}/{name}.parque[t]")


def chunk_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of ``conversations`` as a stream of ``stream_id, seq, chunk, done``."""
    rows = table_stream(spark, sf, "conversations")
    phrase = F.get(F.array(*map(F.lit, X.PHRASES)), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(X.PHRASES))).cast("int"))
    chunk = F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)) == 0, F.concat_ws(" ", "text", phrase)).otherwise(F.col("text"))
    return rows.select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), chunk.alias("chunk"), F.lit(False).alias("done"))


@query("st_classifier", X.sql("chunks", f", {_MID} SELECT stream_id, seq, redacted FROM mid"))
def st_classifier(spark: SparkSession, sf: str) -> DataFrame:
    judged = S.classifier_stream(chunk_stream(spark, sf), default_plan())
    return S.collected(judged.select("stream_id", "seq", "redacted"), "st-classifier")


@query("st_pipeline", X.sql("chunks", f", {_MID} SELECT stream_id, seq, redacted, CASE WHEN redacted THEN '[REDACTED]' ELSE chunk END AS output FROM mid"))
def st_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    judged = S.classifier_stream(chunk_stream(spark, sf), default_plan())
    return S.collected(judged.select("stream_id", "seq", "redacted", "output"), "st-pipeline")


@query("st_context", context_sql("2 PRECEDING"))
def st_context(spark: SparkSession, sf: str) -> DataFrame:
    return S.collected(S.context_stream(chunk_stream(spark, sf), K.ContextConfig(3)).select("stream_id", "seq", "context"), "st-context")


@query("st_reset", X.sql("chunks", f""", g AS (SELECT *, coalesce(sum(CASE WHEN seq % 3 = 2 THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM chunks)
SELECT stream_id, seq, string_agg(chunk, ' ') OVER (PARTITION BY stream_id, part ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS context FROM g"""))  # fmt: skip
def st_reset(spark: SparkSession, sf: str) -> DataFrame:
    """Every third turn ends its conversation, so the next begins with an empty context."""
    rows = chunk_stream(spark, sf).withColumn("done", F.col("seq") % 3 == 2)
    return S.collected(S.context_stream(rows, K.ContextConfig(3)).select("stream_id", "seq", "context"), "st-reset")


@query("st_guard", X.sql("chunks", f", {_GUARD}"))
def st_guard(spark: SparkSession, sf: str) -> DataFrame:
    return S.guard(chunk_stream(spark, sf), default_plan())


@query("st_holdback", X.sql("chunks", "SELECT stream_id, seq, chunk FROM chunks QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY seq DESC) > 2"))
def st_holdback(spark: SparkSession, sf: str) -> DataFrame:
    """What has left with two chunks held back, before any stream is done."""
    return S.collected(S.holdback_stream(chunk_stream(spark, sf), 2), "st-holdback")


@query("st_adapter", X.sql("chunks", "SELECT stream_id, seq, 'content' AS kind, chunk AS text FROM chunks WHERE chunk <> ''"))
def st_adapter(spark: SparkSession, sf: str) -> DataFrame:
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("chunk").alias("content")).alias("delta"))).alias("choices")))
    frames = chunk_stream(spark, sf).select("stream_id", "seq", F.concat(F.lit("data: "), body, F.lit("\n\n")).alias("frame"))
    return S.collected(adapters.parse_frames(frames, adapters.OpenAi()).select("stream_id", "seq", "kind", "text"), "st-adapter")


@query("src_http_stream", X.sql("chunks", "SELECT stream_id, seq, chunk || chr(65533) AS frame FROM chunks"))
def src_http_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of bytes from a streaming source, one by one; bytes that are no UTF-8 become replacement characters."""
    frames = chunk_stream(spark, sf).select("stream_id", "seq", F.concat(F.encode("chunk", "UTF-8"), F.lit(bytearray(b"\xff"))).alias("bytes"))
    return S.collected(adapters.decoded(frames, "bytes", "frame"), "src-http")


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return table_stream(spark, sf, "events")


def audit_stream(spark: SparkSession, sf: str) -> DataFrame:
    e = event_stream(spark, sf)
    return e.select(F.concat(F.lit("evt_"), F.col("event_id")).alias("id"), "event_type", F.col("props").alias("data"), F.col("ts").cast("timestamp").alias("ts"))


AUDIT_LINE = "id string, event_type string, data string, ts timestamp"


@query("st_audit_sink", "SELECT 'evt_' || event_id AS id, event_type, props AS data FROM events")
def st_audit_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Events appended as JSON lines by day by a stream with a checkpoint, then scanned."""
    path = S.work_dir(spark, "audit-jsonl")
    S.audit_sink(audit_stream(spark, sf), path, "st_audit_sink")
    return A.scan_jsonl(spark, path, AUDIT_LINE).select("id", "event_type", "data")


@query("snk_audit_jsonl", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL")
def snk_audit_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines in folders of a day, as a batch writes them: what each folder holds."""
    path = S.work_dir(spark, "audit-days")
    events = X.table(spark, sf, "events").select("event_id", "event_type", F.col("props").alias("data"), F.col("ts").cast("timestamp").alias("ts"))
    events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).repartition("day").write.partitionBy("day").json(path)
    rows = spark.read.schema("event_id bigint, event_type string, data string, ts timestamp, day string").json(path)
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@query("snk_async_writer", "SELECT count(*) AS n_events, count(*) AS n_ids FROM events")
def snk_async_writer(spark: SparkSession, sf: str) -> DataFrame:
    """The writer stopped and started again over the same checkpoint: every event is there, and once."""
    path, state = S.work_dir(spark, "audit-restarted"), S.work_dir(spark, "audit-state")
    for _ in range(2):
        S.audit_sink(audit_stream(spark, sf), path, state=state)
    return A.scan_jsonl(spark, path, AUDIT_LINE).agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("id").alias("n_ids"))


_LINE = "length('{\"id\":\"evt_' || event_id || '\",\"event_type\":\"' || event_type || '\"}') + 1"


@query("snk_rotate", f"""WITH l AS (SELECT event_id, ts, {_LINE} AS size FROM events),
f AS (SELECT strftime(ts, '%Y-%m-%d') AS day, size, coalesce(sum(size) OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 4000 AS file FROM l)
SELECT day, file::BIGINT AS file, count(*) AS n, sum(size)::BIGINT AS bytes FROM f GROUP BY ALL""")  # fmt: skip
def snk_rotate(spark: SparkSession, sf: str) -> DataFrame:
    """Audit files of a day, each of about 4000 bytes: what they hold."""
    path = S.work_dir(spark, "audit-rotated")
    events = X.table(spark, sf, "events").select(F.concat(F.lit("evt_"), F.col("event_id")).alias("id"), "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    A.store_rotated(events, path, 4000, "event_id", columns=("id", "event_type"))
    rows = A.rotated_lines(spark, path)
    return rows.groupBy(F.date_format("event_date", "yyyy-MM-dd").alias("day"), "file").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value") + 1).cast("long").alias("bytes"))


@query("st_snapshot", X.sql("requests", "SELECT action, count(*) AS n, round(sum(latency_ms), 3) AS latency_ms FROM requests GROUP BY action"))
def st_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    base = S.work_dir(spark, "snapshot")
    e = event_stream(spark, sf)
    action = F.when(F.col("event_type") == "error", "block").when(F.col("event_type") == "purchase", "redact").otherwise("pass")
    totals = S.live_totals(e.select(action.alias("action"), F.col("value").alias("latency_ms")))
    S.to_batches(totals, lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/n={n}"), "snapshot")
    rows = spark.read.schema("action string, n bigint, latency_ms double, batch int").option("recursiveFileLookup", "true").parquet(base)
    last = rows.groupBy("action").agg(F.max_by(F.struct("n", "latency_ms"), "batch").alias("s"))
    return last.select("action", "s.n", F.round("s.latency_ms", 3).alias("latency_ms"))


_CHAIN = """b AS (SELECT chain, row_number() OVER (PARTITION BY chain ORDER BY seq) AS k, seq, coalesce(event_type, '') || coalesce(data, '') || epoch_us(ts) AS body FROM audit),
c AS (SELECT chain, k, seq, NULL::VARCHAR AS previous_hash, sha256(body) AS hash FROM b WHERE k = 1
  UNION ALL SELECT b.chain, b.k, b.seq, c.hash, sha256(b.body || c.hash) FROM c JOIN b ON b.chain = c.chain AND b.k = c.k + 1)"""
CHAIN_SQL = X.sql("audit", f", {_CHAIN} SELECT chain, seq, previous_hash, hash FROM c").replace("WITH ", "WITH RECURSIVE ", 1)


@query("aud_chain", CHAIN_SQL)
def aud_chain(spark: SparkSession, sf: str) -> DataFrame:
    return A.chain(X.audit_events(spark, sf)).select("chain", "seq", "previous_hash", "hash")


@query("st_chain", CHAIN_SQL)
def st_chain(spark: SparkSession, sf: str) -> DataFrame:
    e = event_stream(spark, sf)
    rows = e.select(F.date_format("ts", "yyyy-MM-dd").alias("chain"), F.col("event_id").alias("seq"), "event_type", F.col("props").alias("data"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_micros"))
    return S.collected(S.chain_stream(rows), "st-chain")


@query("ten_build", X.sql("guard", f", {O.SCORED} SELECT text_id, round(greatest(tox, sent, pii), 6) > 0.9 AS strict, round(tox, 6) > 0.5 AS lenient FROM scored"))
def ten_build(spark: SparkSession, sf: str) -> DataFrame:
    """Two tenants' compiled plans over the same texts, one projection each."""
    strict = phases.Plan(P.from_config("basic-safety", PIPELINES["basic-safety"]), policies=[], safety_threshold=0.9, tenant="strict")
    lenient = phases.Plan(P.from_config("q", {"stages": [{"type": "single", "name": "t", "classifier": "toxicity"}]}), policies=[], safety_threshold=0.5, tenant="lenient")
    df = phases.ingress(X.guard(spark, sf), strict).select("text_id", "text", F.col("blocked").alias("strict"))
    return phases.ingress(df, lenient).select("text_id", "strict", F.col("blocked").alias("lenient"))


