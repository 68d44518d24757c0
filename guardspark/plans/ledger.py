"""Queries: audit trail, metrics, joins and tenants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardspark.operators import audit as A
from guardspark.operators import demo
from guardspark.operators import metrics as M
from guardspark.operators import ml
from guardspark.operators import tenants as N
from guardspark.plans import fixtures as X
from guardspark.plans.catalog import query
from guardspark.plans.govern import _LOOSE, _R, evaluated, policy_sql
from guardspark.streaming.stateful import work_dir

_RANK = "(CASE severity WHEN 'warning' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 ELSE 0 END)"
NOW = f"TIMESTAMP '{X.NOW}'"


def now() -> Column:
    return F.lit(X.NOW).cast("timestamp")


_FILTERS = {
    "aud_f_type": (A.AuditQuery(event_type="purchase"), "event_type = 'purchase'"),
    "aud_f_request": (A.AuditQuery(request_id="req-7"), "request_id = 'req-7'"),
    "aud_f_phase": (A.AuditQuery(phase="egress"), "phase = 'egress'"),
    "aud_f_severity": (A.AuditQuery(min_severity="high"), f"{_RANK} >= 2"),
    "aud_f_regulation": (A.AuditQuery(regulation="policy:default"), "regulation = 'policy:default'"),
    "aud_f_start": (A.AuditQuery(start="2024-01-20 00:00:00"), "ts >= TIMESTAMP '2024-01-20 00:00:00'"),
    "aud_f_end": (A.AuditQuery(end="2024-01-10 12:00:00"), "ts <= TIMESTAMP '2024-01-10 12:00:00'"),
}
for _name, (_q, _where) in _FILTERS.items():
    query(_name, X.sql("audit", f"SELECT id, event_type, severity FROM audit WHERE {_where}"))(
        lambda spark, sf, q=_q: q.filter(X.audit_events(spark, sf)).select("id", "event_type", "severity")
    )

ALL = A.AuditQuery(min_severity="warning", phase="ingress", start="2024-01-05", end="2024-01-25")
_ALL = f"{_RANK} >= 1 AND phase = 'ingress' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'"


@query("aud_query", X.sql("audit", f"SELECT id, request_id, event_type FROM audit WHERE {_ALL} ORDER BY event_id LIMIT 1000"))
def aud_query(spark: SparkSession, sf: str) -> DataFrame:
    return ALL.page(X.audit_events(spark, sf), "event_id").select("id", "request_id", "event_type")


@query("aud_page", X.sql("audit", f"SELECT id FROM audit WHERE {_ALL} ORDER BY event_id LIMIT 20 OFFSET 30"))
def aud_page(spark: SparkSession, sf: str) -> DataFrame:
    return ALL.with_(offset=30, limit=20).page(X.audit_events(spark, sf), "event_id").select("id")


@query("aud_page_zero", X.sql("audit", "SELECT id FROM audit ORDER BY event_id LIMIT 1"))
def aud_page_zero(spark: SparkSession, sf: str) -> DataFrame:
    return A.AuditQuery(limit=0).page(X.audit_events(spark, sf), "event_id").select("id")


@query("aud_count", X.sql("audit", f"SELECT count(*) AS n FROM audit WHERE {_ALL}"))
def aud_count(spark: SparkSession, sf: str) -> DataFrame:
    return ALL.filter(X.audit_events(spark, sf)).agg(F.count(F.lit(1)).alias("n"))


_STATS = f"""SELECT count(*) AS total_events, count(*) FILTER (WHERE severity = 'critical') AS critical_events, count(*) FILTER (WHERE {_RANK} >= 2) AS high_severity_events,
  count(*) FILTER (WHERE ts >= {NOW} - INTERVAL 24 HOURS) AS events_last_24h FROM audit"""


@query("aud_stats", X.sql("audit", _STATS))
def aud_stats(spark: SparkSession, sf: str) -> DataFrame:
    return A.stats(X.audit_events(spark, sf), now())


@query("aud_stats_http", X.sql("audit", f"""SELECT '{{"total_events":' || total_events || ',"critical_events":' || critical_events || ',"high_severity_events":' || high_severity_events || ',"events_last_24h":' || events_last_24h || '}}' AS body FROM ({_STATS})"""))
def aud_stats_http(spark: SparkSession, sf: str) -> DataFrame:
    s = A.stats(X.audit_events(spark, sf), now())
    return s.select(F.to_json(F.struct(*s.columns)).alias("body"))


@query("aud_http", X.sql("audit", "SELECT floor(epoch(ts))::BIGINT AS timestamp, event_type, upper(severity[1:1]) || severity[2:] AS severity, request_id, session_id, phase, model, data FROM audit"))
def aud_http(spark: SparkSession, sf: str) -> DataFrame:
    return A.served(X.audit_events(spark, sf))


@query("aud_event", """SELECT event_id, 'req-' || user_id AS request_id, 'ingress' AS phase, CASE WHEN event_id % 2 = 0 THEN 's-' || user_id END AS session_id, 'm1' AS model, 'login.' || event_type AS event_type, 'high' AS severity,
  props AS data, sha256('10.0.0.' || (event_id % 9)) AS source_ip_hash, 'evt_' || sha256('req-' || user_id || '|' || CASE WHEN event_id % 2 = 0 THEN 's-' || user_id ELSE '' END || '|login.' || event_type || '|' || props || '||high|' || sha256('10.0.0.' || (event_id % 9)) || '||m1|ingress|' || epoch_us(ts))[1:32] AS id FROM events""")  # fmt: skip
def aud_event(spark: SparkSession, sf: str) -> DataFrame:
    """Ad-hoc events built from a request's context."""
    e = X.table(spark, sf, "events")
    user = F.col("user_id")
    c = A.RequestContext(F.concat(F.lit("req-"), user), "ingress").with_(model="m1", session_id=F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("s-"), user)), source_ip=F.concat(F.lit("10.0.0."), F.col("event_id") % 9))
    made = A.event(F.concat(F.lit("login."), F.col("event_type")), F.col("ts").cast("timestamp"), c, "high", F.col("props"))
    return e.select("event_id", made.alias("e")).select("event_id", *[f"e.{f}" for f in ("request_id", "phase", "session_id", "model", "event_type", "severity", "data", "source_ip_hash", "id")])


_TRAIL = "id string, event_type string, severity string, phase string, ts timestamp"


@query("aud_facade", X.sql("audit", f"SELECT (SELECT count(*) FROM audit WHERE {_ALL}) AS n, (SELECT count(*) FROM audit) AS n_events, (SELECT min(id) FROM (SELECT id FROM audit WHERE {_ALL} ORDER BY ts, id LIMIT 5)) AS first"))
def aud_facade(spark: SparkSession, sf: str) -> DataFrame:
    """Events recorded in two batches through the trail, then counted and queried."""
    trail, events = A.Trail(spark, work_dir(spark, "trail"), _TRAIL), X.audit_events(spark, sf).select("id", "event_type", "severity", "phase", "ts")
    trail.record(events.where("severity = 'info'"))
    trail.record(events.where("severity <> 'info'"))
    trail.flush()
    page = trail.query(ALL.with_(limit=5), "ts", "id").agg(F.min("id").alias("first"))
    return page.select(F.lit(trail.count(ALL)).cast("long").alias("n"), F.lit(trail.events().count()).cast("long").alias("n_events"), "first")


@query("aud_mem_trail", X.sql("audit", "SELECT event_type, count(*) AS n FROM audit WHERE severity IN ('high', 'critical') GROUP BY event_type"))
def aud_mem_trail(spark: SparkSession, sf: str) -> DataFrame:
    events = X.audit_events(spark, sf).select("id", "event_type", "severity", "phase", "ts")
    trail = A.MemoryTrail(spark, _TRAIL).add(events.where("severity = 'high'")).add(events.where("severity = 'critical'"))
    return trail.events().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("aud_verify", X.sql("audit", "SELECT chain, count(*) AS n_events, chain <> '2024-01-03' AND chain <> '2024-01-04' AS valid FROM audit GROUP BY chain"))
def aud_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Chains, one with a changed type and one with a lost first event; both fail, the others hold."""
    chained = A.chain(X.audit_events(spark, sf))
    first = F.col("previous_hash").isNull()
    tampered = chained.withColumn("event_type", F.when((F.col("chain") == "2024-01-03") & first, "changed").otherwise(F.col("event_type")))
    tampered = tampered.withColumn("previous_hash", F.when((F.col("chain") == "2024-01-04") & first, "0").otherwise(F.col("previous_hash")))
    return A.verify(tampered)


@query("aud_from_policy", policy_sql("1").split("SELECT text_id, 1")[0] + f"""SELECT 'r-' || text_id AS request_id, 'role' AS event_type, 'critical' AS severity, 'policy:all' AS regulation,
  '{{"rule_name":"r2","policy_name":"all","matched_content":"' || {_LOOSE} || '"}}' AS data FROM scored WHERE {_R['r2']}
UNION ALL SELECT 'r-' || text_id, 'toxic', 'info', 'policy:all', '{{"rule_name":"r3","policy_name":"all"}}' FROM scored WHERE {_R['r3']}""")  # fmt: skip
def aud_from_policy(spark: SparkSession, sf: str) -> DataFrame:
    df = evaluated(spark, sf).withColumnRenamed("o", "outcome")
    e = A.from_outcomes(df, F.concat(F.lit("r-"), F.col("text_id")), F.lit("ingress"), now())
    return e.select("request_id", "event_type", "severity", "regulation", "data")


query("jn_audit_ctx", policy_sql("1").split("SELECT text_id, 1")[0] + f"""SELECT 'r-' || text_id AS request_id, 's-' || (text_id % 3) AS session_id, 'ingress' AS phase, 1::BIGINT AS n FROM scored WHERE {_R['r2']}""")(
    lambda spark, sf: A.from_outcomes(
        evaluated(spark, sf).withColumnRenamed("o", "outcome"), F.concat(F.lit("r-"), F.col("text_id")), F.lit("ingress"), now(), F.concat(F.lit("s-"), F.col("text_id") % 3)
    ).where("event_type = 'role'").groupBy("request_id", "session_id", "phase").agg(F.count(F.lit(1)).alias("n"))
)


_MD5 = "md5(doc_id::VARCHAR)"


@query("id_gen", f"SELECT doc_id AS text_id, 'req_' || {_MD5}[1:8] || '-' || {_MD5}[9:12] || '-' || {_MD5}[13:16] || '-' || {_MD5}[17:20] || '-' || {_MD5}[21:32] AS named, true AS drawn_well FROM documents")
def id_gen(spark: SparkSession, sf: str) -> DataFrame:
    """Request ids that repeat for a name, and drawn ones."""
    form = "^req_[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
    return X.texts(spark, sf).select("text_id", A.request_id(F.col("text_id")).alias("named"), A.request_id().rlike(form).alias("drawn_well"))


@query("src_audit_scan", X.sql("audit", "SELECT id, event_type, severity, phase FROM audit"))
def src_audit_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as JSON lines with blank and broken lines between, then scanned."""
    path = work_dir(spark, "scan")
    lines = X.audit_events(spark, sf).select(F.to_json(F.struct("id", "event_type", "severity", "phase")).alias("value"))
    lines = lines.withColumn("value", F.explode(F.array(F.col("value"), F.lit(""), F.lit("{broken"))))
    lines.write.text(path)
    return A.scan_jsonl(spark, path, "id string, event_type string, severity string, phase string").drop("file")


@query("snk_retention", X.sql("audit", f"SELECT id FROM audit WHERE ts >= {NOW} - INTERVAL 10 DAYS"))
def snk_retention(spark: SparkSession, sf: str) -> DataFrame:
    return A.retained(X.audit_events(spark, sf), now(), 10).select("id")


EXPORTED = A.AuditQuery(min_severity="high", limit=200)
_PAGE = f"page AS (SELECT * FROM audit WHERE {_RANK} >= 2 ORDER BY event_id LIMIT 200)"
_JSON = """'{"id":"' || id || '","request_id":"' || request_id || '","event_type":"' || event_type || '","severity":"' || severity || CASE WHEN regulation IS NULL THEN '' ELSE '","regulation":"' || regulation END || '","phase":"' || phase || '","data":"' || replace(data, '"', '\\"') || '","ts_micros":' || epoch_us(ts) || '}'"""


def exported(spark: SparkSession, sf: str, form: str, wanted: A.AuditQuery = EXPORTED) -> DataFrame:
    path = work_dir(spark, f"export-{form}")
    A.export(X.audit_events(spark, sf), wanted, path, form, "event_id")
    if form == "json" and wanted.limit is not None:
        # A page's array is one file; its line ends stand between events only.
        return spark.read.text(path, wholetext=True).select(F.replace("value", F.lit("\n"), F.lit("")).alias("line"))
    return spark.read.text(path).withColumnRenamed("value", "line")


query("snk_export_csv", X.sql("audit", f""", {_PAGE} SELECT '{A.CSV_HEADER}' AS line UNION ALL SELECT concat_ws(',', id, request_id, event_type, upper(severity[1:1]) || severity[2:], coalesce(regulation, ''), floor(epoch(ts))::BIGINT, phase, replace(data, ',', ';')) FROM page"""))(
    lambda spark, sf: exported(spark, sf, "csv")
)
query("snk_export_jsonl", X.sql("audit", f", {_PAGE} SELECT {_JSON} AS line FROM page"))(lambda spark, sf: exported(spark, sf, "jsonl"))
query("snk_export_json", X.sql("audit", f", {_PAGE} SELECT '[' || string_agg({_JSON}, ',' ORDER BY event_id) || ']' AS line FROM page"))(lambda spark, sf: exported(spark, sf, "json"))
#: Exports of all matching events and, under the reference's default limit, of a page.
EVERY = EXPORTED.with_(limit=None)
_EVERY = f"every AS (SELECT * FROM audit WHERE {_RANK} >= 2)"
_DEFAULT = f"page AS (SELECT * FROM audit WHERE {_RANK} >= 2 ORDER BY event_id LIMIT {A.DEFAULT_LIMIT})"
query("snk_export_csv_all", X.sql("audit", f""", {_EVERY} SELECT '{A.CSV_HEADER}' AS line UNION ALL SELECT concat_ws(',', id, request_id, event_type, upper(severity[1:1]) || severity[2:], coalesce(regulation, ''), floor(epoch(ts))::BIGINT, phase, replace(data, ',', ';')) FROM every"""))(
    lambda spark, sf: exported(spark, sf, "csv", EVERY)
)
query("snk_export_jsonl_all", X.sql("audit", f", {_EVERY} SELECT {_JSON} AS line FROM every"))(lambda spark, sf: exported(spark, sf, "jsonl", EVERY))
query("snk_export_json_all", X.sql("audit", f", {_EVERY} SELECT CASE WHEN event_id = (SELECT min(event_id) FROM every) THEN '' ELSE ',' END || {_JSON} AS line FROM every UNION ALL SELECT '[' UNION ALL SELECT ']'"))(
    lambda spark, sf: exported(spark, sf, "json", EVERY)
)
query("snk_export_default", X.sql("audit", f", {_DEFAULT} SELECT {_JSON} AS line FROM page"))(
    lambda spark, sf: exported(spark, sf, "jsonl", EXPORTED.with_(limit=A.DEFAULT_LIMIT))
)


# --- metrics ---------------------------------------------------------------------------------------------------------

_COUNTERS = "SELECT count(*) AS total_requests, sum(tokens)::BIGINT AS total_tokens, sum(len(triggered_rules))::BIGINT AS policy_triggers, sum(latency_us)::BIGINT AS total_latency_us, sum(classifier_latency_us)::BIGINT AS classifier_latency_us FROM requests"


@query("met_counters", X.sql("requests", _COUNTERS))
def met_counters(spark: SparkSession, sf: str) -> DataFrame:
    return M.counters(X.requests(spark, sf))


@query("met_derived", X.sql("requests", f"SELECT (total_latency_us // total_requests)::BIGINT AS avg_latency_us, (classifier_latency_us // total_requests)::BIGINT AS avg_classifier_latency_us, round(policy_triggers / total_requests, 9) AS trigger_rate FROM ({_COUNTERS})"))
def met_derived(spark: SparkSession, sf: str) -> DataFrame:
    return M.derived(M.counters(X.requests(spark, sf))).withColumn("trigger_rate", F.round("trigger_rate", 9))


@query("prom_requests", X.sql("requests", "SELECT tenant, count(*) AS n FROM requests GROUP BY tenant"))
def prom_requests(spark: SparkSession, sf: str) -> DataFrame:
    return X.requests(spark, sf).groupBy("tenant").agg(F.count(F.lit(1)).alias("n"))


@query("prom_decisions", X.sql("requests", "SELECT phase, action, count(*) AS n FROM requests GROUP BY phase, action"))
def prom_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return X.requests(spark, sf).groupBy("phase", "action").agg(F.count(F.lit(1)).alias("n"))


@query("prom_policies", X.sql("requests", "SELECT phase, sum(len(triggered_rules))::BIGINT AS n FROM requests GROUP BY phase"))
def prom_policies(spark: SparkSession, sf: str) -> DataFrame:
    return X.requests(spark, sf).groupBy("phase").agg(F.sum(F.size("triggered_rules")).alias("n"))


_BOUNDS = ", ".join(f"({b}::DOUBLE)" for b in M.LATENCY_BUCKETS_MS) + ", ('inf'::DOUBLE)"


@query("prom_latency", X.sql("requests", f"SELECT phase, CASE WHEN isinf(le) THEN -1 ELSE le END AS le, count(*) AS n FROM requests JOIN (VALUES {_BOUNDS}) AS b(le) ON latency_ms <= le GROUP BY phase, le"))
def prom_latency(spark: SparkSession, sf: str) -> DataFrame:
    return M.latency_histogram(X.requests(spark, sf)).withColumn("le", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")))


@query("snk_prometheus", X.sql("requests", """SELECT 'decisions_total{phase="' || phase || '",action="' || action || '"} ' || count(*) AS line FROM requests GROUP BY phase, action"""))
def snk_prometheus(spark: SparkSession, sf: str) -> DataFrame:
    return M.exposition(prom_decisions(spark, sf), "decisions_total", ["phase", "action"])


_TOTALS = """SELECT count(*) AS total_requests, count(*) FILTER (WHERE action = 'block') AS blocked_count, count(*) FILTER (WHERE action = 'redact') AS redacted_count, count(*) FILTER (WHERE action = 'pass') AS passed_count,
  round(count(*) FILTER (WHERE action = 'block') / count(*), 9) AS block_rate, round(count(*) FILTER (WHERE action = 'redact') / count(*), 9) AS redact_rate FROM requests"""


@query("dem_totals", X.sql("requests", _TOTALS))
def dem_totals(spark: SparkSession, sf: str) -> DataFrame:
    t = M.totals(X.requests(spark, sf))
    return t.withColumns({c: F.round(c, 9) for c in ("block_rate", "redact_rate")})


def clock() -> Column:
    """A minute after the last events of sf0.01's table, so that the last minute holds some."""
    return F.lit("2024-01-30 23:57:30").cast("timestamp")


_CLOCK = "TIMESTAMP '2024-01-30 23:57:30'"
_LAST = "last AS (SELECT * FROM requests ORDER BY ts DESC, id DESC LIMIT 10000)"


@query("dem_rpm", X.sql("requests", f", {_LAST} SELECT count(*) FILTER (WHERE ts > {_CLOCK} - INTERVAL 60 SECONDS)::DOUBLE AS requests_per_minute FROM last"))
def dem_rpm(spark: SparkSession, sf: str) -> DataFrame:
    return M.per_minute(X.requests(spark, sf), clock())


@query("dem_bounded_avg", X.sql("requests", f", {_LAST} SELECT round(avg(latency_ms), 6) AS avg_latency_ms FROM last"))
def dem_bounded_avg(spark: SparkSession, sf: str) -> DataFrame:
    return M.bounded_average(X.requests(spark, sf)).select(F.round("avg_latency_ms", 6).alias("avg_latency_ms"))


_PCT = ", ".join(f"list_sort(list(latency_ms))[(round({p / 100} * (count(*) - 1)) + 1)::INT] AS p{p}" for p in (50, 95, 99))

for _name in ("dem_pct", "srt_pct"):
    query(_name, X.sql("requests", f", {_LAST} SELECT {_PCT} FROM last"))(lambda spark, sf: M.percentiles(X.requests(spark, sf)))


query("dem_pct_by_phase", X.sql("requests", f"SELECT phase, {_PCT} FROM requests GROUP BY phase"))(lambda spark, sf: M.exact_percentiles(X.requests(spark, sf), "phase", "latency_ms", (50.0, 95.0, 99.0)))
query("dem_issue_counts", X.sql("requests", "SELECT issue_type, count(*) AS n FROM (SELECT unnest(issues) AS issue_type FROM requests) GROUP BY issue_type"))(lambda spark, sf: M.issue_counts(X.requests(spark, sf)))
query("dem_rule_counts", X.sql("requests", "SELECT rule, count(*) AS n FROM (SELECT unnest(triggered_rules) AS rule FROM requests) GROUP BY rule"))(lambda spark, sf: M.rule_counts(X.requests(spark, sf)))
query("dem_action_counts", X.sql("requests", "SELECT action, count(*) AS n FROM requests GROUP BY action"))(lambda spark, sf: M.action_counts(X.requests(spark, sf)))
_NORMAL = "CASE WHEN i IN ('ssn', 'credit_card', 'email', 'phone') THEN 'pii' ELSE i END"
query("dem_issue_norm", X.sql("requests", f"SELECT DISTINCT i AS issue, {_NORMAL} AS issue_type FROM (SELECT unnest(issues) AS i FROM requests)"))(
    lambda spark, sf: X.requests(spark, sf).select(F.explode("issues.issue_type").alias("issue")).distinct().withColumn("issue_type", M.normal_issue(F.col("issue")))
)
query("dem_issue_norm_counts", X.sql("requests", f"SELECT issue_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM (SELECT {_NORMAL} AS issue_type FROM (SELECT unnest(issues) AS i FROM requests)) GROUP BY issue_type"))(
    lambda spark, sf: M.normal_issue_counts(X.requests(spark, sf)).select("issue_type", "n", F.round(F.col("share").cast("double"), 6).alias("share"))
)


@query("dem_heatmap", X.sql("requests", f"""
, c AS (SELECT rule, floor(epoch(ts) / 60)::BIGINT AS bucket, count(*) AS n FROM (SELECT unnest(triggered_rules) AS rule, ts FROM requests) GROUP BY ALL),
g AS (SELECT rule, unnest(range(floor(epoch({NOW} - INTERVAL 120 MINUTES) / 60)::BIGINT, floor(epoch({NOW}) / 60)::BIGINT + 1)) AS bucket FROM (SELECT DISTINCT rule FROM c))
SELECT g.rule, g.bucket, coalesce(c.n, 0) AS n FROM g LEFT JOIN c USING (rule, bucket)"""))  # fmt: skip
def dem_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return M.heatmap(X.requests(spark, sf), now(), 120)


for _name in ("dem_timeline", "jn_gapfill"):

    @query(_name, X.sql("requests", f"""
, {_LAST}, c AS (SELECT floor((epoch_us(ts) - epoch_us({_CLOCK} - INTERVAL 90 MINUTES)) / 60000000)::BIGINT AS point, count(*) AS n, count(*) FILTER (WHERE action = 'block') AS b, avg(latency_ms) AS a FROM last GROUP BY 1)
SELECT g.point, coalesce(n, 0)::DOUBLE AS requests_per_minute, round(coalesce(b / n, 0), 9)::DOUBLE AS block_rate, round(coalesce(a, 0), 6) AS avg_latency_ms FROM (SELECT unnest(range(0, 91)) AS point) g LEFT JOIN c USING (point)"""))  # fmt: skip
    def dem_timeline(spark: SparkSession, sf: str) -> DataFrame:
        t = M.timeline(X.requests(spark, sf), clock(), 90)
        return t.withColumns({"block_rate": F.round("block_rate", 9), "avg_latency_ms": F.round("avg_latency_ms", 6)})


@query("dem_snapshot", X.sql("requests", f""", {_LAST} SELECT t.total_requests, t.block_rate, t.redact_rate, (SELECT count(*) FILTER (WHERE ts > {_CLOCK} - INTERVAL 60 SECONDS)::DOUBLE FROM last) AS requests_per_minute,
  (SELECT round(avg(latency_ms), 6) FROM last) AS avg_latency_ms, (SELECT list_sort(list(latency_ms))[(round(0.99 * (count(*) - 1)) + 1)::INT] FROM last) AS p99_latency_ms, 0::BIGINT AS active_connections FROM ({_TOTALS}) t"""))  # fmt: skip
def dem_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    s = M.snapshot(X.requests(spark, sf), clock())
    return s.withColumns({"block_rate": F.round("block_rate", 9), "redact_rate": F.round("redact_rate", 9), "avg_latency_ms": F.round("avg_latency_ms", 6)})


query("dem_recent", X.sql("requests", "SELECT id, action FROM requests ORDER BY ts DESC, id DESC LIMIT 100"))(lambda spark, sf: M.recent(X.requests(spark, sf), 100).select("id", "action"))
query("dem_f_action", X.sql("requests", "SELECT id, action FROM (SELECT * FROM requests ORDER BY ts DESC, id DESC LIMIT 100) WHERE contains(lower(action), 'block')"))(lambda spark, sf: demo.listed(X.requests(spark, sf), 100, action="BLOCK").select("id", "action"))
query("dem_f_issue", X.sql("requests", "SELECT id, action FROM (SELECT * FROM requests ORDER BY ts DESC, id DESC LIMIT 100) WHERE len(list_filter(issues, lambda x: contains(x, 'mail'))) > 0"))(lambda spark, sf: demo.listed(X.requests(spark, sf), 100, issue_type="Mail").select("id", "action"))
query("dem_get_event", X.sql("requests", "SELECT id, action, latency_ms FROM requests WHERE id = 77"))(lambda spark, sf: X.requests(spark, sf).where("id = 77").limit(1).select("id", "action", "latency_ms"))


# --- models ----------------------------------------------------------------------------------------------------------


@query("ml_mean_pool", "SELECT label AS text_id, d::INT - 1 AS dim, round(coalesce(avg(x) FILTER (WHERE vec_id % 3 <> 0), avg(x)), 5) AS value FROM (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY label, d")
def ml_mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    v = X.table(spark, sf, "embeddings").select(F.col("label").alias("text_id"), F.col("embedding").alias("vec"), F.when(F.col("vec_id") % 3 == 0, 0).otherwise(1).alias("mask"))
    return ml.mean_pool(v).withColumn("value", F.round("value", 5))


@query("ml_sigmoid_score", "SELECT vec_id, round(s, 6) AS score, CASE WHEN s > 0.5 THEN 'positive' ELSE 'negative' END AS label, round(n, 4) AS norm FROM (SELECT vec_id, 1 / (1 + exp(-greatest(-8.0, least(8.0, embedding[1]::DOUBLE)))) AS s, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)")
def ml_sigmoid_score(spark: SparkSession, sf: str) -> DataFrame:
    s = ml.sigmoid_score(F.col("embedding"))
    return X.table(spark, sf, "embeddings").select("vec_id", F.round(s, 6).alias("score"), F.when(s > 0.5, "positive").otherwise("negative").alias("label"), F.round(ml.norm(F.col("embedding")), 4).alias("norm"))


@query("ml_seq_result", """WITH l AS (SELECT vec_id, exp(embedding[1]::DOUBLE) AS a, exp(embedding[2]::DOUBLE) AS b FROM embeddings), p AS (SELECT vec_id, a / (a + b) AS pa, b / (a + b) AS pb FROM l)
SELECT vec_id, CASE WHEN pb <= 0.55 THEN 'no' WHEN pb >= pa THEN 'yes' ELSE 'no' END AS label, round(pb, 6) AS score FROM p""")  # fmt: skip
def ml_seq_result(spark: SparkSession, sf: str) -> DataFrame:
    p = ml.softmax(F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")))
    r = ml.sequence_result(p, ["no", "yes"], 0.55)
    return X.table(spark, sf, "embeddings").select("vec_id", r["label"].alias("label"), F.round(r["score"], 6).alias("score"))


# --- tenants ---------------------------------------------------------------------------------------------------------

_TENANTS = "(VALUES ('alpha', ['sk-1', 'key-a'], 0.9::DOUBLE, NULL::VARCHAR), ('beta', ['tok 2'], NULL, 'anthropic'), ('gamma', []::VARCHAR[], 0.5, NULL)) AS t(id, api_keys, safety_threshold, stream_format)"


def tenant_rows(spark: SparkSession) -> DataFrame:
    rows = [("alpha", ["sk-1", "key-a"], 0.9, None), ("beta", ["tok 2"], None, "anthropic"), ("gamma", [], 0.5, None)]
    t = spark.createDataFrame(rows, "id string, api_keys array<string>, safety_threshold double, stream_format string")
    none = F.lit(None).cast("string")
    return t.withColumns({"backend_url": none, "policy_path": none, "chunk_threshold": F.lit(None).cast("double")})


_HTTP = """http AS (SELECT event_id AS request_id, (['/alpha/v1/chat', '/v1/chat', '//gamma/v1/x', '/nobody/v1/x', '/beta/v2/x', '/v1/v1/x', 'beta/v1'])[(event_id % 7 + 1)::INT] AS path,
  ([NULL, 'beta', 'nobody', ''])[(event_id % 4 + 1)::INT] AS x_tenant_id, (['Bearer sk-1', 'sk-1', ' key-a ', 'Bearer  tok 2', 'tok 2', NULL])[(event_id // 7 % 6 + 1)::INT] AS "authorization" FROM events)"""


def http(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda values, k: F.get(F.array(*[F.lit(v).cast("string") for v in values]), k.cast("int"))
    e = F.col("event_id")
    return X.table(spark, sf, "events").select(
        e.alias("request_id"), at(["/alpha/v1/chat", "/v1/chat", "//gamma/v1/x", "/nobody/v1/x", "/beta/v2/x", "/v1/v1/x", "beta/v1"], e % 7).alias("path"),
        at([None, "beta", "nobody", ""], e % 4).alias("x_tenant_id"), at(["Bearer sk-1", "sk-1", " key-a ", "Bearer  tok 2", "tok 2", None], F.floor(e / 7) % 6).alias("authorization"),
    )


_PATH = "CASE WHEN split_part(ltrim(path, '/'), '/', 2) = 'v1' AND split_part(ltrim(path, '/'), '/', 1) <> 'v1' THEN split_part(ltrim(path, '/'), '/', 1) END"
_KEY = '''CASE WHEN starts_with(trim("authorization"), 'Bearer ') THEN trim(substr(trim("authorization"), 8)) WHEN starts_with(trim("authorization"), 'sk-') OR starts_with(trim("authorization"), 'key-') THEN trim("authorization") END'''
query("ten_path", f"WITH {_HTTP} SELECT request_id, {_PATH} AS tenant FROM http")(lambda spark, sf: http(spark, sf).select("request_id", N.path_tenant(F.col("path")).alias("tenant")))
query("ten_key", f"WITH {_HTTP} SELECT request_id, {_KEY} AS api_key FROM http")(lambda spark, sf: http(spark, sf).select("request_id", N.api_key(F.col("authorization")).alias("api_key")))
_RESOLVED = f"""WITH {_HTTP}, ten AS (SELECT * FROM {_TENANTS}), k AS (SELECT id, unnest(api_keys) AS k FROM ten)
SELECT request_id, coalesce(h.id, p.id, k.id, 'default') AS tenant FROM http LEFT JOIN ten h ON x_tenant_id = h.id LEFT JOIN ten p ON {_PATH} = p.id LEFT JOIN k ON {_KEY} = k.k"""
for _name in ("ten_resolve", "jn_tenant"):
    query(_name, _RESOLVED)(lambda spark, sf: N.resolve(http(spark, sf), tenant_rows(spark)).select("request_id", "tenant"))
query("route_tenant", f"WITH {_HTTP}, ten AS (SELECT * FROM {_TENANTS}) SELECT request_id, CASE WHEN {_PATH} IS NOT NULL AND ten.id IS NULL THEN 400 ELSE 200 END AS status FROM http LEFT JOIN ten ON {_PATH} = ten.id")(
    lambda spark, sf: N.routed(http(spark, sf), tenant_rows(spark)).select("request_id", "status")
)

# URLs that cover every rule.
URLS = [
    "https://api.example.com/v1", "http://api.example.com", "https://localhost/x", "https://LOCALHOST:80", "https://a.localhost", "https://127.0.0.1", "https://10.1.2.3", "https://172.16.0.1", "https://172.32.0.1",
    "https://192.168.1.1:443/x", "https://100.64.0.1", "https://100.128.0.1", "https://0.1.2.3", "https://169.254.169.254/latest", "https://169.254.1.1", "https://metadata.google.internal", "https://[::1]/",
    "https://[fd00::1]", "https://[fe80::1]", "https://[2001:db8::1]", "ftp://x.org", "not a url", "https://", "https://user:pw@10.0.0.1/", "https://example.com.evil.org", "https://8.8.8.8",
]
_BAD = {
    "http://api.example.com": "invalid_scheme", "ftp://x.org": "invalid_scheme", "not a url": "invalid_url", "https://": "missing_host",
    **dict.fromkeys([u for u in URLS if any(x in u.lower() for x in ("localhost", "127.", "//10.", "@10.", "172.16", "192.168", "100.64", "//0.1", "169.254", "metadata", "[::1]", "[fd00", "[fe80"))], "blocked_host"),
}


@query("sec_url", "SELECT page_id AS id, url, CASE WHEN starts_with(url, 'https://') THEN NULL ELSE 'invalid_scheme' END AS problem FROM pages UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-k - 1}, {X.literal(u)}, {X.literal(_BAD[u]) if u in _BAD else 'NULL'})" for k, u in enumerate(URLS)) + ") AS v(id, url, problem)")
def sec_url(spark: SparkSession, sf: str) -> DataFrame:
    fixed = spark.createDataFrame([(-k - 1, u) for k, u in enumerate(URLS)], "id bigint, url string")
    rows = X.table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url").unionByName(fixed)
    return rows.withColumn("problem", N.url_problem(F.col("url"), N.UrlRules()))


query("sec_url_allowed", "SELECT page_id AS id, CASE WHEN regexp_matches(url, '^https?://([^/]*\\.)?example\\.(com|org)(/|$)') THEN NULL ELSE 'blocked_host' END AS problem FROM pages")(
    lambda spark, sf: X.table(spark, sf, "pages").select(F.col("page_id").alias("id"), N.url_problem(F.col("url"), N.UrlRules(True, True, True, ("example.com", "Example.org"))).alias("problem"))
)

