"""Queries: holdback release, resumable egress matching, event-time context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardspark.operators import classifiers as C
from guardspark.operators import holdback as H
from guardspark.operators import phases
from guardspark.operators import pipelines as P
from guardspark.plans import fixtures as X
from guardspark.plans import oracle as O
from guardspark.plans.catalog import query
from guardspark.plans.flow import chunk_stream, table_stream
from guardspark.plans.govern import _INJ
from guardspark.plans.shipped import DEFAULT
from guardspark.streaming import eventtime as E
from guardspark.streaming import reload
from guardspark.streaming import stateful as S

#: Characters of a token of the queries, and tokens a turn at most.
TOKEN, TURN = 12, 100_000
HOLD = H.Holdback(16, 8)
#: Toxicity and injections stop, numbers are hidden.
PLAN = phases.Plan(egress=P.Pipeline().single("toxicity", C.Toxicity()), policies=[DEFAULT])


def tokens(chunks: DataFrame) -> DataFrame:
    """Chunks cut into tokens of a few characters, so most matches lie over several of them."""
    cut = chunks.withColumn("_t", F.regexp_extract_all("chunk", F.lit(f"(?s).{{1,{TOKEN}}}"), F.lit(0)))
    rows = cut.select(*[c for c in chunks.columns if c not in ("seq", "chunk")], F.col("seq").alias("_seq"), F.posexplode("_t").alias("_i", "token"))
    return rows.withColumn("seq", F.col("_seq") * TURN + F.col("_i")).drop("_seq", "_i")


_HIDE = r"(?:\b\d{3}-\d{2}-\d{4}\b)|(?:\b\d{16}\b)"


def release_sql(final: bool) -> str:
    """Holdback by windows: a mask of each window's hidden characters, put together again token by token. ``final``: streams have ended."""
    h, i = HOLD.hold, HOLD.interval
    ends = f"k % {i} = 0 OR k = n" if final else f"k % {i} = 0"
    return X.sql("chunks", f""", cut AS (SELECT stream_id, seq, regexp_extract_all(chunk, '(?s).{{1,{TOKEN}}}') AS t FROM chunks),
tok AS (SELECT stream_id, seq * {TURN} + j - 1 AS seq, t[j] AS token FROM cut, range(1, len(t) + 1) r(j)),
num AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY stream_id) AS n FROM tok WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
chk AS (SELECT stream_id, (k + {i - 1}) // {i} AS c, k AS top, {'k = n' if final else 'false'} AS last, seq AS last_seq FROM num WHERE {ends}),
win AS (SELECT c.stream_id, c.c, c.last, c.last_seq, string_agg(n.token, '' ORDER BY n.k) AS held FROM chk c JOIN num n ON n.stream_id = c.stream_id AND n.k <= c.top AND n.k > (c.c - 1) * {i} - {2 * h} GROUP BY ALL),
sc AS (SELECT *, {O.tox('held')} AS tox, {_INJ.replace('text', 'held')} AS inj FROM win),
st AS (SELECT *, (tox >= 0.8 OR inj) AS stop, CASE WHEN inj THEN 'Request cannot be processed' ELSE 'Content blocked due to policy violation' END AS message FROM sc),
fs AS (SELECT *, min(CASE WHEN stop THEN c END) OVER (PARTITION BY stream_id) AS f FROM st),
mask AS (SELECT stream_id, c, last, held, list_transform(list_zip(regexp_split_to_array(held, '{_HIDE}'), regexp_extract_all(held, '{_HIDE}')), lambda x: repeat('0', length(x[1])) || CASE WHEN x[2] IS NULL THEN '' ELSE '1' || repeat('2', length(x[2]) - 1) END) AS m FROM fs WHERE f IS NULL OR c < f),
pos AS (SELECT k.stream_id, k.c, n.seq, n.k, n.token, k.last, array_to_string(k.m, '') AS m, sum(length(n.token)) OVER (PARTITION BY k.stream_id, k.c ORDER BY n.k) - length(n.token) AS off
  FROM mask k JOIN num n ON n.stream_id = k.stream_id AND n.k > (k.c - 1) * {i} - {2 * h} AND n.k <= k.c * {i}),
ch AS (SELECT stream_id, c, seq, j, substr(token, j, 1) AS ch, substr(m, (off + j)::BIGINT, 1) AS h FROM pos, range(1, length(token) + 1) r(j) WHERE k > (c - 1) * {i} - {h} AND (last OR k <= c * {i} - {h}))
SELECT stream_id, seq, c AS "check", false AS stopped, string_agg(CASE h WHEN '0' THEN ch WHEN '1' THEN '[REDACTED]' ELSE '' END, '' ORDER BY j) AS output FROM ch GROUP BY ALL
UNION ALL SELECT stream_id, last_seq, c, true, message FROM fs WHERE c = f""")


@query("mid_release", release_sql(True))
def mid_release(spark: SparkSession, sf: str) -> DataFrame:
    """Whole conversations as streams of tokens: what leaves, when, and with what hidden."""
    return H.release(tokens(X.chunks(spark, sf)), HOLD, PLAN)


@query("st_release", release_sql(False))
def st_release(spark: SparkSession, sf: str) -> DataFrame:
    """The same by state; streams that haven't ended keep their last tokens."""
    return S.release_stream(tokens(chunk_stream(spark, sf)), HOLD, PLAN, "st-release")


SESSIONS = E.Sessions(delay_ms=600_000, gap_ms=7_200_000, skip_null=True)


@query("st_sessions", f"""WITH e AS (SELECT user_id AS stream_id, event_id AS seq, ts, epoch_ms(ts) AS ms, event_type AS chunk FROM events),
wm AS (SELECT max(ms) - {SESSIONS.delay_ms} AS passed FROM e),
r AS (SELECT e.*, CASE WHEN ms - lag(ms) OVER w > {SESSIONS.gap_ms} OR lag(ms) OVER w IS NULL THEN seq END AS first FROM e, wm WHERE ms < passed WINDOW w AS (PARTITION BY stream_id ORDER BY ts, seq)),
s AS (SELECT *, max_by(first, ts) FILTER (WHERE first IS NOT NULL) OVER (PARTITION BY stream_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS session FROM r),
c AS (SELECT stream_id, session, max_by(seq, (ts, seq)) AS seq, max(ts) AS ts, max(ms) AS ms, count(*) AS n FROM s GROUP BY ALL)
SELECT stream_id, seq, ts, session, string_agg(chunk, ' ') OVER (PARTITION BY stream_id, session ORDER BY ts, seq ROWS 2 PRECEDING) AS context, false AS closed, row_number() OVER (PARTITION BY stream_id, session ORDER BY ts, seq) AS n FROM s
UNION ALL SELECT stream_id, seq, ts, session, '', true, n FROM c, wm WHERE ms + {SESSIONS.gap_ms} < passed""")  # fmt: skip
def st_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user as a stream by event time: contexts of sessions, and the ends of sessions as the watermark passes them."""
    events = table_stream(spark, sf, "events")
    rows = events.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("chunk"))
    return E.run_sessions(rows, SESSIONS)[0]


# Two versions of a policy.
VERSIONS = [
    "name: p\nrules:\n  - {name: pirates, trigger: {type: pattern, pattern: pirate}, actions: [{type: stop}]}\n  - {name: praise, trigger: {type: pattern, pattern: great}, actions: [{type: log, message: nice}]}",
    "name: p\nrules:\n  - {name: pirates, trigger: {type: pattern, pattern: pirate}, actions: [{type: log, message: seen}]}\n  - {name: insults, trigger: {type: pattern, pattern: idiot}, actions: [{type: stop}]}",
]


@query("st_reload", X.sql("chunks", """SELECT stream_id, seq, stream_id % 2 + 1 AS "version",
  concat_ws('|', CASE WHEN contains(chunk, 'pirate') THEN 'pirates' END, CASE WHEN stream_id % 2 = 0 AND contains(chunk, 'great') THEN 'praise' END, CASE WHEN stream_id % 2 = 1 AND contains(chunk, 'idiot') THEN 'insults' END) AS rules,
  CASE WHEN stream_id % 2 = 0 THEN contains(chunk, 'pirate') ELSE contains(chunk, 'idiot') END AS should_stop FROM chunks"""))  # fmt: skip
def st_reload(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations with even numbers arrive under the first version of a policy, the others once the second has been published."""
    source, state = S.work_dir(spark, "reload-source"), S.work_dir(spark, "reload")
    table = reload.PolicyTable(spark, S.work_dir(spark, "policies"))
    chunks = X.chunks(spark, sf)
    for n, text in enumerate(VERSIONS):
        table.publish([text])
        chunks.where(F.col("stream_id") % 2 == n).write.parquet(f"{source}/{n}")
        rows = reload.judge_stream(spark.readStream.schema(chunks.schema).parquet(f"{source}/*"), table, "chunk", state=state)
    return rows.select("stream_id", "seq", "version", F.array_join("rules", "|").alias("rules"), "should_stop")
