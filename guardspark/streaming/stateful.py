"""Structured Streaming versions of the ordered operators, and the sinks.

State is held per ``stream_id`` (a bounded list of chunks) and freed when a stream says it is done or, where
``idle_ms`` is given, has been silent for so long in processing time. Give it for live sources; a run to a
source's end (``availableNow``) goes without, as a timeout keeps a query waiting. Inside a micro-batch a stream's rows are taken in ``seq``
order; across batches in arrival order. Pipelines and policies run after the stateful step, as the same
Column projections as in batch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from guardspark.operators import holdback, phases, resume
from guardspark.operators.classifiers import small_batches
from guardspark.operators.context import ContextConfig
from guardspark.operators.holdback import WINDOW, Holdback
from guardspark.operators.phases import Plan
from guardspark.operators.resume import Scan


def timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, a temporary one where none is set and the master is this machine."""
    import re
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="guardspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def rows_in_order(pdfs: Iterator[pd.DataFrame]) -> list[tuple]:
    rows = [r for pdf in pdfs for r in zip(pdf["seq"], pdf["chunk"], pdf["done"], strict=True)]
    return sorted(rows, key=lambda r: r[0])


def context_stream(chunks: DataFrame, config: ContextConfig, prefix: bool = False, idle_ms: int | None = None, scan: Scan | None = None) -> DataFrame:
    """``stream_id, seq, chunk, done`` to ``stream_id, seq, chunk, context, prefix`` and the columns of ``scan``; ``done`` resets the stream.

    The growing prefix is kept only where it is asked for; a scan of it (``resume``) needs its own small state instead.
    """
    names = ["stream_id", "seq", "chunk", "context", "prefix", *(scan.matchers if scan else ())]

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start = scan.start if scan else ()
        held, whole, seen_so_far = (list(state.get[0]), state.get[1], json.loads(state.get[2])) if state.exists else ([], "", start)
        out = []
        for seq, chunk, done in rows_in_order(pdfs):
            held = [*held, chunk][-config.max_buffer_size :]
            seen = held[-config.context_chunks :] if config.context_chunks else held
            whole = whole + chunk if prefix else ""
            seen_so_far, found = scan.step(seen_so_far, chunk) if scan else ((), ())
            out.append((key[0], seq, chunk, config.delimiter.join(seen), whole if prefix else None, *found))
            if done:
                held, whole, seen_so_far = [], "", start
        if held:
            state.update((held, whole, json.dumps(seen_so_far)))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=names)

    shape = "stream_id bigint, seq bigint, chunk string, context string, prefix string" + "".join(f", {n} {m.kind}" for n, m in (scan.matchers.items() if scan else ()))
    return chunks.groupBy("stream_id").applyInPandasWithState(step, shape, "held array<string>, whole string, scan string", "append", timeout(idle_ms))


def holdback_stream(chunks: DataFrame, hold: int, idle_ms: int | None = None) -> DataFrame:
    """Each chunk leaves ``hold`` chunks late; the rest leaves when its stream is done or idle."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        out = []
        if state.hasTimedOut:
            out, held = held, []
        else:
            for seq, chunk, done in rows_in_order(pdfs):
                held.append((int(seq), chunk))
                if done:
                    out, held = out + held, []
                elif len(held) > hold:
                    out.append(held.pop(0))
        if held:
            state.update(([s for s, _ in held], [c for _, c in held]))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["stream_id", "seq", "chunk"])

    return chunks.groupBy("stream_id").applyInPandasWithState(step, "stream_id bigint, seq bigint, chunk string", "seqs array<bigint>, chunks array<string>", "append", timeout(idle_ms))


def held_windows(tokens: DataFrame, h: Holdback, idle_ms: int | None = None) -> DataFrame:
    """``stream_id, seq, token, done`` to the windows of ``holdback``: one each ``interval`` tokens, the final one when a stream is done or idle.

    The state of a stream is its number of tokens and the last ``2 * hold + interval`` of them.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, seqs, texts = (state.get[0], list(state.get[1]), list(state.get[2])) if state.exists else (0, [], [])
        out = []

        def check(final: bool) -> None:
            number = -(-n // h.interval)
            seen = min(len(seqs), n - max(0, h.oldest(number) - 1))
            out.append((key[0], number, final, [{"k": n - seen + i + 1, "seq": s, "token": t} for i, (s, t) in enumerate(zip(seqs[-seen:], texts[-seen:], strict=True))]))

        if state.hasTimedOut:
            check(True)
            n = 0
        else:
            rows = sorted((r for pdf in pdfs for r in zip(pdf["seq"], pdf["token"], pdf["done"], strict=True)), key=lambda r: r[0])
            for seq, token, done in rows:
                n, seqs, texts = n + 1, [*seqs, int(seq)][-h.kept :], [*texts, token or ""][-h.kept :]
                if done or n % h.interval == 0:
                    check(bool(done))
                if done:
                    n, seqs, texts = 0, [], []
        if n:
            state.update((n, seqs, texts))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["stream_id", "check", "final", "parts"])

    return tokens.groupBy("stream_id").applyInPandasWithState(step, WINDOW, "n bigint, seqs array<bigint>, tokens array<string>", "append", timeout(idle_ms))


def release_stream(tokens: DataFrame, h: Holdback, plan: Plan, name: str = "release") -> DataFrame:
    """The tokens that leave by ``holdback.judge`` over all that the source has; a stream that was stopped stays silent in later batches."""
    spark = tokens.sparkSession
    # A window has some dozens of tokens, and the windows of a batch are Python objects before they leave.
    small_batches(spark)
    base = work_dir(spark, name)
    shape = "stream_id bigint, first_stop bigint"

    def put(batch: DataFrame, n: int) -> None:
        rows = holdback.judge(batch, h, plan).persist()
        stops = rows.where("stop").groupBy("stream_id").agg(F.min("check").alias("first_stop"))
        if n:
            stops = stops.unionByName(spark.read.schema(shape).parquet(f"{base}/stops/n={n - 1}")).groupBy("stream_id").agg(F.min("first_stop").alias("first_stop"))
        stops.write.mode("overwrite").parquet(f"{base}/stops/n={n}")
        first = spark.read.schema(shape).parquet(f"{base}/stops/n={n}")
        holdback.released(rows.join(first, "stream_id", "left")).write.mode("overwrite").parquet(f"{base}/out/n={n}")
        rows.unpersist()

    to_batches(held_windows(tokens, h), put, name, "append")
    return spark.read.schema("stream_id bigint, seq bigint, check bigint, stopped boolean, output string").option("recursiveFileLookup", "true").parquet(f"{base}/out")


def chain_stream(events: DataFrame) -> DataFrame:
    """Hash chain of a stream of ``chain, seq, event_type, data, ts_micros``; each chain's last hash is its state."""
    import hashlib

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(pdfs)).sort_values("seq")
        out = []
        for seq, kind, data, ts in zip(rows["seq"], rows["event_type"], rows["data"], rows["ts_micros"], strict=True):
            before, last = last, hashlib.sha256(f"{kind or ''}{data or ''}{ts}{last or ''}".encode()).hexdigest()
            out.append((key[0], seq, before, last))
        state.update((last,))
        yield pd.DataFrame(out, columns=["chain", "seq", "previous_hash", "hash"])

    return events.groupBy("chain").applyInPandasWithState(step, "chain string, seq bigint, previous_hash string, hash string", "last string", "append", GroupStateTimeout.NoTimeout)


def collected(stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over all that its source has into Parquet files (exactly once) and read them."""
    spark = stream.sparkSession
    base = work_dir(spark, name)
    q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def classifier_stream(chunks: DataFrame, plan: Plan) -> DataFrame:
    """Midstream judgement of a stream of chunks."""
    return phases.midstream_judged(context_stream(chunks, plan.context), plan)


def guard(chunks: DataFrame, plan: Plan, name: str = "guard") -> DataFrame:
    """Midstream, egress on the growing prefix and cutoff, to the end of the source; the rows that leave.

    The stateful step gives the context and what egress needs of the prefix (``resume``; the prefix itself only where that can't be had); judgement is a projection. A stream's first stop is kept in a
    small table, one version a micro-batch, so later batches of a stopped stream stay silent.
    """
    spark = chunks.sparkSession
    base = work_dir(spark, name)
    shape = "stream_id bigint, first_stop bigint"
    try:
        egress = resume.scan_for(plan.egress, plan.policies)
    except ValueError:
        egress = None

    def put(batch: DataFrame, n: int) -> None:
        mid = phases.midstream_judged(batch, plan).withColumn("mid_redacted", F.col("redacted")).drop("results", "scores", "final_score", "triggered", "outcome", "output")
        if egress:
            rows = egress.verdict(mid)
        else:
            rows = phases.judged(mid, plan.egress, plan.policies, "prefix", "prefix").withColumn("stop", F.col("outcome.should_stop"))
        rows = rows.withColumn("stop", ~F.col("mid_redacted") & F.col("stop"))
        rows = rows.select("stream_id", "seq", "chunk", "mid_redacted", "stop").persist()
        stops = rows.where("stop").groupBy("stream_id").agg(F.min("seq").alias("first_stop"))
        if n:
            stops = stops.unionByName(spark.read.schema(shape).parquet(f"{base}/stops/n={n - 1}")).groupBy("stream_id").agg(F.min("first_stop").alias("first_stop"))
        stops.write.mode("overwrite").parquet(f"{base}/stops/n={n}")
        first = spark.read.schema(shape).parquet(f"{base}/stops/n={n}")
        out = rows.join(first, "stream_id", "left").where("first_stop is null or seq <= first_stop")
        out = out.select("stream_id", "seq", F.when(F.col("mid_redacted") | (F.col("seq") == F.col("first_stop")), phases.REDACTED).otherwise(F.col("chunk")).alias("output"))
        out.write.mode("overwrite").parquet(f"{base}/out/n={n}")
        rows.unpersist()

    stream = context_stream(chunks, plan.context, prefix=egress is None, scan=egress and egress.scan)
    q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.schema("stream_id bigint, seq bigint, output string").option("recursiveFileLookup", "true").parquet(f"{base}/out")


def to_batches(stream: DataFrame, put: Callable[[DataFrame, int], None], name: str, mode: str = "update", checkpoint: str | None = None) -> None:
    """Run a stream to its source's end, handing each micro-batch to ``put``; ``checkpoint``: that of a run to go on with."""
    where = checkpoint or f"{work_dir(stream.sparkSession, name)}/checkpoint"
    stream.writeStream.outputMode(mode).option("checkpointLocation", where).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def audit_sink(events: DataFrame, path: str, name: str = "audit", state: str | None = None) -> None:
    """Append a stream of audit events to JSON-lines files, one folder a day, exactly once; ``state`` is the folder of a run to go on with."""
    base = state or work_dir(events.sparkSession, name)
    q = events.withColumn("event_date", F.to_date("ts")).writeStream.outputMode("append").format("json").partitionBy("event_date")
    q.option("checkpointLocation", f"{base}/checkpoint").option("path", path).trigger(availableNow=True).start().awaitTermination()


def live_totals(requests: DataFrame) -> DataFrame:
    """The streaming aggregate behind a one-second snapshot (update mode)."""
    return requests.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("latency_ms"))
