"""Context by event time: rows in any order of arrival, sessions that end, state that goes.

The source has a watermark: how late a row may come. Rows wait in the state of their stream until the watermark has passed them and then
leave in the order of their time, so the order of arrival makes no difference. A later row than the watermark allows is dropped and
counted. A stream that is silent for longer than ``gap`` of event time ends its session: the context starts anew, and once the watermark
has passed that silence the stream's state goes. So the state holds the streams and rows of the last ``delay + gap`` only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from guardspark.operators.context import ContextConfig
from guardspark.streaming.stateful import work_dir

OUT = "stream_id bigint, seq bigint, ts timestamp, session bigint, context string, closed boolean, n bigint"
#: Inside a step times are microseconds since 1970: pandas would see the clock of the session's time zone, the watermark doesn't.
RAW = OUT.replace("ts timestamp", "micros bigint")
STATE = "session bigint, n bigint, last bigint, last_seq bigint, held array<string>, times array<bigint>, seqs array<bigint>, chunks array<string>"


@dataclass(frozen=True)
class Sessions:
    """``delay``: how late a row may come; ``gap``: silence that ends a session, both in milliseconds of event time.

    A null chunk counts as empty; with ``skip_null`` it adds nothing to a context, and a context of such rows only is null.
    """

    context: ContextConfig = ContextConfig(3)
    delay_ms: int = 600_000
    gap_ms: int = 1_800_000
    skip_null: bool = False


@dataclass(frozen=True)
class Report:
    """What became of a run: rows that came too late, and streams that still have state."""

    late: int
    streams_held: int


def sessions(rows: DataFrame, s: Sessions) -> DataFrame:
    """A stream of ``stream_id, seq, ts, chunk`` to ``OUT``: each row with its session (the ``seq`` of its first row), context and number in it; a closing row says the session's last row again, without context."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs()
        session, n, last, last_seq, held, times, seqs, chunks = state.get if state.exists else (None, 0, 0, None, [], [], [], [])
        waiting = list(zip(times, seqs, chunks, strict=True))
        if not state.hasTimedOut:
            for pdf in pdfs:
                waiting += [(int(t), int(q), c if c is not None or s.skip_null else "") for t, q, c in zip(pdf["micros"], pdf["seq"], pdf["chunk"], strict=True)]
        waiting.sort(key=lambda w: (w[0], w[1], w[2] or ""))
        out, held = [], list(held)

        def close() -> None:
            out.append((key[0], last_seq, last, session, "", True, n))

        ready = [w for w in waiting if w[0] // 1000 < passed]
        waiting = waiting[len(ready) :]
        for time, seq, chunk in ready:
            if n and time // 1000 - last // 1000 > s.gap_ms:
                close()
                n, held = 0, []
            if not n:
                session = seq
            held = [*held, chunk][-s.context.rows :]
            n, last, last_seq = n + 1, time, seq
            said = [c for c in held if c is not None]
            out.append((key[0], seq, time, session, s.context.delimiter.join(said) if said or not s.skip_null else None, False, n))
        if n and last // 1000 + s.gap_ms < passed:
            close()
            n, held, session, last_seq = 0, [], None, None
        if n or waiting:
            state.update((session, n, last, last_seq, held, [w[0] for w in waiting], [w[1] for w in waiting], [w[2] for w in waiting]))
            # The next row that can leave, or the session's end.
            state.setTimeoutTimestamp(max(min([w[0] // 1000 for w in waiting[:1]] + ([last // 1000 + s.gap_ms] if n else [])), passed + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in RAW.split(", ")])

    marked = rows.where("ts is not null").withWatermark("ts", f"{s.delay_ms} milliseconds").withColumn("micros", F.unix_micros("ts"))
    out = marked.groupBy("stream_id").applyInPandasWithState(step, RAW, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("ts", F.timestamp_micros("micros")).select(*[f.split()[0] for f in OUT.split(", ")])


def run_sessions(rows: DataFrame, s: Sessions, name: str = "sessions", state: str | None = None) -> tuple[DataFrame, Report]:
    """Run to the source's end; the rows that have left so far, and the report. ``state``: the folder of a run to go on with."""
    spark = rows.sparkSession
    base = state or work_dir(spark, name)
    q = sessions(rows, s).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    states = [p.stateOperators[0] for p in q.recentProgress if p.stateOperators]
    report = Report(sum(x.numRowsDroppedByWatermark for x in states), states[-1].numRowsTotal if states else 0)
    return spark.read.schema(OUT).parquet(f"{base}/out"), report
