"""Audit events: building, hash chains, verification, queries, statistics, retention and export.

The store is a table with a real timestamp, a date partition, a chain key and a sequence number in it.
An event's hash covers type, data, timestamp (epoch microseconds) and the previous hash of its chain.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .policy import severity as mapped_severity

EVENT = (
    "id string, request_id string, session_id string, event_type string, data string, ts timestamp, hash string, previous_hash string, regulation string, "
    "severity string, source_ip_hash string, user_agent string, model string, phase string, event_date date, chain string, seq bigint"
)
LEVELS = ("info", "warning", "high", "critical")
DEFAULT_LIMIT = 1000


def rank(severity: Column) -> Column:
    """info 0 to critical 3; anything else counts as info."""
    out = F.when(severity == LEVELS[1], 1)
    for k in (2, 3):
        out = out.when(severity == LEVELS[k], k)
    return out.otherwise(0)


def from_outcomes(df: DataFrame, request_id: Column, phase: Column, ts: Column, session_id: Column | None = None) -> DataFrame:
    """One event per audit record of ``outcome``: category as type, mapped severity, ``policy:<name>`` as regulation."""
    rows = df.select(request_id.alias("request_id"), (F.lit(None).cast("string") if session_id is None else session_id).alias("session_id"), phase.alias("phase"), ts.alias("ts"), F.posexplode_outer("outcome.audits").alias("pos", "a"))
    # The outer form: Spark infers no filter from it, which would hold all that the outcome is made of once more.
    rows = rows.where("pos is not null")
    data = F.to_json(F.struct(F.col("a.rule").alias("rule_name"), F.col("a.policy").alias("policy_name"), F.col("a.context").alias("matched_content")))
    return rows.select(
        F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat_ws("|", "request_id", "phase", "pos", "a.rule"), 256), 1, 32)).alias("id"), "request_id", "session_id",
        F.col("a.category").alias("event_type"), data.alias("data"), "ts", mapped_severity(F.col("a.severity")).alias("severity"),
        F.concat(F.lit("policy:"), F.col("a.policy")).alias("regulation"), "phase",
    )


def request_id(name: Column | None = None) -> Column:
    """An id of a request: the same for the same name, or a drawn one."""
    if name is None:
        return F.concat(F.lit("req_"), F.uuid())
    return F.concat(F.lit("req_"), F.regexp_replace(F.md5(name.cast("string").cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


@dataclass(frozen=True)
class RequestContext:
    """What an event says about its request; columns or values."""

    request_id: Column | str | None = None
    phase: Column | str | None = None
    session_id: Column | str | None = None
    model: Column | str | None = None
    user_agent: Column | str | None = None
    source_ip: Column | str | None = None

    def with_(self, **changes) -> RequestContext:
        return replace(self, **changes)


def as_column(x: Column | str | None) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("string")


def event(event_type: Column | str, ts: Column, context: RequestContext | None = None, severity: Column | str = "info", data: Column | None = None, regulation: Column | str | None = None) -> Column:
    """A struct of one event. Addresses are kept as digests only; the id is one of what the event says."""
    c = context or RequestContext()
    fields = {
        "request_id": as_column(c.request_id), "session_id": as_column(c.session_id), "event_type": as_column(event_type), "data": as_column(None) if data is None else data,
        "ts": ts, "regulation": as_column(regulation), "severity": as_column(severity), "source_ip_hash": F.sha2(as_column(c.source_ip), 256), "user_agent": as_column(c.user_agent),
        "model": as_column(c.model), "phase": as_column(c.phase),
    }
    said = F.concat_ws("|", *[F.coalesce(v.cast("string"), F.lit("")) for k, v in fields.items() if k != "ts"], F.unix_micros(ts).cast("string"))
    identity = F.concat(F.lit("evt_"), F.substring(F.sha2(said, 256), 1, 32))
    return F.struct(identity.alias("id"), *[v.alias(k) for k, v in fields.items()])


def micros(ts: Column) -> Column:
    return F.unix_micros(ts).cast("string")


def hash_of(event_type: Column, data: Column, ts: Column, previous: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(event_type, F.lit("")), F.coalesce(data, F.lit("")), F.coalesce(micros(ts), F.lit("")), F.coalesce(previous, F.lit(""))), 256)


def chain(events: DataFrame) -> DataFrame:
    """Adds previous_hash and hash, chain by chain in ``seq`` order.

    A chain is sequential by nature, so it is one sorted run inside one task; rows stream through and only the
    last hash is held. Chains run side by side, so choose a key such as day or tenant.
    """
    events = events.drop("hash", "previous_hash")
    ready = events.withColumn("_body", F.concat(F.coalesce("event_type", F.lit("")), F.coalesce("data", F.lit("")), F.coalesce(micros(F.col("ts")), F.lit(""))).cast("binary"))
    ready = ready.repartition("chain").sortWithinPartitions("chain", "seq")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            before, after = [], []
            for k, body in zip(batch.column("chain").to_pylist(), batch.column("_body").to_pylist(), strict=True):
                if k != key:
                    key, last = k, None
                before.append(last)
                last = hashlib.sha256(body + (last or "").encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(before, pa.string()), pa.array(after, pa.string())], [*batch.schema.names[:-1], "previous_hash", "hash"])

    return ready.mapInArrow(link, f"{shape}, previous_hash string, hash string")


SEGMENT = "chain string, seq bigint, part int, n bigint, bad bigint, first_previous string, last_hash string"


def segments(events: DataFrame) -> DataFrame:
    """``SEGMENT`` rows of ranges of (chain, seq): for each range and chain its number of events, of bad ones, and its two ends; and a row with ``n`` 0 for each bad event.

    An event is bad if its hash doesn't recompute or its previous hash isn't that of the event before. Only neighbours are compared, so a chain
    may lie over many ranges; what stands before a range's first event is left to :func:`breaks`.
    """
    good = F.coalesce(F.col("hash") == hash_of(F.col("event_type"), F.col("data"), F.col("ts"), F.col("previous_hash")), F.lit(False))
    rows = events.select(F.col("chain").cast("string").alias("chain"), F.col("seq").cast("long").alias("seq"), "previous_hash", "hash", good.alias("_good"))
    names = [f.split()[0] for f in SEGMENT.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, run = TaskContext.get().partitionId(), None
        for batch in batches:
            out = []
            for chain, seq, previous, own, fine in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if run is None or run[0] != chain:
                    out += [] if run is None else [tuple(run)]
                    run = [chain, seq, part, 0, 0, previous, None]
                elif previous != run[6]:
                    fine = False
                if not fine:
                    out.append((chain, seq, part, 0, 1, None, None))
                run[3], run[4], run[6] = run[3] + 1, run[4] + (not fine), own
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], names)
        if run is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(run, types, strict=True)], names)

    return rows.repartitionByRange("chain", "seq").sortWithinPartitions("chain", "seq").mapInArrow(walk, SEGMENT)


def joined_ends(found: DataFrame) -> DataFrame:
    """Segments with ``torn``: whether a range's first event doesn't go on where the chain's range before ended. A row a range and chain."""
    before = F.lag("last_hash").over(W.partitionBy("chain").orderBy("part"))
    return found.where("n > 0").withColumn("torn", ~F.col("first_previous").eqNullSafe(before))


def verify(events: DataFrame) -> DataFrame:
    """chain, n_events, valid: every previous hash matches and every hash recomputes."""
    whole = joined_ends(segments(events)).groupBy("chain").agg(F.sum("n").alias("n_events"), (F.sum("bad") + F.count_if("torn") == 0).alias("valid"))
    return whole


def breaks(events: DataFrame) -> DataFrame:
    """chain, seq of the events at which a chain was changed: those whose hash doesn't recompute, and those that don't follow the event before."""
    from guardspark.operators.merkle import saved

    # Ranges are drawn anew by each run, and both parts have to be of one.
    found = saved(segments(events), "segments")
    torn = joined_ends(found).where("torn").select("chain", "seq")
    return found.where("n = 0").select("chain", "seq").unionByName(torn).distinct()


def compliance_report(requests: DataFrame) -> DataFrame:
    """Totals of a period by GROUPING SETS in one pass: all requests, by action, and by rule and action. ``level`` says which; what doesn't apply is ``*``.

    ``requests``: action, triggered_rules. A request counts once a level, however many rules it triggered.
    """
    rows = requests.select("action", F.posexplode_outer("triggered_rules").alias("at", "rule")).withColumn("first", F.coalesce(F.col("at") == 0, F.lit(True)).cast("long"))
    sets = rows.groupingSets([["action", "rule"], ["action"], []], "action", "rule")
    out = sets.agg(F.grouping_id().alias("g"), F.sum("first").alias("n_requests"), F.count("rule").alias("n_triggers"))
    level = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "action").otherwise("rule")
    out = out.where("g <> 0 or rule is not null").withColumn("level", level)
    return out.select("level", F.coalesce("action", F.lit("*")).alias("action"), F.coalesce("rule", F.lit("*")).alias("rule"), F.when(F.col("level") == "rule", F.col("n_triggers")).otherwise(F.col("n_requests")).alias("n"), "n_triggers")


@dataclass(frozen=True)
class AuditQuery:
    """ANDed filters and paging. A limit of 0 still gives one row, a limit of None all."""

    event_type: str | None = None
    request_id: str | None = None
    phase: str | None = None
    min_severity: str | None = None
    regulation: str | None = None
    start: str | None = None
    end: str | None = None
    offset: int = 0
    limit: int | None = DEFAULT_LIMIT

    def with_(self, **changes) -> AuditQuery:
        return replace(self, **changes)

    def filter(self, events: DataFrame) -> DataFrame:
        """Equality never matches null; time bounds include both ends and prune date partitions."""
        for name in ("event_type", "request_id", "phase", "regulation"):
            if (value := getattr(self, name)) is not None:
                events = events.where(F.col(name) == value)
        if self.min_severity is not None:
            least = LEVELS.index(self.min_severity.lower()) if self.min_severity.lower() in LEVELS else 0
            events = events.where(rank(F.col("severity")) >= least)
        dated = "event_date" in events.columns
        if self.start is not None:
            events = events.where(F.col("ts") >= F.lit(self.start).cast("timestamp"))
            events = events.where(F.col("event_date") >= F.to_date(F.lit(self.start))) if dated else events
        if self.end is not None:
            events = events.where(F.col("ts") <= F.lit(self.end).cast("timestamp"))
            events = events.where(F.col("event_date") <= F.to_date(F.lit(self.end))) if dated else events
        return events

    def page(self, events: DataFrame, *order: str) -> DataFrame:
        rows = self.filter(events).orderBy(*order)
        rows = rows.offset(self.offset) if self.offset else rows
        return rows if self.limit is None else rows.limit(max(self.limit, 1))


def stats(events: DataFrame, now: Column) -> DataFrame:
    """Totals in one pass."""
    return events.agg(
        F.count(F.lit(1)).alias("total_events"), F.count_if(F.col("severity") == "critical").alias("critical_events"),
        F.count_if(rank(F.col("severity")) >= 2).alias("high_severity_events"), F.count_if(F.col("ts") >= now - F.expr("INTERVAL 24 HOURS")).alias("events_last_24h"),
    )


def retained(events: DataFrame, now: Column, days: int = 90) -> DataFrame:
    return events.where(F.col("ts") >= now - F.make_dt_interval(F.lit(days)))


def served(events: DataFrame) -> DataFrame:
    """The eight fields that the service shows."""
    return events.select(F.unix_seconds("ts").alias("timestamp"), "event_type", F.initcap("severity").alias("severity"), "request_id", "session_id", "phase", "model", "data")


CSV_HEADER = "id,request_id,event_type,severity,regulation,timestamp,phase,data"


def csv_line() -> Column:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat_ws(",", "id", text("request_id"), "event_type", F.initcap("severity"), text("regulation"), F.unix_seconds("ts").cast("string"), text("phase"), F.replace(text("data"), F.lit(","), F.lit(";")))


def json_line() -> Column:
    fields = ["id", "request_id", "event_type", "severity", "regulation", "phase", "data"]
    return F.to_json(F.struct(*fields, F.unix_micros("ts").alias("ts_micros")))


def export(events: DataFrame, query: AuditQuery, path: str, form: str, *order: str) -> int:
    """Write a query's page as ``jsonl``, ``json`` (one array) or ``csv``; the number of events.

    Part files in the order of their names are the export: a limited page's csv or json is one file; without a limit
    rows stay in the tasks of the sort, and no task or row holds the whole. An array has an event a line.
    """
    seen = Observation()
    page = query.page(events, *order).observe(seen, F.count(F.lit(1)).alias("n"))
    line = lambda text: events.sparkSession.createDataFrame([(text,)], "value string").coalesce(1)
    if form == "csv":
        # The page is sorted already; the header goes in front of its first row.
        lines = line(CSV_HEADER).unionByName(page.select(csv_line().alias("value")))
    elif form == "json":
        # The first task of a sort has rows if any has, and its first row has the id 0: commas go before the others.
        comma = F.when(F.col("_at") == 0, F.lit("")).otherwise(F.lit(","))
        body = page.select(json_line().alias("_j"), F.monotonically_increasing_id().alias("_at")).select(F.concat(comma, "_j").alias("value"))
        lines = line("[").unionByName(body).unionByName(line("]"))
    elif form == "jsonl":
        lines = page.select(json_line().alias("value"))
    else:
        raise ValueError(f"unknown format {form}")
    (lines if query.limit is None or form == "jsonl" else lines.coalesce(1)).write.text(path)
    return seen.get["n"]


def store(events: DataFrame, path: str) -> None:
    """Append to the table, one folder a day."""
    events.withColumn("event_date", F.to_date("ts")).write.mode("append").partitionBy("event_date").parquet(path)


def rotated(events: DataFrame, size: Column, max_bytes: int, *order: str, max_seconds: int = 86_400, held: DataFrame | None = None) -> DataFrame:
    """``events`` with event_date, ``period`` and ``file``: the number of the period's file that a row goes to.

    A file ends with its period (``max_seconds`` of a day), so none is older than that, and when it has ``max_bytes``; ``size`` is a row's bytes. ``held``
    (event_date, period, file, bytes: the last file of each period that is there already) is gone on with. Events without a time have a day of
    their own. Ranges in the order of time are summed side by side, then shifted, so no task sums a day or a burst row by row.
    """
    from guardspark.operators.merkle import saved

    seconds = (F.unix_micros("ts") - F.unix_micros(F.date_trunc("day", "ts"))) / 1_000_000
    rows = events.withColumns({"_size": size, "event_date": F.to_date("ts"), "period": F.coalesce(F.floor(seconds / max_seconds), F.lit(0)).cast("int")})
    by = ("event_date", "period", "ts", *order)
    rows = saved(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "rotation")
    day = F.coalesce(F.col("event_date").cast("string"), F.lit(""))
    rows = rows.withColumns({"_part": F.shiftright("_at", 33), "_day": day})
    keys = ["_day", "period", "_part"]
    # A row a range and period.
    runs = rows.groupBy(*keys).agg(F.sum("_size").alias("_bytes"))
    upto = W.partitionBy("_day", "period").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(*keys, F.coalesce(F.sum("_bytes").over(upto), F.lit(0)).alias("_before"))
    if held is not None:
        runs = runs.join(held.select(day.alias("_day"), "period", F.col("file").alias("_last"), F.col("bytes").alias("_full")), ["_day", "period"], "left")
    else:
        runs = runs.withColumns({"_last": F.lit(None).cast("long"), "_full": F.lit(None).cast("long")})
    inside = W.partitionBy(*keys).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(runs, keys)
    at = F.coalesce("_full", F.lit(0)) + F.col("_before") + F.col("_inside")
    file = F.coalesce("_last", F.lit(0)) + F.floor(at / max_bytes)
    return rows.withColumn("file", file).drop("_size", "_at", "_inside", "_before", "_last", "_full", "_part", "_day")


NO_DAY = "__HIVE_DEFAULT_PARTITION__"
FILES = "event_date string, period int, file bigint, path string, bytes bigint"


def place(spark, path: str) -> str:
    """A folder as pyarrow opens it (file, hdfs, s3, gs)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub("^file:/+", "/", at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString())


def stored_files(spark, path: str) -> DataFrame | None:
    """``FILES`` of a rotated store; None if there is nothing. The driver lists days and periods only, a period's many small files are a task's."""
    from pyarrow.fs import FileSelector, FileSystem, FileType

    uri = place(spark, path)
    system, base = FileSystem.from_uri(uri)
    if system.get_file_info(base).type == FileType.NotFound:
        return None
    below = lambda folder, name: [f.path for f in system.get_file_info(FileSelector(folder)) if f.base_name.startswith(f"{name}=")]
    periods = [(p,) for day in below(base, "event_date") for p in below(day, "period")]
    names = [f.split()[0] for f in FILES.split(", ")]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = FileSystem.from_uri(uri)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [f for f in system.get_file_info(FileSelector(folder, recursive=True)) if f.is_file and f.base_name.startswith("part-")]
                keys = [[k.split("=", 1)[1] for k in f.path.split("/")[-4:-1]] for f in found]
                rows = [[k[0] for k in keys], [int(k[1]) for k in keys], [int(k[2]) for k in keys], [f.path for f in found], [f.size for f in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64()], strict=True)], names)

    folders = spark.createDataFrame(periods, "folder string").repartition(max(1, min(len(periods), 1000)))
    rows = folders.mapInArrow(listed, FILES)
    return rows.withColumn("event_date", F.when(F.col("event_date") != NO_DAY, F.col("event_date")).cast("date"))


def rotated_lines(spark, path: str) -> DataFrame:
    """value, event_date, period, file of every line of a rotated store. Files are dealt over all cores by their number: to plan a task or a listing for
    every few of many small files costs more than to read them."""
    from pyarrow.fs import FileSystem

    uri, shape = place(spark, path), "value string, event_date date, period int, file bigint"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = FileSystem.from_uri(uri)
        for batch in batches:
            for k, name in enumerate(batch.column("path").to_pylist()):
                with system.open_input_file(name) as file:
                    lines = file.read().decode("utf-8").split("\n")
                lines = lines if lines[-1] else lines[:-1]
                for at in range(0, len(lines), 10_000):
                    part = lines[at : at + 10_000]
                    same = [pa.repeat(batch.column(c)[k], len(part)) for c in ("event_date", "period", "file")]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *same], ["value", "event_date", "period", "file"])

    files = stored_files(spark, path)
    if files is None:
        return spark.createDataFrame([], shape)
    return files.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(read, shape)


def last_files(spark, path: str) -> DataFrame | None:
    """event_date, period, file, bytes of the last file of each period below ``path``, from the files' lengths alone; None if there is nothing."""
    files = stored_files(spark, path)
    if files is None:
        return None
    sizes = files.groupBy("event_date", "period", "file").agg(F.sum("bytes").alias("bytes"))
    last = sizes.groupBy("event_date", "period").agg(F.max_by(F.struct("file", "bytes"), "file").alias("f"))
    return last.select("event_date", "period", F.col("f.file").alias("file"), F.col("f.bytes").alias("bytes"))


def store_rotated(events: DataFrame, path: str, max_bytes: int, *order: str, columns: tuple[str, ...] = (), max_seconds: int = 86_400) -> None:
    """Append JSON lines (of ``columns``, or all) in folders of a day, a period and a file number. A file takes lines until it has ``max_bytes``, over
    several appends, so it exceeds that by less than a line.

    Tasks write the files themselves, each under a hidden name first and then moved, so a repeated task leaves them whole and once: a writer by
    partition has a folder, a checksum and a move by the driver for each, which at files of a few KB is nearly all of the time.
    """
    from pyarrow.fs import FileSystem

    spark, own = events.sparkSession, f"part-{uuid.uuid4().hex}.txt"
    line = F.to_json(F.struct(*(columns or events.columns)))
    rows = rotated(events.withColumn("value", line), F.octet_length("value") + 1, max_bytes, *order, max_seconds=max_seconds, held=last_files(spark, path))
    uri = place(spark, path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = FileSystem.from_uri(uri)
        now, hidden, out, n = None, None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                system.move(hidden, f"{base}/{now}/{own}")

        for batch in batches:
            for folder, pairs in groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=lambda x: x[0]):
                if folder != now:
                    close()
                    now, hidden, n = folder, f"{base}/{folder}/.{uuid.uuid4().hex}", n + 1
                    system.create_dir(f"{base}/{folder}", recursive=True)
                    out = system.open_output_stream(hidden)
                out.write("".join(f"{value}\n" for _, value in pairs).encode("utf-8"))
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    day = F.coalesce(F.col("event_date").cast("string"), F.lit(NO_DAY))
    folder = F.concat(F.lit("event_date="), day, F.lit("/period="), F.col("period"), F.lit("/file="), F.col("file"))
    placed = rows.select(folder.alias("folder"), "value").repartition("folder").sortWithinPartitions("folder")
    try:
        placed.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    except Exception:
        # Nothing of an append that failed stays.
        left = stored_files(spark, path)
        if left is not None:
            left.where(F.col("path").endswith(own)).select("path").foreachPartition(lambda these: [FileSystem.from_uri(uri)[0].delete_file(r.path) for r in these])
        raise


class Trail:
    """An audit store behind one object: a table of days below ``path``. Each ``record`` is committed when it returns."""

    def __init__(self, spark, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def record(self, events: DataFrame) -> None:
        store(events, self.path)

    def flush(self) -> None:
        """Nothing is held back: a batch is on disk once :meth:`record` returns."""

    def events(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, event_date date").parquet(self.path)

    def query(self, query: AuditQuery, *order: str) -> DataFrame:
        return query.page(self.events(), *order)

    def count(self, query: AuditQuery) -> int:
        return query.filter(self.events()).count()

    def export(self, query: AuditQuery, path: str, form: str, *order: str) -> int:
        return export(self.events(), query, path, form, *order)


class MemoryTrail:
    """Events that are not stored: frames, one after the other."""

    def __init__(self, spark, schema: str):
        self.frames = [spark.createDataFrame([], schema)]

    def add(self, events: DataFrame) -> MemoryTrail:
        self.frames.append(events)
        return self

    def events(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.frames)


def scan_jsonl(spark, path: str, schema: str) -> DataFrame:
    """JSON lines of every file below ``path`` in file-name order; blank and corrupt lines are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.withColumn("file", F.input_file_name()).where("_corrupt_record is null").drop("_corrupt_record")
