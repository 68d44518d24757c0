"""Counters, rates, percentiles, heatmap and timeline over a table of requests. ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HISTORY = 10_000
BUCKET_SECONDS = 60
LATENCY_BUCKETS_MS = (1, 2, 5, 10, 25, 50, 100, 250, 500)


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def counters(requests: DataFrame) -> DataFrame:
    """From ``tokens, triggers, latency_us, classifier_latency_us`` columns."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return requests.agg(
        F.count(F.lit(1)).alias("total_requests"), total("tokens").alias("total_tokens"), total("triggers").alias("policy_triggers"),
        total("latency_us").alias("total_latency_us"), total("classifier_latency_us").alias("classifier_latency_us"),
    )


def derived(c: DataFrame) -> DataFrame:
    """Integer averages and the trigger rate, 0 without requests."""
    div = lambda part: F.when(F.col("total_requests") > 0, F.expr(f"{part} div nullif(total_requests, 0)")).otherwise(0).cast("long")
    return c.select(div("total_latency_us").alias("avg_latency_us"), div("classifier_latency_us").alias("avg_classifier_latency_us"), ratio(F.col("policy_triggers"), F.col("total_requests")).alias("trigger_rate"))


def totals(requests: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    by = {a: F.count_if(F.col("action") == a) for a in ("block", "redact", "pass")}
    return requests.agg(
        n.alias("total_requests"), by["block"].alias("blocked_count"), by["redact"].alias("redacted_count"), by["pass"].alias("passed_count"),
        ratio(by["block"], n).alias("block_rate"), ratio(by["redact"], n).alias("redact_rate"),
    )


def since_reset(requests: DataFrame, resets: DataFrame) -> DataFrame:
    """Requests from the last of ``resets`` (a column ``at``) on; all if there is none. One row is joined."""
    last = resets.agg(F.max("at").alias("_last"))
    return requests.join(F.broadcast(last), F.coalesce(F.col("ts") >= F.col("_last"), F.lit(True))).drop("_last")


def recent(requests: DataFrame, n: int = HISTORY, order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """The last ``n`` requests (a distributed top-n)."""
    return requests.orderBy(*[F.desc(c) for c in order]).limit(n)


def per_minute(requests: DataFrame, now: Column) -> DataFrame:
    return recent(requests).agg(F.count_if(F.col("ts") > now - F.expr("INTERVAL 60 SECONDS")).cast("double").alias("requests_per_minute"))


def bounded_average(requests: DataFrame) -> DataFrame:
    return recent(requests).agg(F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"))


def percentiles(requests: DataFrame, points: tuple[float, ...] = (50.0, 95.0, 99.0), column: str = "latency_ms") -> DataFrame:
    """Nearest rank ``round(p / 100 * (n - 1))`` over the bounded history, 0 if it is empty. The history bounds the ranked rows."""
    held = recent(requests)
    ranked = held.withColumn("_r", F.row_number().over(W.orderBy(column)) - 1).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy()))
    return ranked.agg(*[F.coalesce(F.max(F.when(F.col("_r") == F.round(F.lit(p / 100) * (F.col("_n") - 1)), F.col(column))), F.lit(0.0)).alias(f"p{p:g}") for p in points])


def exact_percentiles(rows: DataFrame, group: str, column: str, points: tuple[float, ...], bins: int = 4096) -> DataFrame:
    """The same by group over all rows with a value.

    A group's span is cut into ``bins``, whose counts say which bin holds each rank; only values of those bins are sorted, counted by
    value first. So no task sorts a whole group, however few groups there are.
    """
    rows = rows.where(F.col(column).isNotNull()).select(group, F.col(column).alias("_v"))
    span = rows.groupBy(group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))).otherwise(0)
    binned = rows.join(span, group).withColumn("_b", place.cast("int"))
    counts = binned.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy(group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = F.array(*[F.struct(F.lit(f"p{p:g}").alias("_p"), F.round(F.lit(p / 100) * (F.col("_n") - 1)).alias("_r")) for p in points])
    wanted = counts.withColumn("_before", before).withColumn("_t", F.filter(ranks, lambda t: (t["_r"] >= F.col("_before")) & (t["_r"] < F.col("_before") + F.col("_c"))))
    wanted = wanted.where(F.size("_t") > 0).select(group, "_b", "_before", "_t")
    inside = binned.join(wanted.select(group, "_b"), [group, "_b"], "left_semi").groupBy(group, "_b", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(group, "_b").orderBy("_v"))
    found = inside.withColumn("_end", upto).join(wanted, [group, "_b"]).withColumn("_t", F.explode("_t"))
    at = F.col("_t._r") - F.col("_before")
    found = found.where((at < F.col("_end")) & (at >= F.col("_end") - F.col("_c")))
    return found.groupBy(group).agg(*[F.max(F.when(F.col("_t._p") == f"p{p:g}", F.col("_v"))).alias(f"p{p:g}") for p in points])


def issue_counts(requests: DataFrame) -> DataFrame:
    return requests.select(F.explode("issues.issue_type").alias("issue_type")).groupBy("issue_type").agg(F.count(F.lit(1)).alias("n"))


def rule_counts(requests: DataFrame) -> DataFrame:
    return requests.select(F.explode("triggered_rules").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def action_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def normal_issue(issue: Column) -> Column:
    return F.when(issue.isin("ssn", "credit_card", "email", "phone"), "pii").otherwise(issue)


def normal_issue_counts(requests: DataFrame) -> DataFrame:
    n = requests.select(F.explode("issues.issue_type").alias("i")).select(normal_issue(F.col("i")).alias("issue_type"))
    counts = n.groupBy("issue_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()))


def buckets(spark: SparkSession, first: Column, last: Column, name: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(first, last)).alias(name))


def heatmap(requests: DataFrame, now: Column, minutes: int) -> DataFrame:
    """rule, bucket (epoch minutes), n: every rule of the whole table by every minute of the window, both ends included."""
    rules = requests.select(F.explode("triggered_rules").alias("rule"), F.floor(F.unix_seconds("ts") / BUCKET_SECONDS).alias("bucket"))
    counts = rules.groupBy("rule", "bucket").agg(F.count(F.lit(1)).alias("n"))
    end = F.floor(F.unix_seconds(now) / BUCKET_SECONDS)
    start = F.floor((F.unix_seconds(now) - minutes * 60) / BUCKET_SECONDS)
    grid = counts.select("rule").distinct().withColumn("bucket", F.explode(F.sequence(start, end)))
    return grid.join(counts, ["rule", "bucket"], "left").select("rule", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def timeline(requests: DataFrame, now: Column, minutes: int) -> DataFrame:
    """point, requests_per_minute, block_rate, avg_latency_ms: minutes that begin at ``now`` less the window, ``minutes`` + 1 of them."""
    spark = requests.sparkSession
    start = F.unix_micros(now) - minutes * 60_000_000
    point = F.floor((F.unix_micros("ts") - start) / 60_000_000)
    counts = recent(requests).withColumn("point", point).where(F.col("point").between(0, minutes)).groupBy("point").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") == "block").alias("b"), F.avg("latency_ms").alias("avg")
    )
    grid = buckets(spark, F.lit(0).cast("long"), F.lit(minutes).cast("long"), "point")
    return grid.join(counts, "point", "left").select(
        "point", F.coalesce(F.col("n"), F.lit(0)).cast("double").alias("requests_per_minute"), ratio(F.col("b"), F.col("n")).alias("block_rate"), F.coalesce("avg", F.lit(0.0)).alias("avg_latency_ms")
    )


def snapshot(requests: DataFrame, now: Column) -> DataFrame:
    """One row: totals, rate of the last minute, mean and 99th percentile of the history. One-row parts side by side."""
    parts = [totals(requests).select("total_requests", "block_rate", "redact_rate"), per_minute(requests, now), bounded_average(requests), percentiles(requests, (99.0,)).withColumnRenamed("p99", "p99_latency_ms")]
    out = parts[0].withColumn("_k", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k").withColumn("active_connections", F.lit(0).cast("long"))


def latency_histogram(requests: DataFrame) -> DataFrame:
    """phase, le, n: cumulative counts by fixed upper bounds."""
    bounds = F.array(*[F.lit(float(b)) for b in LATENCY_BUCKETS_MS], F.lit(float("inf")))
    return requests.select("phase", F.explode(F.filter(bounds, lambda b: F.col("latency_ms") <= b)).alias("le")).groupBy("phase", "le").agg(F.count(F.lit(1)).alias("n"))


def exposition(counts: DataFrame, metric: str, labels: list[str], value: str = "n") -> DataFrame:
    """Text lines ``metric{label="value"} n``."""
    inner = F.concat_ws(",", *[F.format_string(f'{name}="%s"', F.col(name)) for name in labels])
    return counts.select(F.concat(F.lit(metric + "{"), inner, F.lit("} "), F.col(value).cast("string")).alias("line"))
