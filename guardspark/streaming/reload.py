"""Policies that change while a stream runs: a table of versions that each micro-batch looks up.

Publishing appends a version (one row a policy). A micro-batch takes the latest version there is, notes it before it judges, and judges all
its rows by it: a batch that is run again after a failure takes the version that it noted, so each row is judged once and by one version.
Policies are compiled once a version.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardspark.errors import ConfigError
from guardspark.operators import policy
from guardspark.sources.config import Policy
from guardspark.streaming.stateful import to_batches, work_dir

SHAPE = "version bigint, place int, text string"


@dataclass
class PolicyTable:
    """Versions of a list of policies (as YAML text) in a folder of Parquet files."""

    spark: SparkSession
    path: str
    compiled: dict[int, list[Policy]] = field(default_factory=dict)

    def publish(self, texts: list[str]) -> int:
        """A new version of all policies; a text that is no policy is an error and changes nothing."""
        for t in texts:
            Policy.from_yaml(t)
        version = (self.latest() or 0) + 1
        self.spark.createDataFrame([(version, k, t) for k, t in enumerate(texts)], SHAPE).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/v={version}")
        return version

    def rows(self) -> DataFrame:
        return self.spark.read.schema(SHAPE).option("recursiveFileLookup", "true").parquet(self.path)

    def latest(self) -> int | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.rows().agg(F.max("version")).first()[0] if there else None

    def policies(self, version: int) -> list[Policy]:
        if version not in self.compiled:
            # As many rows as a version has policies.
            found = self.rows().where(F.col("version") == version).orderBy("place").collect()
            self.compiled[version] = [Policy.from_yaml(r.text) for r in found]
        return self.compiled[version]


def judge_stream(texts: DataFrame, table: PolicyTable, text: str = "text", name: str = "reload", state: str | None = None) -> DataFrame:
    """A stream's rows (without ``text``) with ``version``, ``rules`` and ``should_stop``, to the source's end; ``state``: the folder of a run to go on with."""
    spark = texts.sparkSession
    base = state or work_dir(spark, name)

    def noted(n: int) -> int:
        """The version of micro-batch ``n``: what it noted, or the latest."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/versions/n={n}/_SUCCESS")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.read.schema("version bigint").parquet(f"{base}/versions/n={n}").first()[0]
        version = table.latest()
        if version is None:
            raise ConfigError(f"{table.path} holds no policies")
        spark.createDataFrame([(version,)], "version bigint").coalesce(1).write.mode("overwrite").parquet(f"{base}/versions/n={n}")
        return version

    def put(batch: DataFrame, n: int) -> None:
        version = noted(n)
        df = policy.with_evaluation(batch, table.policies(version), text, None)
        out = policy.outcome(F.col("triggered"))
        df = df.select(*[c for c in batch.columns if c != text], F.lit(version).cast("long").alias("version"), F.transform("triggered", lambda r: r["rule"]).alias("rules"), out["should_stop"].alias("should_stop"))
        df.write.mode("overwrite").parquet(f"{base}/out/n={n}")

    to_batches(texts, put, name, "append", f"{base}/checkpoint")
    shape = [f.simpleString() for f in texts.schema.fields if f.name != text]
    names = ", ".join(f"`{s.split(':', 1)[0]}` {s.split(':', 1)[1]}" for s in shape)
    return spark.read.schema(f"{names}, version bigint, rules array<string>, should_stop boolean").option("recursiveFileLookup", "true").parquet(f"{base}/out")
