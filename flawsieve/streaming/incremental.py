"""Scanning versions of files as they arrive: only what is new or changed is scanned.

The state is, for each path, the digest and the number of its last version, in RocksDB.  A row that
repeats the content of the last version, or is older than it, goes no further.  Each micro-batch
writes the changed paths and their findings under its own number, so a batch that runs again
replaces what it wrote.  The findings of a path are those of the last batch that names it, so those
of replaced versions are withdrawn without touching them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..catalogue import DEFAULT_CATALOGUE
from ..plans.scan import scan
from .scan_stream import checkpoint_location

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
VERSIONS = "path string, content string, version long"


def changed_versions(files: DataFrame) -> DataFrame:
    """Of a stream ``(path, content, version)`` the last version of each path in a micro-batch, if
    it is newer than what was seen and says something else.  A null content is a file that is
    gone; of one version with several contents the last in the order of texts counts."""
    def last(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import hashlib

        import pandas as pd

        best = None
        for part in parts:  # never more than one part at a time
            for version, content in zip(part["version"], part["content"]):
                text = None if content is None else str(content)
                rank = (int(version), text is not None, text or "")
                if best is None or rank > best:
                    best = rank
        version, there, text = best
        digest = hashlib.sha256(text.encode()).hexdigest() if there else ""
        known, before = state.get if state.exists else (None, None)
        if before is not None and version < before:
            return
        state.update((digest, version))
        if digest != known:
            yield pd.DataFrame({"path": [key[0]], "content": [text if there else None],
                                "version": [version]})

    rows = files.select("path", "content", F.coalesce("version", F.lit(0)).cast("long").alias(
        "version")).where("path is not null")
    return rows.groupBy("path").applyInPandasWithState(
        last, VERSIONS, "digest string, version long", "update", GroupStateTimeout.NoTimeout)


def incremental_scan(files: DataFrame, folder: str, *, name: str = "incremental",
                     catalogue=DEFAULT_CATALOGUE, checkpoint: str | None = None,
                     available_now: bool = False) -> StreamingQuery:
    """Scans a stream of versions ``(path, content, version)`` into ``folder``;
    ``current_findings`` reads it."""
    spark = files.sparkSession
    spark.conf.set(PROVIDER, ROCKSDB)

    def scanned(batch: DataFrame, number: int) -> None:
        staged = f"{folder}/files/batch={number}"
        batch.write.mode("overwrite").parquet(staged)
        changed = spark.read.schema(VERSIONS).parquet(staged)
        scan(changed.where("content is not null"), catalogue).write.mode("overwrite").parquet(
            f"{folder}/findings/batch={number}")

    writer = changed_versions(files).writeStream.queryName(name).outputMode("update").foreachBatch(
        scanned).option("checkpointLocation", checkpoint_location(spark, name, checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def scanned_versions(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, version, batch)`` of every version that was scanned."""
    return spark.read.schema(f"{VERSIONS}, batch long").parquet(f"{folder}/files").select(
        "path", "version", "batch")


def current_findings(spark: SparkSession, folder: str) -> DataFrame:
    """The findings of the last version of each path."""
    last = scanned_versions(spark, folder).groupBy("path").agg(F.max("batch").alias("batch"))
    findings = spark.read.parquet(f"{folder}/findings")
    return findings.withColumn("batch", F.col("batch").cast("long")).join(
        last.withColumnRenamed("path", "file").hint("merge"), ["file", "batch"], "left_semi").drop("batch")


def withdrawn(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, batch, findings)``: how many findings each replaced version had."""
    later = Window.partitionBy("path").orderBy("batch").rowsBetween(1, Window.unboundedFollowing)
    old = scanned_versions(spark, folder).withColumn("replaced", F.count("*").over(later) > 0)
    findings = spark.read.parquet(f"{folder}/findings").groupBy(
        "file", F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("findings"))
    return findings.join(old.where("replaced").select(F.col("path").alias("file"), "batch")
                         .hint("merge"), ["file", "batch"])
