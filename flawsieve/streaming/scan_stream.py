"""Scanning files as they arrive.

The scan works within the row of a file, so on a stream it is a plain stateless query: no
watermark, no state, no late rows, and the same findings as in batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..catalogue import DEFAULT_CATALOGUE
from ..plans.scan import scan


def checkpoint_location(spark, name: str, given: str | None = None) -> str:
    """The given place, or one under the shared folder the cluster names."""
    base = given or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        raise ValueError("set spark.checkpoint.dir, or pass a checkpoint folder that all "
                         "executors can reach")
    return base if given else f"{base.rstrip('/')}/{name}"


def scan_stream(files: DataFrame, path: str, *, name: str = "scan",
                catalogue=DEFAULT_CATALOGUE, checkpoint: str | None = None, embed=None,
                available_now: bool = False) -> StreamingQuery:
    """Appends the findings of a stream of files ``(path, content)`` to a Parquet table."""
    writer = (
        scan(files, catalogue, embed=embed).writeStream.queryName(name).format("parquet")
        .option("path", path).outputMode("append")
        .option("checkpointLocation",
                checkpoint_location(files.sparkSession, name, checkpoint)))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def running_counts(findings: DataFrame) -> DataFrame:
    """Findings per severity so far; the state is one counter per severity."""
    return findings.groupBy("severity").agg(F.count("*").alias("findings"))
