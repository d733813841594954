"""Exact deduplication with streaming state on disk.

Texts are equal if they are identical without white space.  Of equal texts the row with the most
code points in the original text stays, then the one with the smallest ``doc_id``.

A stream of fingerprints updates one keyed state, which Spark keeps in RocksDB on the executors'
disks and in the checkpoint folder, and never expires.  For each digest it retains the number of
rows and the row that stays: its length, its stable identifier, and the locator of its content
(file and row number, which don't depend on how a job splits the files).  Rows of a micro-batch
are combined before the shuffle, so a digest that a third of all rows share reaches the state as
one row for each task.  More rows can be added later: ``advance`` goes on with the state that the
folder holds.

A digest is only a hint.  The full normalised texts that share one are compared as well: each
task first reduces the texts that it reads to distinct ones, and if a digest has more than one
text, its rows are grouped anew by their full text.

Cases: a null text counts as empty; a null ``doc_id`` comes after all others; of repeated rows
exactly one stays (all have its ``doc_id`` as ``keep_id``); extra columns, whatever their names,
stay in ``distinct_documents`` and play no part; an empty table gives an empty table; long texts
are compared whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, shared_folder, staged

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # An open store takes 4 MB of disk besides its state; a task closes its own when it is done.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
# Fingerprints that one micro-batch takes in.
BATCH_BYTES = 4 << 30


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"{SPACES}+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rank() -> Column:
    """The smallest stays."""
    return F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("unnamed"),
                    "doc_id", "file", "number")


def on_files(docs: DataFrame) -> DataFrame:
    """``docs`` if its rows are read straight from files; else a copy in the shared folder, so
    that the places of its rows are the same each time they are asked for."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return staged(docs)
    return docs


def located(docs: DataFrame) -> DataFrame:
    """``(held, file, number)``: the rows with the place of each in the Parquet files."""
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held")
    return on_files(docs).select(held, F.col("_metadata.file_path").alias("file"),
                                 F.col("_metadata.row_index").alias("number"))


def fingerprints(rows: DataFrame, folder: str, digest: Callable[[Column], Column]) -> DataFrame:
    """One row a document, without its text."""
    text = F.coalesce(F.col("held.text").cast("string"), F.lit(""))
    return staged(rows.select(
        "held.doc_id", F.length(text).cast("long").alias("chars"),
        digest(normalised(text)).alias("digest"), "file", "number"), folder)


def advance(spark: SparkSession, prints: DataFrame, source: str, state: str) -> DataFrame:
    """Takes all fingerprints in ``source`` that are new into the state in folder ``state``;
    returns ``(digest, n, best)`` for each digest ever seen."""
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(prints.schema).option(
            "maxBytesPerTrigger", BATCH_BYTES).parquet(source)
        query = (_summed(stream, "digest").writeStream.outputMode("update").format("noop")
                 .option("checkpointLocation", state).trigger(availableNow=True).start())
        try:
            query.awaitTermination()
        finally:
            query.stop()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    held = spark.read.format("statestore").load(state)
    return held.select("key.digest", F.col("value")[held.schema["value"].dataType[0].name]
                       .alias("n"), F.col("value")[held.schema["value"].dataType[1].name]
                       .alias("best"))


def decisions(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, digest)`` for each row of ``docs``."""
    return _decided(located(docs), digest).drop("file", "number")


def _decided(rows: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    spark = rows.sparkSession
    folder = shared_folder(spark)
    prints = fingerprints(rows, f"{folder}/prints", digest)
    if prints.isEmpty():
        held = _summed(prints, "digest")
    else:
        held = staged(advance(spark, prints, f"{folder}/prints", f"{folder}/state"),
                      f"{folder}/held")
    decided = prints.drop("chars").join(held, "digest")
    texts = rows.select(normalised(F.col("held.text")).alias("plain")).select(
        digest(F.col("plain")).alias("digest"), "plain")
    mixed = staged(texts.distinct().groupBy("digest").count().filter("count > 1")
                   .select("digest"), f"{folder}/mixed")
    if not mixed.isEmpty():
        decided = decided.join(mixed, "digest", "left_anti").unionByName(
            _by_text(rows, mixed, digest))
    return decided.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        ((F.col("file") == F.col("best.file")) & (F.col("number") == F.col("best.number")))
        .alias("kept"), "digest", "file", "number")


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(_rank()).alias("best"))


def _by_text(rows: DataFrame, mixed: DataFrame,
             digest: Callable[[Column], Column]) -> DataFrame:
    """Rows whose digest stands for different texts, grouped by text."""
    text = F.coalesce(F.col("held.text").cast("string"), F.lit(""))
    found = rows.select("held.doc_id", normalised(text).alias("plain"), F.length(text).cast("long")
                        .alias("chars"), "file", "number").withColumn(
        "digest", digest(F.col("plain"))).join(mixed, "digest", "left_semi")
    return found.drop("chars").join(_summed(found, "digest", "plain"),
                                    ["digest", "plain"]).drop("plain")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = located(docs)
    kept = _decided(rows, sha256).filter("kept").select("file", "number")
    return rows.join(kept, ["file", "number"], "left_semi").select("held.*")


ORACLE_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS plain
  FROM documents),
g AS (
  SELECT *, row_number() OVER (PARTITION BY plain ORDER BY chars DESC, doc_id NULLS LAST, r) AS k,
         count(*) OVER (PARTITION BY plain) AS group_size FROM d)
SELECT g.doc_id, b.doc_id AS keep_id, g.group_size, g.k = 1 AS kept, sha256(g.plain) AS text_sha256
FROM g JOIN g AS b ON g.plain = b.plain AND b.k = 1
"""
