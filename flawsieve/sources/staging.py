"""Results that are read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share: ``spark.checkpoint.dir``, or the
    context's checkpoint folder.  Where neither is set, a local session, which is one process,
    gets a folder of its own, and any other is told to set one."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def staged(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes an intermediate result once, as Parquet in ``folder`` or a new shared one, instead
    of computing it for each of its readers, which take the columns that they need."""
    spark = rows.sparkSession
    folder = folder or staging_folder(spark)
    rows.write.mode("overwrite").parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)
