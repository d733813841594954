"""What the operators of this subpackage share: inputs, staged tables, worker set-up."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# White space as the text contracts name it: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with null texts as empty ones; other columns never reach an operator,
    so their names cannot clash with its own."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share.

    That is ``spark.checkpoint.dir`` or the context's checkpoint folder.  Only a local session,
    where driver and executors are one process, gets a folder of its own if neither is set.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
        root = context.getCheckpointDir()
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + os.path.abspath(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def staged(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows, written once as Parquet to the shared folder and read from there: they outlive
    the executors that made them, and each reader takes only the columns it needs."""
    spark = rows.sparkSession
    path = folder or shared_folder(spark)
    rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def ready_workers(spark: SparkSession) -> None:
    """Lets Python workers of a local session import this package.  A cluster gets it by
    ``--py-files``."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if PACKAGE_ROOT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (PACKAGE_ROOT, known) if x)


def arrow_schema(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))
