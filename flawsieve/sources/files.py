"""Where files come from: tables, directories, single files, texts, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lenient_utf8
from .staging import staged
from .walk import FILE, contents, listing

# Names that exclude a path, extensions that are read, size limit in bytes.
IGNORED_NAMES = (
    ".git", ".svn", ".hg",
    "node_modules", "venv", "env", ".venv", "__pycache__",
    "dist", "build", ".egg-info",
    ".pytest_cache", ".tox", ".mypy_cache",
    "vendor", "third_party",
    ".DS_Store", "Thumbs.db",
    "package-lock.json", "yarn.lock", "poetry.lock",
    "requirements.txt", "package.json",
)
EXTENSIONS = (
    ".py", ".js", ".ts", ".jsx", ".tsx",
    ".java", ".go", ".rs", ".rb", ".php",
    ".cs", ".c", ".cpp", ".h", ".hpp",
    ".sh", ".bash", ".zsh",
    ".sql", ".yaml", ".yml", ".json",
    ".xml", ".toml", ".ini", ".cfg",
)
MAX_FILE_SIZE = 1_000_000

# Files differ in size, so work is cut finer than there are cores.
PIECES_PER_CORE = 4


def extension(path: Column) -> Column:
    """The last suffix of the file name; names that only start with a dot have none."""
    return F.regexp_extract(path, r"[^/.][^/]*(\.[^/.]+)$", 1)


def is_ignored(path: Column, names=IGNORED_NAMES) -> Column:
    """Whether a component of the path is one of the excluded names."""
    return F.arrays_overlap(F.split(path, "/"), F.lit(list(names)))


def is_source_file(path: Column, size: Column | None = None, *, ignored=IGNORED_NAMES,
                   extensions=EXTENSIONS, max_size: int = MAX_FILE_SIZE) -> Column:
    keep = ~is_ignored(path, ignored) & extension(path).isin(*extensions)
    return keep if size is None else keep & (size <= max_size)


def source_files(files: DataFrame, *, ignored=IGNORED_NAMES, extensions=EXTENSIONS,
                 max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """The rows of a table ``(path, content, ...)`` that a repository scan reads."""
    path = F.col("path")
    return files.where(is_source_file(
        path, F.octet_length("content"), ignored=ignored, extensions=extensions,
        max_size=max_size)).withColumn("extension", extension(path))


def spread(files: DataFrame, *key: str, partitions: int | None = None) -> DataFrame:
    """For a *small* table that is stored in fewer pieces than there are cores: scanning costs
    far more than moving it.  A large table has enough pieces and should stay where it is.
    """
    n = partitions or PIECES_PER_CORE * files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(n, *key)


def decoded_files(files: DataFrame, data: str = "data") -> DataFrame:
    """A table with raw bytes, with their text as ``content``."""
    return files.withColumn("content", lenient_utf8(data)).drop(data)


def inline_file(spark: SparkSession, code: str, filename: str = "code.py") -> DataFrame:
    return spark.createDataFrame([(filename, code)], "path string, content string")


def list_directory(spark: SparkSession, root: str, *, ignored=IGNORED_NAMES,
                   extensions=EXTENSIONS, max_size: int = MAX_FILE_SIZE,
                   partitions: int | None = None, budget: int | None = None) -> DataFrame:
    """``(path, size, status)`` of the entries under a directory: ``file`` for those that a scan
    reads; ``excluded``, ``extension``, ``size`` and ``unreadable`` for the others."""
    n = partitions or PIECES_PER_CORE * spark.sparkContext.defaultParallelism
    path, status = F.col("path"), F.col("status")
    return staged(listing(spark, root, ignored, n, budget).withColumn(
        "status", F.when(status != FILE, status).when(
            ~extension(path).isin(*extensions), "extension").when(
            F.col("size") > max_size, "size").otherwise(FILE)))


def skipped(listed: DataFrame) -> DataFrame:
    """``(status, entries)``: how many entries of a listing are read, and how many are not."""
    return listed.groupBy("status").agg(F.count("*").alias("entries"))


def read_listed(listed: DataFrame, root: str, partitions: int | None = None) -> DataFrame:
    """``(path, absolute_path, content, extension, error)`` of a listing's files, spread evenly.
    A file that could not be read has an ``error`` and no content."""
    n = partitions or PIECES_PER_CORE * listed.sparkSession.sparkContext.defaultParallelism
    path = F.col("path")
    loaded = contents(listed.where(F.col("status") == FILE).repartition(n), root)
    return decoded_files(loaded).select(
        "path", F.concat(F.lit(root.rstrip("/") + "/"), path).alias("absolute_path"), "content",
        extension(path).alias("extension"), "error")


def read_directory(spark: SparkSession, root: str, *, ignored=IGNORED_NAMES,
                   extensions=EXTENSIONS, max_size: int = MAX_FILE_SIZE,
                   partitions: int | None = None) -> DataFrame:
    """All source files under a directory that the executors can reach, by a path or a URI.  Names
    are filtered before anything is read; ``list_directory`` says what is left out.  (Spark's own
    file listing leaves out names that start with ``_`` or ``.``.)
    """
    listed = list_directory(spark, root, ignored=ignored, extensions=extensions,
                            max_size=max_size, partitions=partitions)
    return read_listed(listed, root, partitions).where("error is null").drop("error")


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One file whatever its name; no row if it cannot be read."""
    one = spark.createDataFrame([(path, path)], "path string, absolute_path string")
    return _read(one).select("path", "content")


_BATCH_BYTES = 16 << 20


def _read(paths: DataFrame) -> DataFrame:
    columns = ["path", "absolute_path", "data"]

    def load(batches):
        import pandas as pd

        rows, size = [], 0
        for batch in batches:
            for path, full in zip(batch["path"], batch["absolute_path"]):
                try:
                    with open(full, "rb") as f:
                        data = f.read()
                except OSError:
                    continue
                rows.append((path, full, data))
                size += len(data)
                if size >= _BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return decoded_files(paths.select("path", "absolute_path").mapInPandas(
        load, "path string, absolute_path string, data binary"))


def changed_paths(diffs: DataFrame, text: str = "diff") -> DataFrame:
    """The distinct paths named by the ``diff --git a/... b/...`` headers of diff texts."""
    return (
        diffs.select(F.explode(F.split(text, "\n")).alias("line"))
        .where(F.startswith("line", F.lit("diff --git")))
        .select(F.trim(F.regexp_extract("line", r" b/(.+)$", 1)).alias("path"))
        .where("path != ''")
        .distinct())


def changed_files(files: DataFrame, diffs: DataFrame, text: str = "diff") -> DataFrame:
    """The files that diff texts touch."""
    return files.join(changed_paths(diffs, text).hint("merge"), "path", "left_semi")
