"""Review prompts for escalated findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import context_window, prompt, prompt_document, prompt_key
from ..functions.text import lines_of


def with_window(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with the window of lines around them, looked up in a table of files.

    A scan that keeps windows (``scan_lines(window=True)``) needs no such join.  Here the
    wanted lines are gathered per file first, so each file is read once and only the windows,
    never whole texts, meet the findings.  Wanted lines grow with the findings, so they are merged
    with the texts and not broadcast.  A file that is not there counts as an empty text.
    """
    wanted = (findings.where(F.col("file").isNotNull()).groupBy("file")
              .agg(F.collect_set("line").alias("wanted")))
    texts = files.select(F.col("path").alias("file"), F.col("content"))
    windows = (
        texts.join(wanted.hint("merge"), "file")
        .select("file", "wanted", lines_of("content").alias("lines"))
        .select("file", F.inline(F.transform("wanted", lambda line: F.struct(
            line.alias("line"), context_window(F.col("lines"), line).alias("_window"))))))
    nothing = context_window(F.array(F.lit("")), F.col("line"))
    return findings.join(windows.hint("merge"), ["file", "line"], "left").select(
        *findings.columns, F.coalesce("_window", nothing).alias("window"))


def render_prompts(findings: DataFrame) -> DataFrame:
    """Findings with ``prompt``, the ``document`` to export and its name ``key``."""
    fields = [F.col(c) for c in ("finding_type", "severity", "evidence", "line")]
    body = prompt(*fields, F.col("window"))
    return findings.withColumn("key", prompt_key(F.col("finding_type"), F.col("line"))) \
        .withColumn("prompt", body) \
        .withColumn("document", prompt_document(*fields, F.col("file"), F.col("prompt")))


def collapse_prompts(prompts: DataFrame) -> DataFrame:
    """One document per name: the last by file and arrival, as if each were written to a file
    of that name in turn."""
    return prompts.groupBy("key").agg(
        F.max_by(F.struct("finding_type", "file", "line", "document"),
                 F.struct("file", "line", "k")).alias("last")).select("key", "last.*")


def write_prompts(prompts: DataFrame, path: str, collapse: bool = False) -> None:
    """Documents by finding type; ``collapse`` keeps one per name."""
    rows = collapse_prompts(prompts) if collapse else prompts
    rows.select("finding_type", "file", "line", "key", "document") \
        .write.mode("overwrite").partitionBy("finding_type").json(path)
