"""A table of vectors by content: each distinct line is embedded once, whoever scans it.

A store is a folder of Parquet files with the digest of a line's text and its vector.  Lines are
reduced to their digests before anything is shuffled; those that the store has are left out by an
anti-join, and only the rest are embedded and added, in a folder of their own that a retry
overwrites.  A scan then takes the matches of distinct lines, few beside the lines, by their digest.
"""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from .linewise import file_lines, pattern_lane_eligible
from .similarity import PATTERN_THRESHOLD, PatternSet, vector_hits

STORE = "digest binary, vector array<double>"


def line_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def stored_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(digest, vector)``; nothing if there is no such store."""
    try:
        return spark.read.schema(f"{STORE}, added string").parquet(path).select("digest", "vector")
    except AnalysisException:
        return spark.createDataFrame([], STORE)


def eligible_texts(files: DataFrame) -> DataFrame:
    """``(digest, text)`` of the distinct lines that the similarity lane looks at."""
    lines = file_lines(files).select(strip("text").alias("text")).where(
        pattern_lane_eligible(F.col("text")))
    return lines.groupBy(line_digest(F.col("text")).alias("digest")).agg(
        F.first("text").alias("text"))


def missing_texts(texts: DataFrame, path: str) -> DataFrame:
    """Those of ``(digest, text)`` that the store lacks."""
    return texts.join(stored_vectors(texts.sparkSession, path).select("digest").hint("merge"),
                      "digest", "left_anti")


def add_vectors(texts: DataFrame, path: str, embed, added: str) -> None:
    """Embeds the missing texts and adds them to the store under the name ``added``, which must be
    new to each set of texts; doing so again replaces them."""
    def vectors(part: pd.Series) -> pd.Series:
        import numpy as np
        import pandas as pd

        # Rows of one matrix: no number becomes an object of Python's.
        return pd.Series([*np.asarray(embed(part.tolist()), dtype=np.float64)], dtype=object)

    rows = missing_texts(texts, path).select(
        "digest", F.pandas_udf(vectors, "array<double>")("text").alias("vector"))
    rows.withColumn("added", F.lit(added)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("added").parquet(path)


def stored_hits(spark: SparkSession, path: str, patterns: PatternSet,
                threshold: float = PATTERN_THRESHOLD) -> DataFrame:
    """``(digest, similar)``: the matches of the stored lines that have any."""
    return stored_vectors(spark, path).select(
        "digest", vector_hits("vector", patterns, threshold).alias("similar")).where(
        F.size("similar") > 0)
