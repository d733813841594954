"""Operators on the lines of a file: eligibility and the keyword scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogue import SENSITIVE_KEYWORDS
from ..functions.text import excerpt, let, lines_of, strip

# Evidence length, keywords a tier needs, confidence and type of a keyword hit.
DETECTOR_EVIDENCE = 80
MIN_KEYWORDS = 2
KEYWORD_CONFIDENCE = 0.6
KEYWORD_TYPE = "Sensitive Data"

_DETECTOR_CRITICAL = ("Secrets Leak", "SQL Injection", "Injection", "Insecure Deserialization")
_DETECTOR_HIGH = ("Command Injection", "Path Traversal", "SSRF", "XSS")


def pattern_lane_eligible(stripped: Column) -> Column:
    """Lines the semantic pattern lane looks at."""
    return ((F.length(stripped) >= 10) & ~F.startswith(stripped, F.lit("#"))
            & ~F.startswith(stripped, F.lit('"""')))


def detector_eligible(stripped: Column) -> Column:
    """Lines the stand-alone detector looks at."""
    return ((F.length(stripped) >= 5) & ~F.startswith(stripped, F.lit("#"))
            & ~F.startswith(stripped, F.lit("//")))


def file_lines(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``(file, line, text)``: the stripped lines of each file, numbered from 1."""
    return files.select(
        F.col(path).alias("file"), F.posexplode(lines_of(content)).alias("pos", "raw")
    ).select("file", (F.col("pos") + 1).alias("line"), strip("raw").alias("text"))


def keyword_tier(text: Column) -> Column:
    """The first tier of which a line holds enough different keywords, else null."""
    def enough(lowered, words):
        found = F.filter(F.lit(list(words)), lambda w: F.contains(lowered, w))
        return F.size(found) >= MIN_KEYWORDS

    def tier(lowered):
        out = F.lit(None).cast("string")
        for name, words in reversed(SENSITIVE_KEYWORDS.items()):
            out = F.when(enough(lowered, words), name).otherwise(out)
        return out

    return F.when(F.contains(text, F.lit("=")), let(F.lower(text), tier))


def keyword_scan(lines: DataFrame) -> DataFrame:
    """Lines that assign something and name several kinds of sensitive data."""
    # Dropping the lines without "=" first keeps the keyword tests off most of the text.
    return (
        lines.where(F.contains("text", F.lit("=")))
        .withColumn("severity", keyword_tier(F.col("text")))
        .where(F.col("severity").isNotNull())
        .select("file", "line", F.lit(KEYWORD_TYPE).alias("finding_type"), "severity",
                excerpt("text", DETECTOR_EVIDENCE).alias("evidence"),
                F.lit(KEYWORD_CONFIDENCE).alias("confidence"),
                F.lit("keyword").alias("method")))


def detector_severity(finding_type: Column) -> Column:
    return (F.when(finding_type.isin(*_DETECTOR_CRITICAL), "Critical")
            .when(finding_type.isin(*_DETECTOR_HIGH), "High")
            .otherwise("Medium"))


def merge_detector(findings: DataFrame) -> DataFrame:
    """One finding per (file, line, type): the first by ``seq``, with the best confidence.

    A plain aggregation, so repetitions are combined before the shuffle.
    """
    first = [c for c in findings.columns
             if c not in ("file", "line", "finding_type", "confidence", "seq")]
    return (
        findings.groupBy("file", "line", "finding_type")
        .agg(F.min_by(F.struct(*first), F.col("seq")).alias("first"),
             F.max("confidence").alias("confidence"))
        .select("file", "line", "finding_type", "first.*", "confidence"))
