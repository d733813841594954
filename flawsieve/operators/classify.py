"""Classification of findings by type, and remedies by type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import CLASSIFICATION, SAFE_ALTERNATIVES, UNKNOWN_CLASSIFICATION

DEFAULT_CONFIDENCE = 0.8
MAX_EXAMPLES = 3


def classification_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(t, level, risk, text, list(examples), fix)
         for t, level, risk, text, examples, fix in CLASSIFICATION],
        "finding_type string, level string, risk string, description string, "
        "examples array<string>, fix string")


def alternatives_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, list(a)) for t, a in SAFE_ALTERNATIVES.items()],
                                 "finding_type string, safe_alternatives array<string>")


def classify_findings(findings: DataFrame) -> DataFrame:
    """Findings with the classification of their type, whose level replaces the severity.

    The dictionary is a constant of a few dozen rows, so it is broadcast whatever the size of
    the findings.
    """
    spark = findings.sparkSession
    level, risk, text, _, fix = UNKNOWN_CLASSIFICATION
    confidence = (F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE))
                  if "confidence" in findings.columns else F.lit(DEFAULT_CONFIDENCE))
    kept = [c for c in findings.columns
            if c not in ("finding_type", "severity", "confidence")]
    named = findings.withColumn("finding_type",
                                F.coalesce("finding_type", F.lit("Unknown")))
    return named.join(F.broadcast(classification_table(spark)), "finding_type", "left").select(
        *kept, "finding_type", F.coalesce("level", F.lit(level)).alias("severity"),
        confidence.alias("confidence"),
        F.struct(
            F.coalesce("risk", F.lit(risk)).alias("risk"),
            F.coalesce("description", F.lit(text)).alias("description"),
            F.slice(F.coalesce("examples", F.array().cast("array<string>")), 1, MAX_EXAMPLES)
            .alias("examples"),
            F.coalesce("fix", F.lit(fix)).alias("fix")).alias("classification"))


def with_alternatives(findings: DataFrame) -> DataFrame:
    """Findings with the remedies known for their type, none for other types."""
    table = F.broadcast(alternatives_table(findings.sparkSession))
    return findings.join(table, "finding_type", "left").select(
        *findings.columns,
        F.coalesce("safe_alternatives", F.array().cast("array<string>"))
        .alias("safe_alternatives"))
