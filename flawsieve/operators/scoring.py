"""Score rows for findings that come with their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import (risk_score, score_confidence, score_terms_in,
                                 severity_from_score)
from ..functions.text import let

# What a finding without the field is scored as.
DEFAULTS = {"finding_type": "Unknown", "evidence": "", "severity": "Medium"}
EVIDENCE_LENGTH = 100


def scored_terms(content: Column) -> Column:
    """What a score takes from a text, as a short text: findings carry it instead of the whole
    text of their file, however many there are."""
    return F.array_join(let(F.lower(content), score_terms_in), " ")


def score_findings(findings: DataFrame, content: str = "content",
                   fallback_model: bool = False) -> DataFrame:
    """One score row per finding, from its type, its evidence and the text it was found in.

    Inside a scan the evidence is part of the text, so there the terms are looked up once per
    file; here it may be anything and is searched as well.
    """
    kept = [c for c in findings.columns if c not in (*DEFAULTS, "line", content)]
    filled = findings.select(
        *kept, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in DEFAULTS.items()],
        F.coalesce("line", F.lit(0)).alias("line"),
        F.coalesce(F.col(content), F.lit("")).alias("_content"))
    # One text per finding, searched once: no term has a blank, so none can span the joint.
    text = F.lower(F.concat_ws(" ", "evidence", "_content"))
    scored = filled.withColumn("_terms", let(text, score_terms_in)).withColumn(
        "score", risk_score(F.col("finding_type"), F.col("_terms")))
    score = F.col("score")
    return scored.select(
        *kept, "finding_type",
        severity_from_score(score, F.col("severity")).alias("severity"),
        F.substring("evidence", 1, EVIDENCE_LENGTH).alias("evidence"), "line", "score",
        score_confidence(score, fallback_model).alias("confidence"))
