"""The stand-alone detector: best-matching description per line, and the keyword scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import excerpt
from ..operators.linewise import (DETECTOR_EVIDENCE, KEYWORD_CONFIDENCE, KEYWORD_TYPE,
                                  detector_eligible, detector_severity, file_lines,
                                  keyword_tier)
from ..operators.similarity import DETECTOR_THRESHOLD, detector_patterns, text_hits


def detect(files: DataFrame, embed, threshold: float = DETECTOR_THRESHOLD,
           path: str = "path", content: str = "content") -> DataFrame:
    """Findings of both lanes, one per (file, line, type).

    A line has at most one semantic finding, whose type is one of the descriptions', and at
    most one keyword finding, whose type is not.  So the two never share a key and the merge
    is a union within the row of the line.
    """
    patterns, types = detector_patterns(embed)
    text = F.col("text")
    best = F.get("best", F.lit(0))
    semantic_type = F.get(F.lit(types), best.ord - 1)

    def finding(finding_type, severity, confidence, method):
        return F.struct(
            finding_type.alias("finding_type"), severity.alias("severity"),
            confidence.alias("confidence"), F.lit(method).alias("method"))

    return (
        file_lines(files, path, content)
        .withColumn("best", text_hits(F.when(detector_eligible(text), text), patterns, embed,
                                      threshold, best_only=True))
        .withColumn("tier", keyword_tier(text))
        .select("file", "line", excerpt(text, DETECTOR_EVIDENCE).alias("evidence"),
                F.inline(F.array_compact(F.array(
                    F.when(best.isNotNull(),
                           finding(semantic_type, detector_severity(semantic_type),
                                   best.similarity, "semantic")),
                    F.when(F.col("tier").isNotNull(),
                           finding(F.lit(KEYWORD_TYPE), F.col("tier"),
                                   F.lit(KEYWORD_CONFIDENCE), "keyword"))))))
    )
