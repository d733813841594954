"""Analyses of escalated findings: answers of a reviewer, or standard texts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogue import DEFAULT_ANALYSIS, STANDARD_ANALYSIS
from ..functions.prompts import ANSWER_CONFIDENCE, STANDARD_CONFIDENCE, parse_answer

_TEXTS = "map<string,struct<explanation:string,fix_suggestion:string>>"


def standard_analysis(finding_type: Column) -> Column:
    """``STRUCT<explanation, fix_suggestion>`` for a type; a general one for other types."""
    known = F.from_json(F.lit(json.dumps(
        {t: {"explanation": e, "fix_suggestion": f}
         for t, (e, f) in STANDARD_ANALYSIS.items()})), _TEXTS)
    other = F.struct(F.lit(DEFAULT_ANALYSIS[0]).alias("explanation"),
                     F.lit(DEFAULT_ANALYSIS[1]).alias("fix_suggestion"))
    return F.coalesce(F.try_element_at(known, F.coalesce(finding_type, F.lit("Unknown"))),
                      other)


def route_analysis(findings: DataFrame, answers: DataFrame, key: list[str],
                   answer: str = "answer") -> DataFrame:
    """Each finding with the parsed answer it got, or the standard analysis if it got none.

    ``answers`` has at most one row per key and may be as many as the findings, so the join
    merges.
    """
    joined = findings.join(
        answers.select(*key, F.col(answer).alias("_answer")).hint("merge"), key, "left")
    answered = F.col("_answer").isNotNull()
    parsed = parse_answer(F.col("_answer"))
    standard = standard_analysis(F.col("finding_type"))
    return joined.select(
        *findings.columns,
        F.when(answered, parsed.explanation).otherwise(standard.explanation)
        .alias("explanation"),
        F.when(answered, parsed.fix_suggestion).otherwise(standard.fix_suggestion)
        .alias("fix_suggestion"),
        F.when(answered, ANSWER_CONFIDENCE).otherwise(STANDARD_CONFIDENCE)
        .alias("confidence"))


def attach_analyses(findings: DataFrame, analyses: DataFrame, order: str = "seq") -> DataFrame:
    """Merged findings with analyses joined by line.

    The last analysis of a line goes to its first finding, whatever the types.  Analyses are
    combined before the shuffle; the findings side is not grouped at all.
    """
    last = analyses.groupBy("file", "line").agg(
        F.max_by(F.struct("explanation", "fix_suggestion"), F.col(order)).alias("last"))
    kept = [c for c in findings.columns if c not in ("explanation", "fix_suggestion")]
    first = F.col("seq") == 0
    return findings.select(*kept).join(last.hint("merge"), ["file", "line"], "left").select(
        *kept, F.when(first, F.col("last.explanation")).alias("explanation"),
        F.when(first, F.col("last.fix_suggestion")).alias("fix_suggestion"))
