"""Risk score, severity from score, escalation."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalogue import SCORE_TERMS, SEVERITY_LEVEL, SEVERITY_RANK
from .text import let, words_in

BASE_SCORE = 0.5
HIGH_SCORE = 0.8
ELEVATED_SCORE = 0.65
MEDIUM_SCORE = 0.5
LOW_CONFIDENCE = 0.4
PIPELINE_CONFIDENCE = 0.5


def score_terms() -> Column:
    return F.from_json(
        F.lit(json.dumps([{"term": t, "weight": w} for t, w in SCORE_TERMS])),
        "array<struct<term:string,weight:double>>")


def score_terms_in(lowered: Column) -> Column:
    """The score terms that occur in a lower-cased text."""
    return words_in(lowered, list(dict.fromkeys(t for t, _ in SCORE_TERMS)))


def risk_score(finding_type: Column, terms: Column) -> Column:
    """The score of a finding in whose texts, besides its type, these terms occur.

    The weights are added in catalogue order, since the order shows in the last digit and
    the digit in the comparison with the thresholds.  Both arguments are bound to variables, or
    the terms would be looked up again for each weight.
    """
    weights = let(F.struct(F.lower(finding_type).alias("name"), terms.alias("terms")),
                  lambda x: F.transform(score_terms(), lambda t: F.when(
                      F.array_contains(x["terms"], t.term) | F.contains(x["name"], t.term),
                      t.weight).otherwise(F.lit(0.0))))
    total = F.aggregate(weights, F.lit(BASE_SCORE), lambda total, w: total + w)
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def severity_from_score(score: Column, original: Column) -> Column:
    return (F.when(score >= HIGH_SCORE, "Critical")
            .when(score >= ELEVATED_SCORE, "High")
            .when(score >= MEDIUM_SCORE, "Medium")
            .otherwise(original))


def score_confidence(score: Column, fallback_model: bool = False) -> Column:
    confidence = F.least(F.abs(score - 0.5) * 2, F.lit(1.0))
    return confidence * 0.8 if fallback_model else confidence


def should_escalate(score: Column, confidence: Column, flag: Column) -> Column:
    return flag | (score >= HIGH_SCORE) | (confidence < LOW_CONFIDENCE)


def severity_rank(severity: Column) -> Column:
    """Report scale; anything that is not on it counts as the lowest rank."""
    rank = F.lit(0)
    for name, value in SEVERITY_RANK.items():
        if value:
            rank = F.when(severity == name, value).otherwise(rank)
    return rank


def severity_level(level: Column) -> Column:
    """Classification scale."""
    rank = F.lit(0)
    for name, value in SEVERITY_LEVEL.items():
        if value:
            rank = F.when(level == name, value).otherwise(rank)
    return rank
