"""The merge operators on *tables* of findings.

A scan merges inside its rows (``operators.merge``).  These are for findings that arrive as
rows: of other lanes, other tools, or earlier runs.  Input columns are ``file, line, lane,
pattern, finding_type, severity, evidence, confidence, needs_escalation`` and ``seq``, the
arrival order within a file.

Aggregations combine rows before the shuffle, and what is collected per key is at most one row per
pattern or type.  In ``dedup`` the raw rows are dealt to ``SALTS`` parts of their key, so a key that
holds a large part of the table does not meet in one task.

Both sides of the joins grow with the findings, and Spark measures staged ones by their compressed
files, so the joins are told to merge: a broadcast would pass a whole side through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalogue import RULE
from .merge import SOURCE_TYPE, merge_line

LINE = ["file", "line"]
TYPE = [*LINE, "finding_type"]
# Parts of a key in the join of repetitions with the firsts.
SALTS = 16


def dedup(findings: DataFrame) -> DataFrame:
    """First finding per (file, line, type, pattern); a repetition lifts the confidence of
    the kept findings of its type that came before it.

    The firsts of a type are few (one per pattern), so their order numbers go to every row as
    a small array; each repetition then falls into the gap between two firsts, and only the
    best confidence of each gap is left to compare.
    """
    firsts = findings.groupBy(*TYPE, "pattern").agg(
        F.min("seq").alias("seq"),
        F.min_by(F.struct("lane", "severity", "evidence", "confidence", "needs_escalation"),
                 F.col("seq")).alias("first"))
    order = firsts.groupBy(*TYPE).agg(F.sort_array(F.collect_list("seq")).alias("firsts"))
    # Only a type with repetitions on a line needs the second look.
    salted = order.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    gaps = (
        findings.select(*TYPE, "seq", "confidence", F.pmod(F.xxhash64("seq"), F.lit(SALTS))
                        .cast("int").alias("salt")).join(salted.hint("merge"), [*TYPE, "salt"])
        .where(~F.array_contains("firsts", F.col("seq")))
        .withColumn("gap", F.size(F.filter("firsts", lambda s: s < F.col("seq"))))
        .groupBy(*TYPE, "gap", "salt").agg(F.max("confidence").alias("confidence"))
        .groupBy(*TYPE, "gap").agg(F.max("confidence").alias("confidence"))
        .groupBy(*TYPE).agg(F.collect_list(F.struct("gap", "confidence")).alias("gaps")))
    lift = F.array_max(F.transform(
        F.filter("gaps", lambda g: g.gap >= F.array_position("firsts", F.col("seq"))),
        lambda g: g.confidence))
    return (
        firsts.join(order.hint("merge"), TYPE).join(gaps.hint("merge"), TYPE, "left")
        .select(*LINE, "first.lane", "pattern", "finding_type", "first.severity",
                "first.evidence",
                F.greatest("first.confidence", lift).alias("confidence"),
                "first.needs_escalation", "seq"))


def merge(findings: DataFrame) -> DataFrame:
    """One row per (file, line, type) with its sources; see ``operators.merge.merge_line``.

    ``findings`` holds rows of the lane ``rule``, which come first, and rows of other lanes,
    deduplicated.
    """
    rules = (
        findings.where(F.col("lane") == RULE).groupBy(*TYPE)
        .agg(F.min("seq").alias("seq"),
             F.min_by(F.struct("lane", "pattern", "severity", "evidence", "confidence",
                               "needs_escalation"), F.col("seq")).alias("f"))
        .select(*TYPE, "seq", "f.*"))
    kept = rules.unionByName(findings.where(F.col("lane") != RULE).select(*rules.columns))
    lines = kept.groupBy(*LINE).agg(F.sort_array(F.collect_list(F.struct(
        (F.col("lane") != RULE).alias("later"), "seq", F.struct(
            "lane", "pattern", "finding_type", "severity", "evidence", "line", "confidence",
            "needs_escalation").cast(SOURCE_TYPE).alias("f")))).alias("ordered"))
    return lines.select(*LINE, F.posexplode(merge_line(
        F.transform("ordered", lambda o: o.f))).alias("seq", "f")).select(*LINE, "seq", "f.*")


def last_scores(scores: DataFrame) -> DataFrame:
    """The last score of each line; ``scores`` has ``file, line, seq, score``."""
    return scores.groupBy(*LINE).agg(F.max_by("score", "seq").alias("score"))


def attach_scores(merged: DataFrame, scores: DataFrame) -> DataFrame:
    """The last score of a line goes to its first finding; other findings score 0."""
    return merged.join(last_scores(scores).hint("merge"), LINE, "left").select(
        *merged.columns,
        F.when(F.col("seq") == 0, F.coalesce("score", F.lit(0.0))).otherwise(F.lit(0.0))
        .alias("risk_score"))


def line_scores_or_default(findings: DataFrame, scores: DataFrame,
                           default: float = 0.5) -> DataFrame:
    """Each finding with the last score of its line, or the default where there is none."""
    return findings.join(last_scores(scores).hint("merge"), LINE, "left").select(
        *findings.columns, F.coalesce("score", F.lit(default)).alias("line_score"))
