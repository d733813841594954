"""Dedup and merge of the findings on one line.

Every key by which the pipeline merges contains file and line, and a scan emits one row per
line with all its hits in an array.  So the merge is a function of that array: no exchange,
no group that could grow with the data.  The array is at most as long as the catalogue, plus
the further matches of deterministic rules on that very line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalogue import RULE
from ..functions.scoring import severity_rank

SOURCE_TYPE = ("struct<lane:string,pattern:string,finding_type:string,severity:string,"
               "evidence:string,line:int,confidence:double,needs_escalation:boolean>")


def same_key(a: Column, b: Column) -> Column:
    return (a.finding_type == b.finding_type) & (a.pattern == b.pattern)


def before(findings: Column, i: Column) -> Column:
    """The first ``i`` elements."""
    return F.slice(findings, F.lit(1), i)


def dedup_heuristics(findings: Column) -> Column:
    """First finding per (type, pattern) of a line, in arrival order.

    A finding dropped as a repetition lifts the confidence of every kept one of its type that
    came before it, whatever the pattern.
    """
    marked = F.transform(findings, lambda f, i: F.struct(
        f.alias("f"), i.alias("i"),
        F.exists(before(findings, i), lambda e: same_key(e, f)).alias("repeated")))
    repeats = F.filter(marked, lambda m: m.repeated)

    def lifted(m):
        later = F.filter(repeats, lambda r: (r.i > m.i)
                         & (r.f.finding_type == m.f.finding_type))
        best = F.array_max(F.transform(later, lambda r: r.f.confidence))
        return m.f.withField("confidence", F.greatest(m.f.confidence, best))

    return F.when(F.size(repeats) == 0, findings).otherwise(
        F.transform(F.filter(marked, lambda m: ~m.repeated), lifted))


def merge_line(kept: Column) -> Column:
    """One element per finding type of a line, in order of first arrival.

    ``kept`` holds the deterministic findings, then the deduplicated heuristic ones.  Evidence
    and escalation flag come from the first finding, the severity is the first of highest
    rank, and of several deterministic findings of a type only the first is a source.
    """
    def one_type(finding_type):
        of_type = F.filter(kept, lambda f: f.finding_type == finding_type)
        sources = F.filter(of_type, lambda f, i: (i == 0) | (f.lane != RULE))
        first = F.get(of_type, F.lit(0))
        severity = F.aggregate(
            sources, first.severity,
            lambda best, f: F.when(severity_rank(f.severity) > severity_rank(best),
                                   f.severity).otherwise(best))
        return F.struct(
            finding_type.alias("finding_type"), severity.alias("severity"),
            first.evidence.alias("evidence"),
            ((first.lane == RULE) & first.needs_escalation).alias("needs_escalation"),
            sources.alias("source_details"))

    types = F.array_distinct(F.transform(kept, lambda f: f.finding_type))
    return F.transform(types, one_type)
