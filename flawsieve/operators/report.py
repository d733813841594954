"""Report: order, summary, gate, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import severity_rank
from ..sources.staging import staged

# Fixed values of the report.
SHOWN_FINDINGS = 20
SHOWN_EVIDENCE, SHOWN_EXPLANATION, SHOWN_FIX = 60, 100, 80
COUNTED = ("Critical", "High", "Medium", "Low")


def order_columns() -> list[Column]:
    """Files by path; inside a file the worst and lowest-placed findings first."""
    return [F.asc("file"), F.desc(severity_rank(F.col("severity"))), F.desc("line"),
            F.asc("seq")]


def report_order(findings: DataFrame, by_file: bool = False) -> DataFrame:
    """The findings in report order within each partition.

    A scan leaves all findings of a file in one partition, so this alone puts every file in
    order, without a shuffle; which file comes first means nothing in a report.  For findings
    from elsewhere ``by_file`` brings those of a file together first.  (A global sort would
    run the whole scan a second time, just to sample the sort keys.)
    """
    rows = findings.repartition("file") if by_file else findings
    return rows.sortWithinPartitions(*order_columns())


def ranked_report(findings: DataFrame) -> DataFrame:
    """The findings with their ``rank``, from 1, in the order of the whole report.

    The findings, small beside the texts that were scanned, are staged once.  They are dealt to
    ranges of the order and numbered within each; a range's numbers go on from the sum of the
    counts of those before it, one row for each range.  So no task sees them all.
    """
    placed = staged(findings).repartitionByRange(*order_columns()).sortWithinPartitions(
        *order_columns()).withColumn("_at", F.monotonically_increasing_id())
    placed = staged(placed)
    # The upper bits number the range, the lower ones the row in it.
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").select(
        (F.col("_start") + row + 1).alias("rank"), *findings.columns)


def severity_counts() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(f"{s.lower()}_count") for s in COUNTED]


def summary(findings: DataFrame, files: DataFrame | int,
            scan_seconds: float | None = None) -> DataFrame:
    """One row: findings in total and by severity, and the number of files scanned, those
    without findings included.

    ``files`` is that number, or the table itself.  Then both are counted in one aggregation,
    and of the files no more is read than their filter needs.
    """
    rows = findings.select("severity", F.lit(1).alias("finding"), F.lit(0).alias("file"))
    if isinstance(files, DataFrame):
        rows = rows.unionByName(files.select(
            F.lit(None).cast("string").alias("severity"), F.lit(0).alias("finding"),
            F.lit(1).alias("file")))
    known = F.lit(0 if isinstance(files, DataFrame) else files).cast("long")
    out = rows.agg(
        F.coalesce(F.sum("finding"), F.lit(0)).alias("total_findings"), *severity_counts(),
        (F.coalesce(F.sum("file"), F.lit(0)) + known).alias("files_scanned"))
    if scan_seconds is not None:
        out = out.withColumn("scan_time_seconds", F.lit(round(scan_seconds, 2)))
    return out


def gate(summary: DataFrame, any_finding: bool = False) -> DataFrame:
    """The exit code: 2 for a critical finding, else 1 for a high one, else 0; or, for
    ``any_finding``, 1 for a finding of whatever severity."""
    code = (F.when(F.col("total_findings") > 0, 1).otherwise(0) if any_finding
            else F.when(F.col("critical_count") > 0, 2)
            .when(F.col("high_count") > 0, 1).otherwise(0))
    return summary.select("*", code.cast("int").alias("exit_code"))


def top_findings(findings: DataFrame, n: int = SHOWN_FINDINGS) -> DataFrame:
    """The head of the report, cut to the width of a screen.  Takes a top-n, not a sort."""
    return findings.orderBy(*order_columns()).limit(n).select(
        "file", "line", "seq", "finding_type", "severity",
        F.substring("evidence", 1, SHOWN_EVIDENCE).alias("evidence"),
        F.substring("explanation", 1, SHOWN_EXPLANATION).alias("explanation"),
        F.substring("fix_suggestion", 1, SHOWN_FIX).alias("fix_suggestion"))


def console_report(summary: DataFrame, findings: DataFrame) -> str:
    """The report as text: the counts and the head of the findings."""
    s = summary.first().asDict()
    out = [f"Files scanned: {s['files_scanned']}"]
    if "scan_time_seconds" in s:
        out.append(f"Scan time: {s['scan_time_seconds']} s")
    out.append(f"Findings: {s['total_findings']}")
    out += [f"  {name}: {s[name.lower() + '_count']}" for name in COUNTED]
    for i, f in enumerate(top_findings(findings).collect(), 1):
        out += ["", f"{i}. [{f.severity}] {f.finding_type}", f"   File: {f.file}:{f.line}",
                f"   Evidence: {f.evidence}"]
        if f.explanation:
            out.append(f"   Explanation: {f.explanation}...")
        if f.fix_suggestion:
            out.append(f"   Fix: {f.fix_suggestion}...")
    return "\n".join(out)


def report_rows(findings: DataFrame) -> DataFrame:
    """The findings with the field names and rounding of the report."""
    sources = F.transform("source_details", lambda s: F.struct(
        s.lane.alias("lane"), s.pattern.alias("pattern"),
        s.finding_type.alias("finding_type"), s.severity.alias("severity"),
        s.evidence.alias("evidence_span"), s.line.alias("line"),
        s.confidence.alias("confidence"), s.needs_escalation.alias("needs_escalation")))
    return findings.select(
        "finding_type", "severity", F.col("evidence").alias("evidence_span"), "line", "file",
        F.round("risk_score", 2).alias("risk_score"), "needs_escalation",
        F.col("explanation").alias("llm_explanation"), "fix_suggestion",
        sources.alias("source_details"))


def json_rows(findings: DataFrame) -> DataFrame:
    """One JSON object per finding, null fields included."""
    rows = report_rows(findings)
    return rows.select("file", F.to_json(
        F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_json(findings: DataFrame, path: str) -> None:
    report_rows(report_order(findings)).write.mode("overwrite") \
        .option("ignoreNullFields", "false").json(path)
