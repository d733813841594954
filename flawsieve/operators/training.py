"""Labelled examples made from findings, and the history of scans."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXAMPLE_SCHEMA = ("finding_type string, severity string, evidence string, code string, "
                  "label int")
# Examples and characters of evidence in a summary, label of a finding.
SUMMARY_EXAMPLES = 5
SUMMARY_EVIDENCE = 50
VULNERABLE = 1


def training_rows(findings: DataFrame, code: str = "content",
                  label: int = VULNERABLE) -> DataFrame:
    """Examples from findings that carry the text of their file, as a scan with
    ``keep=("content",)`` returns them."""
    kept = [c for c in ("file", "line", "seq") if c in findings.columns]
    return findings.select(*kept, "finding_type", "severity", "evidence",
                           F.col(code).alias("code"), F.lit(label).alias("label"))


def save_examples(examples: DataFrame, path: str, scan_id: str) -> None:
    """Puts the examples of a scan into a set.  They replace those that the set has of this scan, so
    a retry changes nothing; a repetition within the scan is one row with its number of ``copies``,
    known by the digest of all its columns."""
    names = [f.split()[0] for f in EXAMPLE_SCHEMA.split(", ")]
    digest = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    rows = examples.groupBy(digest.alias("digest")).agg(
        *[F.first(n).alias(n) for n in names], F.count("*").alias("copies"))
    # Spark writes the new files aside and moves the scan's folder into place when all are there.
    rows.withColumn("scan_id", F.lit(scan_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("scan_id").json(path)


def load_examples(spark: SparkSession, path: str) -> DataFrame:
    """The examples of a set, repetitions included as they may be weighted by them, and the scan
    of each; none if there is no such set."""
    names = [f.split()[0] for f in EXAMPLE_SCHEMA.split(", ")]
    try:
        rows = spark.read.schema(f"{EXAMPLE_SCHEMA}, copies long, scan_id string").json(path)
    except AnalysisException:
        return spark.createDataFrame([], f"{EXAMPLE_SCHEMA}, scan_id string")
    copies = F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long")))
    return rows.withColumn("copy", F.explode(copies)).select(*names, "scan_id")


def known_patterns(examples: DataFrame, order: list[Column | str]) -> DataFrame:
    """One row: a summary of the first few examples, and how many examples there are."""
    first = examples.orderBy(*order).limit(SUMMARY_EXAMPLES)
    ranked = first.select(
        F.struct(*order).alias("o"),
        F.concat(F.lit("- "), "finding_type", F.lit(": "),
                 F.substring(F.coalesce("evidence", F.lit("")), 1, SUMMARY_EVIDENCE),
                 F.lit("\n")).alias("text"), F.lit(0).cast("long").alias("n"))
    total = examples.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(None).cast(ranked.schema["o"].dataType).alias("o"),
        F.lit(None).cast("string").alias("text"), "n")
    return ranked.unionByName(total).agg(
        F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("o", "text"))))
        .alias("t"), F.max("n").alias("n_examples")).select(
        F.array_join(F.transform("t", lambda t: t.text), "").alias("known_patterns"), "n_examples")


def knowledge_prompt(code: Column, known: Column) -> Column:
    """Asks a reviewer to judge code with the known patterns at hand."""
    return F.concat(F.lit("Earlier reviews confirmed these:\n"), known,
                    F.lit("\nDoes the following code show one of them, or another weakness? "
                          "Name the lines.\n\n"), code, F.lit("\n"))


def record_scan(findings: DataFrame, scan_id: str, path: str) -> None:
    """Stores the findings of a scan under its id; doing so again replaces them."""
    findings.withColumn("scan_id", F.lit(scan_id)).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").parquet(path)


def findings_history(recorded: DataFrame) -> DataFrame:
    """Findings per scan."""
    return recorded.groupBy("scan_id").agg(F.count("*").alias("findings"))


def learning_cycle(findings: DataFrame, iterations: int,
                   code: str = "content") -> tuple[DataFrame, DataFrame]:
    """History and examples of scanning the same code repeatedly and learning each time.

    The scan gives the same findings each time, so they are repeated rather than recomputed.
    """
    rounds = F.sequence(F.lit(1), F.lit(iterations))
    total = findings.agg(F.count("*").alias("findings"))
    history = total.select(F.explode(rounds).alias("iteration"), "findings")
    examples = training_rows(findings, code).select(
        F.explode(rounds).alias("iteration"), "*")
    return history, examples
