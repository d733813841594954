"""The entry points: scan a directory, a file or a piece of code, and get a report."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, partial

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..catalogue import DEFAULT_CATALOGUE
from ..operators import report
from ..operators.prompts import render_prompts, write_prompts
from ..sources.files import inline_file, read_directory, read_file
from ..sources.staging import staged
from .scan import escalations, scan, scan_lines


@dataclass(frozen=True)
class Report:
    """The files of a scan and what finds their findings; neither runs before it is asked.

    ``findings`` is lazy.  The first question for a summary, a text or an exit code scans the
    files once and writes the findings to the shared folder; all are answered from there.
    """

    files: DataFrame
    finder: Callable[[DataFrame], DataFrame]

    @cached_property
    def findings(self) -> DataFrame:
        return self.finder(self.files)

    @cached_property
    def _scanned(self) -> tuple[DataFrame, int, float]:
        """The written findings, the number of files, counted as they passed, and the seconds."""
        started, counted = time.time(), Observation()
        files = self.files.observe(counted, F.count(F.lit(1)).alias("files"))
        found = staged(self.finder(files))
        return found, counted.get["files"], time.time() - started

    def summary(self) -> DataFrame:
        return report.summary(*self._scanned)

    def exit_code(self, any_finding: bool = False) -> int:
        return report.gate(self.summary(), any_finding).first().exit_code

    def text(self) -> str:
        return report.console_report(self.summary(), self._scanned[0])

    def save(self, path: str) -> DataFrame:
        """Writes ``findings`` (JSON, in report order) and ``summary`` under a folder, and
        returns the summary.

        The files are read once: they are counted as they pass, and the summary is made from
        the written findings.
        """
        spark, started = self.files.sparkSession, time.time()
        counted = Observation()
        files = self.files.select("path", "content").observe(
            counted, F.count(F.lit(1)).alias("files"))
        report.write_json(self.finder(files), f"{path}/findings")
        written = spark.read.schema("severity string").json(f"{path}/findings")
        report.summary(written, counted.get["files"], time.time() - started) \
            .write.mode("overwrite").json(f"{path}/summary")
        return spark.read.json(f"{path}/summary")


def scan_files(files: DataFrame, catalogue=DEFAULT_CATALOGUE, *, embed=None, analyse=False,
               context_filter=False, strict=False, prompts: str | None = None) -> Report:
    """The report on a table of files ``(path, content)``.

    With ``prompts`` a review prompt is written there for each escalated finding, in a pass
    over the files of its own.
    """
    if prompts is not None:
        lines = scan_lines(files, catalogue, embed=embed, window=True)
        write_prompts(render_prompts(escalations(lines)), prompts)
    return Report(files, partial(scan, catalogue=catalogue, embed=embed, analyse=analyse,
                                 context_filter=context_filter, strict=strict))


def scan_repository(spark: SparkSession, path: str, catalogue=DEFAULT_CATALOGUE,
                    **options) -> Report:
    return scan_files(read_directory(spark, path), catalogue, **options)


def scan_file(spark: SparkSession, path: str, catalogue=DEFAULT_CATALOGUE,
              **options) -> Report:
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    return scan_files(read_file(spark, path), catalogue, **options)


def scan_code(spark: SparkSession, code: str, filename: str = "code.py",
              catalogue=DEFAULT_CATALOGUE, **options) -> Report:
    """Only findings that the context validator accepts are escalated; all are reported
    unless ``strict`` is set."""
    return scan_files(inline_file(spark, code, filename), catalogue,
                      **{"context_filter": True, **options})
