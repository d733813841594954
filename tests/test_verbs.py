"""The entry points."""

import os

import pytest
from test_scan import GOLDEN, GOLDEN_REPORT

import flawsieve


def test_repository_file_and_code_agree(spark, tmp_path):
    os.makedirs(tmp_path / "repo" / "src")
    (tmp_path / "repo" / "src" / "g.py").write_text(GOLDEN)
    (tmp_path / "repo" / "src" / "notes.md").write_text("eval(x)")
    by = {"repository": flawsieve.scan_repository(spark, str(tmp_path / "repo")),
          "file": flawsieve.scan_file(spark, str(tmp_path / "repo" / "src" / "g.py")),
          "code": flawsieve.scan_code(spark, GOLDEN)}
    for r in by.values():
        got = {(f.line, f.finding_type, f.severity, len(f.source_details))
               for f in r.findings.collect()}
        assert got == set(GOLDEN_REPORT)
        assert r.summary().first().files_scanned == 1
        assert r.exit_code() == 2
    assert by["repository"].findings.first().file == "src/g.py"
    assert by["code"].findings.first().file == "code.py"
    with pytest.raises(FileNotFoundError):
        flawsieve.scan_file(spark, str(tmp_path / "none"))


def test_save_counts_clean_files_in_the_same_pass(spark, tmp_path):
    files = spark.createDataFrame([(f"f{i}.py", GOLDEN if i == 3 else "x = 1")
                                   for i in range(40)], "path string, content string")
    summary = flawsieve.scan_files(files.repartition(5)).save(str(tmp_path / "r")).first()
    assert (summary.files_scanned, summary.total_findings) == (40, 11)


def test_save(spark, tmp_path):
    report = flawsieve.scan_code(spark, GOLDEN, strict=True)
    summary = report.save(str(tmp_path / "r")).first()
    assert summary.total_findings == report.findings.count() < 11
    assert summary.files_scanned == 1 and summary.scan_time_seconds >= 0


def test_clean_code(spark):
    report = flawsieve.scan_code(spark, "def add(a, b): return a")
    assert report.summary().first().total_findings == 0 and report.exit_code() == 0
    assert "Findings: 0" in report.text()


def test_prompts_are_written(spark, tmp_path):
    files = flawsieve.scan_code(spark, GOLDEN).files
    flawsieve.scan_files(files, prompts=str(tmp_path / "p"))
    rows = spark.read.json(str(tmp_path / "p")).collect()
    assert {r.key for r in rows} >= {"Injection_line16", "XSS_line12"}
    assert all("State the cause" in r.document for r in rows)


def test_a_report_scans_once(spark):
    scans = []
    files = flawsieve.scan_code(spark, GOLDEN).files
    report = flawsieve.scan_files(files)
    counted = type(report)(files, lambda f: scans.append(1) or report.finder(f))
    assert counted.text() and counted.exit_code() and counted.exit_code(True)
    assert counted.summary().first().files_scanned == 1 and len(scans) == 1
