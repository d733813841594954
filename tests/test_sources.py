"""Files from directories, tables, diffs and requests; rules from JSON."""

import json
import os
import subprocess
import sys

import pytest
from conftest import files_frame

from flawsieve import catalogue as cat
from flawsieve.operators import report
from flawsieve.operators.training import (findings_history, known_patterns, knowledge_prompt,
                                          learning_cycle, load_examples, record_scan,
                                          save_examples, training_rows)
from flawsieve.plans.requests import answer_requests
from flawsieve.plans.scan import scan
from flawsieve.sources.files import (changed_files, decoded_files, extension, inline_file,
                                     list_directory, read_directory, read_file, read_listed,
                                     skipped, source_files)
from flawsieve.sources.rules import read_rules
from flawsieve.sources.staging import staged
from pyspark.sql import functions as F


def write(root, path, data):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as f:
        f.write(data)


def test_directory(spark, tmp_path):
    root = str(tmp_path / "repo")
    write(root, "src/__init__.py", b"eval(x)\r\nb\rc")
    write(root, "_top.py", "é�".encode() + b"\xff\xc3(")
    write(root, "src/.hidden.py", b"x")
    write(root, "src/a b.js", b"y")
    write(root, "node_modules/x.js", b"no")
    write(root, "src/build/x.js", b"no")
    write(root, "src/.py", b"no")
    write(root, "src/readme.md", b"no")
    write(root, "package.json", b"no")
    write(root, "src/exact.py", b"a" * 1_000_000)
    write(root, "src/large.py", b"a" * 1_000_001)
    write(root, "src/empty.py", b"")
    got = {r.path: r for r in read_directory(spark, root).collect()}
    assert set(got) == {"src/__init__.py", "_top.py", "src/.hidden.py", "src/a b.js",
                        "src/exact.py", "src/empty.py"}
    assert got["src/__init__.py"].content == "eval(x)\nb\nc"
    assert got["_top.py"].content == (b"\xc3\xa9\xef\xbf\xbd\xff\xc3(").decode(
        "utf-8", errors="ignore")
    assert got["src/a b.js"].extension == ".js"
    assert got["src/a b.js"].absolute_path == os.path.join(root, "src/a b.js")
    assert scan(read_directory(spark, root)).count() == 1
    with pytest.raises(ValueError):
        read_directory(spark, str(tmp_path / "none"))
    os.makedirs(tmp_path / "bare")
    assert read_directory(spark, str(tmp_path / "bare")).count() == 0
    assert [r.content for r in read_file(spark, os.path.join(root, "src/readme.md")).collect()] \
        == ["no"]
    assert read_file(spark, os.path.join(root, "missing")).count() == 0


def test_wide_folder_in_little_memory(tmp_path):
    """A task that lists a wide folder holds one batch of its entries, not all."""
    for i in range(60_000):
        open(tmp_path / f"a_file_with_some_longer_name_{i}.py", "w").close()
    code = f"""
import resource
import pandas as pd
from pyarrow import fs
from flawsieve.sources.walk import _lister
walk = _lister({str(tmp_path)!r}, frozenset(), 100)
pd.DataFrame([("", None, "")] * 10_000, columns=["path", "size", "status"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(len(b) for b in walk([pd.DataFrame({{"path": [""]}})]))
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True,
                         cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    listed, kilobytes = map(int, out.stdout.split())
    assert listed == 60_000 and kilobytes < 15_000


@pytest.mark.parametrize("budget", [1, 3, 10_000])
def test_walk(spark, tmp_path, budget):
    """Every entry is listed once and accounted for, however often a task hands folders back."""
    root = str(tmp_path / "tree")
    deep = "/".join(f"d{i}" for i in range(9))
    for i in range(7):
        write(root, f"wide/f{i}.py", b"eval(x)")
        write(root, f"{'/'.join(deep.split('/')[:i + 1])}/g{i}.py", b"a")
    write(root, f"{deep}/node_modules/lib/x.py", b"no")
    write(root, f"{deep}/notes.txt", b"no")
    write(root, f"{deep}/large.py", b"a" * 30)
    os.symlink(root, f"{root}/wide/loop")
    os.symlink(f"{root}/nowhere", f"{root}/wide/gone.py")
    os.symlink(f"{root}/wide/f1.py", f"{root}/linked.py")
    listed = list_directory(spark, root, max_size=20, budget=budget)
    rows = [(r.path, r.status) for r in listed.collect()]
    assert len(rows) == len(set(rows))
    other = {p: s for p, s in rows if s != "file"}
    assert other == {f"{deep}/node_modules": "excluded", f"{deep}/notes.txt": "extension",
                     f"{deep}/large.py": "size", "wide/loop": "excluded",
                     "wide/gone.py": "unreadable"}
    assert {p for p, s in rows if s == "file"} == {
        *(f"wide/f{i}.py" for i in range(7)), "linked.py",
        *(f"{'/'.join(deep.split('/')[:i + 1])}/g{i}.py" for i in range(7))}
    assert {r.status: r.entries for r in skipped(listed).collect()} == {
        "file": 15, "excluded": 2, "extension": 1, "size": 1, "unreadable": 1}
    by_uri = read_listed(list_directory(spark, f"file://{root}", max_size=20), f"file://{root}")
    assert {r.path for r in by_uri.collect()} == {p for p, s in rows if s == "file"}
    os.remove(f"{root}/wide/f3.py")  # since it was listed
    read = {r.path: r for r in read_listed(listed, root).collect()}
    assert read["wide/f3.py"].error and read["wide/f3.py"].content is None
    assert read["linked.py"].content == "eval(x)" and read["linked.py"].error is None
    assert scan(read_directory(spark, root)).count() == 7


def test_decode(spark):
    data = [b"", b"\xff\xfe", b"a\xf0\x9f\x98\x80b\xf0\x9f", b"\xed\xa0\x80x", b"\r\r\n\n",
            "�".encode() + b"\x80" + "".encode(), b"\xc0\xafz"]
    rows = decoded_files(spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)],
                                               "i int, data binary"))
    for r in rows.collect():
        want = data[r.i].decode("utf-8", errors="ignore")
        assert r.content == want.replace("\r\n", "\n").replace("\r", "\n"), data[r.i]


def test_extensions(spark):
    names = ["a.py", "a.tar.gz", ".bashrc", "d.x/file", "a.", "d/.x.py", "noext", "x.PY", "a.b/c.d"]
    got = [r.e for r in spark.createDataFrame([(n,) for n in names], "p string").select(
        extension(F.col("p")).alias("e")).collect()]
    assert got == [".py", ".gz", "", "", "", ".py", "", ".PY", ".d"]


def test_source_files(spark):
    files = files_frame(spark, [("a/x.py", "1"), ("dist/x.py", "1"), ("x.PY", "1"),
                                ("a/distx/y.go", "1"), ("a/big.c", "é" * 4)])
    assert {r.path for r in source_files(files).collect()} == {
        "a/x.py", "a/distx/y.go", "a/big.c"}
    assert {r.path for r in source_files(files, max_size=7).collect()} == {
        "a/x.py", "a/distx/y.go"}


def test_changed_files(spark):
    diff = ("diff --git a/lib b/x.py b/lib b/x.py\n+diff --git a/n b/n\n"
            "diff --git a/web/y.js b/web/y.js\r\nindex\ndiff --git nothing")
    diffs = spark.createDataFrame([(diff.replace("\r", ""),)], "diff string")
    files = files_frame(spark, [("x.py b/lib b/x.py", "1"), ("web/y.js", "1"), ("n", "1")])
    got = {r.path for r in changed_files(files, diffs).collect()}
    assert got == {"x.py b/lib b/x.py", "web/y.js"}


def test_rules_file(spark, tmp_path):
    path = str(tmp_path / "rules.json")
    with open(path, "w") as f:
        json.dump([{"id": "A1", "name": "n", "pattern": r"foo\(", "severity": "High",
                    "finding_type": "Foo", "needs_escalation": True},
                   {"id": "A2", "pattern": "", "severity": "Low", "finding_type": "Bar"}], f)
    rules = read_rules(spark, path)
    assert [r.name for r in rules[:2]] == ["A1", "A2"] and len(rules) == 66
    got = scan(inline_file(spark, "foo(1)"), rules).first()
    assert (got.finding_type, got.needs_escalation) == ("Foo", True)
    assert read_rules(spark, None) == cat.DEFAULT_CATALOGUE
    with pytest.warns(UserWarning):
        assert read_rules(spark, str(tmp_path / "missing.json")) == cat.DEFAULT_CATALOGUE
    with open(tmp_path / "bad.json", "w") as f:
        f.write("{not json")
    with pytest.warns(UserWarning):
        assert read_rules(spark, str(tmp_path / "bad.json")) == cat.DEFAULT_CATALOGUE
    frame = cat.rules_frame(spark)
    assert frame.count() == 76 and frame.where("lane = 'rule'").count() == 12


REQUESTS = [
    (1, {"method": "analyze_code", "params": {"code": "eval(x)"}}),
    (2, {"method": "analyze_file", "params": {"file_path": "a/b.py", "file_content": "x=1"}}),
    (3, {"method": "analyze_file", "params": {"file_path": "src/a.py", "file_content": ""}}),
    (4, {"method": "analyze_file", "params": {"file_path": "gone.py"}}),
    (5, {"method": "analyze_repository", "params": {"repo_path": "./src/"}}),
    (6, {"method": "analyze_repository"}),
    (7, {"method": "other"}), (8, {}),
    (9, {"method": "analyze_repository", "params": {"repo_path": "none"}}),
    (10, {"method": "analyze_file", "params": {"file_path": "notes.md"}}),
    (11, {"method": "analyze_code", "params": {"filename": "x.py"}}),
]


def test_requests(spark):
    rows = [(i, json.dumps(r)) for i, r in REQUESTS] + [(12, "not json")]
    files = files_frame(spark, [("src/a.py", "eval(x)\nDEBUG = True"), ("src/c/d.py", "x=1"),
                                ("notes.md", "eval(x)"), ("top.py", "os.system(x)")])
    got = {r.request_id: (r.error, r.total_findings, r.critical_count, r.files_scanned)
           for r in answer_requests(spark.createDataFrame(rows, "request_id int, request string"),
                                    files).collect()}
    assert got == {
        1: (None, 1, 1, 1), 2: (None, 0, 0, 1), 3: (None, 2, 1, 1),
        4: ("file not found: gone.py", None, None, None), 5: (None, 2, 1, 2),
        6: (None, 4, 1, 3), 7: ("unknown method: other", None, None, None),
        8: ("unknown method: ", None, None, None),
        9: ("no such directory: none", None, None, None), 10: (None, 1, 1, 1),
        11: (None, 0, 0, 1), 12: ("invalid JSON", None, None, None)}


def test_training(spark, tmp_path):
    path = str(tmp_path / "examples")
    assert load_examples(spark, path).count() == 0
    findings = scan(files_frame(spark, ["eval(x)\nDEBUG = True"]), keep=("content",))
    rows = training_rows(findings)
    save_examples(rows, path, "a")
    save_examples(rows.unionByName(rows), path, "b")
    save_examples(rows.unionByName(rows), path, "b")  # again, as after a lost driver
    saved = load_examples(spark, path)
    assert sorted(r.scan_id for r in saved.collect()) == ["a"] * 2 + ["b"] * 4
    save_examples(rows.limit(0), path, "c")
    save_examples(rows.limit(1), path, "b")
    assert sorted(r.scan_id for r in load_examples(spark, path).collect()) == ["a", "a", "b"]
    save_examples(rows.withColumn("evidence", F.lit(None).cast("string")), path, "n")
    assert load_examples(spark, path).filter("evidence is null").count() == 2
    saved = load_examples(spark, path)
    assert {(r.finding_type, r.code, r.label) for r in saved.collect()} == {
        ("Injection", "eval(x)\nDEBUG = True", 1),
        ("Misconfiguration", "eval(x)\nDEBUG = True", 1)}
    known = known_patterns(rows, ["file", "line"]).first().known_patterns
    assert known == "- Injection: eval(\n- Misconfiguration: DEBUG = True\n"
    asked = spark.range(1).select(knowledge_prompt(F.lit("CODE"), F.lit(known)).alias("p"))
    assert "CODE" in asked.first().p and known in asked.first().p
    history, examples = learning_cycle(findings, 3)
    assert [(r.iteration, r.findings) for r in history.orderBy("iteration").collect()] == [
        (1, 2), (2, 2), (3, 2)]
    assert examples.count() == 6


def test_recording_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "scans")
    one = scan(files_frame(spark, ["eval(x)"]))
    two = scan(files_frame(spark, ["eval(x)\nos.system(y)"]))
    for scan_id, findings in (("a", one), ("b", two), ("b", two)):
        record_scan(findings, scan_id, path)
    got = {r.scan_id: r.findings for r in findings_history(spark.read.parquet(path)).collect()}
    assert got == {"a": 1, "b": 3}


def test_json_sink(spark, tmp_path):
    findings = scan(files_frame(spark, ["eval(x)"]))
    report.write_json(findings, str(tmp_path / "r"))
    text = [line for f in os.listdir(tmp_path / "r") if f.endswith(".json")
            for line in open(tmp_path / "r" / f)]
    row = json.loads(text[0])
    assert len(text) == 1 and list(row) == [
        "finding_type", "severity", "evidence_span", "line", "file", "risk_score",
        "needs_escalation", "llm_explanation", "fix_suggestion", "source_details"]
    assert row["llm_explanation"] is None and len(row["source_details"]) == 2
    assert json.loads(report.json_rows(findings).first().json) == row


def test_staged(spark):
    rows = staged(spark.range(5))
    assert rows.count() == 5 and "Range" not in rows._jdf.queryExecution().optimizedPlan().toString()
