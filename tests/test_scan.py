"""The scan as a whole, against the plain-Python model."""

import random

import pytest
from conftest import files_frame
from test_matching import ODD, SAMPLES

import model
from flawsieve import catalogue as cat
from flawsieve.operators import report
from flawsieve.operators.similarity import hashed_ngrams, unit_rows
from flawsieve.plans.scan import escalations, merged_findings, scan, scan_lines

GOLDEN = '''import sqlite3
API_KEY = "0123456789abcdef0123"
total = 1 + 2

def load(blob):
    return pickle.loads(blob)

def lookup(cur, name):
    cur.execute("select * from t where n = " + name)

def page(name):
    return render_template_string("<p>%s</p>" % name)

def run(cmd):
    subprocess.run(cmd, shell=True)
    return eval (cmd)
r = requests.get(
    url,
    timeout=3)
digest = hashlib.md5(b"x").hexdigest()  # eval (old)
app.run(debug=True)
'''
GOLDEN_REPORT = [
    (20, "Injection", "Critical", 2), (16, "Injection", "Critical", 2),
    (12, "XSS", "Critical", 2), (6, "Insecure Deserialization", "Critical", 2),
    (2, "Secrets Leak", "Critical", 3), (17, "SSRF", "High", 1),
    (15, "Command Injection", "High", 1), (9, "SQL Injection", "High", 2),
    (3, "SQL Injection", "High", 1), (20, "Weak Cryptography", "Medium", 2),
    (21, "Misconfiguration", "Low", 1)]


def rows_of(findings):
    """Findings as the model writes them, by file."""
    out = {}
    for r in report.report_order(findings).collect():
        out.setdefault(r.file, []).append({
            "line": r.line, "finding_type": r.finding_type, "severity": r.severity,
            "evidence": r.evidence, "needs_escalation": r.needs_escalation,
            "risk_score": r.risk_score,
            "sources": [(s.lane, s.pattern, s.confidence) for s in r.source_details]})
    return out


def test_golden_report(spark):
    files = files_frame(spark, [("g.py", GOLDEN), ("clean.py", "x = 1\n")])
    findings = scan(files)
    got = [(r.line, r.finding_type, r.severity, len(r.source_details))
           for r in report.report_order(findings).collect()]
    assert got == GOLDEN_REPORT
    summary = report.summary(findings, files, scan_seconds=1.234)
    assert summary.first().asDict() == {
        "total_findings": 11, "critical_count": 5, "high_count": 4, "medium_count": 1,
        "low_count": 1, "files_scanned": 2, "scan_time_seconds": 1.23}
    assert report.gate(summary).first().exit_code == 2
    assert report.gate(summary, any_finding=True).first().exit_code == 1
    text = report.console_report(summary, findings)
    assert text.startswith("Files scanned: 2\nScan time: 1.23 s\nFindings: 11\n  Critical: 5")
    assert "1. [Critical] Injection\n   File: g.py:20" in text


def test_equals_the_model(spark):
    rng = random.Random(5)
    pieces = SAMPLES + ODD
    texts = pieces + ["\n".join(rng.choices(pieces, k=rng.randrange(2, 9))) for _ in range(60)]
    texts += [" ".join(rng.choices(pieces, k=rng.randrange(2, 5))) for _ in range(60)]
    named = [(f"f{i}", t) for i, t in enumerate(texts)]
    got = rows_of(scan(files_frame(spark, named)))
    want = {p: m for p, t in named if (m := model.scan(t))}
    assert got == want
    assert sum(map(len, want.values())) > 500


def test_semantic_lane_equals_the_model(spark):
    embed = hashed_ngrams()
    unit = unit_rows(embed([p.text for p in cat.SEMANTIC_PATTERNS]))
    rng = random.Random(9)
    texts = ["\n".join(rng.choices(
        SAMPLES + [p.text for p in cat.SEMANTIC_PATTERNS] + ["# md5 digest", '"""md5 digest'],
        k=8)) for _ in range(40)]
    texts += ["md5 digest\nhashlib.md5(x) md5 digest", "shell=True subprocess run shell true"]
    want = {}
    for i, text in enumerate(texts):
        extra = []
        for n, line in enumerate(text.split("\n"), 1):
            line = line.strip()
            if len(line) < 10 or line.startswith(("#", '"""')):
                continue
            sims = (unit * unit_rows(embed([line]))[0]).sum(axis=1)
            for p, s in zip(cat.SEMANTIC_PATTERNS, sims):
                if s > 0.65:
                    extra.append({
                        "lane": "semantic", "pattern": p.name, "finding_type": p.finding_type,
                        "severity": p.severity, "evidence": line[:100], "line": n,
                        "confidence": float(s), "needs_escalation": False})
        if merged := model.scan(text, extra=extra):
            want[f"f{i}"] = merged
    got = rows_of(scan(files_frame(spark, list(zip([f"f{i}" for i in range(len(texts))],
                                                   texts))), embed=embed))

    def rounded(reports):
        return {f: [dict(r, sources=[(a, b, c and round(c, 9)) for a, b, c in r["sources"]])
                    for r in rs] for f, rs in reports.items()}

    assert rounded(got) == rounded(want)
    assert any(s[0] == "semantic" for rs in want.values() for r in rs for s in r["sources"])


def test_similarity_lifts_regex_confidence(spark):
    """A similarity match that repeats a regex pattern lifts what came before it."""
    embed = lambda texts: [[1.0, 0.0] if "md5" in t else [0.0, 1.0] for t in texts]
    r = scan(files_frame(spark, ["hashlib.md5(x) # sha"]), embed=embed).where(
        "finding_type = 'Weak Cryptography'").first()
    by_name = {(s.lane, s.pattern): s.confidence for s in r.source_details}
    assert by_name[("heuristic", "md5_hash")] == pytest.approx(1.0)
    assert ("semantic", "md5_hash") not in by_name


@pytest.mark.parametrize("code, at_least", [
    ('API_KEY = "zq81mmw0c7vd55xk"', 1), ("total = eval(cell)", 1),
    ("os.system(line)", 1), ('exec(step)', 1),
    ('x = 1\nAPI_KEY = "zq81mmw0c7vd55xk"\nfor c in cells:\n    eval(c)\n', 2)])
def test_known_weaknesses(spark, code, at_least):
    assert scan(files_frame(spark, [code])).count() >= at_least


def test_sum_is_a_heuristic_finding_only(spark):
    got = scan(files_frame(spark, ["def add(a, b): return a + b"])).collect()
    assert [(r.finding_type, r.source_details[0].pattern) for r in got] == [
        ("SQL Injection", "sql_order_by")]


def test_scan_has_no_exchange_and_reads_two_columns(spark, tmp_path):
    files_frame(spark, [GOLDEN]).selectExpr("*", "1 AS unused").write.parquet(
        str(tmp_path / "f"))
    df = report.report_order(scan(spark.read.parquet(str(tmp_path / "f")), analyse=True))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "unused" not in plan


def test_copies_of_one_path_stay_apart(spark):
    """Files are rows: equal paths, as in copies of a repository, are separate files."""
    copies = [("setup.py", "eval(x)")] * 300 + [(f"f{i}.py", "eval(x)") for i in range(600)]
    files = spark.createDataFrame(copies, "path string, content string").repartition(8)
    got = scan(files)
    assert got.count() == 900
    assert got.where("size(source_details) <> 2").count() == 0


def test_extra_columns_are_kept(spark):
    files = files_frame(spark, ["eval(x)"]).selectExpr("*", "7 AS repo")
    assert scan(files, keep=("repo",)).first().repo == 7


def test_strict_and_context_filter(spark):
    code = 'password = os.environ.get("password")\nh = hashlib.md5(x)\neval(x)\n'
    files = files_frame(spark, [code])
    plain = {(r.line, r.finding_type): r.explanation for r in
             scan(files, analyse=True).collect()}
    filtered = {(r.line, r.finding_type): r.explanation for r in
                scan(files, analyse=True, context_filter=True).collect()}
    strict = {(r.line, r.finding_type) for r in scan(files, strict=True).collect()}
    assert plain.keys() == filtered.keys() > strict
    assert strict == {(2, "Weak Cryptography")}
    assert {k for k, e in filtered.items() if e} == {(2, "Weak Cryptography")}
    assert {k for k, e in plain.items() if e} == set(plain)


def test_escalations_carry_their_window(spark):
    text = "\n".join(f"line {i}" for i in range(1, 30)) + "\neval(secret password token)\nend"
    got = escalations(scan_lines(files_frame(spark, [text]), window=True)).collect()
    assert {r.line for r in got} == {30}
    assert got[0].window.split("\n")[0] == "21: line 21"
    assert got[0].window.split("\n")[-1] == "31: end"


def test_null_content_is_no_file(spark):
    files = spark.createDataFrame([("a", None), ("b", "eval(x)")], "path string, content string")
    assert [r.file for r in scan(files).collect()] == ["b"]


def test_analysis_of_the_last_escalated_goes_first(spark):
    lines = scan_lines(files_frame(spark, ['API_KEY = "abcdefgh12345678"; pickle.loads(x)']))
    got = merged_findings(lines, analyse=True).orderBy("seq").collect()
    assert [r.finding_type for r in got] == ["Secrets Leak", "Insecure Deserialization"]
    assert got[0].explanation == cat.STANDARD_ANALYSIS["Insecure Deserialization"][0]
    assert got[1].explanation is None
    assert got[0].risk_score > 0 and got[1].risk_score == 0.0
