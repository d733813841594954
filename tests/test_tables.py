"""Merge operators on tables of findings, against the loops of the model."""

import random
from collections import Counter

import pytest
from conftest import files_frame
from pyspark.sql import functions as F

import model
from flawsieve.operators import embedding_store as store
from flawsieve.operators import findings as tables
from flawsieve.operators import report
from flawsieve.operators.analysis import attach_analyses, route_analysis
from flawsieve.operators.classify import classify_findings, with_alternatives
from flawsieve.operators.linewise import merge_detector
from flawsieve.operators.scoring import score_findings
from flawsieve.operators.similarity import hashed_ngrams
from flawsieve.plans.scan import scan
from flawsieve.sources.staging import staged

SCHEMA = ("file string, line int, lane string, pattern string, finding_type string, "
          "severity string, evidence string, confidence double, needs_escalation boolean, "
          "seq int")


def random_findings(rng, n, lanes=("heuristic",)):
    out = []
    for seq in range(n):
        lane = rng.choice(lanes)
        out.append({
            "line": rng.randrange(1, 4), "lane": lane, "pattern": rng.choice("pqrs"),
            "finding_type": rng.choice(["A", "B"]),
            "severity": rng.choice(["Critical", "High", "Medium", "Low", "Potential"]),
            "evidence": f"e{seq}", "confidence": round(rng.random(), 3),
            "needs_escalation": lane == "rule" and rng.random() < 0.5, "seq": seq})
    return out


def frame(spark, by_file):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame(
        [tuple(dict(f, file=file)[n] for n in names)
         for file, fs in by_file.items() for f in fs], SCHEMA)


def test_dedup(spark):
    rng = random.Random(1)
    by_file = {f"f{i}": random_findings(rng, rng.randrange(1, 40)) for i in range(80)}
    want = Counter((file, f["line"], f["finding_type"], f["pattern"], f["evidence"],
                    f["confidence"], f["seq"])
                   for file, fs in by_file.items() for f in model.dedup(fs))
    got = Counter((r.file, r.line, r.finding_type, r.pattern, r.evidence, r.confidence, r.seq)
                  for r in tables.dedup(frame(spark, by_file)).collect())
    assert got == want


def test_dedup_of_one_hot_key(spark):
    """A third of all rows repeat one key."""
    rng = random.Random(2)
    hot = [{"line": 1, "lane": "heuristic", "pattern": "p", "finding_type": "A",
            "severity": "High", "evidence": f"e{i}", "confidence": (i % 97) / 100,
            "needs_escalation": False, "seq": i} for i in range(20_000)]
    by_file = {"hot": hot} | {f"f{i}": random_findings(rng, 10) for i in range(4000)}
    got = tables.dedup(frame(spark, by_file)).where("file = 'hot'").collect()
    assert [(r.evidence, r.confidence) for r in got] == [("e0", 0.96)]


def test_growing_tables_are_not_broadcast(spark, capsys):
    """However small their files are: Spark takes a table for as large as it is when compressed."""
    rng = random.Random(4)
    rows = staged(frame(spark, {f"f{i}": random_findings(rng, 9) for i in range(20)}))
    scores = rows.select("file", "line", "seq", F.lit(0.5).alias("score"))
    for joined in (tables.attach_scores(tables.merge(tables.dedup(rows)), scores),
                   tables.line_scores_or_default(rows, scores)):
        joined.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_merge(spark):
    rng = random.Random(3)
    by_file = {}
    for i in range(80):
        fs = random_findings(rng, rng.randrange(1, 25), ("rule", "heuristic", "semantic"))
        by_file[f"f{i}"] = ([f for f in fs if f["lane"] == "rule"]
                            + model.dedup([f for f in fs if f["lane"] != "rule"]))
        for seq, f in enumerate(by_file[f"f{i}"]):
            f["seq"] = seq
    got = {}
    for r in tables.merge(frame(spark, by_file)).orderBy("file", "line", "seq").collect():
        got.setdefault((r.file, r.line), []).append(
            (r.finding_type, r.severity, r.evidence, r.needs_escalation,
             [(s.lane, s.pattern, s.confidence) for s in r.source_details]))
    want = {}
    for file, fs in by_file.items():
        rules = [f for f in fs if f["lane"] == "rule"]
        for m in model.merge(rules, [f for f in fs if f["lane"] != "rule"]):
            want.setdefault((file, m["line"]), []).append(
                (m["finding_type"], m["severity"], m["evidence"], m["needs_escalation"],
                 m["sources"]))
    assert got == want


def test_scores_and_analyses_go_to_the_first_finding(spark):
    merged = spark.createDataFrame(
        [("f", 1, 0, "A"), ("f", 1, 1, "B"), ("f", 2, 0, "A")],
        "file string, line int, seq int, finding_type string")
    scores = spark.createDataFrame(
        [("f", 1, 0, 0.9), ("f", 1, 5, 0.6), ("g", 1, 0, 0.7)],
        "file string, line int, seq int, score double")
    got = {(r.line, r.seq): r.risk_score
           for r in tables.attach_scores(merged, scores).collect()}
    assert got == {(1, 0): 0.6, (1, 1): 0.0, (2, 0): 0.0}
    found = {(r.line, r.seq): r.line_score
             for r in tables.line_scores_or_default(merged, scores).collect()}
    assert found == {(1, 0): 0.6, (1, 1): 0.6, (2, 0): 0.5}
    analyses = spark.createDataFrame(
        [("f", 1, 0, "x", "y"), ("f", 1, 1, "z", None)],
        "file string, line int, seq int, explanation string, fix_suggestion string")
    told = {(r.line, r.seq): (r.explanation, r.fix_suggestion)
            for r in attach_analyses(merged, analyses).collect()}
    assert told == {(1, 0): ("z", None), (1, 1): (None, None), (2, 0): (None, None)}


def test_detector_merge(spark):
    rows = spark.createDataFrame(
        [("f", 1, "A", "High", 0.6, 0), ("f", 1, "A", "Low", 0.9, 1), ("f", 2, "A", "Low", 0.1, 2)],
        "file string, line int, finding_type string, severity string, confidence double, seq int")
    got = {(r.line, r.severity, r.confidence) for r in merge_detector(rows).collect()}
    assert got == {(1, "High", 0.9), (2, "Low", 0.1)}


@pytest.mark.parametrize("fallback", [False, True])
def test_score_rows(spark, fallback):
    cases = [("Secrets Leak", "Critical", "password=xxx", 1, "code"),
             ("Injection", "High", "x" * 150, 2, "nothing"), (None, None, None, None, None),
             ("XSS", "Low", "api_key token", 3, "eval(x) os.system(y)"),
             ("CRLF Injection", "Medium", "a", 4, "hash")]
    rows = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(cases)],
        "id int, finding_type string, severity string, evidence string, line int, "
        "content string")
    got = {r.id: r for r in score_findings(rows, fallback_model=fallback).collect()}
    for i, (t, severity, evidence, line, content) in enumerate(cases):
        want = model.score(t or "Unknown", evidence or "", content or "")
        assert got[i].score == want
        confidence = min(abs(want - 0.5) * 2, 1.0)
        assert got[i].confidence == (confidence * 0.8 if fallback else confidence)
        assert got[i].line == (line or 0) and got[i].evidence == (evidence or "")[:100]
    assert got[0].score == 0.8 and got[0].severity == "Critical"


def test_sum_keeps_the_order_of_its_terms(spark):
    """0.5 + 0.1 + 0.1 + 0.1 stays below 0.8, as it does when added one by one."""
    rows = spark.createDataFrame([("T", "High", "system shell command", 1, "")],
                                 "finding_type string, severity string, evidence string, "
                                 "line int, content string")
    r = score_findings(rows).first()
    assert r.score == 0.5 + 0.1 + 0.1 + 0.1 < 0.8
    assert r.severity == "High"


def test_classification(spark):
    rows = spark.createDataFrame([("Injection", "Low", 0.4), ("Log Injection", "Low", None)],
                                 "finding_type string, severity string, confidence double")
    got = {r.finding_type: r for r in classify_findings(rows).collect()}
    assert got["Injection"].severity == "CRITICAL" and got["Injection"].confidence == 0.4
    assert len(got["Injection"].classification.examples) == 3
    assert got["Log Injection"].severity == "POTENTIAL"
    assert got["Log Injection"].confidence == 0.8
    assert got["Log Injection"].classification.examples == []
    found = {r.finding_type: r.safe_alternatives for r in with_alternatives(rows).collect()}
    assert found["Log Injection"] == [] and found["Injection"] == []


def test_routing(spark):
    found = spark.createDataFrame([("f", 1, "Injection"), ("g", 1, "IDOR"), ("h", 1, "XSS")],
                                  "file string, line int, finding_type string")
    answers = spark.createDataFrame(
        [("f", "bad\nthe FIX is\nthis"), ("h", "only words")], "file string, answer string")
    got = {r.file: r for r in route_analysis(found, answers, ["file"]).collect()}
    assert (got["f"].explanation, got["f"].fix_suggestion, got["f"].confidence) == (
        "bad", "the FIX is\nthis", 0.7)
    assert (got["h"].explanation, got["h"].fix_suggestion) == ("only words", None)
    assert got["g"].confidence == 0.4 and got["g"].fix_suggestion


def test_ranked_report(spark):
    """One order over all ranges, numbered without gaps."""
    texts = [(f"f{i % 23}.py", "eval(x)\nDEBUG = True\nos.system(c)\nmd5(x) eval(y)" * (i % 3))
             for i in range(23)]
    findings = scan(files_frame(spark, texts))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        ranked = report.ranked_report(findings).orderBy("rank").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = [tuple(r) for r in findings.orderBy(*report.order_columns()).drop("source_details")
            .collect()]
    assert [r["rank"] for r in ranked] == list(range(1, len(want) + 1)) and len(want) > 50
    columns = [c for c in findings.columns if c != "source_details"]
    assert [tuple(r[c] for c in columns) for r in ranked] == want
    assert report.ranked_report(findings.limit(0)).count() == 0


def test_embedding_store(spark, tmp_path):
    """A line is embedded once; findings are those of a scan that embeds all lines."""
    path, embed = str(tmp_path / "vectors"), hashed_ngrams()
    # A store holds what was embedded when it was filled.
    some = files_frame(spark, ["literal api key assigned in the code = 1\n  x = 1 + 22222\n# no"])
    more = files_frame(spark, [
        "literal api key assigned in the code = 1\nother line here\nother line here\neval(x)",
        "other line here\nliteral password assigned in the code = 2", "", "a"])
    store.add_vectors(store.eligible_texts(some), path, embed, "first")
    known = store.stored_vectors(spark, path).count()
    assert known == 2 and store.missing_texts(store.eligible_texts(some), path).count() == 0
    missing = [r.text for r in store.missing_texts(store.eligible_texts(more), path).collect()]
    assert len(missing) == len(set(missing)) and "other line here" in missing \
        and "literal api key assigned in the code = 1" not in missing
    for _ in range(2):  # the second time nothing is missing
        store.add_vectors(store.eligible_texts(more), path, embed, "second")
    assert store.stored_vectors(spark, path).count() == known + len(missing)

    found = sorted(str(r) for r in scan(more, embed=embed, store=path).collect())
    assert found == sorted(str(r) for r in scan(more, embed=embed).collect())
    assert any("semantic" in r for r in found)
    assert store.stored_vectors(spark, str(tmp_path / "none")).count() == 0


def test_terms_of_a_finding_are_looked_up_once(spark):
    """The look-up does not stand inside the loop over the weights."""
    rows = spark.range(3).selectExpr(
        "'Injection' || id AS finding_type", "'eval(x)' || id AS evidence", "'Low' AS severity",
        "1 AS line", "'shell' || id AS content")
    plan = score_findings(rows)._jdf.queryExecution().optimizedPlan().toString()
    tests = plan.split("array_contains(")[1:]
    assert tests and all(t.startswith("lambda ") for t in tests)
