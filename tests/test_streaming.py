"""A stream of files gives the findings of the batch."""

import pytest
from conftest import files_frame
from test_scan import GOLDEN

from flawsieve.plans.scan import scan
from flawsieve.streaming.incremental import (current_findings, incremental_scan,
                                             scanned_versions, withdrawn)
from flawsieve.streaming.scan_stream import checkpoint_location, running_counts, scan_stream


def test_stream_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = files_frame(spark, [("a.py", GOLDEN), ("b.py", "x = 1")])
    second = files_frame(spark, [("c.py", "eval(x)\n" + GOLDEN)])
    first.write.parquet(source)
    stream = lambda: spark.readStream.schema(first.schema).parquet(source)

    def run():
        query = scan_stream(stream(), out, checkpoint=str(tmp_path / "cp"), available_now=True)
        query.awaitTermination(120)
        return spark.read.parquet(out)

    assert run().count() == scan(first).count()
    second.write.mode("append").parquet(source)
    got, want = run(), scan(first.unionByName(second))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_incremental_scan(spark, tmp_path):
    """Only new and changed versions are scanned; findings are those of the last ones."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [
        [("a.py", "eval(x)", 1), ("b.py", GOLDEN, 1), ("c.py", "x = 1", 1), ("d.py", "exec(a)", 1),
         (None, "eval(x)", 1), ("e.py", "eval(old)", 1), ("e.py", "eval(x)\nexec(y)", 2)],
        [("a.py", "exec(y)", 2), ("b.py", GOLDEN, 2), ("c.py", "eval(z)", None), ("d.py", None, 2),
         ("f.py", "", 1)],
        [("a.py", "eval(x)", 3), ("e.py", "eval(older)", 1), ("d.py", None, 3),
         ("c.py", "x = 1", 2)]]
    schema = "path string, content string, version long"
    scanned, seen = [], set()
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        query = incremental_scan(spark.readStream.schema(schema).parquet(source), out,
                                 name=f"test_{len(scanned)}", checkpoint=str(tmp_path / "state"),
                                 available_now=True)
        query.awaitTermination(200)
        assert query.exception() is None
        now = {(r.path, r.version) for r in scanned_versions(spark, out).collect()}
        scanned.append(now - seen)
        seen = now
    assert scanned == [
        {("a.py", 1), ("b.py", 1), ("c.py", 1), ("d.py", 1), ("e.py", 2)},
        {("a.py", 2), ("d.py", 2), ("f.py", 1)}, {("a.py", 3)}]
    last = files_frame(spark, [("a.py", "eval(x)"), ("b.py", GOLDEN), ("c.py", "x = 1"),
                               ("e.py", "eval(x)\nexec(y)"), ("f.py", "")])
    got, want = current_findings(spark, out), scan(last)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert {(r.file, r.findings) for r in withdrawn(spark, out).collect()} == {
        ("a.py", 1), ("d.py", 1)}


def test_running_counts(spark, tmp_path):
    files = files_frame(spark, [("a.py", GOLDEN)])
    files.write.parquet(str(tmp_path / "in"))
    counts = running_counts(scan(spark.readStream.schema(files.schema).parquet(
        str(tmp_path / "in"))))
    query = (counts.writeStream.format("memory").queryName("counts").outputMode("complete")
             .option("checkpointLocation", str(tmp_path / "cp")).start())
    query.processAllAvailable()
    query.stop()
    got = {r.severity: r.findings for r in spark.table("counts").collect()}
    assert got == {"Critical": 5, "High": 4, "Medium": 1, "Low": 1}


def test_checkpoint_location(spark):
    assert checkpoint_location(spark, "x", "/shared/y") == "/shared/y"
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError):
            checkpoint_location(spark, "x")
