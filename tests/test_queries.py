"""The registered queries, and some of them against DuckDB on the smallest tables.

``python -m checks.compare`` compares all of them.
"""

import os

import pytest

import __spark_entry__ as contract
from checks.compare import TABLES, compare
from checks.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
COMPARED = ["heuristic_scan", "heuristic_dedup", "table_merge", "scan_report",
            "filtered_report", "report_summary", "json_report", "context_validate",
            "keyword_lines", "cosine_best", "cosine_blocks", "mean_pool", "prompt_window_join",
            "prompt_export", "response_parse", "analysed_report", "request_batch", "fallback_rule_scan",
            "cosine_nearest", "directory_scan", "ordered_report", "training_roundtrip",
            "semantic_report", "embedding_store", "detector_scan", "incremental_findings"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def test_every_query_has_its_sql():
    assert set(QUERIES) <= set(contract.oracle_sql())
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@needs_data
def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[:4] == ["file", "line", "seq", "finding_type"] and df.count() > 0


@needs_data
@pytest.mark.parametrize("name", COMPARED)
def test_equals_sql(spark, duck, name):
    verdict = compare(spark, duck, SF_DIR, name, contract.oracle_sql()[name])
    assert verdict.startswith("equal"), verdict
