"""Runs registered queries and their SQL side by side:  python -m checks.compare [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from .oracle import oracles
from .queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def compare(spark, con, sf_dir: str, name: str, sql: str | None) -> str:
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    spark_time = time.time() - start
    if sql is None:
        return f"rows only  {sum(rows.values()):>7} rows  {spark_time:6.1f}s"
    start = time.time()
    relation = con.sql(sql)
    if sorted(relation.columns) != columns:
        return f"COLUMNS    {columns} / {sorted(relation.columns)}"
    order = [relation.columns.index(c) for c in columns]
    expected = Counter(tuple(plain(r[i]) for i in order) for r in relation.fetchall())
    sql_time = time.time() - start
    types = dict(zip(relation.columns, relation.types))
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN"}
    odd = {c: (t, str(types[c])) for c, t in df.dtypes if kinds.get(t) != str(types[c])}
    verdict = "equal    " if rows == expected else "DIFFERENT"
    out = (f"{verdict}  {sum(rows.values()):>7} rows  {spark_time:6.1f}s  "
           f"sql {sql_time:6.1f}s  {odd or ''}")
    if rows != expected:
        out += (f"\n   only spark {list((rows - expected).items())[:2]}"
                f"\n   only sql   {list((expected - rows).items())[:2]}"
                f"\n   {sum(expected.values())} expected")
    return out


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    sqls = oracles()
    for name in names or QUERIES:
        try:
            print(f"{name:24} {compare(spark, con, sf_dir, name, sqls.get(name))}", flush=True)
        except Exception as e:
            print(f"{name:24} FAILED {type(e).__name__}: {str(e)[:300]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
