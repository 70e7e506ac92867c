"""Every query with SQL against DuckDB, the size of generated methods, and the driver contract."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tickloom.plans import file_queries, problem_queries, reference_queries

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


ORACLE = problem_queries.ORACLE | reference_queries.ORACLE | file_queries.ORACLE
QUERIES = problem_queries.QUERIES | reference_queries.QUERIES | file_queries.QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, tables, name):
    made = QUERIES[name](spark, FOLDER)
    columns = sorted(made.columns)
    sql = ORACLE[name]
    assert sorted(tables.sql(sql).columns) == columns
    wanted = sorted(map(str, tables.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()))
    assert sorted(str(tuple(r[c] for c in columns)) for r in made.collect()) == wanted


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p4_found", "malformed_rows"])
def test_generated_methods_compile(spark, name):
    """No stage falls back from whole-stage code for a method above 64 KB."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    stages = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert sizes and all(0 < n < 65_535 for n in sizes)


def test_whole_tables_round_trip_and_planted_spikes(spark):
    """What SQL can't express: each finding of problem 2 by the definition of its kind, over the whole table."""
    found = {}
    for r in QUERIES["p2_reasons"](spark, FOLDER).collect():
        found.setdefault(r["reason"], set()).add(r["row_id"])
    con = duckdb.connect()
    bounds = con.sql(f"SELECT row_id FROM '{FOLDER}/all_categories.parquet' WHERE high <= 0 OR low <= 0 OR close <= 0 OR high < low OR close < low OR close > high").fetchall()
    assert found["impossible"] == {r[0] for r in bounds}
    assert 20 < len(found["spike"]) < 400 and 100 < len(found["stuck"]) < 2_000


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert {r["category"] for r in entry.entry(spark).collect()} == {"MissingCandle", "DuplicateRecord", "InvalidOhlc", "ClosedMarketRecord", "TimeGap", "MalformedRow"}
