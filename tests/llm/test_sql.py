"""Queries with SQL against DuckDB, and held-out quality of the classifier, on the small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, tables, name):
    found = tables.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    want = sorted(map(repr, (tuple(r) for r in found.fetchall())))
    assert sorted(map(repr, map(tuple, QUERIES[name](spark, SF).select(*columns).collect()))) == want


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    judged = QUERIES["op10_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    right, n, base = judged.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count("*"), F.avg("quality")).first()
    assert n > 50 and right > max(base, 1 - base) + 0.05
