import duckdb
import pytest

import __spark_entry__ as entry
from sigspark.plans import driver_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (a, b))
    assert a.equals(b)


@pytest.mark.parametrize("name", sorted(driver_queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    got = driver_queries.QUERIES[name](spark, sf_dir)
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()
    with duckdb.connect() as db:
        for t in TABLES:
            db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        _same(got.toPandas(), db.sql(driver_queries.ORACLES[name]).df())


def test_whole_queries_take_every_row_and_miss_some_sites(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    codes = driver_queries.QUERIES["group_codes_whole"](spark, sf_dir).select("position", "run").collect()
    assert {tuple(r) for r in codes} == {tuple(r) for r in lines.selectExpr("l_partkey", "l_returnflag || '-' || l_linestatus").distinct().collect()}
    assert 0 < driver_queries.QUERIES["site_intersection_whole"](spark, sf_dir).count() < lines.select("l_partkey").distinct().count()


def test_refits_combine_events_once(spark, sf_dir):
    plan = driver_queries.QUERIES["refitted_table"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "norm_mean" in plan


def test_gated_counts_read_the_table_once(spark, sf_dir):
    plan = driver_queries.QUERIES["count_gates"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") == 1


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
