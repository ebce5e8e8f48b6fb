"""Every bound query against its SQL in DuckDB, and the plans it compiles to."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as driver

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, ORACLE = driver.queries(), driver.oracle_sql()
# learned steps take long and are checked by their own test
LEARNED = {"l2g_train", "l2g_predict"}
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return f"{value + 0.0:.9g}"
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in LEARNED])
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in FORBIDDEN if node in plan]
    mine = df.collect()
    if name not in ORACLE:
        assert df.columns
        return
    relation = duck.sql(ORACLE[name])
    assert sorted(relation.columns) == sorted(df.columns)
    assert rows(df.columns, mine) == rows(relation.columns, relation.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["chunk", "n", "first_chrom", "first_pos", "last_chrom", "last_pos"]
    assert df.count() > 0


def test_model_separates(spark):
    from locusforge.operators import l2g

    rows_ = [(i, float(i % 10), float(i % 7), int(i % 10 >= 5)) for i in range(200)]
    df = spark.createDataFrame(rows_, "id long, a double, b double, label int")
    model = l2g.l2g_train(df.drop("label"), df.select("id", "label"), ["id"], ["a", "b"], estimators=3, depth=2)
    scored = l2g.l2g_predict(model, df).collect()
    assert all((r["score"] > 0.5) == bool(r["label"]) for r in scored)
    assert all(0 <= r["score"] <= 1 for r in scored)
    # the order on the feature that separates
    assert min(r["score"] for r in scored if r["a"] >= 5) > max(r["score"] for r in scored if r["a"] < 5)


@pytest.mark.parametrize("name", ["dedup_first", "pick_consequence", "evidence_union"])
def test_rank_filters_reach_the_map_side(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_scan_is_pruned_and_filtered(spark):
    plan = QUERIES["pvalue_filter"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(value,5.0)" in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in plan


def test_listing_reads_no_content(spark):
    from locusforge.sources import listing

    plan = listing.list_objects(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
