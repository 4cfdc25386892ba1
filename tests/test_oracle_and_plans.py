"""Every registered query against its DuckDB oracle on sf0.001, and plan
assertions on the physical plans (no Python UDF evaluation, no nested-loop
or cartesian joins, hash aggregation for the candle path, pushed filters)."""

import datetime as dt
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tickspark.plans import catalog
from tools.compare import TABLES, digest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


NAMES = sorted(catalog.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(rows, df.columns) == digest(orows, ocols)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) >= 100 and {r.severity for r in rows} > {"normal"}
    assert "anomaly_type" in df.columns


def test_rows_only_queries_run(spark):
    assert catalog.ROWS_ONLY == set(catalog.queries()) - set(catalog.oracle_sql())
    for name in sorted(catalog.ROWS_ONLY):
        assert entry.queries()[name](spark, SF).count() > 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_python_or_nested_loop(spark, name):
    plan = _plan(entry.queries()[name](spark, SF))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, (name, bad)


def test_candles_combine_before_the_shuffle(spark):
    plan = _plan(entry.queries()["candles_60"](spark, SF))
    below = plan.split("Exchange hashpartitioning")[1]
    assert "partial_min_by" in below and "partial_max_by" in below


def test_candles_break_ties_by_event_id(spark):
    from tickspark.operators import candles, serve
    rows = [(f"e{i:04d}", "S", dt.datetime(2024, 1, 1, 0, k), float(i), 1) for k in range(40) for i in range(50)]
    ticks = spark.createDataFrame(rows, "event_id string, symbol string, time timestamp, price double, volume int").repartition(7)
    assert {(r.open, r.close) for r in candles.candles(ticks, 60).collect()} == {(0.0, 49.0)}
    assert serve.latest_price(ticks).first().price == 49.0


@pytest.mark.parametrize("name", ["recent_alerts", "candlesticks_alerts", "heatmap_long", "deep_dive", "route_alerts", "alert_enrich"])
def test_serving_reads_stored_alerts(spark, name):
    """No detection (tick windows of 20 and 30 rows, volumes) below a serving query."""
    plan = _plan(entry.queries()[name](spark, SF))
    assert "alert-table-" in plan and "stddev" not in plan.replace("stddev_samp", "") and "props" not in plan


def test_pruned_scan(spark):
    df = entry.queries()["latest_price"](spark, SF)
    df.collect()
    plan = _plan(df)
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double>" in plan
