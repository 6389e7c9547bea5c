"""Every registered query against its SQL twin, on plain and on heavily skewed tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import compare
from tidemark.plans.oracles import ORACLES
from tidemark.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")

SKEWED = [
    "daily_gmv", "campaign_lift", "sku_rollup", "sku_demand", "sku_metrics", "month_topk",
    "hero_products", "candidate_fallback", "modal_category", "first_country", "scenario_grid",
    "duplicate_keys", "orphan_check", "orphans_removed", "planned_delete", "live_gmv_hourly",
    "live_oos_eta", "live_sessions", "sessions_batch", "live_dedup", "dedup_batch", "users_exact",
    "callout_clean", "clean_sales",
]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() == 40 and df.columns[0] == "campaign"


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) - set(ORACLES) == {
        "forecast_additive", "forecast_by_category", "forecast_weekly", "forecast_accuracy_additive", "live_users",
        "forecast_sparse", "forecast_accuracy_sparse",
    }


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_twin(spark, name):
    assert compare.run(spark, FOLDER, [name]) == {}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """One part, one order, one user and one event id own a third or more of all rows."""
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    changes = {
        "lineitem": "* REPLACE (CASE WHEN rowid0 % 3 = 0 THEN 7 ELSE l_partkey END AS l_partkey,"
                    " CASE WHEN rowid0 % 3 = 1 THEN 11 ELSE l_orderkey END AS l_orderkey)",
        "events": "* REPLACE (CASE WHEN rowid0 % 3 < 2 THEN 1 ELSE user_id END AS user_id,"
                  " CASE WHEN rowid0 % 3 = 0 THEN '{\"k\": 7}' ELSE props END AS props)",
        "orders": "* REPLACE (CASE WHEN rowid0 % 2 = 0 THEN 3 ELSE o_custkey END AS o_custkey)",
    }
    for name in compare.TABLES:
        source = f"(SELECT *, ROW_NUMBER() OVER () - 1 AS rowid0 FROM '{FOLDER}/{name}.parquet')"
        columns = changes.get(name, "*").replace("* ", "* EXCLUDE (rowid0) ", 1) if name in changes else "* EXCLUDE (rowid0)"
        con.execute(f"COPY (SELECT {columns} FROM {source}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", SKEWED)
def test_skewed_tables(spark, skewed, name):
    """No broadcast joins, and every partition over 20 KB counts as skewed."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        assert compare.run(spark, skewed, [name]) == {}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
