import json

from helpers import day
from pyspark.sql import functions as F

from tidemark.operators import quality as Q
from tidemark.schemas import LIVE_DOCUMENT
from tidemark.sources import documents as D
from tidemark.sources import sinks, tables


def plan(spark):
    return spark.createDataFrame(
        [("New Year", day("2015-01-02"), 123, 2.538, 1.884, 100, "Maximize GMV", "Increase Stock Levels", "green"),
         ("Halloween", None, 0, 2.0, 1.0, 105, "Maximize GMV", "Run Discount Ads", "yellow")],
        "campaign string, peak_date date, projected_volume bigint, planned_lift double, observed_lift double,"
        " baseline_units bigint, strategy string, action_item string, status_color string")


def heroes(spark):
    return spark.createDataFrame(
        [("New Year", 2, "S-2", 'Desk "L"', "Tech", 0.5, 10, 0.0, 1.0, None, None, 0.25, "Trending", 0.7),
         ("New Year", 1, "S-1", "Lamp", None, 0.9, 365, 0.01, 0.4, 12.5, 7, 0.5, "Stockout Risk", 0.8)],
        "campaign string, rank int, sku string, name string, category string, trend double, age_days int,"
        " velocity double, pressure double, stockout_days double, lead_time_days int, margin double,"
        " signal string, priority_score double")


def test_dashboard_round_trip(spark, rows, tmp_path):
    path = str(tmp_path / "dash")
    document = D.dashboard_document(plan(spark), heroes(spark))
    D.write_dashboard(document, path)
    text = document.first()[0]
    entry = json.loads(text)["Campaigns"]["New Year"]
    assert list(entry) == ["peak_date", "projected_volume", "campaign_lift_multiplier", "observed_lift_multiplier",
                           "avg_units_per_product_baseline", "hero_products", "strategy", "action_item", "status_color"]
    assert (entry["campaign_lift_multiplier"], entry["observed_lift_multiplier"]) == (2.54, 1.88)
    assert [h["sku"] for h in entry["hero_products"]] == ["S-1", "S-2"]
    assert entry["hero_products"][1]["metrics"]["stockout_days"] is None
    other = json.loads(text)["Campaigns"]["Halloween"]
    assert other["peak_date"] == "N/A" and other["hero_products"] == []
    back = rows(D.read_dashboard(spark, path), "rank")
    assert [(r["rank"], r["sku"], r["name"], r["inventory_age_days"], r["lead_time_days"]) for r in back] == [
        (1, "S-1", "Lamp", 365, 7), (2, "S-2", 'Desk "L"', 10, None)]
    assert D.read_dashboard_entries(spark, path).count() == 2


def test_indented_dashboard_with_bad_skus(spark, rows, tmp_path):
    hero = {"sku": "a", "name": "n", "category": "c", "metrics": {"search_volume_trend": 1.0}, "ai_signal": "Trending", "priority_score": 0.5}
    doc = {"Campaigns": {"X": {"hero_products": [{**hero, "sku": s} for s in (None, "", "  ", "ok")]}, "Y": {"hero_products": []}}}
    path = tmp_path / "dash.json"
    path.write_text(json.dumps(doc, indent=2))
    flat = D.read_dashboard(spark, str(path))
    assert Q.empty_sku_check(flat).first().asDict() == {"ok": False, "empty_count": 3}
    assert [r["rank"] for r in rows(Q.empty_sku_sample(flat))] == [1, 2, 3]
    assert Q.empty_sku_check(flat.where("rank = 4")).first().ok


def test_live_document(spark, rows, tmp_path):
    path = tmp_path / "live.json"
    path.write_text(json.dumps({
        "onlineUsers": 5, "gmv": {"current": 1, "target": 2, "projectionPct": 50},
        "criticalInterventions": [{"sku": "a", "reason": "r", "etaOosMins": 3}, {"sku": "", "reason": "r", "etaOosMins": 3}],
        "oosWatchlist": [{"sku": "a", "name": "n", "oosMins": 12, "diagnosis": "d", "action": "Monitor"}],
        "liveSalesHistory": [{"name": "n", "etaMins": 12, "time": "2026-03-26T17:50:00Z"}],
    }, indent=1))
    doc = D.read_live_document(spark, str(path))
    assert doc.schema == LIVE_DOCUMENT
    assert rows(D.live_watchlist_rows(doc))[0]["oosMins"] == 12
    assert rows(D.live_sales_rows(doc))[0]["time"].hour == 17
    out = str(tmp_path / "critical")
    sinks.export_critical_skus(D.live_critical_rows(doc), out)
    assert [r[0] for r in spark.read.text(out).collect()] == ["a"]


def test_sku_mix_cells_are_quoted(spark, tmp_path):
    out = str(tmp_path / "mix")
    mix = sinks.sku_mix(plan(spark), heroes(spark).withColumn("category", F.when(F.col("rank") == 2, 'a "b"')))
    sinks.export_sku_mix(mix.coalesce(1), out)
    lines = sorted(r[0] for r in spark.read.text(out).collect())
    assert '"New Year","2015-01-02","123","a ""b""","Maximize GMV","Increase Stock Levels","2","S-2"' in lines
    assert '"New Year","2015-01-02","123","Unknown","Maximize GMV","Increase Stock Levels","1","S-1"' in lines
    assert lines[0] == '"Campaign","Peak Date","Projected Volume (USD)","Category","Strategy","Action Item","Rank","SKU"'


def test_accuracy_report(spark, tmp_path):
    metrics = "n_weeks bigint, mae double, rmse double, mape double, coverage double"
    overall = spark.createDataFrame([(52, 1.234, 2.345, 15.454, 76.92)], metrics)
    per = spark.createDataFrame([("Halloween", 3, 1.0, 2.0, 3.0, 66.66)], "campaign string, " + metrics)
    report = sinks.accuracy_report(overall, per, ("2011-01-01", "2013-12-31"), ("2014-01-01", "2014-12-31"))
    out = str(tmp_path / "acc")
    sinks.write_accuracy_report(report, out)
    doc = json.loads(spark.read.text(out).first()[0])
    assert doc["train_window"] == {"start": "2011-01-01", "end": "2013-12-31"}
    assert doc["overall"]["MAE ($)"] == 1.23 and doc["overall"]["Test weeks"] == 52
    assert doc["per_campaign"]["Halloween"]["Coverage"] == 66.7


def test_relational_defaults_and_round_trip(spark, rows, tmp_path):
    inv = spark.createDataFrame([("a", 1.0, 5, None, None), ("b", 1.0, 5, 2, 3)],
                                "sku string, cost_price double, qty_on_hand int, qty_reserved int, lead_time_days int")
    tables.write_table(inv, "inventory", str(tmp_path))
    got = rows(tables.read_table(spark, "inventory", str(tmp_path)), "sku")
    assert [(r["qty_reserved"], r["lead_time_days"], r["msrp"]) for r in got] == [(0, 14, None), (2, 3, None)]
    camp = tables.conform(spark.createDataFrame([("x", None)], "name string, status string"), "campaigns")
    assert camp.first().status == "active"


def test_bucketed_sku_days_need_no_shuffle(spark):
    from tidemark.operators.demand import sku_demand
    days = spark.range(100).select(
        (F.col("id") % 7).cast("string").alias("sku"), F.lit("c").alias("category"),
        F.date_add(F.lit("2014-01-01").cast("date"), F.col("id").cast("int")).alias("order_date"),
        F.lit(1.0).alias("sales"), F.lit(1).cast("bigint").alias("n_lines"))
    tables.save_sku_day(days, "sku_day_test", 4)
    try:
        demand = sku_demand(spark.table("sku_day_test"))
        assert "Exchange" not in demand._jdf.queryExecution().executedPlan().toString()
        assert demand.count() == 7
    finally:
        spark.sql("DROP TABLE sku_day_test")
