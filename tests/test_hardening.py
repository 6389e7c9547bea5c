"""Wide sums, rows that are no numbers, streams that go on, deliveries of several shapes."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F
from tidemark.functions.exact import exact_mean, exact_sum
from tidemark.operators import demand, forecast, inventory, planner
from tidemark.sources import sales, sinks, star
from tidemark.streaming import live, runner


@pytest.mark.parametrize(("values", "total"), [
    ([1e15], 1e15), ([3e14] * 4, 1.2e15), ([0.1] * 10, 1.0), ([float("nan"), 2.5, float("inf"), None], 2.5),
    ([-1.25, 0.25], -1.0), ([9e17, 9e17, 9e17], 2.7e18), ([-9e17, 0.25, 9e17], 0.25), ([1e36, -1e36, 0.5], 0.5),
    ([104857.6, -104857.6001] * 3, -0.0003), ([2.0**59 + 256, 1e-4], 2.0**59 + 256),
])
def test_sums_are_exact_and_wide(spark, values, total):
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert frame.agg(exact_sum("v")).first()[0] == total
    counted = [v for v in values if v is not None and abs(v) < 1e18]
    assert frame.agg(exact_mean("v")).first()[0] == pytest.approx(total / len(counted))


def test_forecast_does_not_depend_on_row_order(spark):
    """Daily amounts as large as at a thousand times the tests' size."""
    rng = random.Random(5)
    rows = [(dt.date(2015, 1, 1) + dt.timedelta(days=i), round(4e9 * rng.random(), 2)) for i in range(2400)]
    results = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        frame = spark.createDataFrame(rows, "ds date, y double").repartition(seed + 2)
        results.append(sorted(map(tuple, forecast.seasonal_trend_forecast(frame).collect())))
    assert results[0] == results[1]


def test_amounts_that_are_not_finite_are_no_sales(spark):
    raw = spark.createDataFrame(
        [("2024-01-01", "a", "Infinity"), ("2024-01-01", "b", "NaN"), ("2024-01-01", "c", "5"), ("2024-01-01", "d", "-Infinity")],
        "date string, sku string, sales string")
    assert [r["sku"] for r in sales.clean_sales(raw).collect()] == ["c"]


def test_malformed_event_has_no_sku(spark):
    rows = spark.createDataFrame([('{"k":"abc"}',), ('{"k":"7"}',), ("no json",), (None,)], "props string").selectExpr(
        "1L AS event_id", "timestamp'2024-01-01' AS ts", "1L AS user_id", "'purchase' AS event_type", "1.0D AS value", "props")
    assert sorted(str(r["sku"]) for r in star._event_columns(rows).collect()) == ["7", "None", "None", "None"]


def events(spark, folder, name, first, number):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=i), i % 5, "purchase", 1.0, '{"k":"1"}') for i in range(first, first + number)]
    from tidemark.schemas import EVENTS
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    frame.select(*[F.col(f.name).cast(f.dataType) for f in EVENTS.fields]).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def source(spark, folder):
    from tidemark.schemas import EVENTS
    return star._event_columns(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*"))


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    events(spark, tmp_path / "in", "events-0", 0, 300)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = str(tmp_path / "out")
    first = runner.run_to_table(live.gmv_by_hour(source(spark, tmp_path / "in")), "x", out).count()
    events(spark, tmp_path / "in", "events-1", 300, 300)
    rows = runner.run_to_table(live.gmv_by_hour(source(spark, tmp_path / "in")), "x", out).collect()
    assert 0 < first < len(rows)
    assert len({r["hour_start"] for r in rows}) == len(rows)
    assert all(r["gmv"] == 60.0 for r in rows)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_ticker_goes_on_and_stores_little(spark, tmp_path):
    out = str(tmp_path / "out")
    for i in range(4):
        events(spark, tmp_path / "in", f"events-{i}", 50 * i, 50)
        found = runner.run_ticker(source(spark, tmp_path / "in"), n=5, folder=out)
        assert sorted(r["event_id"] for r in found.collect()) == list(range(50 * i + 45, 50 * i + 50))
    assert len(list((tmp_path / "out" / "rows").iterdir())) == 2


def test_ticker_without_events(spark, tmp_path):
    events(spark, tmp_path / "in", "events-0", 0, 1)
    assert runner.run_ticker(source(spark, tmp_path / "in").where("false"), n=5).count() == 0


def test_deliveries_with_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Order Date,SKU,Sales\n2024-01-01,x,10\n")
    (tmp_path / "b.csv").write_text("sales,sku,order-date,sub.category\n20,y,2024-01-02,toys\n")
    raw = sales.read_sales(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    rows = {r["sku"]: r for r in sales.clean_sales(raw).collect()}
    assert (rows["x"]["sales"], rows["y"]["sales"]) == (10.0, 20.0)
    assert rows["y"]["order_date"] == dt.date(2024, 1, 2)
    assert (rows["x"]["category"], rows["y"]["category"]) == ("General", "toys")


def test_line_breaks_in_quoted_cells(spark, tmp_path):
    stock = spark.createDataFrame([("a", 'line1\nline2 "q"')], "sku string, name string")
    stock = stock.selectExpr("*", *[f"cast(null as {f.dataType.simpleString()}) AS {f.name}" for f in sales.INVENTORY.fields
                                    if f.name not in ("sku", "name")])
    sinks.write_inventory_csv(stock, str(tmp_path / "out"))
    back = sales.read_inventory(spark, str(tmp_path / "out"), multi_line=True).collect()
    assert [(r["sku"], r["name"]) for r in back] == [("a", 'line1\nline2 "q"')]


def test_returns_are_in_the_rollup(spark, tmp_path):
    for name, frame in {
        "lineitem": spark.createDataFrame([(1, 10.0), (1, -4.0), (2, 0.0)], "l_partkey long, l_extendedprice double"),
        "part": spark.createDataFrame([(1, "one", "t"), (2, "two", "t")], "p_partkey long, p_name string, p_type string"),
    }.items():
        from tidemark.schemas import STAR
        frame.selectExpr(*[f.name if f.name in frame.columns else f"cast(null as {f.dataType.simpleString()}) AS {f.name}"
                           for f in STAR[name].fields]).select(
            *[F.col(f.name).cast(f.dataType) for f in STAR[name].fields]).write.parquet(f"{tmp_path}/{name}.parquet")
    assert {r["sku"]: r["total_sales"] for r in star.sku_totals(spark, str(tmp_path)).collect()} == {"1": 6.0, "2": 0.0}


def test_long_keys_make_stock(spark):
    rollup = spark.createDataFrame([("99999999999999", 5.0, "n", "c"), ("7", 4.0, "n", "c")],
                                   "sku string, total_sales double, name string, category string")
    rows = inventory.synth_inventory(rollup, dt.date(2024, 1, 1)).collect()
    assert len(rows) == 2 and all(r["msrp"] >= 40 for r in rows)


def test_one_row_of_a_sku_whatever_the_order(spark):
    rows = [("a", 5, "w", 1.0, 2.0, None, 99), ("a", 5, "w", 1.0, 2.0, None, 10)]
    kind = "sku string, qty_on_hand int, warehouse string, cost_price double, msrp double, last_restock_date date, reorder_point int"
    found = {inventory.one_row_per_sku(spark.createDataFrame(r, kind).coalesce(1)).first()["reorder_point"] for r in (rows, rows[::-1])}
    assert found == {10}


def test_keyword_filter_without_a_valid_pattern(spark):
    frame = spark.createDataFrame([("a1", "toys"), ("b2", "food")], "sku string, category string")
    assert demand.keyword_filter(frame, ["*"]).count() == 2
    assert demand.keyword_filter(frame, ["TOY", "zz"]).count() == 1
    assert demand.keyword_filter(frame, ["(", "toy"]).count() == 2


def test_empty_category_keeps_all(spark):
    heroes = spark.createDataFrame([("c", "s", None), ("c", "t", "x")], "campaign string, sku string, category string")
    assert planner.category_mix(heroes, "").count() == 2
    assert planner.category_mix(heroes, "X").count() == 1


def test_first_planned_campaign(spark):
    known = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "campaign string, position int")
    planned = spark.createDataFrame([("C",), ("B",), (None,)], "campaign string")
    assert planner.pick_campaign(known, "zzz", planned).first()["campaign"] == "B"
    assert planner.pick_campaign(known, "C", planned).first()["campaign"] == "C"
    assert planner.pick_campaign(known, None).first()["campaign"] == "A"
    assert planner.pick_campaign(known, "zzz", planned).columns == ["campaign", "position"]


def test_the_per_task_cut_holds_for_large_numbers(spark):
    """More than 1,000 ranks a campaign are still cut before the shuffle."""
    rows = [(f"c{i % 2}", f"s{i}", float(i)) for i in range(50)]
    totals = spark.createDataFrame(rows, "campaign string, sku string, total double")
    ranked = totals.withColumn("r", F.expr("row_number() over (partition by campaign order by total desc)")).where("r <= 5000")
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString()
