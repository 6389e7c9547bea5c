import pytest
from helpers import day
from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.operators import planner as P
from tidemark.operators import ranking as R


def units(spark, base, lift, velocity):
    df = spark.createDataFrame([(base, lift, velocity)], "baseline_units bigint, planned_lift double, velocity double")
    return tuple(df.select(P.planner_units(), P.dashboard_units()).first())


@pytest.mark.parametrize("args,expect", [
    ((100, 2.0, 0.0), (264, 200)),      # zero velocity takes the default
    ((100, 2.0, None), (264, 200)),
    ((100, 2.0, 1.0), (288, 240)),
    ((None, None, 1.0), (403, 120)),
    ((0, 0.0, 1.0), (403, 120)),
])
def test_units(spark, args, expect):
    assert units(spark, *args) == expect


def test_halves_round_up(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (0.49999,)], "x double")
    assert [r[0] for r in df.select(X.round_half_up("x")).collect()] == [3, -2, 0]


def scenario(spark, forecast, stock, discounts=None):
    products = spark.createDataFrame([("a", forecast)], "sku string, forecast bigint")
    inv = spark.createDataFrame(stock, "sku string, qty_on_hand int, msrp double")
    got = {r.discount_pct: r for r in P.discount_scenarios(products, inv).collect()}
    assert sorted(got) == list(range(31))
    return got


def test_scenario_grid(spark):
    got = scenario(spark, 300, [("a", 20, 10.0)])
    assert (got[0].stockout_days, got[0].risk, got[0].revenue) == (2.0, "High", 3000.0)
    assert got[30].demand_units == pytest.approx(345) and got[30].risk == "High"
    assert got[0].recommendation.startswith("Reduce")
    for d in range(30):
        assert got[d + 1].revenue > got[d].revenue and got[d + 1].stockout_days < got[d].stockout_days


def test_scenario_thresholds_and_gaps(spark):
    assert scenario(spark, 300, [("a", 70, 1.0)])[0].risk == "Medium"
    assert scenario(spark, 300, [("a", 71, 1.0)])[0].risk == "Low"
    bare = scenario(spark, 300, [])[5]
    assert (bare.stockout_days, bare.revenue, bare.risk) == (0.0, 0.0, "High")
    idle = scenario(spark, 0, [("a", 5, 1.0)])[5]
    assert (idle.stockout_days, idle.risk) == (None, "Low") and idle.recommendation.startswith("Stock levels")
    assert scenario(spark, None, [("a", 5, 1.0)])[5].risk == "Low"


RISK = [
    # stockout_days, lead, pressure, on_hand, reorder -> zero_fill, strict
    ((None, None, 0.9, 500, 10), True, False),
    ((20.0, 21, 0.9, 500, 10), True, True),
    ((13.9, 1, 0.9, 500, 10), True, True),
    ((14.0, 1, 0.9, 500, 10), False, False),
    ((99.0, 1, 0.25, 500, 10), True, True),
    ((99.0, 1, 0.9, 10, 10), True, True),
    ((99.0, 1, 0.9, 0, 10), False, True),
    ((99.0, 1, 0.9, 5, 0), False, False),
]


@pytest.mark.parametrize("row,zero_fill,strict", RISK)
def test_at_risk(spark, row, zero_fill, strict):
    df = spark.createDataFrame([row], "stockout_days double, lead_time_days int, pressure double, qty_on_hand int, reorder_point int")
    assert tuple(df.select(P.at_risk("zero_fill"), P.at_risk("strict")).first()) == (zero_fill, strict)
    with pytest.raises(ValueError):
        P.at_risk("other")


def heroes(spark):
    return spark.createDataFrame(
        [("A", 1, "s1", "Tech"), ("A", 2, "s2", "art"), ("A", 3, "s3", None), ("B", 1, "s4", "Tech"), ("B", 2, "s5", "")],
        "campaign string, rank int, sku string, category string")


def test_category_mix(spark, rows):
    def pick(category):
        return [r["sku"] for r in rows(P.category_mix(heroes(spark), category), "sku")]

    assert pick("ART") == ["s2", "s4", "s5"]
    assert pick("tech") == ["s1", "s4"]
    assert pick("none") == pick("All") == pick(None) == ["s1", "s2", "s3", "s4", "s5"]
    assert [r["category"] for r in rows(P.campaign_categories(heroes(spark)), "campaign", "category")] == ["Tech", "art", "Tech"]
    assert R.top_movers(heroes(spark), 1).count() == 2


def test_strategy_of_unknown_signals(spark, rows):
    df = spark.createDataFrame([("Trending",), ("High Search Vol",), ("Odd",), (None,), ("",)], "signal string")
    got = [(r["signal"], r["strategy"], r["color"]) for r in rows(P.with_strategy(df, P.strategies(spark)), "signal")]
    organic = ("Organic Demand", "Protect Margin", "#48BB78")
    assert got == [("High Search Vol", "Light Discount", "#4299E1"), ("Odd", "Protect Margin", "#48BB78"), organic, organic,
                   ("Trending", "Boost Visibility", "#D69E2E")]


def planned(spark, pairs):
    return spark.createDataFrame(pairs, "user_id bigint, campaign string")


def test_launch_and_delete(spark, rows):
    now = planned(spark, [(1, "Halloween"), (1, "New Year"), (2, "Christmas")])
    after = rows(P.launch(now, planned(spark, [(1, "Halloween"), (2, "Halloween"), (3, "X"), (3, " "), (3, None)])), "user_id", "campaign")
    assert [(r["user_id"], r["campaign"]) for r in after] == [
        (1, "Halloween"), (1, "New Year"), (2, "Christmas"), (2, "Halloween"), (3, "X")]
    left = rows(P.delete(now, planned(spark, [(1, "New Year"), (1, "Halloween"), (2, "Christmas"), (9, "x")])), "user_id")
    assert [(r["user_id"], r["campaign"]) for r in left] == [(1, "New Year"), (2, "New Year")]


def test_planned_order(spark, rows):
    plan = spark.createDataFrame([("New Year", day("2015-01-02")), ("A", day("2015-03-01")), ("B", day("2014-03-01")), ("Z", None), ("Y", None)],
                                 "campaign string, peak_date date")
    mine = planned(spark, [(1, c) for c in ("Z", "A", "New Year", "Y", "B", "Unknown")])
    got = sorted(rows(P.planned_order(mine, plan)), key=lambda r: r["position"])
    assert [r["campaign"] for r in got] == ["New Year", "B", "A", "Y", "Z"]


def test_pick_campaign(spark):
    config = spark.createDataFrame([("A", 1), ("B", 2)], "campaign string, position int")
    assert P.pick_campaign(config, "B").first().campaign == "B"
    assert P.pick_campaign(config, "C").first().campaign == "A"


def test_campaign_tables(spark, rows):
    table = spark.createDataFrame(
        [(1, "A", day("2015-01-01"), day("2015-01-04"), day("2015-01-07"), "active"),
         (2, "B", day("2015-02-01"), None, day("2015-02-07"), "cancelled")],
        "id bigint, name string, start_date date, peak_date date, end_date date, status string")
    products = spark.createDataFrame([(1, "s2", None, 2, 5), (1, "s1", "c", 1, 9), (7, "s9", "c", 1, 9)],
                                     "campaign_id bigint, sku string, category string, rank int, expected_sales int")
    row = P.campaign_by_id(table, 2).first()
    assert (row.start_date, row.peak_date, row.status_color) == ("2015-02-01", None, "gray")
    nested = rows(P.campaigns_with_products(table, products), "id")
    assert [(h["sku"], h["category"]) for h in nested[0]["hero_products"]] == [("s1", "c"), ("s2", "Unknown")]
    assert nested[0]["status_color"] == "green" and nested[1]["hero_products"] is None
    assert P.campaign_products(products, 7).count() == 1


def test_labels(spark):
    df = spark.createDataFrame([(" Lamp ", "s_1", 3, 59, day("2015-01-02")), (" ", "red_lamp", 3, 60, None), (None, None, 7, 390, day("2014-12-30"))],
                               "name string, sku string, n int, mins int, peak date")
    got = [tuple(r) for r in df.select(X.display_name("name", "sku", "n"), X.cover_label("mins"), X.date_range_label("peak")).collect()]
    assert got == [("Lamp", "59m remaining", "Dec 30 - Jan 5"), ("red lamp", "1h 0m", "—"), ("Product 07", "6h 30m", "Dec 27 - Jan 2")]


def test_planning_uses_two_decimals_of_the_lift(spark):
    from tidemark.plans.dashboard import published_lifts
    plan = spark.createDataFrame([("A", 1, 100, 2.538)], "campaign string, position int, baseline_units bigint, planned_lift double")
    row = published_lifts(plan).withColumn("velocity", F.lit(1.0)).select(P.planner_units().alias("u")).first()
    assert row.u == 366  # 100 * 2.54 * 1.2 * 1.2 = 365.76


def test_stored_scenarios(spark):
    plan = spark.createDataFrame([("A", 3)], "campaign string, position int")
    scen = spark.createDataFrame([("A", "s2", 10, None, 2.5), ("A", "s1", 10, 4.0, 1.25)],
                                 "campaign string, sku string, discount_pct int, stockout_days double, revenue double")
    row = P.simulation_results(scen, plan).first()
    assert (row.id, row.campaign_id, row.total_revenue) == (3010, 3, 3.75)
    assert row.stockout_days == {"s1": 4.0, "s2": None} and row.scenario_params.demand_multiplier == 1.05
