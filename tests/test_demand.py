import random
from collections import Counter, defaultdict

import pytest
from helpers import day
from pyspark.sql import functions as F

from tidemark.functions.stock import rounded_metrics
from tidemark.operators import campaigns as C
from tidemark.operators import demand as D
from tidemark.operators import inventory as I
from tidemark.operators import ranking as R

AS_OF = day("2014-12-31")
INV = ("sku string, warehouse string, cost_price double, msrp double, qty_on_hand int, qty_reserved int,"
       " reorder_point int, last_restock_date date, lead_time_days int")


def days(spark, rows):
    return spark.createDataFrame(
        [(s, c, day(d), float(v), n) for s, c, d, v, n in rows],
        "sku string, category string, order_date date, sales double, n_lines bigint")


def inventory(spark, rows):
    return spark.createDataFrame(rows, INV)


def test_demand_periods_include_their_first_day(spark):
    row = D.sku_demand(days(spark, [
        ("a", "x", "2014-07-01", 1, 1),   # last
        ("a", "x", "2014-04-02", 10, 2),  # 90 days before: recent
        ("a", "x", "2014-04-01", 100, 1),  # 91 days before: base
        ("a", "x", "2014-01-02", 1000, 1),  # 180 days before: base
        ("a", "x", "2014-01-01", 5000, 3),  # 181 days before: neither
    ])).first()
    assert (row.recent_sales, row.base_sales, row.n_lines, row.recent_lines) == (11.0, 1100.0, 8, 3)
    assert row.recent_days == 90


def test_single_day_sku_without_base(spark):
    row = D.sku_metrics(days(spark, [("a", "x", "2014-07-01", 0.4, 2)]), inventory(spark, []), AS_OF).first()
    assert row.base_sales == 0.0 and row.trend == 0.4 and row.age_days == 0
    assert row.velocity == pytest.approx(0.2) and row.daily_units == 2.0
    assert row.available is None and row.stockout_days is None and row.pressure == 0.5 and row.margin == 0.25


@pytest.mark.parametrize("stock,expect", [
    # cost, msrp, on hand, reserved, reorder, lead -> available, pressure, margin, risk
    ((10.0, 40.0, 9, None, 4, 5), (0.0, 0.0, 0.75, True)),
    ((10.0, 40.0, 5, 9, 4, None), (0.0, 0.0, 0.75, False)),
    ((10.0, 40.0, 8, 0, 0, 1), (8.0, 0.5, 0.75, False)),
    ((90.0, 30.0, 8, 0, 4, 1), (8.0, 1.0, -1.0, False)),
    ((10.0, 0.0, 8, 0, 4, 1), (8.0, 1.0, 0.25, False)),
    ((None, 40.0, None, 3, 4, 1), (None, 0.5, 0.25, False)),
])
def test_inventory_edges(spark, stock, expect):
    cost, msrp, hand, reserved, reorder, lead = stock
    inv = inventory(spark, [("a", "w", cost, msrp, hand, reserved, reorder, day("2014-12-01"), lead)])
    row = D.sku_metrics(days(spark, [("a", "x", "2014-07-01", 5, 1)]), inv, AS_OF).first()
    assert (row.available, row.pressure, row.margin, row.stockout_risk) == expect
    assert row.age_days == 30


def test_copies_of_an_inventory_sku_count_once(spark):
    inv = inventory(spark, [("a", w, 1.0, 2.0, q, 0, 1, day(d), 1) for w, q, d in
                            [("old", 5, "2014-01-01"), ("new", 7, "2014-02-01"), ("new", 9, "2014-02-01")]])
    got = I.one_row_per_sku(inv).collect()
    assert len(got) == 1 and got[0].qty_on_hand == 7


@pytest.mark.parametrize("over,label", [
    ({"stockout_risk": True, "trend": 0.61}, "Stockout Risk"),
    ({"stockout_risk": True, "trend": 0.6}, "Organic Demand"),
    ({"low_margin": True, "trend": 0.9}, "Margin Watch"),
    ({"stockout_risk": True, "low_margin": True, "trend": 0.9}, "Stockout Risk"),
    ({"trend": 0.76}, "Trending"),
    ({"trend": 0.75}, "Organic Demand"),
    ({"age_days": 181, "pressure_raw": 1.01}, "Aging Stock"),
    ({"age_days": 180, "pressure_raw": 1.01}, "Organic Demand"),
    ({"age_days": 181, "pressure_raw": 1.0}, "Organic Demand"),
    ({"age_days": 181, "pressure_raw": None}, "Organic Demand"),
])
def test_signals(spark, over, label):
    from tidemark.functions.stock import signal
    row = {"stockout_risk": False, "low_margin": False, "trend": 0.1, "age_days": 1, "pressure_raw": 0.5, **over}
    df = spark.createDataFrame(
        [tuple(row.values())],
        "stockout_risk boolean, low_margin boolean, trend double, age_days int, pressure_raw double")
    assert df.select(signal()).first()[0] == label


def test_health_is_marked_down(spark):
    from tidemark.functions.stock import health
    df = spark.createDataFrame(
        [(0.5, 0.2, False, False), (2.0, 0.9, True, False), (0.5, 0.05, True, True)],
        "pressure double, margin double, stockout_risk boolean, low_margin boolean")
    got = [r[0] for r in df.select(health()).collect()]
    assert got == pytest.approx([0.55 * 0.5 + 0.45 * 0.5, 0.65, (0.275 + 0.45 * 0.125) * 0.65 * 0.7])


def test_published_rounding(spark):
    df = spark.createDataFrame(
        [(0.125, 400, 0.375, 0.005, 12.25, 0.675, 0.8125)],
        "trend double, age_days int, velocity double, pressure double, stockout_days double, margin double, health double")
    row = rounded_metrics(df).first()
    assert (row.trend, row.age_days, row.velocity, row.stockout_days, row.health) == (0.12, 365, 0.38, 12.2, 0.812)


def test_keyword_filter(spark, rows):
    df = days(spark, [("A+1", "Phones", "2014-01-01", 1, 1), ("B.2", "Chairs", "2014-01-01", 1, 1),
                      ("Bx2", None, "2014-01-01", 1, 1), ("a1", "Tables", "2014-01-01", 1, 1)])

    def pick(words):
        return sorted(r["sku"] for r in rows(D.keyword_filter(df, words)))

    assert pick(["phone"]) == ["A+1"]
    assert pick(["a+1", "CHAIR"]) == ["A+1", "B.2"]
    assert pick(["b.2"]) == ["B.2"]
    assert pick(["zzz"]) == []
    assert len(pick([])) == len(pick(None)) == len(pick(["zzz", "All"])) == 4


def test_modal_value_smallest_on_ties(spark, rows):
    df = spark.createDataFrame(
        [("a", "z"), ("a", "b"), ("a", "z"), ("a", "b"), ("a", None), ("a", None), ("a", None), ("b", "q")],
        "sku string, category string")
    assert [(r["sku"], r["category"]) for r in rows(D.modal_value(df, ["sku"], "category"), "sku")] == [
        ("a", "b"), ("b", "q")]


def test_first_value_and_rollup(spark, rows):
    sales = spark.createDataFrame(
        [(day("2014-02-01"), "a", "later", "c", 1.0), (day("2014-01-01"), "a", "old", "d", 2.0),
         (day("2014-01-01"), "a", "new", "e", 4.0), (day("2014-01-01"), "b", "bee", "c", 7.0),
         (day("2014-01-01"), "c", "cee", "c", 6.5)],
        "order_date date, sku string, name string, category string, sales double")
    assert rows(D.first_value(sales, "name"), "sku")[0]["name"] == "new"
    top = rows(D.sku_rollup(sales, 2), "sku")
    assert [(r["sku"], r["total_sales"], r["name"], r["category"]) for r in top] == [
        ("a", 7.0, "new", "d"), ("b", 7.0, "bee", "c")]


def month_frame(spark, n, category="c"):
    return [(f"s{i:02d}", category, "2014-02-10", 100 - i, 1) for i in range(n)]


def test_candidates_fall_back_to_the_month(spark, rows):
    config = C.campaigns(spark, [
        {"campaign": "few", "month": 2, "day": 14, "window": 7, "default_lift": 2.0, "baseline_units": 1,
         "keywords": ["rare"]},
        {"campaign": "none", "month": 3, "day": 1, "window": 7, "default_lift": 2.0, "baseline_units": 1,
         "keywords": ["All"]}])
    data = month_frame(spark, 60) + [("r1", "rare", "2014-02-11", 0.5, 1), ("r2", "rare", "2014-02-11", 0.5, 1),
                                     ("s00", "c", "2014-03-01", 5, 1)]
    got = rows(D.candidates(D.month_totals(days(spark, data), config), 10), "sku")
    few = [r for r in got if r["campaign"] == "few"]
    assert [r["sku"] for r in few if not r["is_fallback"]] == ["r1", "r2"]
    assert sorted(r["sku"] for r in few if r["is_fallback"]) == [f"s{i:02d}" for i in range(20)]
    assert {r["best_total"] for r in few} == {100.0}
    assert [r["sku"] for r in got if r["campaign"] == "none"] == ["s00"]


def test_enough_matches_need_no_fallback(spark, rows):
    config = C.campaigns(spark, [{"campaign": "x", "month": 2, "day": 14, "window": 7, "default_lift": 2.0,
                                  "baseline_units": 1, "keywords": ["k"]}])
    data = month_frame(spark, 30, "other") + [(f"k{i:02d}", "k", "2014-02-10", 1 + i % 3, 1) for i in range(60)]
    got = rows(D.candidates(D.month_totals(days(spark, data), config), 10), "sku")
    assert len(got) == 50 and not any(r["is_fallback"] for r in got)
    # ties in sales are cut by SKU: all of the 3s and 2s, then the first of the 1s
    assert sum(r["total"] == 1.0 for r in got) == 10
    assert [r["sku"] for r in got if r["total"] == 1.0] == [f"k{i:02d}" for i in range(0, 30, 3)]


def test_heroes_rank_by_score_then_sales(spark, rows):
    config = C.campaigns(spark, [{"campaign": "x", "month": 2, "day": 14, "window": 7, "default_lift": 2.0,
                                  "baseline_units": 1, "keywords": ["All"]}])
    sku_days = days(spark, month_frame(spark, 40))
    names = spark.createDataFrame([(f"s{i:02d}", f"name {i}") for i in range(39)], "sku string, name string")
    inv = inventory(spark, [("s05", "w", 1.0, 100.0, 50, 0, 5, day("2014-12-01"), 1)])
    got = rows(R.hero_products(sku_days, names, inv, config, AS_OF, n=10))
    got.sort(key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 11))
    assert got[0]["sku"] == "s05" and got[0]["name"] == "name 5"
    assert all(0 <= r["priority_score"] <= 1 for r in got)
    scores = [(-r["priority_score"], -r["total"], r["sku"]) for r in got]
    assert scores == sorted(scores)
    raw = rows(R.hero_products(sku_days, names, inv, config, AS_OF, n=10, rounded=False))
    assert len(raw) == 10


def test_missing_name_falls_back_to_sku(spark, rows):
    config = C.campaigns(spark)
    names = spark.createDataFrame([], "sku string, name string")
    got = rows(R.hero_products(days(spark, month_frame(spark, 3)), names, inventory(spark, []), config, AS_OF))
    assert len(got) == 3 and all(r["name"] == r["sku"] for r in got)


def test_hot_sku_equals_brute_force(spark, rows):
    rng = random.Random(3)
    sales = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(50)}", rng.choice("xyz"),
              day(f"2014-{rng.randrange(1, 13):02d}-{rng.randrange(1, 28):02d}"), rng.randrange(1, 10000) / 100)
             for _ in range(4000)]
    df = spark.createDataFrame(sales, "sku string, category string, order_date date, sales double").repartition(16)
    got = {r["sku"]: r for r in rows(D.sku_demand(D.sku_day(df)))}
    by_sku = defaultdict(list)
    for sku, _, d, v in sales:
        by_sku[sku].append((d, v))
    assert len(got) == len(by_sku)
    for sku, lines in by_sku.items():
        last = max(d for d, _ in lines)
        recent = [(d, v) for d, v in lines if (last - d).days <= 90]
        base = sum(round(v * 100) for d, v in lines if 90 < (last - d).days <= 180) / 100
        assert got[sku]["n_lines"] == len(lines) and got[sku]["recent_lines"] == len(recent)
        assert got[sku]["recent_sales"] == sum(round(v * 100) for _, v in recent) / 100
        assert got[sku]["base_sales"] == base
    modes = {r["sku"]: r["category"] for r in rows(D.modal_value(df, ["sku"], "category"))}
    for sku in by_sku:
        counts = Counter(c for s, c, _, _ in sales if s == sku)
        assert modes[sku] == min(counts, key=lambda c: (-counts[c], c))


def test_sums_do_not_depend_on_the_partitioning(spark):
    df = spark.range(20000).select(
        (F.col("id") % 3).cast("string").alias("sku"), F.lit("c").alias("category"),
        F.lit("2014-01-01").cast("date").alias("order_date"), ((F.col("id") * 7919 % 100003) / 100).alias("sales"))
    totals = [sorted(map(tuple, D.sku_day(df.repartition(n)).collect())) for n in (1, 7, 32)]
    assert totals[0] == totals[1] == totals[2]


def test_synthetic_inventory_ranges(spark, rows):
    rollup = spark.createDataFrame([(f"{i}", 1000.0 - i, "n", "c") for i in range(1, 121)]
                                   + [("ABC-9", 5.0, "n", "c")], "sku string, total_sales double, name string, category string")
    got = rows(I.synth_inventory(rollup, AS_OF))
    by_rank = sorted(got, key=lambda r: (r["sku"] == "ABC-9", int(r["sku"]) if r["sku"].isdigit() else 0))
    for i, r in enumerate(by_rank):
        assert (1 <= r["qty_on_hand"] <= 99) if i % 2 == 0 else (100 <= r["qty_on_hand"] <= 1000)
        assert 0 <= r["qty_reserved"] <= min(50, r["qty_on_hand"] // 5)
        assert 50 <= r["reorder_point"] <= 500 and 3 <= r["lead_time_days"] <= 14
        assert 20 <= r["cost_price"] <= 400 and 40 <= r["msrp"] <= 700
