"""Range joins, keyword indexes, incremental totals, ranks over whole tables, repeated keys."""

import datetime as dt
import random
from collections import Counter

import pytest
from helpers import day
from pyspark.sql import functions as F

from tidemark.operators import global_rank, intervals, keywords, quality
from tidemark.plans import incremental


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Range joins

def calendar(seed, n=400):
    rng = random.Random(seed)
    start = dt.date(2020, 1, 1)
    windows = []
    for i in range(n):
        low = start + dt.timedelta(days=rng.randrange(-5, 400))
        length = rng.choice([0, 0, 1, 2, 3, 7, 8, 30, 31, 365, 4000, -1])
        windows.append((i, low, low + dt.timedelta(days=length)))
    windows += [(n, None, start), (n + 1, start, None), (n + 2, windows[0][1], windows[0][2])]
    points = [(j, start + dt.timedelta(days=rng.randrange(0, 380))) for j in range(150)] + [(999, None)]
    return points, windows


def test_every_point_meets_its_windows_once(spark):
    points, windows = calendar(1)
    left = spark.createDataFrame(points, "p int, ds date").repartition(3)
    right = spark.createDataFrame(windows, "w int, window_start date, window_end date").repartition(4)
    met = intervals.points_in_windows(left, right)
    want = Counter((p, w) for p, at in points for w, lo, hi in windows if None not in (at, lo, hi) and lo <= at <= hi)
    assert Counter((r["p"], r["w"]) for r in met.collect()) == want and max(want.values()) == 1 and len(want) > 5000
    assert "NestedLoop" not in plan_of(met) and "Cartesian" not in plan_of(met)
    flags = {r["p"]: r["is_inside"] for r in intervals.flag_points(left, right).collect()}
    assert flags == {p: any((p, w) in want for w, _, _ in windows) for p, _ in points}


def test_ranges_of_times_and_numbers(spark):
    rng = random.Random(2)
    numbers = [rng.choice([-1, 1]) * rng.randrange(0, 10**rng.randrange(1, 12)) for _ in range(200)]
    windows = [(i, x, x + rng.randrange(0, 10**rng.randrange(1, 11))) for i, x in enumerate(numbers)]
    left = spark.createDataFrame([(x,) for x in numbers], "ds bigint")
    right = spark.createDataFrame(windows, "w int, window_start bigint, window_end bigint")
    want = Counter((x, w) for x in numbers for w, lo, hi in windows if lo <= x <= hi)
    assert Counter(map(tuple, intervals.points_in_windows(left, right).select("ds", "w").collect())) == want
    t0 = dt.datetime(2024, 3, 1)
    times = spark.createDataFrame([(t0 + dt.timedelta(microseconds=k),) for k in (0, 1, 5)], "ds timestamp")
    spans = spark.createDataFrame([(1, t0, t0 + dt.timedelta(microseconds=1)), (2, t0 + dt.timedelta(microseconds=5), t0 + dt.timedelta(days=9))],
                                  "w int, window_start timestamp, window_end timestamp")
    found = intervals.points_in_windows(times, spans).select("ds", "w").collect()
    assert sorted((r["ds"].microsecond, r["w"]) for r in found) == [(0, 1), (1, 1), (5, 2)]


def test_empty_calendars_and_equal_names(spark):
    points, windows = calendar(3)
    left = spark.createDataFrame(points, "p int, ds date")
    right = spark.createDataFrame(windows, "w int, window_start date, window_end date")
    assert intervals.points_in_windows(left, right.where("false")).count() == 0
    assert intervals.points_in_windows(left.where("false"), right).count() == 0
    assert {r["is_inside"] for r in intervals.flag_points(left, right.where("false")).collect()} == {False}
    with pytest.raises(ValueError):
        intervals.points_in_windows(left, right.withColumnRenamed("w", "p"))


# Keyword lists

def test_lists_hold_the_products_that_contain_a_keyword(spark):
    rng = random.Random(4)
    letters = "abcÉé+.(l"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    products = [(word(3) + str(i), rng.choice([word(6), word(9), "Shoes", None, ""])) for i in range(120)] + [("S1", "SHOES"), ("S1", "shoes")]
    lists = [(i, [rng.choice([word(rng.randrange(1, 6)), "hoe", None, "zzz", products[i % 60][0][:4]]) for _ in range(rng.randrange(1, 4))])
             for i in range(150)]
    lists += [(900, []), (901, None), (902, ["All", "x"]), (903, ["", "q"]), (904, [None])]
    frame = spark.createDataFrame(products, "sku string, category string").repartition(3)
    asked = spark.createDataFrame(lists, "list_id int, keywords array<string>").repartition(3)
    opened = {900, 901, 902, 903}
    assert {r["list_id"] for r in keywords.open_lists(asked).collect()} == opened
    want = {(i, sku) for i, words in lists if i not in opened for sku, category in products for w in words
            if w is not None and any(t is not None and w.lower() in t.lower() for t in (sku, category))}
    found = keywords.match_lists(frame, asked)
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) > 500
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    assert keywords.match_lists(frame.where("false"), asked).count() == 0
    assert keywords.match_lists(frame, asked.where("false")).count() == 0


def test_the_rarest_gram_is_looked_up(spark):
    """Every text holds the first letters of the keyword; one text holds it all."""
    texts = spark.createDataFrame([(f"common {i}",) for i in range(200)] + [("common zq7",)], "text string")
    words = spark.createDataFrame([("common zq7",), ("nowhere",)], "word string")
    assert [tuple(r) for r in keywords.keyword_hits(words, texts).collect()] == [("common zq7", "common zq7")]


def test_totals_of_lists_meet_groups_and_not_their_products(spark):
    """Lists that share a keyword and products that share a name: the counts are made without their pairs."""
    rng = random.Random(9)
    products = [(str(i), rng.choice(["Red Bolt", "red bolt", "blue bolt", "Nut", None])) for i in range(300)]
    products += [("7", "blue bolt"), ("7", "x7"), (None, "nut"), (None, None)]
    lists = [(i, [rng.choice(["bolt", "RED B", "nut"]), f"{i}7", rng.choice(["no such word", "7", "2"])]) for i in range(200)]
    lists += [(None, ["nut", "99"]), (901, ["nothing"])]
    frame = spark.createDataFrame(products, "sku string, category string").repartition(3)
    asked = spark.createDataFrame(lists, "list_id int, keywords array<string>").repartition(3)
    want = {}
    for i, words in lists:
        own = {sku for sku, category in products for w in words if any(t is not None and w.lower() in t.lower() for t in (sku, category))}
        if own:
            want[i] = (len(own), min((s for s in own if s is not None), default=None))
    totals = keywords.match_lists(frame, asked, totals=True)
    assert {r["list_id"]: (r["n_products"], r["first_sku"]) for r in totals.collect()} == want and 901 not in want
    pairs = [tuple(r) for r in keywords.match_lists(frame, asked).collect()]
    assert len(pairs) == len(set(pairs)) == sum(n for n, _ in want.values())
    found, members = keywords.match_groups(frame, asked)
    assert members.count() <= 2 * len(products) and found.count() < len(pairs) / 4


# Incremental totals

def lines(seed, n, first, last):
    rng = random.Random(seed)
    span = (day(last) - day(first)).days + 1
    rows = [(f"S{rng.choice([1, 1, 1, rng.randrange(2, 40)])}", day(first) + dt.timedelta(days=rng.randrange(span)),
             rng.choice([rng.randrange(1, 10**6) / 100, 0.1, 1e12 + 0.25])) for _ in range(n)]
    return rows + [(None, day(first), 5.0), ("S1", None, 5.0), ("S1", day(first), None), ("S1", day(first), float("nan"))]


SALES = "sku string, order_date date, sales double"


def whole(spark, path):
    return sorted(map(tuple, incremental.sku_days(spark, path).collect()))


def recomputed(spark, rows):
    path = f"{spark.conf.get('spark.checkpoint.dir')}/{random.random()}"
    incremental.add_delivery(spark.createDataFrame(rows, SALES), 1, path)
    return whole(spark, path)


def test_deliveries_equal_a_full_recompute(spark, tmp_path):
    path = str(tmp_path / "sku-days")
    parts = [lines(1, 300, "2020-01-01", "2020-06-30"), lines(2, 200, "2020-06-15", "2020-08-31"), lines(3, 50, "2020-03-01", "2020-03-20")]
    written = []
    for number, rows in enumerate(parts, 1):
        incremental.add_delivery(spark.createDataFrame(rows, SALES).repartition(3), number, path,
                                 lambda merged: written.append({r[0] for r in merged.select("month").distinct().collect()}))
    assert written[1] == {202006, 202007, 202008} and written[2] == {202003}
    every = [r for rows in parts for r in rows]
    assert whole(spark, path) == recomputed(spark, every)
    exact = {}
    for sku, d, amount in every:
        if sku and d and amount == amount and amount is not None:
            exact[d] = exact.get(d, 0) + round(amount * 10**4)
    daily = {r["ds"]: r["y"] for r in incremental.daily_totals(spark, path).collect()}
    assert daily == {d: float(u) / 1e4 for d, u in exact.items()}
    some = {r["ds"]: r["y"] for r in incremental.daily_totals(spark, path, "2020-03-05", "2020-06-20").collect()}
    assert some == {d: y for d, y in daily.items() if day("2020-03-05") <= d <= day("2020-06-20")}
    totals = {r["sku"]: r for r in incremental.sku_totals(spark, path).collect()}
    assert totals["S1"]["n_lines"] == sum(1 for s, d, y in every if s == "S1" and d and y is not None and y == y)


def test_a_delivery_counts_once_and_goes_on_where_it_broke_off(spark, tmp_path):
    path = str(tmp_path / "sku-days")
    first, second = lines(5, 100, "2021-01-01", "2021-03-31"), lines(6, 100, "2021-02-01", "2021-04-30")
    incremental.add_delivery(spark.createDataFrame(first, SALES), 1, path)
    once = whole(spark, path)
    incremental.add_delivery(spark.createDataFrame(first, SALES), 1, path)
    assert whole(spark, path) == once

    # Only one month of the second delivery was written when it broke off.
    incremental.add_delivery(spark.createDataFrame([r for r in second if r[1] and r[1].month == 3], SALES), 2, path)
    incremental.add_delivery(spark.createDataFrame(second, SALES), 2, path)
    assert whole(spark, path) == recomputed(spark, first + second)


def test_only_touched_months_are_read(spark, tmp_path):
    path = str(tmp_path / "sku-days")
    incremental.add_delivery(spark.createDataFrame(lines(7, 300, "2020-01-01", "2020-12-31"), SALES), 1, path)
    months = spark.createDataFrame([(202003, 4), (202009, 1)], "month int, n_days bigint")
    read = incremental.touched(spark, path, months)
    assert {r["month"] for r in read.select("month").distinct().collect()} == {202003, 202009}
    assert "dynamicpruning" in plan_of(read).lower()
    assert "PartitionFilters: [isnotnull(month" in plan_of(incremental.daily_totals(spark, path, "2020-05-01", "2020-05-31"))


def test_an_empty_delivery(spark, tmp_path):
    path = str(tmp_path / "sku-days")
    none = spark.createDataFrame([], SALES)
    incremental.add_delivery(spark.createDataFrame(lines(8, 20, "2020-01-01", "2020-01-31"), SALES), 1, path)
    before = whole(spark, path)
    incremental.add_delivery(none, 2, path)
    assert whole(spark, path) == before


# Ranks

@pytest.mark.parametrize("parts", [1, 5, 40])
def test_ranks_over_all_rows(spark, parts):
    rng = random.Random(9)
    rows = [(f"S{i}", float(rng.choice([0, 0, 1, rng.randrange(10**6)]))) for i in range(2000)]
    frame = spark.createDataFrame(rows, "sku string, sales double").repartition(7)
    ranked = global_rank.global_rank(frame, F.desc("sales"), F.asc("sku"), parts=parts)
    got = {r["sku"]: (r["rank"], r["percentile"]) for r in ranked.collect()}
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert got == {sku: (i + 1, i / 1999.0) for i, (sku, _) in enumerate(want)}
    assert "Window" not in plan_of(ranked) and "SinglePartition" not in plan_of(ranked)


def test_ranks_of_nothing_and_of_one_row(spark):
    frame = spark.createDataFrame([("a", 1.0)], "sku string, sales double")
    assert [tuple(r) for r in global_rank.global_rank(frame, F.desc("sales"), "sku").collect()] == [("a", 1.0, 1, 0.0)]
    assert global_rank.global_rank(frame.where("false"), F.desc("sales"), F.asc("sku")).count() == 0


# Repeated keys

@pytest.mark.parametrize("held", [1 << 22, 7])
def test_repeated_keys_equal_a_grouping(spark, monkeypatch, held):
    monkeypatch.setattr(quality, "HELD", held)
    rng = random.Random(10)
    rows = [(f"k{i}", i % 3) for i in range(3000)] + [("hot", 1)] * 1500 + [(f"k{rng.randrange(3000)}", rng.randrange(3)) for _ in range(200)]
    rows += [(None, 1), (None, 1), ("", None), (None, None)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "sku string, line int").repartition(6)
    want = {k: c for k, c in Counter(rows).items() if c > 1}
    got = quality.repeated_keys(frame, ["sku", "line"], parts=11).collect()
    assert {(r["sku"], r["line"]): r["n_rows"] for r in got} == want and len(got) == len(want) > 50


def test_repeated_keys_move_few_rows(spark):
    frame = spark.range(200000).select(F.concat(F.lit("a long key of many letters "), "id").alias("k"), F.lit(1).alias("v"))
    frame = frame.unionAll(frame.where("k like '% 1999_'")).repartition(4)
    packed = quality._packed(frame.select(F.xxhash64("k").alias("print")), 16)
    assert packed.count() <= 4 * 16
    suspects = quality._repeated_prints(packed)
    assert suspects.count() == 10 == quality.repeated_keys(frame, ["k"]).count()
    assert quality.repeated_keys(frame.where("false"), ["k"]).count() == 0
