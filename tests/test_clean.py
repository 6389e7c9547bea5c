import datetime as dt

import pytest
from helpers import day

from tidemark.sources import sales, sinks
from tidemark.schemas import INVENTORY


def raw(spark, rows):
    return sales.normalise_headers(spark.createDataFrame(
        rows, "`Order.Date` string, Sales string, `Product.ID` string, `Product-Name` string, ` Category ` string"
    ))


def test_headers_are_normalised(spark):
    df = spark.createDataFrame([(1, 2, 3)], "` Order Date ` int, `Ship-Mode` int, SALES int")
    assert sales.normalise_headers(df).columns == ["order_date", "ship_mode", "sales"]


def test_first_alias_wins_and_missing_column_fails(spark):
    df = spark.createDataFrame([(1, 2)], "revenue int, amount int")
    assert sales.pick_column(df, ["sales", "revenue", "amount"], "sales") == "revenue"
    with pytest.raises(ValueError, match="no date column"):
        sales.pick_column(df, ["order_date", "date"], "date")
    with pytest.raises(ValueError, match="missing columns"):
        sales.require_columns(df, ["revenue", "sku"])


def test_dirty_rows_are_dropped(spark, rows):
    clean = sales.clean_sales(raw(spark, [
        ("2014-01-05", "10.5", "  A-1 ", " Lamp ", "Tech"),
        ("1/6/2014", "2", "A-2", None, "  "),
        ("2014-01-05 13:45:00", "3", "A-3", "x", None),
        ("not a date", "5", "A-4", "x", "Tech"),
        (None, "5", "A-5", "x", "Tech"),
        ("2014-01-05", "0", "A-6", "x", "Tech"),
        ("2014-01-05", "-1", "A-7", "x", "Tech"),
        ("2014-01-05", "abc", "A-8", "x", "Tech"),
        ("2014-01-05", "NaN", "A-8", "x", "Tech"),
        ("2014-01-05", None, "A-9", "x", "Tech"),
        ("2014-01-05", "5", "   ", "x", "Tech"),
        ("2014-01-05", "5", None, "x", "Tech"),
    ]))
    got = rows(clean, "sku")
    assert [(r["sku"], r["order_date"], r["sales"], r["category"]) for r in got] == [
        ("A-1", day("2014-01-05"), 10.5, "Tech"),
        ("A-2", day("2014-01-06"), 2.0, "General"),
        ("A-3", day("2014-01-05"), 3.0, "General"),
    ]
    assert got[0]["name"] == "Lamp" and got[1]["name"] is None


def test_category_alternates(spark, rows):
    df = spark.createDataFrame(
        [("2014-01-05", "1", "a", None, "Alt"), ("2014-01-05", "1", "b", "First", "Alt")],
        "date string, amount string, sku string, category_1 string, category_name_1 string",
    )
    assert [r["category"] for r in rows(sales.clean_sales(df), "sku")] == ["Alt", "First"]


def test_csv_scan(spark, rows, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text('Order Date,Sales,Product ID,Product Name,Category\n'
                    '2014-02-01,12.5,SKU-1,"Desk, 20"" wide",Furniture\n', encoding="utf-8")
    got = rows(sales.clean_sales(sales.read_sales(spark, str(path))))
    assert got[0]["name"] == 'Desk, 20" wide' and got[0]["sales"] == 12.5
    with pytest.raises(ValueError, match="unsupported format"):
        sales.read_sales(spark, str(path), "xlsx")


def test_bad_inventory_values_become_null(spark, rows, tmp_path):
    path = tmp_path / "inv.csv"
    path.write_text("sku,cost_price,msrp,qty_on_hand,last_restock_date,lead_time_days\n"
                    " A ,x,20.5,7.0,2014-01-02,\nB,1,2,n/a,never,14\n")
    a, b = rows(sales.read_inventory(spark, str(path)), "sku")
    assert (a["sku"], a["cost_price"], a["msrp"], a["qty_on_hand"]) == ("A", None, 20.5, 7)
    assert a["last_restock_date"] == dt.date(2014, 1, 2) and a["lead_time_days"] is None
    assert b["qty_on_hand"] is None and b["last_restock_date"] is None and b["reorder_point"] is None


def test_inventory_round_trips(spark, rows, tmp_path):
    inv = spark.createDataFrame(
        [("A", 'say "hi", ok', "c", "w", "s", 1.25, None, 3, 0, 5, day("2014-01-01"), 7)], INVENTORY)
    sinks.write_inventory_csv(inv, str(tmp_path / "csv"))
    sinks.write_inventory_json(sales.read_inventory(spark, str(tmp_path / "csv")), str(tmp_path / "json"))
    assert rows(sales.read_inventory(spark, str(tmp_path / "csv"))) == rows(inv)
    assert rows(sales.read_inventory(spark, str(tmp_path / "json"), "json")) == rows(inv)


def test_inventory_json_array_is_readable(spark, rows, tmp_path):
    path = tmp_path / "inv.json"
    path.write_text('[{"sku": "A", "qty_on_hand": 3}, {"sku": "B", "msrp": 4.5}]')
    got = rows(sales.read_inventory(spark, str(path), "json"), "sku")
    assert [(r["sku"], r["qty_on_hand"], r["msrp"]) for r in got] == [("A", 3, None), ("B", None, 4.5)]
