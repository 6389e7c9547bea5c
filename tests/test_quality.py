
from helpers import day
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.operators import callouts as K
from tidemark.operators import inventory as I
from tidemark.operators import quality as Q
from tidemark.plans import refresh as RF
from tidemark.schemas import INVENTORY
from tidemark.sources import tables


def test_duplicates_nulls_and_orphans(spark, rows):
    df = spark.createDataFrame([("a", day("2014-01-01"), 1), ("a", day("2014-01-01"), 2), ("b", None, 3), (None, None, None)],
                               "sku string, date date, x int")
    dup = rows(Q.duplicate_keys(df, ["sku", "date"]))
    assert [(r["sku"], r["n_rows"]) for r in dup] == [("a", 2)]
    assert {r["column_name"]: r["n_missing"] for r in rows(Q.missing_values(df, ["sku", "date", "x"]))} == {"sku": 1, "date": 2, "x": 1}
    checks = {(r["rule"], r["column_name"]): r["n_bad"] for r in rows(Q.table_checks(tables.conform(df, "sales_data"), "sales_data"))}
    assert checks == {("unique", "sku,date"): 1, ("required", "sku"): 1, ("required", "date"): 2}
    parents = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    kids = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z")], "parent int, v string")
    assert sorted(r["v"] for r in rows(Q.orphans(kids, parents, "parent", "id"))) == ["y", "z"]
    assert [r["v"] for r in rows(Q.without_orphans(kids, parents, "parent", "id"))] == ["x"]


def test_every_relational_table_has_a_check(spark):
    from tidemark.schemas import TABLES
    for name in TABLES:
        empty = spark.createDataFrame([], TABLES[name]["schema"])
        assert all(r.n_bad == 0 for r in Q.table_checks(empty, name).collect())


def inventory(spark):
    return spark.createDataFrame(
        [("AB-1", "n", "c", "w", "s", 1.0, 2.0, 5, 7, 5, None, 3), ("AB-2", "n", "c", "w", "s", 1.0, 2.0, 6, 0, 5, None, 3),
         ("AB-3", "n", "c", "w", "s", 1.0, 2.0, None, 0, 5, None, 3)], INVENTORY)


def test_lookups(spark, rows):
    inv = inventory(spark)
    assert I.lookup(inv, F.lit("ab-1")).first().available_qty == -2
    assert [r["sku"] for r in rows(I.low_stock(inv))] == ["AB-1"]
    assert I.low_stock_count(inv).first()[0] == 1
    keys = spark.createDataFrame([("ab-1",), ("AB-2",), ("ab-2",), ("zz",), (None,)], "sku string")
    found = I.bulk_lookup(inv, keys)
    assert [r["sku"] for r in rows(found, "sku")] == ["AB-1", "AB-2"]
    answer = I.as_lookup_map(found).first()["inventory"]
    assert answer["AB-2"]["available_qty"] == 6 and set(answer) == {"AB-1", "AB-2"}


TEXT = '1. "Grab the lamp before it is gone"\n\n 2) Lamp deal\n3 - \'Light up your evening today\'\n' \
       "short one\n\t10: Third good line here\nFourth good line here"


def test_clean_callouts(spark, rows):
    df = spark.createDataFrame([(1, TEXT), (2, "tiny\n\n"), (3, None), (4, "é" * 11 + " \n" + "é" * 10)], "id int, text string")
    got = [(r["id"], r["position"], r["callout"]) for r in rows(K.clean_callouts(df, ["id"], "text"), "id", "position")]
    assert got == [
        (1, 1, "Grab the lamp before it is gone"), (1, 2, ") Lamp deal"), (1, 3, "Light up your evening today"), (4, 1, "é" * 11)]


def test_callouts_fall_back_to_templates(spark, rows):
    df = spark.createDataFrame([("a", "Lamp", "Urgent", TEXT), ("b", "Desk", "Urgent", "no"), ("c", "Vase", "Other", None)],
                               "sku string, name string, tone string, text string")
    got = rows(K.callouts(df, "text"), "sku", "id")
    assert [r["id"] for r in got] == [0, 1, 2] * 3
    assert got[0]["text"].startswith("Grab the lamp")
    urgent = {t.replace("{name}", "Desk") for t in fv.TEMPLATES["Urgent"]}
    playful = {t.replace("{name}", "Vase") for t in fv.TEMPLATES["Playful"]}
    desk, vase = {r["text"] for r in got[3:6]}, {r["text"] for r in got[6:]}
    assert len(desk) == len(vase) == 3 and desk <= urgent and vase <= playful
    assert K.callouts(df).count() == 9


def test_step_report(spark):
    def broken():
        raise RuntimeError("no disk\nmore")

    steps = [("a", lambda: (True, "fine"), "failed"), ("b", broken, "failed"), ("c", lambda: (False, "2 bad"), "warning")]
    report = RF.run_steps(steps)
    assert report == [("a", "success", "fine"), ("b", "failed", "RuntimeError: no disk"), ("c", "warning", "2 bad")]
    assert RF.overall_status(report) == "partial_success"
    assert RF.overall_status(report[1:]) == "failed"
    assert RF.overall_status([report[0], report[2]]) == "success"
    assert RF.overall_status(RF.run_steps([("d", lambda: (False, "x"), "failed"), steps[0]])) == "partial_success"


def test_refresh_of_a_broken_folder(spark, tmp_path):
    got = {r.step: r.status for r in RF.refresh(spark, str(tmp_path / "nothing"), str(tmp_path / "out")).collect()}
    assert got["overall"] == "failed" and got["generate_inventory"] == "failed"
