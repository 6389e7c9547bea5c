import datetime as dt
import random

import pytest
from helpers import day
from pyspark.sql import functions as F

from tidemark.schemas import EVENTS
from tidemark.sources import star
from tidemark.streaming import live, runner

T0 = dt.datetime(2024, 1, 1, 10, 0)


def write(spark, folder, events, name="events-0"):
    df = spark.createDataFrame(events, EVENTS)
    df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def event(i, minutes, user=1, kind="purchase", value=1.0, sku=5):
    return (i, T0 + dt.timedelta(minutes=minutes), user, kind, value, '{"k": %d}' % sku)


@pytest.fixture()
def late(spark, tmp_path):
    """Three deliveries; the last repeats an event and brings one that is far too late.

    Rows count as late against the watermark of the batch before, hence the one between.
    """
    write(spark, tmp_path, [event(1, 0, value=2.5), event(2, 59), event(3, 61, sku=6), event(4, 150, kind="view"), event(4, 150, kind="view"),
                            event(9, 185)], "events-0")
    write(spark, tmp_path, [event(8, 186)], "events-1")
    write(spark, tmp_path, [event(2, 59), event(5, 20, value=100.0), event(6, 190), event(7, 400)], "events-2")
    return str(tmp_path)


def stream(spark, folder):
    # Read in file order, one file per batch.
    reader = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return star._event_columns(reader.parquet(folder))


def test_late_rows_are_dropped(spark, rows, late):
    got = rows(runner.run_to_table(live.gmv_by_hour(stream(spark, late)), "late"), "hour_start")
    assert [(r["hour_start"].hour, r["gmv"], r["orders"]) for r in got] == [(10, 3.5, 2), (11, 1.0, 1), (13, 3.0, 3)]


def test_duplicates_are_removed(spark, rows, late):
    got = rows(runner.run_to_table(live.deduplicate(stream(spark, late)), "dup"), "event_id")
    assert [r["event_id"] for r in got] == [1, 2, 3, 4, 6, 8, 9]


def batch(spark, events):
    return star._event_columns(spark.createDataFrame(events, EVENTS))


def test_batch_deduplication_keeps_the_first(spark, rows):
    got = rows(live.deduplicate(batch(spark, [event(1, 5, value=9.0), event(1, 3), event(1, 3), event(2, 1)])), "event_id")
    assert [(r["event_id"], r["value"]) for r in got] == [(1, 1.0), (2, 1.0)]


def test_stream_equals_batch(spark, rows, tmp_path):
    rng = random.Random(1)
    events = [event(i, rng.randrange(0, 600), user=rng.choice([1, 1, 1, rng.randrange(9)]), kind=rng.choice(["purchase", "view"]),
                    value=rng.randrange(1, 9999) / 100, sku=rng.randrange(3)) for i in range(500)]
    write(spark, tmp_path, events)
    inv = spark.createDataFrame([("0", "zero", 5, 1), ("1", "one", 3, 5)], "sku string, name string, qty_on_hand int, qty_reserved int")
    twins = {
        "gmv": (live.gmv_by_hour, "hour_end"),
        "users": (lambda e: live.online_users(e), "window_end"),
        "eta": (lambda e: live.sku_orders_by_hour(e, inv), "hour_end"),
    }
    closed = F.lit(T0 + dt.timedelta(minutes=580)).cast("timestamp_ntz")
    for label, (metric, end) in twins.items():
        a = rows(runner.run_to_table(metric(stream(spark, str(tmp_path))), label).where(F.col(end) <= closed))
        b = rows(metric(batch(spark, events)).where(F.col(end) <= closed))
        assert sorted(map(str, a)) == sorted(map(str, b)) and a, label


def test_session_gap(spark, rows, tmp_path):
    events = [event(1, 0), event(2, 30), event(3, 60.02), event(4, 5, user=2), event(5, 600, user=3)]
    got = rows(live.sessions_batch(batch(spark, events)), "user_id", "session_start")
    assert [(r["user_id"], r["n_events"]) for r in got] == [(1, 2), (1, 1), (2, 1), (3, 1)]
    assert got[0]["session_end"] == T0 + dt.timedelta(minutes=60)
    write(spark, tmp_path, events)
    live_rows = rows(runner.run_to_table(live.sessions(stream(spark, str(tmp_path))), "sessions"), "user_id", "session_start")
    assert live_rows == got[:3]


def test_hot_user_sessions_equal_brute_force(spark, rows):
    rng = random.Random(2)
    events = [event(i, rng.randrange(0, 40000) / 7, user=1 if rng.random() < 0.5 else rng.randrange(20)) for i in range(1500)]
    want = []
    for user in {e[2] for e in events}:
        times = sorted(e[1] for e in events if e[2] == user)
        start = prev = times[0]
        n = 0
        for t in times:
            if t - prev > dt.timedelta(minutes=30):
                want.append((user, start, n))
                start, n = t, 0
            n, prev = n + 1, t
        want.append((user, start, n))
    got = rows(live.sessions_batch(batch(spark, events)))
    assert sorted((r["user_id"], r["session_start"], r["n_events"]) for r in got) == sorted(want)


def test_velocity_and_pacing(spark, rows):
    hours = spark.createDataFrame(
        [(T0, T0 + dt.timedelta(hours=1), 40.0, 120), (T0 + dt.timedelta(hours=1), T0 + dt.timedelta(hours=2), 20.0, 90),
         (T0 + dt.timedelta(hours=4), T0 + dt.timedelta(hours=5), 1.0, 6)],
        "hour_start timestamp_ntz, hour_end timestamp_ntz, gmv double, orders bigint")
    got = rows(live.velocity(hours), "hour_start")
    assert [(r["orders_per_min"], r["delta_pct"]) for r in got] == [(2.0, None), (1.5, -25.0), (0.1, None)]
    assert [r["pct_of_target"] for r in rows(live.pacing(hours, 50.0), "hour_start")] == [80.0, 40.0, 2.0]


def test_watchlist_rules(spark, rows):
    etas = spark.createDataFrame(
        [(T0, "a", 19.9), (T0, "b", 20.0), (T0, "c", None), (T0 + dt.timedelta(hours=1), "d", 300.0)],
        "hour_start timestamp_ntz, sku string, eta_oos_mins double")
    paced = spark.createDataFrame([(T0, 79.9), (T0 + dt.timedelta(hours=1), 80.0)], "hour_start timestamp_ntz, pct_of_target double")
    got = rows(live.watchlist(etas, paced), "sku")
    assert [r["action"] for r in got] == ["Raise Price 5%", "Trigger Flash Push", "Trigger Flash Push", "Monitor"]
    assert [r["sku"] for r in rows(live.critical(etas))] == ["a"]


def test_minutes_to_out_of_stock(spark, rows):
    df = spark.createDataFrame([("a", 4, 10.0), ("b", 4, None)], "sku string, orders bigint, available double")
    assert [r["eta_oos_mins"] for r in rows(live.minutes_to_out_of_stock(df), "sku")] == [150.0, None]


def test_ticker_keeps_the_newest_over_batches(spark, rows, tmp_path):
    write(spark, tmp_path, [event(i, i) for i in range(0, 30)], "events-0")
    write(spark, tmp_path, [event(i, i) for i in range(15, 40, 4)], "events-1")
    got = runner.run_ticker(stream(spark, str(tmp_path)), n=5)
    assert sorted(r.event_id for r in got.collect()) == [28, 29, 31, 35, 39]


def test_work_folder_follows_the_setting(spark):
    from tidemark.session import work_folder
    a, b = work_folder(spark, "x"), work_folder(spark, "x")
    assert a != b and a.startswith(spark.conf.get("spark.checkpoint.dir"))


class _Session:
    """A session without the setting."""

    def __init__(self, master):
        self.master, self.folder = master, None
        self.sparkContext = self.conf = self

    def get(self, key, default=None):
        return default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_work_folder_without_the_setting():
    from tidemark.session import work_folder
    local = _Session("local[2]")
    first, second = work_folder(local, "x"), work_folder(local, "x")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0] == local.folder
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_folder(_Session("spark://host:7077"), "x")
