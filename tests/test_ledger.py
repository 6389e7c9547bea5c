"""Running stock, velocity on the stream, sketches of users."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from test_live import T0, batch, event, stream, write
from tidemark.streaming import lateness, ledger, live, runner

MOVES = "sku string, ts timestamp, qty bigint"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def booked(events, deliveries, until):
    """The ledger in plain Python, of periods that end by `until` minutes."""
    moves = [(str(e[5].split(": ")[1][:-1]), e[1], 1, e[0], 1) for e in events if e[3] == "purchase"]
    moves += [(sku, ts, 0, -1, qty) for sku, ts, qty in deliveries]
    out, stock, sold = [], {}, {}
    for sku, ts, kind, event_id, qty in sorted(moves, key=lambda m: m[1:4]):
        end = ts.replace(minute=0, second=0, microsecond=0) + dt.timedelta(hours=1)
        if end > at(until):
            continue
        if kind == 0:
            stock[sku] = qty
        else:
            stock[sku] = None if stock.get(sku) is None else stock[sku] - 1
            out.append((sku, ts, event_id, stock[sku], None, None))
            sold.setdefault((sku, end), 0)
            sold[sku, end] += 1
    state = {}
    for sku, ts, kind, event_id, qty in sorted(moves, key=lambda m: m[1:4]):
        end = ts.replace(minute=0, second=0, microsecond=0) + dt.timedelta(hours=1)
        if end <= at(until):
            if kind == 0:
                state.setdefault(sku, {})[end] = qty
            else:
                last = [v for k, v in sorted(state.get(sku, {}).items()) if k <= end]
                state.setdefault(sku, {})[end] = None if not last or last[-1] is None else last[-1] - 1
    for (sku, end), orders in sold.items():
        left = state[sku][end]
        out.append((sku, end, None, left, orders, None if left is None else 60.0 * max(left, 0) / orders))
    return sorted(out, key=str)


def deliver(spark, folder, rows, name):
    spark.createDataFrame(rows, MOVES).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def run(spark, sold, came, folder, files=1):
    deliveries = spark.readStream.schema(MOVES).option("recursiveFileLookup", True).option(
        "maxFilesPerTrigger", files).parquet(came)
    stocked = ledger.running_stock(ledger.moves(stream(spark, sold), deliveries))
    return sorted(map(tuple, runner.run_to_table(stocked, "ledger", folder).collect()), key=str)


def case(seed, n=160):
    rng = random.Random(seed)
    events = [event(i, 2 * i + rng.randrange(0, 8), kind=rng.choice(["purchase", "purchase", "view"]), sku=rng.choice([1, 1, 1, 2, 3, 9]))
              for i in range(n)]
    deliveries = [(str(rng.choice([1, 1, 2, 3])), at(rng.randrange(0, 2 * n)), rng.randrange(0, 30)) for _ in range(12)]
    deliveries = list({(s, t): (s, t, q) for s, t, q in deliveries}.values())
    return events, deliveries


def test_the_ledger_equals_a_running_sum_whatever_the_order(spark, tmp_path):
    events, deliveries = case(3)
    rng = random.Random(4)
    sold, came = tmp_path / "sold", tmp_path / "came"
    for k in range(4):  # deliveries and purchases of one span come together, purchases in no order
        part = events[40 * k:40 * k + 40]
        rng.shuffle(part)
        write(spark, sold, part, f"events-{k}")
        lo, hi = at(80 * k), at(80 * k + 80)
        deliver(spark, came, [d for d in deliveries if lo <= d[1] < hi] + [("none", lo, 1)], f"moves-{k}")
    write(spark, sold, [event(9999, 500, kind="purchase", sku=77)], "events-9")
    deliver(spark, came, [("none", at(500), 1)], "moves-9")
    got = run(spark, str(sold), str(came), str(tmp_path / "out"))
    want = booked(events, deliveries, 480)
    assert got == want and len(want) > 100
    assert any(r[3] is None for r in got) and any(r[3] is not None and r[3] < 0 for r in got)


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    events, deliveries = case(5)
    sold, came, out = (str(tmp_path / x) for x in ("sold", "came", "out"))
    write(spark, sold, events[:90], "events-0")
    deliver(spark, came, [d for d in deliveries if d[1] < at(180)], "moves-0")
    first = run(spark, sold, came, out)
    assert first and first == run(spark, sold, came, out)  # nothing new, nothing twice
    write(spark, sold, events[90:], "events-1")
    deliver(spark, came, [d for d in deliveries if d[1] >= at(180)] or [("none", at(180), 1)], "moves-1")
    write(spark, sold, [event(9999, 500, kind="purchase", sku=77)], "events-9")
    assert run(spark, sold, came, out) == booked(events, deliveries, 480)


def test_velocity_on_the_stream_equals_velocity_of_its_hours(spark, tmp_path):
    rng = random.Random(6)
    events = [event(i, rng.choice([rng.randrange(0, 200), rng.randrange(320, 900)])) for i in range(300)]
    write(spark, tmp_path, sorted(events, key=lambda e: e[1])[:150], "events-0")
    write(spark, tmp_path, sorted(events, key=lambda e: e[1])[150:], "events-1")
    write(spark, tmp_path, [event(999, 1500)], "events-2")
    joined = live.velocity_stream(stream(spark, str(tmp_path)), stream(spark, str(tmp_path)))
    got = sorted(map(tuple, runner.run_to_table(joined, "velocity").collect()))
    hours = live.gmv_by_hour(batch(spark, events))
    assert got == sorted(map(tuple, live.velocity(hours).collect()))
    assert any(r[3] is None for r in got[1:]) and len(got) > 10


def test_panes_merge_to_windows_days_and_all(spark, tmp_path):
    rng = random.Random(7)
    events = [event(i, rng.randrange(0, 4000), user=rng.choice([1, rng.randrange(20000)]), kind="view") for i in range(30000)]
    write(spark, tmp_path, events)
    panes = runner.run_to_table(live.user_panes(stream(spark, str(tmp_path))), "panes")
    closed = batch(spark, events).where(F.col("ts") < F.lit(panes.agg(F.max("pane_end")).first()[0]).cast("timestamp"))
    exact = {r["window_start"]: r["users"] for r in live.online_users_exact(closed).collect()}
    got = {r["window_start"]: r["users"] for r in live.pane_windows(panes).collect()}
    assert got.keys() == exact.keys() and len(got) > 700
    assert all(abs(got[k] - n) <= 1 + 3 * live.SKETCH_ERROR * n for k, n in exact.items())
    days = {r["day"]: r["users"] for r in live.merge_panes(panes, F.to_date("pane_start").alias("day")).collect()}
    want = {r["day"]: r["n"] for r in closed.groupBy(F.to_date("ts").alias("day")).agg(F.countDistinct("user_id").alias("n")).collect()}
    assert days.keys() == want.keys()
    assert all(abs(days[d] - n) <= 3 * live.SKETCH_ERROR * n for d, n in want.items())
    [[every]] = live.merge_panes(panes).collect()
    number = closed.select("user_id").distinct().count()
    assert every == pytest.approx(number, rel=3 * live.SKETCH_ERROR) and number > 10000


def test_every_event_is_kept_a_copy_or_late(spark, tmp_path):
    rng = random.Random(11)
    events = [event(i, i, kind=rng.choice(["view", "purchase"])) for i in range(240)]
    batches = [[] for _ in range(6)]
    for i, e in enumerate(events):
        own = i // 40
        batches[own].append(e)
        if i % 4 == 0:
            batches[own].append(e)  # a copy at once
        if i % 7 == 0 and own < 5:
            batches[own + 1].append(e)  # late, or a copy if it is young enough
        if i % 50 == 9 and own < 4:
            batches[own + 2].append(event(1000 + i, i))  # too late, and new
    batches[2] += [(None, T0 + dt.timedelta(minutes=119), 1, "view", 1.0, "{}")] * 2 + [(None, None, 1, "view", 1.0, "{}")]
    for k, rows in enumerate(batches):
        rng.shuffle(rows)
        write(spark, tmp_path / "in", rows, f"events-{k}")
    got, metrics = lateness.run_split(stream(spark, str(tmp_path / "in")), folder=str(tmp_path / "out"))

    want, seen, high = [], set(), None
    for rows in batches:
        floor = None if high is None else high - dt.timedelta(minutes=10)
        for e in rows:
            if e[1] is None or (floor is not None and e[1] < floor):
                want.append((e[0], "late"))
            elif e[0] is not None and e[0] in seen:
                want.append((e[0], "copy"))
            else:
                want.append((e[0], "kept"))
                seen.add(e[0])
        high = max([e[1] for e in rows if e[1] is not None] + ([high] if high else []))
    found = [(r["event_id"], r["status"]) for r in got.collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    numbers = {s: sum(1 for _, x in want if x == s) for s in ("kept", "copy", "late")}
    assert min(numbers.values()) > 10
    assert {s: sum(m[s] for m in metrics) for s in numbers} == numbers
    assert sum(m["rows"] for m in metrics) == sum(map(len, batches))
    assert got.where("status = 'late'").inputFiles() and all(
        "status=late" in f for f in spark.read.parquet(f"{tmp_path}/out/rows/status=late").inputFiles())

    # Nothing new: nothing twice. A row that is late by the stored watermark stays late after a restart.
    write(spark, tmp_path / "in", [event(5000, 1), event(5001, 238), event(238, 238)], "events-8")
    again, metrics = lateness.run_split(stream(spark, str(tmp_path / "in")), folder=str(tmp_path / "out"))
    new = sorted(((r["event_id"], r["status"]) for r in again.collect()), key=str)
    assert new == sorted([*found, (5000, "late"), (5001, "kept"), (238, "copy")], key=str)


# One pass over what a batch closes

class Held:
    """A SKU's state, timers and the number of moves that were read, in plain Python."""

    def __init__(self):
        self.timers, self.values, self.lists, self.read = set(), {}, {}, 0

    def getValueState(self, name, schema):
        held = self.values

        class Value:
            exists = staticmethod(lambda: name in held)
            get = staticmethod(lambda: held.get(name))
            update = staticmethod(lambda value: held.__setitem__(name, value))
        return Value

    def getListState(self, name, schema):
        mine = self

        class Rows:
            @staticmethod
            def get():
                found = mine.lists.get(name, [])
                mine.read += sum(len(r[0]) // ledger._MOVE.itemsize if len(r) == 1 else 1 for r in found)
                return iter(list(found))
            appendList = staticmethod(lambda rows: mine.lists.setdefault(name, []).extend(rows))
            appendValue = staticmethod(lambda row: mine.lists.setdefault(name, []).append(row))
            put = staticmethod(lambda rows: mine.lists.__setitem__(name, list(rows)))
            clear = staticmethod(lambda: mine.lists.pop(name, None))
        return Rows

    def registerTimer(self, end):
        self.timers.add(end)


class Passed:
    def __init__(self, end):
        self.end = end

    def getCurrentWatermarkInMs(self):
        return self.end

    def getExpiryTimeInMs(self):
        return self.end


def passes(hours, until):
    """One input of a purchase an hour; then the timers that `until` hours have passed."""
    held, book = Held(), ledger.StockLedger()
    book.init(held)
    at_hour = [T0 + dt.timedelta(hours=h) for h in range(hours)]
    rows = pd.DataFrame({"sku": "a", "ts": at_hour, "kind": ledger.PURCHASE, "known": 1, "event_id": range(hours), "qty": 1})
    list(book.handleInputRows(("a",), iter([rows]), Passed(0)))
    now = int(T0.replace(tzinfo=dt.UTC).timestamp() * 1000) + until * ledger.HOUR_MS
    out = []
    while due := sorted(t for t in held.timers if t <= now):
        held.timers.remove(due[0])
        fired = Passed(due[0])
        out += book.handleExpiredTimer(("a",), Passed(now), fired)
    return held, pd.concat(out)


def test_a_batch_that_closes_many_hours_reads_its_moves_once():
    held, out = passes(500, 400)
    assert held.read == 500
    assert int(out["event_id"].notna().sum()) == 400 and sorted(out["event_id"].dropna()) == list(range(400))
    assert len(held.timers) == 1  # the first of the hours that are still open


def test_hours_closed_in_one_pass_have_their_own_orders():
    held, out = passes(300, 300)
    closed = out[out["orders"].notna()]
    assert held.read == 300 and len(closed) == 300 and set(closed["orders"]) == {1}
    assert not held.timers and not held.lists and "stock" not in held.values  # no delivery: no stock


def test_a_new_checkpoint_has_no_more_state_partitions_than_asked_for(spark, tmp_path):
    events, deliveries = case(4)
    write(spark, str(tmp_path / "sold"), events, "events-0")
    deliver(spark, str(tmp_path / "came"), deliveries, "came-0")
    came = spark.readStream.schema(MOVES).option("recursiveFileLookup", True).parquet(str(tmp_path / "came"))
    stocked = ledger.running_stock(ledger.moves(stream(spark, str(tmp_path / "sold")), came))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    folder = tmp_path / "run"
    got = runner.run_to_table(stocked, "ledger", str(folder), most_partitions=2)
    assert sorted(p.name for p in (folder / "checkpoint/state/0").iterdir() if p.name.isdigit()) == ["0", "1"]
    assert spark.conf.get("spark.sql.shuffle.partitions") == before != "2"
    assert sorted(map(tuple, got.collect()), key=str) == run(spark, str(tmp_path / "sold"), str(tmp_path / "came"), str(tmp_path / "plain"))
