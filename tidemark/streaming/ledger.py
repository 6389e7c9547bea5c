"""Running stock per SKU on a stream: arbitrary keyed state with event-time timers.

Moves are deliveries and purchases: ``sku, ts, kind, event_id, qty``. A delivery sets the SKU's
stock to its quantity; a purchase takes one unit. Rows may arrive in any order within the
watermark's delay: they wait in the SKU's state until a timer at the end of their period fires,
and are then booked by ``(ts, kind, event_id)``. So the ledger is the same however the input was
cut into batches, and equals a running sum over the finished table.

State of a SKU (RocksDB): its stock, and the moves of the periods that are still open, packed to
arrays. Nothing is held of periods that are closed. A timer books all periods that the watermark
has passed in one pass and leaves a timer for the next open one, so that a batch that closes
many periods reads their moves once.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.live import DELAY, purchases

DELIVERY, PURCHASE = 0, 1
HOUR_MS = 3_600_000
LEDGER = (
    "sku string, ts timestamp, event_id bigint, remaining bigint, orders bigint, eta_oos_mins double"
)
#: A move as it waits in the state; `known` tells whether it has an event_id.
_MOVE = np.dtype([("ts", "<i8"), ("kind", "i1"), ("known", "i1"), ("event_id", "<i8"), ("qty", "<i8")])
#: Moves in one array of the state, and rows in one frame of the ledger.
CHUNK = 20_000


def moves(events: DataFrame, deliveries: DataFrame, delay: str = DELAY) -> DataFrame:
    """Purchases of ``events`` and ``deliveries`` (``sku, ts, qty``) as one stream (or batch) of moves.

    Purchases without a SKU move no stock. A delivery without a quantity tells nothing.
    """
    sold = purchases(events).where("sku is not null and ts is not null").select(
        "sku", "ts", F.lit(PURCHASE).alias("kind"), F.col("event_id").cast("bigint"), F.lit(1).cast("bigint").alias("qty")
    )
    came = deliveries.where("sku is not null and ts is not null and qty is not null").select(
        "sku", "ts", F.lit(DELIVERY).alias("kind"), F.lit(None).cast("bigint").alias("event_id"),
        F.col("qty").cast("bigint"),
    )
    return sold.unionByName(came).withWatermark("ts", delay)


class StockLedger(StatefulProcessor):
    """Books the moves of a SKU when the watermark has passed the end of their period.

    A purchase gives a row with the stock that it leaves (null before the first delivery; below
    zero where more was sold than there was). A period with purchases ends with a row without
    an event: the stock, the number of orders and the minutes until the stock is sold at that pace.
    """

    def __init__(self, period_ms: int = HOUR_MS):
        self.period_ms = period_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stock = handle.getValueState("stock", "qty bigint")
        self.open = handle.getListState("open", "moves binary")

    def _ends(self, moves: np.ndarray) -> np.ndarray:
        """The end of each move's period, in milliseconds."""
        return (moves["ts"] // 1000 // self.period_ms + 1) * self.period_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            new = np.zeros(len(batch), _MOVE)
            new["ts"] = batch["ts"].to_numpy("datetime64[us]").astype("int64")
            for column in ("kind", "known", "event_id", "qty"):
                new[column] = batch[column].to_numpy()
            if len(new):
                self.open.appendValue((new.tobytes(),))
                end = int(self._ends(new).min())
                first = end if first is None else min(first, end)
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = [np.frombuffer(row[0], _MOVE) for row in self.open.get()]
        if not held:  # a timer before this one has booked them
            return
        waiting = np.concatenate(held)
        ends = self._ends(waiting)
        due, later = waiting[ends <= passed], waiting[ends > passed]
        if not len(due):
            return
        if len(later):
            self.open.put([(later[i:i + CHUNK].tobytes(),) for i in range(0, len(later), CHUNK)])
            self.handle.registerTimer(int(ends[ends > passed].min()))
        else:
            self.open.clear()
        stock = self.stock.get() if self.stock.exists() else None
        yield from self._book(key[0], due, None if stock is None else stock[0])

    def _book(self, sku: str, due: np.ndarray, stock: int | None) -> Iterator[pd.DataFrame]:
        """The rows of moves of closed periods; the stock that they leave goes to the state."""
        due = due[np.lexsort([due[c] for c in ("qty", "event_id", "kind", "ts")])]
        sold = due["kind"] == PURCHASE
        number = np.cumsum(sold)
        # What was there at the last delivery before each move, less what was sold since.
        last = np.maximum.accumulate(np.where(sold, -1, np.arange(len(due))))
        left = np.where(last >= 0, due["qty"][last] + number[last], 0 if stock is None else stock) - number
        known = (last >= 0) | (stock is not None)
        if known[-1]:
            self.stock.update((int(left[-1]),))

        ends = self._ends(due)
        close = np.flatnonzero(np.append(ends[1:] != ends[:-1], True))  # the last move of each period
        orders = np.diff(number[close], prepend=0)
        close, orders = close[orders > 0], orders[orders > 0]
        eta = 60.0 * np.maximum(left[close], 0) / orders * (self.period_ms / HOUR_MS)
        at = np.flatnonzero(sold)
        none = np.zeros(len(close), bool)
        ts = np.concatenate([due["ts"][at], ends[close] * 1000])
        columns = {
            "event_id": (np.concatenate([due["event_id"][at], ends[close]]), np.concatenate([due["known"][at] != 0, none])),
            "remaining": (np.concatenate([left[at], left[close]]), np.concatenate([known[at], known[close]])),
            "orders": (np.concatenate([at, orders]), np.concatenate([np.zeros(len(at), bool), ~none])),
        }
        minutes = np.concatenate([np.full(len(at), np.nan), np.where(known[close], eta, np.nan)])
        for i in range(0, len(ts), CHUNK):
            part = slice(i, i + CHUNK)
            whole = {c: pd.arrays.IntegerArray(v[part].astype("int64"), ~there[part]) for c, (v, there) in columns.items()}
            yield pd.DataFrame({"sku": sku, "ts": ts[part].astype("datetime64[us]"), **whole, "eta_oos_mins": minutes[part]})

    def close(self) -> None:
        pass


def running_stock(stream: DataFrame, period_ms: int = HOUR_MS) -> DataFrame:
    """The ledger of a stream of ``moves``, in append mode; needs the RocksDB state store.

    Rows of purchases have an ``event_id``; rows that close a period have ``orders``.
    """
    # Moves without an event come before those with one; whole numbers stay whole beside no nulls.
    known = F.col("event_id").isNotNull().cast("tinyint").alias("known")
    plain = stream.select("sku", "ts", "kind", known, F.coalesce("event_id", F.lit(-1).cast("bigint")).alias("event_id"), "qty")
    return plain.groupBy("sku").transformWithStateInPandas(
        statefulProcessor=StockLedger(period_ms), outputStructType=LEDGER, outputMode="Append", timeMode="EventTime"
    )
