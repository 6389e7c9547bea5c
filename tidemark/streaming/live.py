"""Live metrics. Each function takes a stream or a batch of events alike.

Events: ``event_id, ts (timestamp), user_id, event_type, value, sku``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.exact import exact_sum
from tidemark.functions.scalars import as_col
from tidemark.functions.stock import available_quantity

DELAY = "10 minutes"
HOUR = "1 hour"


def purchases(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == "purchase")


def on_time(events: DataFrame, delay: str = DELAY) -> DataFrame:
    return events.withWatermark("ts", delay)


def deduplicate(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Each event once; rows later than the watermark are dropped on a stream.

    Equal copies are merged by a grouping, which combines before the shuffle: an event
    copied millions of times arrives as one row per task. What is left are copies of an id
    at different times.
    """
    merged = on_time(events, delay).groupBy(*events.columns).agg(F.count(F.lit(1)).alias("copies"))
    merged = merged.drop("copies")
    if events.isStreaming:
        return merged.dropDuplicatesWithinWatermark(["event_id"])
    first = F.min_by(F.struct(*events.columns), F.struct(*events.columns)).alias("row")
    return merged.groupBy("event_id").agg(first).select("row.*")


def _ntz(column: str) -> Column:
    return F.col(column).cast("timestamp_ntz")


def gmv_by_hour(events: DataFrame) -> DataFrame:
    """Purchase amount and number of orders per hour."""
    return (
        on_time(purchases(events))
        .groupBy(F.window("ts", HOUR))
        .agg(exact_sum("value").alias("gmv"), F.count(F.lit(1)).alias("orders"))
        .select(
            _ntz("window.start").alias("hour_start"), _ntz("window.end").alias("hour_end"),
            "gmv", "orders",
        )
    )


def pacing(hourly: DataFrame, target) -> DataFrame:
    """Hourly amount as a percentage of the target."""
    share = F.col("gmv") / F.nullif(as_col(target), F.lit(0.0))
    return hourly.withColumn("pct_of_target", share * F.lit(100.0))


def velocity(hourly: DataFrame) -> DataFrame:
    """Orders per minute and the change against the clock hour before, in percent.

    Takes finished hours; the hour before is found by an equi-join, so no ordered window
    over all hours is needed. No value when that hour had no orders.
    """
    before = hourly.select(
        F.col("hour_end").alias("hour_start"), F.col("orders").alias("orders_before")
    )
    change = (F.col("orders") - F.col("orders_before")) / F.col("orders_before") * F.lit(100.0)
    return hourly.join(before, "hour_start", "left").select(
        "hour_start",
        "orders",
        (F.col("orders") / F.lit(60.0)).alias("orders_per_min"),
        change.alias("delta_pct"),
    )


def _closing_hours(events: DataFrame) -> DataFrame:
    """Orders per hour with the hour's closing time, which carries the watermark on."""
    counted = on_time(purchases(events)).groupBy(F.window("ts", HOUR)).agg(F.count(F.lit(1)).alias("orders"))
    return counted.select(
        F.window_time("window").alias("closing"), _ntz("window.start").alias("hour_start"),
        _ntz("window.end").alias("hour_end"), "orders",
    )


def velocity_stream(events: DataFrame, earlier: DataFrame) -> DataFrame:
    """``velocity`` while the stream runs: each hour joins the hour before it, both as streams.

    ``earlier`` is a second reading of the same stream. Both sides carry a watermark and the
    join bounds the time between them, so that the state holds the hours that are still open or
    wait for their neighbour, and no more. An hour whose neighbour had no orders is given without
    a change once the watermark rules that neighbour out.
    """
    now = _closing_hours(events)
    before = _closing_hours(earlier).select(
        F.col("closing").alias("closing_before"), F.col("hour_end").alias("end_before"),
        F.col("orders").alias("orders_before"),
    )
    next_to = (
        (F.col("hour_start") == F.col("end_before"))
        & (F.col("closing_before") >= F.col("closing") - F.expr(f"interval {HOUR}"))
        & (F.col("closing_before") <= F.col("closing") - F.expr(f"interval {HOUR}"))
    )
    change = (F.col("orders") - F.col("orders_before")) / F.col("orders_before") * F.lit(100.0)
    return now.join(before, next_to, "leftOuter").select(
        "hour_start", "orders", (F.col("orders") / F.lit(60.0)).alias("orders_per_min"), change.alias("delta_pct"),
    )


# Panes of users.
PANE = "5 minutes"
SKETCH_BITS = 12
#: One standard error of an estimate, as a part of the number: 1.04 / sqrt(2 ** SKETCH_BITS).
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def user_panes(events: DataFrame, width: str = PANE) -> DataFrame:
    """A mergeable sketch of the users of each pane of time; on a stream, of the finished panes.

    Users are merged to sketches before the shuffle, so a hot pane sends a few kilobytes a task.
    """
    return (
        on_time(events).where("user_id is not null")
        .groupBy(F.window("ts", width))
        .agg(F.hll_sketch_agg("user_id", SKETCH_BITS).alias("sketch"))
        .select(_ntz("window.start").alias("pane_start"), _ntz("window.end").alias("pane_end"), "sketch")
    )


def merge_panes(panes: DataFrame, *scope: Column) -> DataFrame:
    """Users per scope (any expressions over panes; none for all panes), from stored sketches alone."""
    return panes.groupBy(*scope).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("users"))


def pane_windows(panes: DataFrame, width_panes: int = 2) -> DataFrame:
    """Users per sliding window of so many panes that begins at every pane."""
    width = F.col("pane_end") - F.col("pane_start")
    starts = F.explode(F.array(*[F.col("pane_start") - width * k for k in range(width_panes)]))
    placed = panes.select(starts.alias("window_start"), (width * width_panes).alias("length"), "sketch")
    merged = merge_panes(placed, F.col("window_start"), F.col("length"))
    return merged.select("window_start", (F.col("window_start") + F.col("length")).alias("window_end"), "users")


def online_users(events: DataFrame, width: str = "10 minutes", slide: str = "5 minutes",
                 error: float = 0.05) -> DataFrame:
    """Approximate number of active users per sliding window."""
    return (
        on_time(events)
        .groupBy(F.window("ts", width, slide))
        .agg(F.approx_count_distinct("user_id", error).alias("users"))
        .select(
            _ntz("window.start").alias("window_start"), _ntz("window.end").alias("window_end"), "users"
        )
    )


def online_users_exact(events: DataFrame, width: str = "10 minutes", slide: str = "5 minutes") -> DataFrame:
    """Exact twin for finished data: distinct users are combined first, then counted."""
    seen = events.select(F.window("ts", width, slide).alias("w"), "user_id").distinct()
    return seen.groupBy("w").agg(F.count(F.lit(1)).alias("users")).select(
        _ntz("w.start").alias("window_start"), _ntz("w.end").alias("window_end"), "users"
    )


def sku_orders_by_hour(events: DataFrame, inventory: DataFrame) -> DataFrame:
    """Purchases per SKU and hour with the SKU's available stock.

    Purchases are counted first and meet the static inventory afterwards, once per SKU
    and hour.
    """
    counts = (
        on_time(purchases(events))
        .groupBy(F.window("ts", HOUR), "sku")
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    stock = inventory.select("sku", "name", available_quantity().alias("available"))
    return counts.join(stock, "sku", "left").select(
        _ntz("window.start").alias("hour_start"), _ntz("window.end").alias("hour_end"),
        "sku", "name", "orders", "available",
    )


def minutes_to_out_of_stock(sku_hours: DataFrame) -> DataFrame:
    """Minutes until the available stock is sold at the hour's pace; null without stock data."""
    return sku_hours.withColumn(
        "eta_oos_mins", F.lit(60.0) * F.col("available") / F.col("orders")
    )


def watchlist(sku_etas: DataFrame, paced: DataFrame) -> DataFrame:
    """Diagnosis and action per SKU and hour by the first rule that holds."""
    rules = [
        (F.col("eta_oos_mins") < fv.CRITICAL_MINUTES, fv.DIAGNOSIS_DEMAND),
        (F.col("pct_of_target") < fv.PACING_FLOOR * 100, fv.DIAGNOSIS_PACING),
    ]

    def pick(i):
        chain = F.when(rules[0][0], rules[0][1][i])
        for rule, texts in rules[1:]:
            chain = chain.when(rule, texts[i])
        return chain.otherwise(fv.DIAGNOSIS_ON_TRACK[i])

    return sku_etas.join(paced.select("hour_start", "pct_of_target"), "hour_start").withColumns(
        {"diagnosis": pick(0), "action": pick(1)}
    )


def critical(sku_etas: DataFrame, minutes: float = fv.CRITICAL_MINUTES) -> DataFrame:
    """SKUs that run out within so many minutes."""
    return sku_etas.where(F.col("eta_oos_mins") < minutes)


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """User sessions of a stream: a pause longer than the gap ends one."""
    return (
        on_time(events)
        .groupBy(F.session_window("ts", gap), "user_id")
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(
            "user_id", _ntz("session_window.start").alias("session_start"),
            _ntz("session_window.end").alias("session_end"), "n_events",
        )
    )


def sessions_batch(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """The same sessions from finished data, safe for a user who owns most events.

    Events closer than the gap are always in one session, so they are first merged per
    user and gap-sized slot; the ordered pass then sees a user's slots, not the events.
    """
    gap = gap_minutes * 60 * 1_000_000
    micros = F.unix_micros("ts")
    slots = events.groupBy("user_id", F.floor(micros / F.lit(gap)).alias("slot")).agg(
        F.min(micros).alias("lo"), F.max(micros).alias("hi"), F.count(F.lit(1)).alias("n")
    )
    w = W.partitionBy("user_id").orderBy("slot")
    starts = F.when(F.col("lo") - F.lag("hi").over(w) <= gap, 0).otherwise(1)
    return (
        slots.withColumn("is_start", starts)
        .withColumn("session", F.sum("is_start").over(w.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("user_id", "session")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n_events"))
        .select(
            "user_id",
            F.timestamp_micros("lo").cast("timestamp_ntz").alias("session_start"),
            F.timestamp_micros(F.col("hi") + gap).cast("timestamp_ntz").alias("session_end"),
            "n_events",
        )
    )
