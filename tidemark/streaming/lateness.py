"""Events told apart by the watermark: kept once, copies, and those that came too late.

An operator with an event-time column drops late rows before they are seen. Here the operator gets the
time as a number, so all rows reach it, and compares them with the watermark itself. What it says of a
row goes to the row's own folder of one table, so that late rows can be counted, looked at and booked by
hand. Every row is in exactly one: ``kept + copy + late`` is the input.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.session import work_folder
from tidemark.streaming.live import DELAY

KEPT, COPY, LATE = "kept", "copy", "late"
METRICS = "arrivals"
_KEY, _ID, _AT = "id_group", "id_text", "at_micros"
#: Groups of ids; a group's rows of a batch are handled together.
GROUPS = 256


class TellApart(StatefulProcessor):
    """Says of each row of a group of ids whether it is late, the first of its id or a copy.

    The state lists the ids of the group that were seen, each until the watermark has passed its last
    row: any further row of that time is late then. A timer clears a group that gets no more rows. A
    row older than the watermark is late, whether or not its id was seen. Rows without an id are no
    copies of each other.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "id string, until bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        until = {own: end for own, end in self.seen.get() if end > watermark}
        for batch in rows:
            said = []
            for own, at in zip(batch[_ID], batch[_AT], strict=True):
                if pd.isna(at) or at < watermark * 1000:
                    said.append(LATE)
                    continue
                copy = own is not None and own in until
                said.append(COPY if copy else KEPT)
                if own is not None:
                    until[own] = max(until.get(own, 0), int(at) // 1000 + 1)
            yield batch.assign(status=said)
        self._keep(until)

    def _keep(self, until: dict[str, int]) -> None:
        if until:
            self.seen.put(list(until.items()))
            self.handle.registerTimer(max(until.values()))
        else:
            self.seen.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        left = [row for row in self.seen.get() if row[1] > now]
        if left:
            self.seen.put(left)
        else:
            self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def tell_apart(events: DataFrame, delay: str = DELAY, groups: int = GROUPS) -> DataFrame:
    """The events of a stream with a ``status``; rows without a time are late.

    Each micro-batch reports the numbers of rows, kept, copies and late ones as observed metrics.
    """
    columns = events.columns
    named = F.col("event_id").cast("string")
    spread = F.pmod(F.when(named.isNull(), F.xxhash64(*columns)).otherwise(F.xxhash64(named)), F.lit(groups))
    marked = events.withWatermark("ts", delay).select(
        *[c for c in columns if c != "ts"], F.unix_micros("ts").alias(_AT), named.alias(_ID), spread.alias(_KEY))
    schema = T.StructType([*marked.schema.fields, T.StructField("status", T.StringType())])
    told = marked.groupBy(_KEY).transformWithStateInPandas(
        statefulProcessor=TellApart(), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    told = told.withColumn("ts", F.timestamp_micros(_AT)).select(*columns, "status")
    number = lambda status: F.count_if(F.col("status") == status).alias(status)
    return told.observe(METRICS, F.count(F.lit(1)).alias("rows"), number(KEPT), number(COPY), number(LATE))


def run_split(events: DataFrame, label: str = "arrivals", folder: str | None = None,
              delay: str = DELAY) -> tuple[DataFrame, list[dict]]:
    """Process all available input: the rows with their status, stored apart by it, and each batch's metrics."""
    spark = events.sparkSession
    base = folder or work_folder(spark, label)
    told = tell_apart(events, delay)
    query = told.writeStream.outputMode("append").format("parquet").partitionBy("status").option(
        "path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    metrics = [dict(p["observedMetrics"][METRICS].asDict()) for p in query.recentProgress if METRICS in p["observedMetrics"]]
    return spark.read.schema(told.schema).parquet(f"{base}/rows"), metrics
