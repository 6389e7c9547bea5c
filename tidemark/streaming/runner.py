"""Running streams over what is available now.

A stream runs until its input is used up, however long that takes. Rows and checkpoint lie in
folders that the caller may name; a run that was cut off goes on from there when it is called
again with the same ones, and repeats no row. Without names they get a fresh working folder.
The session's settings are left alone; the number of state partitions is the number of shuffle
partitions when a checkpoint begins, or a smaller one that the caller asks for.
"""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.operators.ranking import newest
from tidemark.session import work_folder


@contextmanager
def _at_most(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    """Shuffle partitions bounded for streams that start within; a stream keeps the settings it started with."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    if partitions is None or int(before) <= partitions:
        yield
        return
    spark.conf.set(key, partitions)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run_to_table(stream: DataFrame, label: str, folder: str | None = None, most_partitions: int | None = None) -> DataFrame:
    """Process all available input in append mode; the finished rows as a table.

    A new checkpoint has `most_partitions` state partitions at most; one that is there keeps its number.
    """
    spark = stream.sparkSession
    base = folder or work_folder(spark, label)
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/rows").option(
        "checkpointLocation", f"{base}/checkpoint"
    ).trigger(availableNow=True)
    with _at_most(spark, most_partitions):
        running = writer.start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def _read_if_there(spark, schema, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def run_ticker(stream: DataFrame, label: str = "ticker", n: int = fv.TICKER_ROWS, folder: str | None = None) -> DataFrame:
    """The newest ``n`` rows of a stream.

    Each micro-batch writes the newest rows so far, its own and those of the batch before, to one of
    two folders in turn; a repeated batch writes the same again. So ``2 n`` rows are stored at most.
    """
    spark = stream.sparkSession
    base = folder or work_folder(spark, label)
    schema = stream.schema.add("batch", "long")

    def slot(number: int) -> str:
        return f"{base}/rows/slot={number % 2}"

    def keep(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = batch.drop("batch")
        before = _read_if_there(session, schema, slot(number + 1))
        if before is not None:
            rows = rows.unionByName(before.drop("batch"))
        kept = newest(rows, n).selectExpr("*", f"{number}L AS batch")
        kept.coalesce(1).write.mode("overwrite").parquet(slot(number))

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(
        availableNow=True
    ).start().awaitTermination()
    last, rows = -1, spark.createDataFrame([], stream.schema)
    for i in range(2):
        found = _read_if_there(spark, schema, slot(i))
        number = None if found is None else found.agg(F.max("batch")).first()[0]
        if number is not None and number > last:
            last, rows = number, found.drop("batch")
    return newest(rows, n)
