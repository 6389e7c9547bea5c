"""Session settings and the shared working folder."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on; they can be set on a running session.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The per-task cut of a top-k by rank holds for any k that a caller asks for.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000000",
    # Merge a user's open sessions before the shuffle, so a hot user sends few rows.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # Keyed state (SKU-hours, event ids) outgrows the executor heap on a long stream.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
START_SETTINGS = {
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, **extra: str) -> SparkSession:
    """A session with the engine's settings; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName("tidemark")
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **START_SETTINGS}.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder for intermediate tables and stream checkpoints.

    It lies in the shared folder named by ``spark.checkpoint.dir`` (or set on the context).
    Only a local session without one, as in a test, gets a temporary folder of its own.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/tidemark-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a result that several later steps read, and read it back.

    It cuts the lineage and survives lost executors: the rows lie in the shared folder.
    """
    spark = df.sparkSession
    path = work_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
