"""Written intermediate tables in the shared folder of the cluster.

Each table goes to `<spark.checkpoint.dir>/tidemark-llm/<id>`; a lost executor then costs a reread
and never a recomputation, and the size of a reread table is known to the optimiser.
"""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tables with at most so many rows of a few numbers may be sent to every executor.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a fresh one is set only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to storage that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Give the executors this package, once an application, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="tidemark-")) / f"{root.name}-package.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(str(path))  # the driver serves it to the executors
    _sent.add(context.applicationId)


#: Most bytes of the rows that go to a Python worker at once, and the setting that bounds them.
BATCH_BYTES = "2m"
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python workers BATCH_BYTES at a time, unless the session sets a size of its own.

    By rows alone, 10,000 texts of 3 KB are one batch: a task then holds it in vectors that double as
    they grow, outside the heap, and its worker holds it with the one before.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def stage(df: DataFrame) -> DataFrame:
    """Write `df` and return what was written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast of a staged table of numbers, if its counted `rows` stay in the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def plain(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns cast to types; a column that `df` lacks is null.

    Only these columns go on, so other columns of `df` may have any names. A name that occurs
    twice in `df` is taken at its first place.
    """
    send_package(df.sparkSession)
    places = {}
    for i, name in enumerate(df.columns):
        places.setdefault(name, i)
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return numbered.select([
        (F.col(f"c{places[n]}") if n in places else F.lit(None)).cast(t).alias(n)
        for n, t in columns.items()
    ])


def annotated(documents: DataFrame, annotate: Callable[[pa.Array], Iterator[tuple[int, int, list[pa.Array]]]],
              **types: str) -> DataFrame:
    """`documents` with columns that are made of its text, in one pass and without a join.

    annotate: from a batch of texts, (first row, last row + 1, new columns) of groups of its rows.
    """
    send_package(documents.sparkSession)
    clash = set(types) & set(documents.columns)
    if clash or len(set(documents.columns)) < len(documents.columns):
        raise ValueError(f"column names clash: {sorted(clash) or documents.columns}")
    schema = T.StructType([*documents.schema.fields, *fields(**types).fields])
    place = documents.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, new in annotate(batch.column(place)):
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(lo, hi - lo) for c in batch.columns], *new], names=schema.names)

    return documents.mapInArrow(rows, schema)


#: Places of rows for `sampled` lie below this.
PLACES = 1 << 63


def place(*columns: str) -> Column:
    """A number below PLACES that the columns' values decide, with the full width of the hash."""
    return F.xxhash64(*columns).bitwiseAND(F.lit(PLACES - 1))


def below(share: float) -> int:
    """The bound on places that holds this share of them; above 0 for every share above 0."""
    return PLACES - 1 if share >= 1 else math.ceil(share * PLACES)


def quotas(there: dict[str, int], rows: int) -> dict[str, int]:
    """How many of `rows` each group gives: as equal as the groups' own numbers allow."""
    out, left = {}, rows
    for i, (name, number) in enumerate(sorted(there.items(), key=lambda x: (x[1], x[0]))):
        out[name] = min(number, left // (len(there) - i))
        left -= out[name]
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fields(**types: str) -> T.StructType:
    return T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in types.items()))
