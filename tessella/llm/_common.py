"""Helpers shared by the training-data operators.

Scratch tables go to the shared folder that the cluster names in ``spark.checkpoint.dir``; only where that
is unset (tests, a laptop) a folder of our own is made. A staged table is a written Parquet table: it cuts
lineage and survives the loss of an executor.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII A-Z to a-z, every other byte as it is; bytes.split() then cuts at exactly [\x20\x09-\x0D].
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
WHITESPACE = b" \t\n\v\f\r"

#: Rows, and bytes, of documents in one Arrow batch; a single longer text is a batch of its own.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20

_own_dir: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; one of our own only where Spark runs on one machine and none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="tessella-"))
    return _own_dir[0]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs whose plans are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes so that long texts don't add up to more than a worker may hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Other rows a batch for what runs inside; the session's setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_columns(df: DataFrame, function: Callable[[dict], dict], schema: str) -> DataFrame:
    """mapInArrow over whole batches: ``function`` gets and gives a dict of column lists."""
    from pyspark.sql.types import StructType

    spark_schema = StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, spark_schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` doesn't have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_fold(column: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def map_rows(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """mapInArrow that keeps the schema: for stages that drop or rewrite whole rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield function(batch)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)
