"""Shared-folder tables: the only way this package cuts lineage."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rollcall.session import checkpoint_dir, ship_package

#: Rows of a text table that a Python worker holds at once.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; without one this raises."""
    return checkpoint_dir(spark).rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows of ``schema``. ``createDataFrame`` would start Python workers in
    every executor for them, which stay there."""
    return spark.range(0).where("false").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's ``rows`` (not none), by way of Arrow: from a
    list, ``createDataFrame`` starts Python workers in every executor, which stay there."""
    fields = StructType.fromDDL(schema)
    return spark.createDataFrame(pa.table([list(c) for c in zip(*rows)], schema=to_arrow_schema(fields)), fields)


def small_batches(spark: SparkSession) -> None:
    """From now on at most ``BATCH_ROWS`` rows go to a Python worker at once: the
    buffers of both sides stay with the executor (Spark's default is 10,000 rows)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers."""
    ship_package(spark)
