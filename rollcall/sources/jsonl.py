"""JSON-lines source, prepared-example sink and split helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

MESSAGE = StructType([StructField("role", StringType()), StructField("content", StringType()),
                      StructField("thinking", StringType())])
CHAT_SCHEMA = StructType([StructField("conv_id", LongType()), StructField("messages", ArrayType(MESSAGE)),
                          StructField("db_id", StringType()), StructField("database", StringType())])


def load_jsonl(spark: SparkSession, path: str, schema: StructType = CHAT_SCHEMA, limit: int | None = None) -> DataFrame:
    """Read JSON lines with a fixed schema; a malformed line fails the job
    (FAILFAST); blank lines and a UTF-8 BOM are tolerated.

    ``limit`` counts raw lines (blank ones included), file by file in path
    order and by offset inside a file; the lines are capped, then parsed.
    Without a limit the JSON reader splits files in parallel."""
    if limit is None:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"),
                                       F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    head = raw.orderBy("_file", "_block", "_line").limit(limit)
    body = F.regexp_replace(F.col("value"), "^\ufeff", "")
    return (head.where(~body.rlike(r"(?U)^\s*$"))
            .select(F.from_json(body, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*"))


def write_prepared(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select("conv_id", "prompt", "ground_truth_sql", "ground_truth_thinking", "database_name") \
        .write.mode(mode).parquet(path)


def replicate(df: DataFrame, n: int) -> DataFrame:
    """Each row n times (``explode(sequence)``: no join)."""
    return df.withColumn("replica", F.explode(F.sequence(F.lit(1), F.lit(n))))


def limit_rows(df: DataFrame, n: int | None, order_col: str) -> DataFrame:
    """Deterministic row cap (top-n by key; no cap when ``n`` is None)."""
    return df if n is None else df.orderBy(order_col).limit(n)


def holdout_flag(df: DataFrame, pct: int, key: Column | None = None) -> DataFrame:
    """Stable holdout: bucket = pmod(key, 100), default key xxhash64 of all
    columns; rows with bucket < pct are held out."""
    k = key if key is not None else F.xxhash64(*df.columns)
    return df.withColumn("is_holdout", F.pmod(k, F.lit(100)) < pct)


def dataset_sizes(splits: dict) -> DataFrame:
    """Raw / kept / dropped counts per split (union of small aggregates)."""
    out = None
    for name, d in splits.items():
        a = d.agg(F.count(F.lit(1)).alias("n_raw"), F.count_if(F.col("drop_reason").isNull()).alias("n_kept"),
                  F.count_if(F.col("drop_reason").isNotNull()).alias("n_dropped")).select(F.lit(name).alias("split"), "*")
        out = a if out is None else out.unionByName(a)
    return out
