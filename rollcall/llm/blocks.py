"""Blocks of documents: contiguous ranges of the id, of about equal bytes.

A block is the unit that one task call sees; it is bounded by ``block_bytes``
(and by the longest document), and by ``BLOCK_ROWS`` rows. Blocks are ordered as their ids. Where one id (or
null) holds a block's share of the rows and more than ``block_bytes``, its rows
are a block of their own, cut into parts by ranges of the text, with repeated
rows counted instead of kept.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from .storage import shuffle_partitions, stage

#: Rows of a block, however short their texts: a row counts as its share of ``block_bytes`` besides its text.
BLOCK_ROWS = 8192
#: The unit of one task call.
UNIT = ["block", "part"]


def with_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = 4 << 20):
    """(id, text, block, part, n, leads), whether rows were counted, bytes of text and rows.

    Split points are approximate quantiles of the id (8 bytes a block on the
    driver); a null id goes to the last block. ``n`` is how many equal rows a
    row stands for (1 outside divided blocks). ``leads`` marks the first row of
    a part in order of the text; it is null outside divided blocks."""
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    number = F.col("id").cast("double")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(block_bytes // BLOCK_ROWS)
    total, unnamed = df.agg(F.sum(size), F.sum(F.when(F.col("id").isNull(), size))).first()
    total, unnamed = total or 0, unnamed or 0
    want = max(math.ceil(total / block_bytes), min(shuffle_partitions(docs.sparkSession), math.ceil(total / 65536)), 1)
    cuts = df.select(number.alias("id")).approxQuantile(
        "id", [i / want for i in range(1, want)], 1 / (4 * want)) if want > 1 else []
    # an id that fills a block is a cut at least twice
    twice = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    large = {} if not twice else {r.at: r.bytes for r in df.where(number.isin(twice)).groupBy(number.alias("at"))
             .agg(F.sum(size).alias("bytes"), F.min("id").alias("lo"), F.max("id").alias("hi"))
             .where((F.col("lo") == F.col("hi")) & (F.col("bytes") > block_bytes)).collect()}
    divided = unnamed > block_bytes
    splits = [-math.inf, *sorted({*cuts, *large, *(math.nextafter(c, math.inf) for c in large)}), math.inf]
    if len(splits) < 3:
        out = df.withColumn("block", F.when(F.col("id").isNull() & F.lit(divided), 1).otherwise(0))
        hot = [1] if divided else []
    else:
        cut = Bucketizer(splits=splits, inputCol="id_", outputCol="block_", handleInvalid="keep")
        out = cut.transform(df.withColumn("id_", F.coalesce(number, F.lit(float("nan"))))) \
            .select("id", "text", F.col("block_").cast("int").alias("block"))
        hot = [splits.index(c) for c in large] + ([len(splits) - 1] if divided else [])
    whole = out.withColumns({"part": F.lit(0), "n": F.lit(1).cast("long"), "leads": F.lit(None).cast("boolean")})
    if not hot:
        return whole, False, total
    parts = math.ceil((sum(large.values()) + unnamed * divided) / block_bytes) + 1
    # written once, as two range exchanges may cut differently
    rows = out.where(F.col("block").isin(hot)).groupBy("id", "text", "block").agg(F.count(F.lit(1)).alias("n"))
    rows = stage(rows.repartitionByRange(parts, "block", "text").withColumn("part", F.spark_partition_id()), "ties")
    first = F.row_number().over(Window.partitionBy(*UNIT).orderBy("text")) == 1
    rows = rows.withColumn("leads", first).select(*whole.columns)
    return whole.where(~F.col("block").isin(hot)).unionByName(rows), True, total


def repeated(df: DataFrame) -> DataFrame:
    """Every row ``n`` times, without ``n``."""
    return df.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")
