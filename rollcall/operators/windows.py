"""Per-step ranking windows over rollouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import staged


def first_k_per_step(df: DataFrame, k: int, step_col: str = "step",
                     order_cols: list[str] = ("prompt_id", "gen_idx")) -> DataFrame:
    """First k rows of each step. ``row_number() <= k`` lets Spark insert a
    per-partition group limit before the shuffle (WindowGroupLimit), so a
    hot step sends only k rows per map task."""
    w = W.partitionBy(step_col).orderBy(*order_cols)
    return df.withColumn("rank_in_step", F.row_number().over(w)).where(F.col("rank_in_step") <= k)


def _numbered(df: DataFrame, by: str, order: str, out: str) -> DataFrame:
    """Adds the 1-based position of each row within its ``by`` key in the order
    of ``order``, without bringing a key into one task: rows are range-partitioned
    and numbered inside each partition, and each (partition, key) starts where the
    partitions before it end. The offsets are one row per partition and key. The
    numbered rows are written once to the shared folder: offsets and result must
    see the same partitions, which a second range exchange does not promise."""
    parts = df.repartitionByRange(by, order).withColumn("_part", F.spark_partition_id())
    inside = staged(parts.withColumn("_at", F.row_number().over(W.partitionBy("_part", by).orderBy(order))), "positions")
    ends = inside.groupBy(F.col("_part").alias("_p"), F.col(by).alias("_by")).agg(F.max("_at").alias("_n"))
    before = ends.withColumn("_before", F.coalesce(F.sum("_n").over(
        W.partitionBy("_by").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return inside.join(before, (F.col("_part") == F.col("_p")) & F.col(by).eqNullSafe(F.col("_by"))) \
        .withColumn(out, (F.col("_at") + F.col("_before")).cast("bigint")) \
        .drop("_part", "_at", "_before", "_p", "_by")


def positional_groups(df: DataFrame, num_generations: int, step_col: str = "step",
                      pos_col: str = "rollout_id") -> DataFrame:
    """Prompt group from position in the batch: ``floor((rn-1)/G)``; only
    for inputs that carry no prompt key. ``pos_col`` is unique."""
    d = _numbered(df, step_col, pos_col, "_rn")
    return d.withColumn("pos_group", F.floor((F.col("_rn") - 1) / num_generations).cast("bigint")).drop("_rn")


def call_counter(df: DataFrame, batch_col: str = "step") -> DataFrame:
    """Sequential call number per batch key (dense rank; a null key comes first):
    the distinct keys are range-partitioned and numbered, written once, then
    joined back. The offsets and the numbers see the same written partitions."""
    keys = df.select(F.col(batch_col).alias("_key")).distinct().repartitionByRange("_key").withColumn("_part", F.spark_partition_id())
    inside = staged(keys.withColumn("_at", F.row_number().over(W.partitionBy("_part").orderBy("_key"))), "call-numbers")
    # one row per partition: the only window without a key
    ends = inside.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = inside.join(ends, "_part").select("_key", (F.col("_at") + F.col("_before")).cast("bigint").alias("call_no"))
    return df.join(ranked, F.col(batch_col).eqNullSafe(F.col("_key"))).drop("_key")
