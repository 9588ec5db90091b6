"""Work on keys that may hold a large share of all rows: statistics joined back
without a hot task, exact quantiles without a buffer of values.

Neither depends on adaptive skew joins: Spark does not split a join whose other
side is an aggregate on the join key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import staged


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)])


def salted_join(df: DataFrame, stats: DataFrame, keys: list[str], rows_col: str, hot_rows: int = 100_000, how: str = "inner") -> DataFrame:
    """``df`` joined to one row a key of ``stats`` (a written table), whose column
    ``rows_col`` counts the key's rows in ``df``. Null keys join. ``how`` "left"
    keeps the rows of ``df`` whose key ``stats`` has not.

    A key is hot above ``hot_rows`` rows, or a 100,000th of all rows if that is
    more: so at most 100,000 hot keys exist, which are broadcast to mark their
    rows. Marked rows are dealt over as many salts as the key fills, by a hash of
    the whole row, and the key's statistics are repeated for each salt."""
    own = [f"_key{i}" for i in range(len(keys))]
    small = stats.withColumnsRenamed(dict(zip(keys, own)))
    every = small.agg(F.sum(rows_col)).first()[0] or 0
    limit = max(hot_rows, every // 100_000)
    hot = small.where(F.col(rows_col) > limit).select(*[F.col(c).alias(f"{c}h") for c in own], F.ceil(F.col(rows_col) / limit).alias("_salts"))
    if not hot.head(1):
        return df.join(small, _same(keys, own), how).drop(*own, rows_col)
    plain = [f.name for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    marked = df.join(F.broadcast(hot), _same(keys, [f"{c}h" for c in own]), "left") \
        .withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*plain), F.col("_salts")))) \
        .drop("_salts", *[f"{c}h" for c in own])
    spread = F.when(F.col(rows_col) > limit, F.ceil(F.col(rows_col) / limit)).otherwise(F.lit(1))
    repeated = small.withColumn("_of_salt", F.explode(F.sequence(F.lit(0).cast("long"), spread.cast("long") - 1)))
    return marked.join(repeated, _same([*keys, "_salt"], [*own, "_of_salt"]), how).drop(*own, rows_col, "_salt", "_of_salt")


def counted_values(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, _n) written once: how often each value occurs; nulls left out."""
    return staged(values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")), "counted")


def quantiles(counted: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(keys, one double column for each name of ``at``): exact quantiles with
    linear interpolation, as ``percentile`` gives them, from ``counted_values``.

    Ranks instead of buffers: the counted values are range-partitioned, each
    partition sums its counts in order, and each (partition, key) starts at the
    sum of the partitions before it. Only the values that hold a wanted rank go
    on. A hot key's values lie in many partitions."""
    parts = staged(counted.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = parts.withColumn("_end", F.sum("_n").over(W.partitionBy("_part", *keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)))
    own = [f"_key{i}" for i in range(len(keys))]
    # one row per partition and key
    sums = parts.groupBy(F.col("_part").alias("_p"), *[F.col(k).alias(o) for k, o in zip(keys, own)]).agg(F.sum("_n").alias("_sum"))
    over = W.partitionBy(*own)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(over.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))) \
        .withColumn("_all", F.sum("_sum").over(over)).drop("_sum")
    placed = inside.join(sums, _same(["_part", *keys], ["_p", *own])) \
        .withColumn("_to", F.col("_before") + F.col("_end")).withColumn("_from", F.col("_before") + F.col("_end") - F.col("_n"))

    def holds(rank: Column) -> Column:
        return (F.col("_from") <= rank) & (rank < F.col("_to"))

    spot = {name: F.lit(float(q)) * (F.col("_all") - 1) for name, q in at.items()}
    ends = {name: (F.floor(x), F.ceil(x)) for name, x in spot.items()}
    wanted = reduce(lambda a, b: a | b, [holds(r) for pair in ends.values() for r in pair])
    v = F.col(value).cast("double")
    found = placed.where(wanted).groupBy(*keys).agg(F.max("_all").alias("_all"), *[
        F.max(F.when(holds(r), v)).alias(f"_{name}{i}") for name, pair in ends.items() for i, r in enumerate(pair)])

    def between(name: str) -> Column:
        x, (lo, hi) = spot[name], ends[name]
        a, b = F.col(f"_{name}0"), F.col(f"_{name}1")
        return F.when(lo == hi, a).otherwise((hi - x) * a + (x - lo) * b)

    return found.select(*keys, *[between(name).alias(name) for name in at])
