"""Hot keys: salted join-back, quantiles by rank, numbering; tiles of matrices."""

import random
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.operators import code as C
from rollcall.operators import prepare as P
from rollcall.operators import ranks as R
from rollcall.operators import scores as S
from rollcall.operators import windows as W


@contextmanager
def conf(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plain_conf(spark, n=50):
    return conf(spark, spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__shuffle__partitions=str(n))


def half_in_one_group(spark, n=200_000):
    """Half of all rows in group 0, one row in forty in the null group."""
    g = F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 40 == 1, None).otherwise(F.col("id") % 5000)
    return spark.range(n).select("id", g.alias("g"), (F.col("id") % 97).cast("double").alias("r"))


def test_a_hot_group_is_spread_over_tasks(spark):
    df = half_in_one_group(spark)
    with plain_conf(spark):
        out = S.group_advantage(df, "r", ["g"], hot_rows=2000)
        shares = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(shares) == 200_000 and max(shares) < 0.1 * 200_000
        plain = S.group_advantage(df, "r", ["g"])
        assert max(r["count"] for r in plain.groupBy(F.spark_partition_id().alias("p")).count().collect()) >= 100_000


def test_salted_statistics_equal_plain_ones(spark):
    df = half_in_one_group(spark, 20_000)
    got = S.group_advantage(df, "r", ["g"], hot_rows=50)
    w = df.groupBy("g").agg(F.avg("r").alias("m"), F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("s")).withColumnRenamed("g", "g2")
    expect = df.join(w, F.col("g").eqNullSafe(F.col("g2"))).select("id", "g", "r", F.col("m").alias("group_mean"), F.col("s").alias("group_std"),
                                                                   ((F.col("r") - F.col("m")) / (F.col("s") + F.lit(1e-4))).alias("advantage"))
    assert got.columns == expect.columns
    key = lambda rows: sorted((r.id, round(r.group_mean, 9), round(r.group_std, 9), round(r.advantage, 6)) for r in rows)
    assert key(got.collect()) == key(expect.collect())
    assert S.group_advantage(df.limit(0), "r", ["g"]).count() == 0


@pytest.mark.parametrize("keys", [["k"], ["k", "h"], []])
def test_quantiles_equal_percentile(spark, keys):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 1, 1, 2]), rng.choice(["a", "b"]), rng.choice([None, rng.randrange(20), rng.randrange(10_000)])) for _ in range(5000)]
    rows += [(7, "a", None), (8, "a", 3)]
    df = spark.createDataFrame(rows, "k int, h string, v long").repartition(6)
    at = {"q0": 0.0, "q13": 0.13, "mid": 0.5, "q99": 0.99, "q1": 1.0}
    with plain_conf(spark, 9):
        got = R.quantiles(R.counted_values(df, keys, "v"), keys, "v", at).collect()
    expect = df.where("v is not null").groupBy(*keys).agg(*[F.percentile("v", q).alias(n) for n, q in at.items()]).collect()
    assert sorted(map(str, got)) == sorted(map(str, expect))


def test_no_value_buffer_in_the_plans(spark):
    lengths = spark.range(100).select(*[F.col("id").alias(f"{c}_tokens") for c in ("prompt", "completion", "thinking", "content", "total")],
                                      (F.col("id") % 2 == 0).alias("has_assistant"))
    samples = spark.range(100).select((F.col("id") % 3).alias("kernel_id"), F.col("id").alias("elapsed_ns"), F.lit("ok").alias("outcome"))
    for out in (P.token_stats(lengths), C.timing_summary(samples)):
        assert "percentile" not in out._jdf.queryExecution().toString().lower()
    empty = {r.series: (r.n, r["mean"], r.p99) for r in P.token_stats(lengths.limit(0)).collect()}
    assert empty == {s: (0, None, None) for s in ("prompt", "completion", "thinking", "sql", "total")}


def test_a_hot_kernel_lies_in_many_ranges(spark):
    """Half of all trials belong to kernel 0: its counted values fill many partitions."""
    df = spark.range(100_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.xxhash64("id").alias("v"))
    with plain_conf(spark, 20):
        counted = R.counted_values(df, ["k"], "v")
        shares = counted.repartitionByRange("k", "v").where("k = 0").groupBy(F.spark_partition_id()).count().collect()
        assert len(shares) >= 8
        got = R.quantiles(counted, ["k"], "v", {"m": 0.5}).where("k = 0").first().m
    assert got == df.where("k = 0").agg(F.percentile("v", 0.5)).first()[0]


def test_loops_and_exception_texts(spark):
    rows = [(1, 10, 3, "ok", None), (1, 11, 3, "exception", "E1"), (1, 20, 0, "exception", "E1"), (1, 5, None, "exception", None), (None, 9, 2, "timeout", None)]
    df = spark.createDataFrame(rows, "kernel_id int, elapsed_ns long, loops int, outcome string, error string")
    got = {r.kernel_id: r for r in C.timing_summary(df, loops_col="loops").collect()}
    assert (got[1].median_ns, got[1].mean_ns, got[1].exceptions, got[1].trials) == (4, 7, 3, 4)  # 3, 3, 20, 5
    assert (got[None].median_ns, got[None].timeouts, got[None].stdev_ns) == (4, 1, 0)
    assert sorted((r.kernel_id, r.text, r.n) for r in C.timing_exceptions(df).collect()) == [(1, "", 1), (1, "E1", 2)]
    speed = {r.kernel_id: r for r in C.speed_score(C.timing_summary(df.where("kernel_id = 1")), baseline_key=99).collect()}
    assert speed[1].base_ns is None and speed[1].speed_score is None


def test_call_numbers_without_exchange_reuse(spark):
    keys = spark.range(300_000).select((F.col("id") * 7 % 300_000).alias("step"), F.concat(F.lit("x"), "id").alias("text"))
    with conf(spark, spark__sql__exchange__reuse="false"):
        got = W.call_counter(keys).agg(F.count_distinct("call_no"), F.min("call_no"), F.max("call_no"),
                                       F.count_if(F.col("call_no") != F.col("step") + 1)).first()
    assert tuple(got) == (300_000, 1, 300_000, 0)
    odd = spark.createDataFrame([(None,), (5,), (5,), (2,)], "step long")
    assert sorted(r.call_no for r in W.call_counter(odd).collect()) == [1, 2, 3, 3]


def cells(spark, m):
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in np.ndindex(*m.shape)], "i long, j long, v double")


@pytest.mark.parametrize("block,held", [(4, 2), (256, 64)])
def test_tiles_multiply_as_numpy(spark, block, held):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(11, 30)), rng.normal(size=(30, 9))
    got = C.matmul_blocks(cells(spark, a), cells(spark, b), block, held).collect()
    out = np.full((11, 9), np.nan)
    for r in got:
        out[r.i, r.j] = r.v
    assert np.allclose(out, a @ b) and len(got) == 99
    assert C.matmul_blocks(cells(spark, a).limit(0), cells(spark, b)).count() == 0


def test_sparse_tiles_equal_the_cell_join(spark):
    rng = random.Random(3)
    a = spark.createDataFrame([(rng.randrange(40), rng.randrange(1000), float(rng.randrange(1, 9))) for _ in range(300)], "i long, j long, v double").dropDuplicates(["i", "j"])
    b = spark.createDataFrame([(rng.randrange(1000), rng.randrange(40), float(rng.randrange(1, 9))) for _ in range(300)], "i long, j long, v double").dropDuplicates(["i", "j"])
    key = lambda df: {(r.i, r.j): r.v for r in df.collect() if r.v}
    assert key(C.matmul_blocks(a, b, 16)) == key(C.matmul(a, b))


def test_errors_of_matrices(spark):
    real = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 2.0), (2, 0, 0, 5.0)], "task_id long, i long, j long, v double")
    pred = spark.createDataFrame([
        (10, 1, 0, 0, 1.5), (10, 1, 0, 1, 0.0), (11, 1, 0, 0, 1.0), (12, 1, 0, 0, 1.0), (12, 1, 0, 1, 2.0), (12, 1, 0, 2, 0.0),
        (13, 1, 0, 0, 1.0), (13, 1, 1, 1, 2.0), (14, 1, 0, 0, 1.0), (14, 1, 0, 1, None), (15, 2, 0, 0, 4.0), (16, 3, 0, 0, 4.0)],
        "completion_id long, task_id long, i long, j long, v double")
    got = {r.completion_id: (r.amax_error, r.mse_error) for r in C.matrix_errors(pred, real).collect()}
    assert got == {10: (0.5, 2.125), 11: (5.0, 5.0), 12: (5.0, 5.0), 13: (5.0, 5.0), 14: (5.0, 5.0), 15: (-1.0, 1.0), 16: (5.0, 5.0)}
