"""Training-progress tracking over a per-step metric series.

Input: one row per logged step with ``step`` (and optionally a run key),
``reward`` and a timestamp. Windows are partitioned by the run key; one
run's series has one row per optimiser step (thousands of rows), so the
per-run window partition stays small at any corpus size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# --- fixed values (tracking rules) ------------------------------------------
CHECK_EVERY = 25          # report rolling reward at steps divisible by this
WINDOW = 50               # rolling window (rewards)
TREND_EPS = 0.01          # improving > eps, degrading < -eps
PLATEAU_WARN = 200        # warn after this many steps without improvement
ETA_WINDOW = 10           # mean of the last N step durations
# Canonical names for trainer log keys (source key -> canonical tag).
METRIC_ALIASES = [
    ("loss", "grpo/loss"),
    ("reward", "grpo/reward_mean"),
    ("reward_std", "grpo/reward_std"),
    ("kl", "grpo/kl_divergence"),
    ("learning_rate", "grpo/learning_rate"),
    ("completion_length", "grpo/completion_length"),
    ("clip_ratio", "grpo/clip_ratio"),
]
# --- end fixed values --------------------------------------------------------


def _w(run_cols):
    if not run_cols:
        raise ValueError("a series needs its run key: without one, all runs would meet in one task")
    return W.partitionBy(*run_cols).orderBy("step")


def rolling_reward(df: DataFrame, run_cols: list[str], every: int = CHECK_EVERY,
                   window: int = WINDOW) -> DataFrame:
    """Rolling mean of the last ``window`` rewards and the previous window's
    mean, the delta and the trend label (only once history exceeds the
    window). Steps without a reward are no part of the history; ``is_check``
    marks reporting steps."""
    w = _w(list(run_cols))
    cur = w.rowsBetween(-(window - 1), 0)
    prev = w.rowsBetween(-(2 * window - 1), -window)
    rn = F.row_number().over(w)
    out = (df.where(F.col("reward").isNotNull()).withColumn("history_len", rn)
           .withColumn("rolling_avg", F.avg("reward").over(cur))
           .withColumn("window_len", F.least(F.col("history_len"), F.lit(window)))
           .withColumn("prev_avg", F.when(F.col("history_len") > window, F.avg("reward").over(prev)))
           .withColumn("delta", F.col("rolling_avg") - F.col("prev_avg"))
           .withColumn("trend", F.when(F.col("delta").isNull(), F.lit(None))
                       .when(F.col("delta") > TREND_EPS, "improving")
                       .when(F.col("delta") < -TREND_EPS, "degrading").otherwise("flat"))
           .withColumn("is_check", (F.col("step") > 0) & (F.col("step") % every == 0)))
    return out


def plateau(df: DataFrame, run_cols: list[str], every: int = CHECK_EVERY) -> DataFrame:
    """Best rolling average so far and steps without improvement.

    Over check rows only: ``improved`` when the rolling average beats the
    best of earlier checks (the first check always does); a run of checks
    between improvements forms a segment and the counter is ``every`` times
    the position inside the segment.
    """
    run_cols = list(run_cols)
    checks = rolling_reward(df, run_cols, every).where("is_check")
    w = _w(run_cols)
    best_before = F.max("rolling_avg").over(w.rowsBetween(W.unboundedPreceding, -1))
    seg = checks.withColumn("improved", best_before.isNull() | (F.col("rolling_avg") > best_before)) \
        .withColumn("segment", F.sum(F.col("improved").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    ws = W.partitionBy(*run_cols, "segment").orderBy("step")
    return (seg.withColumn("best_avg_reward", F.max("rolling_avg").over(w.rowsBetween(W.unboundedPreceding, 0)))
            .withColumn("steps_since_improvement", F.lit(every) * (F.row_number().over(ws) - 1))
            .withColumn("plateau_warning", F.col("steps_since_improvement") >= PLATEAU_WARN))


def _diff_secs(start: Column, end: Column) -> Column:
    """Seconds between two timestamps (works for TIMESTAMP and TIMESTAMP_NTZ)."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def step_eta(df: DataFrame, max_steps: int, run_cols: list[str], ts_col: str = "ts") -> DataFrame:
    """Step duration (from consecutive timestamps), mean of the last 10,
    ETA = mean × remaining steps, progress in percent, elapsed seconds.

    Durations are summed as integer microseconds and divided once, so the
    result is exact up to one rounding (identical on any engine)."""
    w = _w(list(run_cols))
    first = F.first(ts_col).over(w.rowsBetween(W.unboundedPreceding, 0))
    last10 = w.rowsBetween(-(ETA_WINDOW - 1), 0)
    us = F.timestamp_diff("MICROSECOND", F.lag(ts_col).over(w), F.col(ts_col))
    d = df.withColumn("step_us", us)
    n = F.count("step_us").over(last10)
    return (d.withColumn("step_seconds", F.col("step_us") / F.lit(1e6))
            .withColumn("avg_step_seconds", F.when(n > 0, F.sum("step_us").over(last10) / (n * F.lit(1e6)))
                        .otherwise(F.lit(0.0)))
            .withColumn("remaining_steps", F.lit(max_steps) - F.col("step"))
            .withColumn("eta_seconds", F.col("avg_step_seconds") * F.col("remaining_steps"))
            .withColumn("progress_pct", F.lit(100.0) * F.col("step") / F.lit(max(max_steps, 1)))
            .withColumn("elapsed_seconds", _diff_secs(first, F.col(ts_col)))
            .drop("step_us"))


def run_summary(df: DataFrame, run_cols: list[str], ts_col: str = "ts", last_n: int = 100) -> DataFrame:
    """Total wall time, number of steps, and mean/min/max step time over the
    last ``last_n`` step durations (the reference keeps only the last 100)."""
    run_cols = list(run_cols)
    w = _w(run_cols)
    rev = W.partitionBy(*run_cols).orderBy(F.col("step").desc())
    d = (df.withColumn("dt", _diff_secs(F.lag(ts_col).over(w), F.col(ts_col)))
         .withColumn("from_end", F.row_number().over(rev)))
    recent = F.when(F.col("from_end") <= last_n, F.col("dt"))
    return d.groupBy(*run_cols).agg(
        _diff_secs(F.min(ts_col), F.max(ts_col)).alias("total_seconds"),
        F.max("step").alias("n_steps"),
        F.avg(recent).alias("avg_step_seconds"), F.min(recent).alias("min_step_seconds"),
        F.max(recent).alias("max_step_seconds"))


def metric_points(df: DataFrame, value_cols: list[str], step_col: str = "step",
                  ts_col: str | None = None) -> DataFrame:
    """Wide metric columns -> long ``(tag, value, step[, ts])`` points."""
    ids = [step_col] + ([ts_col] if ts_col else [])
    casted = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in value_cols])
    return casted.unpivot(ids, value_cols, "tag", "value").where(F.col("value").isNotNull())


def append_metric_points(points: DataFrame, path: str, batch: int) -> None:
    """Append sink: every batch has a folder of its own, partitioned by tag, so
    that writing a batch again (a retry) replaces it instead of doubling it."""
    points.write.mode("overwrite").partitionBy("tag").parquet(f"{path}/batch={int(batch)}")


def read_metric_points(spark, path: str) -> DataFrame:
    """The points of all batches; the tag stays text."""
    d = spark.read.option("recursiveFileLookup", "false").parquet(path)
    return d.withColumn("tag", F.col("tag").cast("string")).drop("batch")


def sample_every_n(df: DataFrame, n: int, step_col: str = "step") -> DataFrame:
    """Keep step 1 and every n-th step."""
    s = F.col(step_col)
    return df.where((s == 1) | (s % n == 0))


def numeric_metrics(logs: DataFrame, map_col: str = "logs", step_col: str = "step") -> DataFrame:
    """Trainer log map -> numeric points; drop keys starting with ``_`` and
    NULL values; tag = ``trainer/`` + key with ``/`` replaced by ``_``."""
    e = logs.select(step_col, F.explode(map_col).alias("key", "value"))
    return (e.where(~F.col("key").startswith("_") & F.col("value").isNotNull())
            .select(step_col, F.concat(F.lit("trainer/"), F.replace(F.col("key"), F.lit("/"), F.lit("_"))).alias("tag"),
                    F.col("value").cast("double").alias("value")))


def alias_frame(spark) -> DataFrame:
    return spark.createDataFrame(METRIC_ALIASES, "src string, tag string")


def metric_aliases(logs: DataFrame, aliases: DataFrame, map_col: str = "logs",
                   step_col: str = "step") -> DataFrame:
    """Canonical metrics: bare key preferred over its ``train/`` form.

    Explode the log map, strip the prefix, join the (fixed, 7-row, so
    broadcast) alias table on the bare key, and keep the bare value when both
    forms exist (``min_by`` on the prefixed flag), even where it is NULL; then
    NULL values are no points.
    """
    e = (logs.select(step_col, F.explode(map_col).alias("key", "value"))
         .withColumn("prefixed", F.col("key").startswith("train/"))
         .withColumn("src", F.regexp_replace("key", "^train/", "")))
    j = e.join(F.broadcast(aliases), "src")
    best = j.groupBy(step_col, "tag").agg(F.min_by(F.struct("value"), F.col("prefixed").cast("int")).alias("v"))
    return best.select(step_col, "tag", "v.value").where(F.col("value").isNotNull())
