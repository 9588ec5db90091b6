"""Registered queries over the per-step metric series and rollout windows."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..config import MAX_STEPS, NUM_GENERATIONS
from ..operators import tracking as T
from ..operators import windows as Wn
from ..session import checkpoint_dir
from ..sources.fixtures import duck_with, fixture
from .registry import register, rounded

MX = duck_with("fx_metrics")
RX = duck_with("fx_run_metrics")
RUN = ["run_id"]
HIST = """, h AS (
 SELECT run_id, step, reward, ts, row_number() OVER r AS history_len,
   avg(reward) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS rolling_avg,
   avg(reward) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN 99 PRECEDING AND 50 PRECEDING) AS prev_avg0
 FROM fx_run_metrics WHERE reward IS NOT NULL WINDOW r AS (PARTITION BY run_id ORDER BY step))
"""
PLATEAU_SQL = RX + HIST + """
, c AS (SELECT run_id, step, rolling_avg,
          max(rolling_avg) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before
        FROM h WHERE step > 0 AND step % 25 = 0),
s AS (SELECT *, (best_before IS NULL OR rolling_avg > best_before) AS improved FROM c),
g AS (SELECT *, sum(CAST(improved AS INT)) OVER r AS segment, max(rolling_avg) OVER r AS best_avg_reward
      FROM s WINDOW r AS (PARTITION BY run_id ORDER BY step ROWS UNBOUNDED PRECEDING))
SELECT run_id, step, round(rolling_avg, 6) AS rolling_avg, improved, round(best_avg_reward, 6) AS best_avg_reward,
  CAST(25 * (row_number() OVER (PARTITION BY run_id, segment ORDER BY step) - 1) AS BIGINT) AS steps_since_improvement,
  25 * (row_number() OVER (PARTITION BY run_id, segment ORDER BY step) - 1) >= 200 AS plateau_warning
FROM g"""


@register("rolling_reward", RX + HIST + """
SELECT run_id, step, round(rolling_avg, 6) AS rolling_avg, least(history_len, 50) AS window_len,
  round(CASE WHEN history_len > 50 THEN prev_avg0 END, 6) AS prev_avg
FROM h WHERE step > 0 AND step % 25 = 0""")
def q_rolling(spark, sf):
    r = T.rolling_reward(fixture(spark, sf, "fx_run_metrics"), RUN)
    return rounded(r.where("is_check").select("run_id", "step", "rolling_avg", F.col("window_len").cast("bigint"), "prev_avg"))


@register("reward_trend", RX + HIST + """
SELECT run_id, step, round(rolling_avg - prev_avg0, 6) AS delta,
  CASE WHEN rolling_avg - prev_avg0 > 0.01 THEN 'improving' WHEN rolling_avg - prev_avg0 < -0.01 THEN 'degrading'
       ELSE 'flat' END AS trend
FROM h WHERE step > 0 AND step % 25 = 0 AND history_len > 50""")
def q_trend(spark, sf):
    r = T.rolling_reward(fixture(spark, sf, "fx_run_metrics"), RUN)
    return rounded(r.where("is_check AND history_len > 50").select("run_id", "step", "delta", "trend"))


@register("plateau", PLATEAU_SQL)
def q_plateau(spark, sf):
    p = T.plateau(fixture(spark, sf, "fx_run_metrics"), RUN)
    return rounded(p.select("run_id", "step", "rolling_avg", "improved", "best_avg_reward",
                            F.col("steps_since_improvement").cast("bigint"), "plateau_warning"))


@register("step_eta", RX + f"""
, d AS (SELECT run_id, step, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER r AS step_us, first_value(ts) OVER r AS t0
        FROM fx_run_metrics WINDOW r AS (PARTITION BY run_id ORDER BY step)),
e AS (SELECT *, CAST(sum(step_us) OVER r AS BIGINT) AS s10, count(step_us) OVER r AS n10 FROM d
      WINDOW r AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT run_id, step, step_us / 1e6 AS step_seconds,
  CASE WHEN n10 > 0 THEN s10 / (n10 * 1e6) ELSE 0.0 END AS avg_step_seconds,
  CAST({MAX_STEPS} - step AS BIGINT) AS remaining_steps,
  (CASE WHEN n10 > 0 THEN s10 / (n10 * 1e6) ELSE 0.0 END) * ({MAX_STEPS} - step) AS eta_seconds,
  100.0 * step / {MAX_STEPS} AS progress_pct,
  (epoch_us(ts) - epoch_us(t0)) / 1e6 AS elapsed_seconds
FROM e""")
def q_eta(spark, sf):
    e = T.step_eta(fixture(spark, sf, "fx_run_metrics"), MAX_STEPS, RUN)
    return e.select("run_id", "step", "step_seconds", "avg_step_seconds", F.col("remaining_steps").cast("bigint"),
                    "eta_seconds", "progress_pct", "elapsed_seconds")


@register("run_summary", RX + """
, d AS (SELECT run_id, step, ts, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY run_id ORDER BY step) AS dt,
               row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS from_end FROM fx_run_metrics)
SELECT run_id, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 6) AS total_seconds, max(step) AS n_steps,
  round(avg(CASE WHEN from_end <= 100 THEN dt END), 6) AS avg_step_seconds,
  round(min(CASE WHEN from_end <= 100 THEN dt END), 6) AS min_step_seconds,
  round(max(CASE WHEN from_end <= 100 THEN dt END), 6) AS max_step_seconds
FROM d GROUP BY run_id""")
def q_run_summary(spark, sf):
    return rounded(T.run_summary(fixture(spark, sf, "fx_run_metrics"), RUN))


@register("metric_points", MX + """
SELECT step, 'reward' AS tag, round(reward, 6) AS value FROM fx_metrics
UNION ALL SELECT step, 'reward_std', round(reward_std, 6) FROM fx_metrics
UNION ALL SELECT step, 'n', round(CAST(n AS DOUBLE), 6) FROM fx_metrics""")
def q_metric_points(spark, sf):
    return rounded(T.metric_points(fixture(spark, sf, "fx_metrics"), ["reward", "reward_std", "n"]))


@register("sample_every_n", MX + """
SELECT step, round(reward, 6) AS reward FROM fx_metrics WHERE step = 1 OR step % 10 = 0""")
def q_sample(spark, sf):
    return rounded(T.sample_every_n(fixture(spark, sf, "fx_metrics"), 10).select("step", "reward"))


def fx_logs(spark, sf):
    """Trainer log maps derived from the metric series (bare, prefixed and
    private keys; some NULL values)."""
    m = fixture(spark, sf, "fx_metrics")
    return m.select("step", F.create_map(
        F.lit("reward"), F.col("reward"),
        F.lit("train/reward"), F.col("reward") + 1.0,
        F.lit("train/reward_std"), F.col("reward_std"),
        F.lit("clip_ratio"), F.when(F.col("step") % 3 == 0, F.col("reward_std")),
        F.lit("train/clip_ratio"), F.col("reward_std") * 2,
        F.lit("kl"), F.col("n").cast("double") / 1000,
        F.lit("_runtime"), F.col("n").cast("double"),
        F.lit("train/loss"), F.when(F.col("step") % 2 == 0, F.col("reward_std"))).alias("logs"))


@register("numeric_metrics", MX + """
SELECT step, 'trainer/reward' AS tag, round(reward, 6) AS value FROM fx_metrics
UNION ALL SELECT step, 'trainer/train_reward', round(reward + 1.0, 6) FROM fx_metrics
UNION ALL SELECT step, 'trainer/train_reward_std', round(reward_std, 6) FROM fx_metrics
UNION ALL SELECT step, 'trainer/kl', round(n / 1000, 6) FROM fx_metrics
UNION ALL SELECT step, 'trainer/clip_ratio', round(reward_std, 6) FROM fx_metrics WHERE step % 3 = 0
UNION ALL SELECT step, 'trainer/train_clip_ratio', round(reward_std * 2, 6) FROM fx_metrics
UNION ALL SELECT step, 'trainer/train_loss', round(reward_std, 6) FROM fx_metrics WHERE step % 2 = 0""")
def q_numeric_metrics(spark, sf):
    return rounded(T.numeric_metrics(fx_logs(spark, sf)))


@register("metric_aliases", MX + """
SELECT step, 'grpo/reward_mean' AS tag, round(reward, 6) AS value FROM fx_metrics
UNION ALL SELECT step, 'grpo/reward_std', round(reward_std, 6) FROM fx_metrics
UNION ALL SELECT step, 'grpo/kl_divergence', round(n / 1000, 6) FROM fx_metrics
UNION ALL SELECT step, 'grpo/clip_ratio', round(reward_std, 6) FROM fx_metrics WHERE step % 3 = 0
UNION ALL SELECT step, 'grpo/loss', round(reward_std, 6) FROM fx_metrics WHERE step % 2 = 0""")
def q_metric_aliases(spark, sf):
    return rounded(T.metric_aliases(fx_logs(spark, sf), T.alias_frame(spark)))


RO = duck_with("fx_rollouts")


@register("first_k_per_step", RO + """
SELECT rollout_id, step, rank_in_step FROM (
  SELECT rollout_id, step, row_number() OVER (PARTITION BY step ORDER BY prompt_id, gen_idx) AS rank_in_step
  FROM fx_rollouts) WHERE rank_in_step <= 4""")
def q_first_k(spark, sf):
    d = Wn.first_k_per_step(fixture(spark, sf, "fx_rollouts"), 4)
    return d.select("rollout_id", "step", F.col("rank_in_step").cast("bigint"))


@register("positional_groups", RO + f"""
SELECT rollout_id, step, CAST(floor((row_number() OVER (PARTITION BY step ORDER BY rollout_id) - 1) / {NUM_GENERATIONS}) AS BIGINT) AS pos_group
FROM fx_rollouts""")
def q_pos_groups(spark, sf):
    d = Wn.positional_groups(fixture(spark, sf, "fx_rollouts"), NUM_GENERATIONS)
    return d.select("rollout_id", "step", "pos_group")


@register("call_counter", RO + """
SELECT rollout_id, CAST(dense_rank() OVER (ORDER BY step) AS BIGINT) AS call_no FROM fx_rollouts""")
def q_call_counter(spark, sf):
    d = Wn.call_counter(fixture(spark, sf, "fx_rollouts"))
    return d.select("rollout_id", F.col("call_no").cast("bigint"))


@register("append_metric_points", duck_with("fx_metrics") + """
SELECT tag, round(value, 6) AS value, step FROM (SELECT 'reward' AS tag, reward AS value, step FROM fx_metrics
  UNION ALL SELECT 'reward_std', reward_std, step FROM fx_metrics) WHERE value IS NOT NULL""")
def q_append_points(spark, sf):
    """Points appended in two batches, the second one written twice (a retry)."""
    path = os.path.join(checkpoint_dir(spark), f"points-{uuid.uuid4().hex}")
    points = T.metric_points(fixture(spark, sf, "fx_metrics"), ["reward", "reward_std"])
    for batch in (0, 1, 1):
        T.append_metric_points(points.where(F.col("step") % 2 == batch), path, batch)
    return rounded(T.read_metric_points(spark, path).select("tag", "value", "step"))
