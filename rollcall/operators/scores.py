"""Reports over scored rollouts (composite, breakdowns, per-group diagnostics).

Input: one row per rollout with keys ``(step, prompt_id, gen_idx)`` and one
double column per reward component (see ``SCORE_COLS``). Prompt groups are
explicit keys, never row positions.

Scale notes: every report aggregates first (partial aggregation on the map
side) and reshapes the small aggregate afterwards, so no per-rollout row
expansion reaches a shuffle. Group statistics are joined back instead of
computed in a window, and the rows of a huge prompt group are salted for it.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import RewardConfig
from ..session import staged
from .ranks import salted_join

SCORE_COLS = {
    "format_reward": "format_score",
    "syntax_execution_reward": "syntax_score",
    "result_reward": "result_score",
    "schema_linking_reward": "schema_score",
    "ngram_similarity_reward": "ngram_score",
    "thinking_quality_reward": "thinking_score",
    "llm_judge_reward": "judge_score",
}


def score_col(cfg: RewardConfig, comp: str) -> str:
    return cfg.extra[comp][0] if comp in cfg.extra else SCORE_COLS[comp]


def _score(df: DataFrame, comp: str, cfg: RewardConfig) -> Column:
    c = score_col(cfg, comp)
    if c not in df.columns:
        raise ValueError(f"enabled component {comp} needs column {c}")
    return F.col(c)


def exact(c: Column) -> Column:
    """A score as DECIMAL: sums of it do not depend on their order."""
    return c.cast("decimal(18,6)")


def exact_composite(df: DataFrame, cfg: RewardConfig) -> Column:
    terms = [F.lit(Decimal(str(cfg.weight(c)))).cast("decimal(6,4)") * exact(_score(df, c, cfg)) for c in cfg.enabled_components()]
    return reduce(lambda a, b: a + b, terms, F.lit(Decimal(0)).cast("decimal(18,6)"))


def exact_mean(c: Column) -> Column:
    """Mean of a DECIMAL: one exact sum, one division."""
    return F.sum(c).cast("double") / F.count(c)


def composite_expr(df: DataFrame, cfg: RewardConfig) -> Column:
    """Σ w·score over enabled components; disabled components contribute 0."""
    terms = [F.lit(cfg.weight(c)) * _score(df, c, cfg) for c in cfg.enabled_components()]
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def with_composite(df: DataFrame, cfg: RewardConfig, name: str = "composite") -> DataFrame:
    return df.withColumn(name, composite_expr(df, cfg))


def unweighted_reward(df: DataFrame, cfg: RewardConfig, name: str = "reward") -> DataFrame:
    """Plain sum of the enabled reward functions (trainer-side summation)."""
    terms = [_score(df, c, cfg) for c in cfg.enabled_components()]
    return df.withColumn(name, reduce(lambda a, b: a + b, terms, F.lit(0.0)))


def to_long(df: DataFrame, keys: list[str], cfg: RewardConfig) -> DataFrame:
    """Wide component columns -> ``(keys..., component, score)`` rows."""
    present = [c for c in cfg.enabled_components() if _score(df, c, cfg) is not None]
    return df.unpivot(keys, [score_col(cfg, c) for c in present], "score_col", "score") \
        .withColumn("component", F.element_at(F.create_map(*[
            x for c in present for x in (F.lit(score_col(cfg, c)), F.lit(c))]), F.col("score_col"))) \
        .drop("score_col")


def weights_frame(spark, cfg: RewardConfig) -> DataFrame:
    """Weights as a 7-row dimension table (size fixed by the component list)."""
    rows = [(c, cfg.weight(c), bool(cfg.on(c)), *cfg.span(c)) for c in cfg.components()]
    return spark.createDataFrame(rows, "component string, weight double, enabled boolean, "
                                       "range_min double, range_max double")


def apply_weights_long(long_scores: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Long-form weighted sum: scores ⋈ broadcast(weights) then sum per key.

    The weights table has one row per component (bounded by the component
    list), so broadcasting it is safe at any data size. Missing weight = 0.
    """
    w = F.broadcast(weights.where("enabled").select("component", "weight"))
    return (long_scores.join(w, "component", "left")
            .groupBy(*keys)
            .agg(F.sum(F.coalesce(F.col("weight"), F.lit(0.0)) * F.col("score")).alias("composite")))


def apply_weights(df: DataFrame, weights: DataFrame, cfg: RewardConfig, name: str = "composite") -> DataFrame:
    """The weighted sum with weights from a table: they become one map, a scalar
    subquery (one entry a component), and the sum is a projection. A component
    without an enabled weight counts 0."""
    one = weights.where("enabled").agg(F.map_from_entries(F.collect_list(F.struct("component", "weight"))).alias("w"))
    w = one.scalar()
    terms = [F.coalesce(F.try_element_at(w, F.lit(c)), F.lit(0.0)) * _score(df, c, cfg) for c in cfg.enabled_components()]
    return df.withColumn(name, reduce(lambda a, b: a + b, terms, F.lit(0.0)))


def reward_breakdown(df: DataFrame, cfg: RewardConfig, by: list[str] | None = None) -> DataFrame:
    """Per component: weight, mean, min, max, weight×mean; plus a TOTAL row.

    Aggregates the wide table once (map-side partial aggregation), then
    reshapes the tiny aggregate to one row per component.
    """
    by = by or []
    comps = [c for c in cfg.enabled_components()]
    comp = exact_composite(df, cfg)
    aggs = []
    for c in comps:
        s = _score(df, c, cfg)
        aggs += [exact_mean(exact(s)).alias(f"{c}__mean"), F.min(s).alias(f"{c}__min"), F.max(s).alias(f"{c}__max")]
    aggs += [exact_mean(comp).alias("total__mean"), F.min(comp).cast("double").alias("total__min"),
             F.max(comp).cast("double").alias("total__max")]
    wide = df.groupBy(*by).agg(*aggs)
    parts = []
    for c in comps + ["total"]:
        w = F.lit(cfg.weight(c)) if c != "total" else F.lit(None).cast("double")
        mean = F.col(f"{c}__mean")
        parts.append(F.struct(F.lit(c).alias("component"), w.alias("weight"),
                              mean.alias("mean"), F.col(f"{c}__min").alias("min"),
                              F.col(f"{c}__max").alias("max"),
                              (w * mean).alias("weighted_mean")))
    return wide.select(*by, F.inline(F.array(*parts)))


def component_means(df: DataFrame, cfg: RewardConfig, by: list[str] = ("step",), *more: Column) -> DataFrame:
    """Means of the components and the composite; ``more`` aggregates come first."""
    aggs = [exact_mean(exact(_score(df, c, cfg))).alias(f"{c}_mean") for c in cfg.enabled_components()]
    return df.groupBy(*by).agg(*more, *aggs, exact_mean(exact_composite(df, cfg)).alias("composite_mean"))


def execution_accuracy(df: DataFrame, by: list[str] = ("step",), result_col: str = "result_score") -> DataFrame:
    r = F.col(result_col)
    return (df.groupBy(*by)
            .agg(F.count_if(r > 0).alias("n_correct"), F.count_if(r != 0).alias("n_evaluated"),
                 F.count_if(r < 0).alias("n_wrong"), F.count_if(r == 0).alias("n_unknown"),
                 F.count_if(r >= 3.0).alias("n_exact"), F.count(F.lit(1)).alias("n"))
            .withColumn("execution_accuracy",
                        F.col("n_correct") / F.greatest(F.col("n_evaluated"), F.lit(1)))
            .withColumn("exact_match_rate", F.col("n_exact") / F.greatest(F.col("n"), F.lit(1))))


def sql_rates(df: DataFrame, by: list[str] = ("step",), syntax_col: str = "syntax_score") -> DataFrame:
    s = F.col(syntax_col)
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return df.groupBy(*by).agg(
        (F.count_if(s != 0) / n).alias("sql_extraction_rate"),
        (F.count_if(s > 0) / n).alias("sql_execution_rate"))


def group_diagnostics(df: DataFrame, cfg: RewardConfig, step_col: str = "step",
                      group_col: str = "prompt_id") -> DataFrame:
    """Per step: prompts with no learning signal.

    Two-level hash aggregate: per (step, prompt) flags, then per step counts.
    "No reward variance" (≤1 distinct composite rounded to 4 places) is
    computed as ``min = max`` of the rounded value, which aggregates
    partially and never materialises the distinct set. Groups whose size is
    not ``num_generations`` are counted as incomplete (explicit keys make the
    reference's skip rule unnecessary).
    """
    comp = F.round(composite_expr(df, cfg), 4)
    syn = F.col(SCORE_COLS["syntax_execution_reward"])
    per_group = (df.groupBy(step_col, group_col).agg(
        F.count(F.lit(1)).alias("n_gen"),
        F.count_if(syn != 0).alias("n_with_sql"),
        F.count_if(syn < 0).alias("n_exec_fail"),
        F.min(comp).alias("cmin"), F.max(comp).alias("cmax")))
    g = cfg.num_generations
    return (per_group.groupBy(step_col).agg(
        F.count(F.lit(1)).alias("n_prompts"),
        F.count_if(F.col("n_gen") != g).alias("n_incomplete_groups"),
        F.count_if(F.col("n_with_sql") == 0).alias("prompts_all_gens_no_sql"),
        F.count_if((F.col("n_with_sql") > 0) & (F.col("n_with_sql") < F.col("n_gen")))
         .alias("prompts_some_gens_no_sql"),
        F.count_if(F.col("n_exec_fail") == F.col("n_gen")).alias("prompts_all_gens_failed_exec"),
        F.count_if(F.col("cmin") == F.col("cmax")).alias("prompts_no_reward_variance"))
        .withColumn("pct_all_gens_no_sql",
                    100.0 * F.col("prompts_all_gens_no_sql") / F.greatest(F.col("n_prompts"), F.lit(1)))
        .withColumn("pct_no_reward_variance",
                    100.0 * F.col("prompts_no_reward_variance") / F.greatest(F.col("n_prompts"), F.lit(1))))


def group_advantage(df: DataFrame, reward_col: str = "composite", keys: list[str] = ("step", "prompt_id"),
                    eps: float = 1e-4, hot_rows: int = 100_000) -> DataFrame:
    """Group-relative advantage ``(r - mean_g) / (std_g + eps)``.

    ``std_g`` is the sample standard deviation (NULL → 0 for one-row groups).
    Group statistics come from a hash aggregate, written once and joined back;
    the rows of groups above ``hot_rows`` are salted (``ranks.salted_join``).
    """
    keys = list(keys)
    stats = staged(df.groupBy(*keys).agg(
        F.avg(reward_col).alias("group_mean"), F.coalesce(F.stddev_samp(reward_col), F.lit(0.0)).alias("group_std"),
        F.count(F.lit(1)).alias("_rows")), "group-stats")
    return (salted_join(df, stats, keys, "_rows", hot_rows)
            .withColumn("advantage", (F.col(reward_col) - F.col("group_mean")) / (F.col("group_std") + F.lit(eps))))


def dominance_check(df: DataFrame, cfg: RewardConfig, keys: list[str] = ("step", "prompt_id"),
                    result_col: str = "result_score", comp_col: str = "composite") -> DataFrame:
    """Can an incorrect rollout outscore a correct one?

    Static form: ``w_result × 6 > Σ w_i × range_i`` over the other enabled
    components; minimum safe result weight = Σ / 6. Empirical form: prompt
    groups where the best wrong rollout (result < 0) scores ≥ the worst
    correct one (result > 0).
    """
    lo, hi = cfg.span("result_reward")
    gap = cfg.weight("result_reward") * (hi - lo)
    other = sum(cfg.weight(c) * (cfg.span(c)[1] - cfg.span(c)[0])
                for c in cfg.enabled_components() if c != "result_reward")
    sdf = df if comp_col in df.columns else with_composite(df, cfg, comp_col)
    r, s = F.col(result_col), F.col(comp_col)
    per_group = sdf.groupBy(*keys).agg(
        F.min(F.when(r > 0, s)).alias("min_right"), F.max(F.when(r < 0, s)).alias("max_wrong"))
    return per_group.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(F.col("max_wrong") >= F.col("min_right")).alias("n_groups_wrong_beats_right"),
    ).select(F.lit(gap).alias("result_gap"), F.lit(float(other)).alias("max_other_advantage"),
             F.lit(gap > other).alias("is_valid"), F.lit(float(other) / 6.0).alias("min_safe_result_weight"),
             "n_groups", "n_groups_wrong_beats_right")
