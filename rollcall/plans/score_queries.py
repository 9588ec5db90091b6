"""Registered queries over scored rollouts (fx_rollouts, fx_metrics)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import RewardConfig
from ..operators import scores as S
from ..sources.fixtures import duck_with, fixture
from .registry import register, rounded

CFG = RewardConfig()
# Composite of the run configuration, written out for the oracle.
COMPOSITE_SQL = "(0.2 * syntax_score + 1.0 * result_score + 0.3 * schema_score + 0.3 * ngram_score)"
# The same in DECIMAL, so that sums are exact.
EXACT = {c: f"CAST({c}_score AS DECIMAL(18,6))" for c in ("syntax", "result", "schema", "ngram")}
EXACT_COMPOSITE = "(" + " + ".join(f"CAST({w} AS DECIMAL(6,4)) * {EXACT[c]}" for c, w in
                                   (("syntax", 0.2), ("result", 1.0), ("schema", 0.3), ("ngram", 0.3))) + ")"


def exact_avg(x: str) -> str:
    return f"CAST(sum({x}) AS DOUBLE) / count({x})"


RO = duck_with("fx_rollouts")


@register("composite_reward", RO + f"""
SELECT rollout_id, step, prompt_id, gen_idx, round({COMPOSITE_SQL}, 6) AS composite FROM fx_rollouts""")
def q_composite(spark, sf):
    df = fixture(spark, sf, "fx_rollouts")
    return rounded(S.with_composite(df, CFG).select("rollout_id", "step", "prompt_id", "gen_idx", "composite"))


@register("unweighted_reward", RO + """
SELECT rollout_id, round(syntax_score + result_score + schema_score + ngram_score, 6) AS reward FROM fx_rollouts""")
def q_unweighted(spark, sf):
    df = fixture(spark, sf, "fx_rollouts")
    return rounded(S.unweighted_reward(df, CFG).select("rollout_id", "reward"))


@register("apply_weights", RO + """
, w(component, weight) AS (VALUES ('syntax_execution_reward', 0.2), ('result_reward', 1.0),
      ('schema_linking_reward', 0.3), ('ngram_similarity_reward', 0.3)),
l AS (
  SELECT rollout_id, 'syntax_execution_reward' AS component, syntax_score AS score FROM fx_rollouts
  UNION ALL SELECT rollout_id, 'result_reward', result_score FROM fx_rollouts
  UNION ALL SELECT rollout_id, 'schema_linking_reward', schema_score FROM fx_rollouts
  UNION ALL SELECT rollout_id, 'ngram_similarity_reward', ngram_score FROM fx_rollouts)
SELECT rollout_id, round(sum(CAST(w.weight AS DOUBLE) * l.score), 6) AS composite
FROM l JOIN w USING (component) GROUP BY rollout_id""")
def q_apply_weights(spark, sf):
    df = fixture(spark, sf, "fx_rollouts")
    return rounded(S.apply_weights(df, S.weights_frame(spark, CFG), CFG).select("rollout_id", "composite"))


@register("apply_weights_long", RO + f"""
SELECT step, prompt_id, round(sum({COMPOSITE_SQL}), 6) AS composite FROM fx_rollouts GROUP BY step, prompt_id""")
def q_apply_weights_long(spark, sf):
    """Scores that come as one row a component, summed by prompt group."""
    long = S.to_long(fixture(spark, sf, "fx_rollouts"), ["step", "prompt_id"], CFG)
    return rounded(S.apply_weights_long(long, S.weights_frame(spark, CFG), ["step", "prompt_id"]))


_BREAK_PARTS = [("syntax_execution_reward", "syntax_score", 0.2), ("result_reward", "result_score", 1.0),
                ("schema_linking_reward", "schema_score", 0.3), ("ngram_similarity_reward", "ngram_score", 0.3)]


def _breakdown_sql():
    sel = []
    for name, col, w in _BREAK_PARTS:
        sel.append(f"""SELECT step, '{name}' AS component, CAST({w} AS DOUBLE) AS weight, {exact_avg(f'CAST({col} AS DECIMAL(18,6))')} AS mean,
  min({col}) AS min, max({col}) AS max, CAST({w} AS DOUBLE) * ({exact_avg(f'CAST({col} AS DECIMAL(18,6))')}) AS weighted_mean
  FROM fx_rollouts GROUP BY step""")
    sel.append(f"""SELECT step, 'total', CAST(NULL AS DOUBLE), {exact_avg(EXACT_COMPOSITE)}, CAST(min({EXACT_COMPOSITE}) AS DOUBLE),
  CAST(max({EXACT_COMPOSITE}) AS DOUBLE), CAST(NULL AS DOUBLE) FROM fx_rollouts GROUP BY step""")
    return RO + "\nUNION ALL\n".join(sel)


@register("reward_breakdown", _breakdown_sql())
def q_breakdown(spark, sf):
    df = fixture(spark, sf, "fx_rollouts")
    return S.reward_breakdown(df, CFG, by=["step"])


@register("component_means", RO + f"""
SELECT step, {exact_avg(EXACT['syntax'])} AS syntax_execution_reward_mean, {exact_avg(EXACT['result'])} AS result_reward_mean,
  {exact_avg(EXACT['schema'])} AS schema_linking_reward_mean, {exact_avg(EXACT['ngram'])} AS ngram_similarity_reward_mean,
  {exact_avg(EXACT_COMPOSITE)} AS composite_mean
FROM fx_rollouts GROUP BY step""")
def q_component_means(spark, sf):
    return S.component_means(fixture(spark, sf, "fx_rollouts"), CFG, ["step"])


@register("execution_accuracy", RO + """
SELECT step, CAST(count_if(result_score > 0) AS BIGINT) AS n_correct, CAST(count_if(result_score <> 0) AS BIGINT) AS n_evaluated,
  CAST(count_if(result_score < 0) AS BIGINT) AS n_wrong, CAST(count_if(result_score = 0) AS BIGINT) AS n_unknown,
  CAST(count_if(result_score >= 3.0) AS BIGINT) AS n_exact, count(*) AS n,
  round(CAST(count_if(result_score > 0) AS BIGINT) / greatest(CAST(count_if(result_score <> 0) AS BIGINT), 1), 6) AS execution_accuracy,
  round(CAST(count_if(result_score >= 3.0) AS BIGINT) / greatest(count(*), 1), 6) AS exact_match_rate
FROM fx_rollouts GROUP BY step""")
def q_exec_acc(spark, sf):
    return rounded(S.execution_accuracy(fixture(spark, sf, "fx_rollouts"), ["step"]))


@register("sql_rates", RO + """
SELECT step, round(CAST(count_if(syntax_score <> 0) AS BIGINT) / greatest(count(*), 1), 6) AS sql_extraction_rate,
  round(CAST(count_if(syntax_score > 0) AS BIGINT) / greatest(count(*), 1), 6) AS sql_execution_rate
FROM fx_rollouts GROUP BY step""")
def q_sql_rates(spark, sf):
    return rounded(S.sql_rates(fixture(spark, sf, "fx_rollouts"), ["step"]))


GROUP_DIAG_SQL = RO + f"""
, g AS (SELECT step, prompt_id, count(*) AS n_gen, CAST(count_if(syntax_score <> 0) AS BIGINT) AS n_with_sql,
          CAST(count_if(syntax_score < 0) AS BIGINT) AS n_exec_fail, count(DISTINCT round({COMPOSITE_SQL}, 4)) AS n_distinct
        FROM fx_rollouts GROUP BY step, prompt_id)
SELECT step, count(*) AS n_prompts, CAST(count_if(n_gen <> 4) AS BIGINT) AS n_incomplete_groups,
  CAST(count_if(n_with_sql = 0) AS BIGINT) AS prompts_all_gens_no_sql,
  CAST(count_if(n_with_sql > 0 AND n_with_sql < n_gen) AS BIGINT) AS prompts_some_gens_no_sql,
  CAST(count_if(n_exec_fail = n_gen) AS BIGINT) AS prompts_all_gens_failed_exec,
  CAST(count_if(n_distinct <= 1) AS BIGINT) AS prompts_no_reward_variance,
  round(100.0 * CAST(count_if(n_with_sql = 0) AS BIGINT) / greatest(count(*), 1), 6) AS pct_all_gens_no_sql,
  round(100.0 * CAST(count_if(n_distinct <= 1) AS BIGINT) / greatest(count(*), 1), 6) AS pct_no_reward_variance
FROM g GROUP BY step"""


@register("group_diagnostics", GROUP_DIAG_SQL)
def q_group_diag(spark, sf):
    return rounded(S.group_diagnostics(fixture(spark, sf, "fx_rollouts"), CFG))


@register("group_advantage", RO + f"""
, s AS (SELECT rollout_id, step, prompt_id, {COMPOSITE_SQL} AS composite FROM fx_rollouts),
g AS (SELECT step, prompt_id, avg(composite) AS group_mean, coalesce(stddev_samp(composite), 0) AS group_std
      FROM s GROUP BY step, prompt_id)
SELECT rollout_id, round(composite, 6) AS composite, round(group_mean, 6) AS group_mean, round(group_std, 6) AS group_std,
  round((composite - group_mean) / (group_std + 0.0001), 6) AS advantage
FROM s JOIN g USING (step, prompt_id)""")
def q_group_adv(spark, sf):
    df = S.with_composite(fixture(spark, sf, "fx_rollouts"), CFG)
    out = S.group_advantage(df.select("rollout_id", "step", "prompt_id", "composite"))
    return rounded(out.select("rollout_id", "composite", "group_mean", "group_std", "advantage"))


@register("dominance_check", RO + f"""
, g AS (SELECT step, prompt_id, min(CASE WHEN result_score > 0 THEN {COMPOSITE_SQL} END) AS min_right,
          max(CASE WHEN result_score < 0 THEN {COMPOSITE_SQL} END) AS max_wrong
        FROM fx_rollouts GROUP BY step, prompt_id)
SELECT CAST(6.0 AS DOUBLE) AS result_gap, round(CAST(0.2 * 4 + 0.3 * 2 + 0.3 * 2 AS DOUBLE), 6) AS max_other_advantage,
  true AS is_valid, round(CAST((0.2 * 4 + 0.3 * 2 + 0.3 * 2) / 6 AS DOUBLE), 6) AS min_safe_result_weight,
  count(*) AS n_groups, CAST(count_if(max_wrong >= min_right) AS BIGINT) AS n_groups_wrong_beats_right FROM g""")
def q_dominance(spark, sf):
    return rounded(S.dominance_check(fixture(spark, sf, "fx_rollouts"), CFG))
