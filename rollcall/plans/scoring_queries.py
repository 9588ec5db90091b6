"""Registered queries: scoring end to end, recorded outcomes, long chats, tool turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import LengthLimits, RewardConfig
from ..functions import markers as Mk
from ..functions import parsing as P
from ..operators import code as C
from ..operators import execution as X
from ..operators import matching as M
from ..operators import prepare as Pr
from ..operators import reward_functions as Rf
from ..operators import rewards as R
from ..operators import scores as S
from ..operators import tools as T
from ..operators import windows as Wn
from ..session import staged
from ..sources.fixtures import duck_with, fixture
from .code_queries import CODE_CTE, _audited, _band_sql
from .exec_queries import CATALOGUE
from .match_queries import MATCH_CTE, _match
from .prep_queries import LIM, PREP_CTE
from .registry import dealt, register, rounded
from .reward_queries import _special_re_duck
from .score_queries import COMPOSITE_SQL, EXACT, EXACT_COMPOSITE, exact_avg
from .text_queries import ITEMS_CTE, JACC, NGRAMS, SQL_CTE, TOK_CTE, _with_sql

# ---- syntax reward from recorded executions (statements of one length class fail)
DB_PATH = "CASE database_name WHEN 'db0' THEN 'dbs/db0/db0.sqlite' WHEN 'db1' THEN 'dbs/db1/db1.db' ELSE '' END"
SYNTAX = "CASE WHEN sql = '' OR db_path = '' THEN 0.0 WHEN length(sql) % 5 <> 0 THEN 2.0 ELSE -2.0 END"


def _executed(spark, sf):
    """Completions with SQL, database and the outcome of their statement. The SQL
    is written once: the statements to run and the rows they answer both read it."""
    d = staged(_with_sql(spark, sf).select("completion_id", "prompt_id", "database_name", "ground_truth_sql", "sql"), "extracted")
    d = X.resolve_database(d, "database_name", spark.createDataFrame(CATALOGUE, "name string, kind string, path string"))
    runs = X.dedupe_executions(d, "database_name", "sql").select("db", F.col("sql").alias("ran"), (F.length("sql") % 5 != 0).alias("success"))
    return d.join(runs, (F.col("database_name") == F.col("db")) & (F.col("sql") == F.col("ran")), "left").drop("db", "ran")


@register("syntax_execution_reward", SQL_CTE + f"""
SELECT completion_id, CAST({SYNTAX} AS DOUBLE) AS syntax_score FROM (SELECT *, {DB_PATH} AS db_path FROM x)""")
def q_syntax_execution(spark, sf):
    return R.syntax_execution_reward(_executed(spark, sf), "sql", "db_path", "success").select("completion_id", "syntax_score")


def _tail(cte: str) -> str:
    """A CTE list without its shared beginning."""
    return cte[len(SQL_CTE):] if cte.startswith(SQL_CTE) else cte[cte.index("\n, p AS ("):]


@register("score_completions", duck_with("fx_completions", "fx_pred_rows", "fx_gt_rows") + SQL_CTE[SQL_CTE.index(", x AS ("):]
          + _tail(ITEMS_CTE) + _tail(TOK_CTE) + _tail(MATCH_CTE) + f"""
, rr AS (SELECT candidate_id, CASE WHEN exact_match THEN 3.0
    WHEN pred_cols = gt_cols AND pred_cols > 0 AND n_pred > 0 AND n_gt > 0 AND f1 > 0.5 THEN least(-3.0 + f1 * 4.5, 1.5) ELSE -3.0 END AS rs FROM f1),
s AS (SELECT x.completion_id, x.prompt_id, CAST({SYNTAX.replace("sql", "x.sql")} AS DOUBLE) AS syntax_score,
    CAST(CASE WHEN x.sql = '' THEN -3.0 ELSE coalesce(rr.rs, -3.0) END AS DOUBLE) AS result_score,
    CAST(CASE WHEN x.sql = '' THEN 0.0 ELSE 2.0 * ({JACC("it.a", "it.b")}) END AS DOUBLE) AS schema_score,
    CAST(CASE WHEN x.sql = '' OR len(tp) = 0 OR len(tg) = 0 THEN 0.0 ELSE (({JACC(NGRAMS('tp', 1), NGRAMS('tg', 1))})
      + ({JACC(NGRAMS('tp', 2), NGRAMS('tg', 2))}) + ({JACC(NGRAMS('tp', 3), NGRAMS('tg', 3))})) / 3 * 2.0 END AS DOUBLE) AS ngram_score
  FROM (SELECT *, {DB_PATH} AS db_path FROM x) x JOIN tk USING (completion_id)
  JOIN (SELECT completion_id, CASE WHEN items = '' THEN [] ELSE string_split(items, ',') END AS a,
          string_split('o,orders,orders.o_custkey,orders.o_orderkey', ',') AS b FROM it) it USING (completion_id)
  LEFT JOIN rr ON rr.candidate_id = x.completion_id)
SELECT prompt_id, count(*) AS n, {exact_avg(EXACT['syntax'])} AS syntax_execution_reward_mean, {exact_avg(EXACT['result'])} AS result_reward_mean,
  {exact_avg(EXACT['schema'])} AS schema_linking_reward_mean, {exact_avg(EXACT['ngram'])} AS ngram_similarity_reward_mean,
  {exact_avg(EXACT_COMPOSITE)} AS composite_mean FROM s GROUP BY prompt_id""")
def q_score_completions(spark, sf):
    """From raw completions to the per-prompt means of all components."""
    cfg = RewardConfig()
    d = R.syntax_execution_reward(_executed(spark, sf), "sql", "db_path", "success")
    result = M.result_score(_match(spark, sf)).select(F.col("candidate_id").alias("completion_id"), F.col("result_score").alias("r"))
    d = d.join(result, "completion_id", "left").withColumn(
        "result_score", F.when(F.col("sql") == "", -3.0).otherwise(F.coalesce("r", F.lit(-3.0))))
    d = R.schema_linking_reward(d, "sql", "ground_truth_sql")
    d = R.ngram_similarity_reward(d, "sql", "ground_truth_sql")
    return S.component_means(d, cfg, ["prompt_id"], F.count(F.lit(1)).alias("n")).where("prompt_id IS NOT NULL")


# ---- a registered reward
BREVITY = "CASE WHEN gen_idx < 2 THEN 0.5 ELSE -0.25 END"


@register("register_reward", duck_with("fx_rollouts") + f"""
, s AS (SELECT *, CAST({BREVITY} AS DECIMAL(18,6)) AS brevity_score FROM fx_rollouts)
SELECT step, {exact_avg(EXACT['syntax'])} AS syntax_execution_reward_mean, {exact_avg(EXACT['result'])} AS result_reward_mean,
  {exact_avg(EXACT['schema'])} AS schema_linking_reward_mean, {exact_avg(EXACT['ngram'])} AS ngram_similarity_reward_mean,
  {exact_avg('brevity_score')} AS brevity_mean,
  {exact_avg('(' + EXACT_COMPOSITE + ' + CAST(0.4 AS DECIMAL(6,4)) * brevity_score)')} AS composite_mean FROM s GROUP BY step""")
def q_register_reward(spark, sf):
    """A reward of the user's own in the composite and the means."""
    cfg = RewardConfig().with_reward("brevity", "brevity_score", (-0.25, 0.5), 0.4)
    d = fixture(spark, sf, "fx_rollouts").withColumn("brevity_score", F.when(F.col("gen_idx") < 2, 0.5).otherwise(-0.25))
    return S.component_means(d, cfg, ["step"])


# ---- rewards given as functions
STEADY = "CASE WHEN gen_idx = 3 THEN 0.0 WHEN syntax_score > 0 THEN 0.75 ELSE -0.5 END"


def _steady(gen_idx, syntax_score):
    """No score for the last generation, else by the syntax score."""
    return [None if g == 3 else 0.75 if s > 0 else -0.5 for g, s in zip(gen_idx, syntax_score)]


def _with_function():
    return Rf.with_function(RewardConfig(), Rf.reward_function("steady", _steady, ["gen_idx", "syntax_score"], (-0.5, 0.75)), 0.4)


FUNCTION_CTE = duck_with("fx_rollouts") + f", s AS (SELECT *, CAST({STEADY} AS DOUBLE) AS steady_score FROM fx_rollouts)\n"
FUNCTION_COMPOSITE = "(" + EXACT_COMPOSITE + " + CAST(0.4 AS DECIMAL(6,4)) * CAST(steady_score AS DECIMAL(18,6)))"


@register("function_reward", FUNCTION_CTE + f"""
SELECT step, 'steady' AS component, CAST(0.4 AS DOUBLE) AS weight, {exact_avg('CAST(steady_score AS DECIMAL(18,6))')} AS mean, min(steady_score) AS min,
  max(steady_score) AS max, 0.4 * ({exact_avg('CAST(steady_score AS DECIMAL(18,6))')}) AS weighted_mean FROM s GROUP BY step
UNION ALL SELECT step, 'total', NULL, {exact_avg(FUNCTION_COMPOSITE)}, CAST(min({FUNCTION_COMPOSITE}) AS DOUBLE),
  CAST(max({FUNCTION_COMPOSITE}) AS DOUBLE), NULL FROM s GROUP BY step""")
def q_function_reward(spark, sf):
    """A Python function as a reward in the breakdown."""
    cfg = _with_function()
    out = S.reward_breakdown(Rf.add_function_scores(fixture(spark, sf, "fx_rollouts"), cfg), cfg, ["step"])
    return out.where("component IN ('steady', 'total')")


@register("function_dominance", FUNCTION_CTE + f"""
, g AS (SELECT step, prompt_id, min(CASE WHEN result_score > 0 THEN {COMPOSITE_SQL} + 0.4 * steady_score END) AS min_right,
          max(CASE WHEN result_score < 0 THEN {COMPOSITE_SQL} + 0.4 * steady_score END) AS max_wrong FROM s GROUP BY step, prompt_id)
SELECT CAST(6.0 AS DOUBLE) AS result_gap, round(CAST(0.2 * 4 + 0.3 * 2 + 0.3 * 2 + 0.4 * 1.25 AS DOUBLE), 6) AS max_other_advantage, true AS is_valid,
  round(CAST((0.2 * 4 + 0.3 * 2 + 0.3 * 2 + 0.4 * 1.25) / 6 AS DOUBLE), 6) AS min_safe_result_weight,
  count(*) AS n_groups, CAST(count_if(max_wrong >= min_right) AS BIGINT) AS n_groups_wrong_beats_right FROM g""")
def q_function_dominance(spark, sf):
    cfg = _with_function()
    return rounded(S.dominance_check(Rf.add_function_scores(fixture(spark, sf, "fx_rollouts"), cfg), cfg))


@register("function_sql", FUNCTION_CTE + "SELECT prompt_id, sum(CASE WHEN gen_idx <> 3 THEN steady_score END) AS steady, count(*) AS n FROM s GROUP BY prompt_id")
def q_function_sql(spark, sf):
    """The same function called from SQL."""
    Rf.register(spark, _with_function().functions[0])
    return spark.sql("SELECT prompt_id, sum(steady(gen_idx, syntax_score)) AS steady, count(*) AS n FROM {r} GROUP BY prompt_id",
                     r=fixture(spark, sf, "fx_rollouts"))


# ---- raw completion samples
@register("sample_raw_completions", duck_with("fx_completions") + f"""
, s AS (SELECT *, CAST(floor(prompt_id / 8) AS BIGINT) + 1 AS step FROM fx_completions),
r AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY prompt_id, completion_id) AS rank_in_step FROM s WHERE step = 1 OR step % 10 = 0)
SELECT step, completion_id, CAST(rank_in_step AS BIGINT) AS rank_in_step, completion AS raw,
  regexp_replace(completion, '{_special_re_duck()}', '', 'g') AS cleaned FROM r WHERE rank_in_step <= 4""")
def q_sample_raw(spark, sf):
    """At step 1 and every tenth step, the first four completions, raw and cleaned."""
    d = fixture(spark, sf, "fx_completions").withColumn("step", F.floor(F.col("prompt_id") / 8).cast("bigint") + 1)
    d = Wn.first_k_per_step(d.where("step = 1 OR step % 10 = 0"), 4, order_cols=["prompt_id", "completion_id"])
    return d.select("step", "completion_id", F.col("rank_in_step").cast("bigint"), F.col("completion").alias("raw"),
                    Mk.strip_special_tokens("completion").alias("cleaned"))


# ---- code rewards per completion
BASE_NS = 40


@register("completion_code_rewards", "WITH " + duck_with("fx_code_runs")[5:].rstrip() + ", " + CODE_CTE[5:] + f"""
, j AS (SELECT a.completion_id, u.*, code IS NOT NULL AND coalesce(syntax_ok, false) AS has,
          code IS NOT NULL AND coalesce(syntax_ok, false) AND u.define_ok AS ran FROM a JOIN fx_code_runs u USING (completion_id))
SELECT completion_id, CAST(CASE WHEN NOT has THEN -2.0 WHEN NOT define_ok THEN -0.5 ELSE 1.0 END AS DOUBLE) AS works_score,
  CAST(CASE WHEN NOT ran THEN 0.0 WHEN amax_error IS NULL THEN -2.0 ELSE {_band_sql('amax_error')} + {_band_sql('mse_error')} END AS DOUBLE) AS correctness_score,
  round(CASE WHEN NOT ran OR median_ns IS NULL THEN 0.0 WHEN median_ns >= {BASE_NS} THEN greatest(-10.0, -(median_ns / {BASE_NS}) / 100)
    ELSE least(10.0, ({BASE_NS} / median_ns) / 100) END, 6) AS speed_score,
  CAST(CASE WHEN NOT ran THEN 0.0 WHEN outcome = 'success' THEN 20.0 WHEN outcome = 'timeout' THEN -1.0 WHEN outcome = 'exception' THEN -3.0 ELSE 2.0 END AS DOUBLE) AS outcome_score
FROM j""")
def q_completion_code(spark, sf):
    d = _audited(spark, sf).join(fixture(spark, sf, "fx_code_runs"), "completion_id")
    return rounded(C.completion_rewards(d, BASE_NS).select("completion_id", "works_score", "correctness_score", "speed_score", "outcome_score"))


# ---- drops that happen: chats made of documents, and a tight sequence limit
TIGHT = LengthLimits(max_seq_length=1500)
LONG_CTE = duck_with("fx_chat_long").rstrip() + ",\nfx_chat AS (SELECT * FROM fx_chat_long)" + PREP_CTE[PREP_CTE.index("\n, b AS ("):] \
    .replace(f"> {LIM.max_seq_length} THEN 'total_too_long'", f"> {TIGHT.max_seq_length} THEN 'total_too_long'")


def _long(spark, sf):
    return Pr.prepare_examples(dealt(fixture(spark, sf, "fx_chat_long"), "conv_id"), TIGHT, keep_dropped=True)


@register("filter_report_long", LONG_CTE + """
SELECT coalesce(drop_reason, 'kept') AS reason, count(*) AS n, 100.0 * count(*) / greatest(sum(count(*)) OVER (), 1) AS pct FROM f GROUP BY 1""")
def q_filter_long(spark, sf):
    return Pr.filter_report(_long(spark, sf))


def _drop_query(reason: str):
    def build(spark, sf):
        return _long(spark, sf).where(F.col("drop_reason") == reason).select("conv_id", "prompt_tokens", "gt_completion_tokens")
    return build


for _name, _reason in (("drop_long_prompt", "prompt_too_long"), ("drop_long_total", "total_too_long"),
                       ("drop_long_gt", "completion_too_long"), ("drop_no_user_long", "no_user_msg")):
    register(_name, LONG_CTE + f"SELECT conv_id, prompt_tokens, gt_completion_tokens FROM f WHERE drop_reason = '{_reason}'")(_drop_query(_reason))


@register("flag_no_gt_sql", LONG_CTE + "SELECT conv_id, ground_truth_sql = '' AS no_gt_sql FROM f WHERE drop_reason IS NULL")
def q_flag_no_gt(spark, sf):
    return _long(spark, sf).where("drop_reason IS NULL").select("conv_id", "no_gt_sql")


@register("completion_text", duck_with("fx_chat") + """
SELECT conv_id, coalesce(list_filter(messages, lambda m: m.role = 'assistant')[1].content, '') AS completion_text FROM fx_chat""")
def q_completion_text(spark, sf):
    d = fixture(spark, sf, "fx_chat").withColumn("completion", F.filter("messages", lambda m: m["role"] == "assistant"))
    return d.select("conv_id", Pr.completion_text("completion").alias("completion_text"))


# ---- tool turns
TOOLS_CTE = duck_with("fx_tools") + """
, a AS (SELECT *, role = 'assistant' AND tool_name IS NULL AS answer FROM fx_tools),
b AS (SELECT *, coalesce(bool_or(answer) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS later_answer,
        coalesce(sum(CAST(answer AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span FROM a),
t AS (SELECT *, last_value(tool_name IGNORE NULLS) OVER (PARTITION BY conv_id, span ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_tool FROM b)
"""


@register("turn_context", TOOLS_CTE + "SELECT conv_id, turn, later_answer, last_tool FROM t")
def q_turn_context(spark, sf):
    return Pr.tool_turns(fixture(spark, sf, "fx_tools")).select("conv_id", "turn", "later_answer", "last_tool")


@register("chat_lint", TOOLS_CTE + """
, l AS (SELECT conv_id,
  CAST(count_if(role = 'assistant' AND regexp_matches(coalesce(thinking, ''), '<\\|channel\\|>(?:analysis|final)<\\|message\\|>')) AS BIGINT) AS n_channel_tags,
  CAST(count_if(role = 'assistant' AND tool_name IS NOT NULL AND coalesce(text, '') <> '' AND coalesce(thinking, '') <> '') AS BIGINT) AS n_both_with_call,
  CAST(count_if(role = 'tool' AND last_tool IS NULL) AS BIGINT) AS n_result_without_call FROM t GROUP BY conv_id)
SELECT *, n_channel_tags = 0 AND n_both_with_call = 0 AND n_result_without_call = 0 AS ok FROM l""")
def q_chat_lint(spark, sf):
    return Pr.chat_lint(Pr.tool_turns(fixture(spark, sf, "fx_tools")))


# The rules of a turn, branch by branch.
ANALYSIS, FINAL = "'<|start|>assistant<|channel|>analysis<|message|>'", "'<|start|>assistant<|channel|>final<|message|>'"
TURN_SQL = f"""CASE WHEN role = 'user' THEN '<|start|>user<|message|>' || coalesce(text, '') || '<|end|>'
  WHEN role = 'tool' THEN '<|start|>functions.' || coalesce(last_tool, '') || ' to=assistant<|channel|>commentary<|message|>' || coalesce(text, '') || '<|end|>'
  WHEN role <> 'assistant' THEN ''
  WHEN tool_name IS NOT NULL THEN
    CASE WHEN later_answer THEN '' WHEN coalesce(text, '') <> '' THEN {ANALYSIS} || text || '<|end|>'
         WHEN coalesce(thinking, '') <> '' THEN {ANALYSIS} || thinking || '<|end|>' ELSE '' END
    || '<|start|>assistant to=functions.' || tool_name || '<|channel|>commentary ' || coalesce(content_type, 'json') || '<|message|>' || coalesce(arguments, '') || '<|call|>'
  WHEN thinking IS NOT NULL THEN {ANALYSIS} || thinking || '<|end|>'
  ELSE {FINAL} || coalesce(text, '') || '<|end|>' END"""


@register("render_tool_turns", TOOLS_CTE + f"SELECT conv_id, turn, {TURN_SQL} AS rendered FROM t")
def q_render_tools(spark, sf):
    return Pr.tool_turns(fixture(spark, sf, "fx_tools")).select("conv_id", "turn", Pr.render_turn().alias("rendered"))


# ---- tools in the prompt: the expected block of each layout, written out by hand
_SPACE = " " * 16
BLOCKS = [
    "// Time of part @key.\ntype now = () => any;\n\n",
    "// Finds @brand.\ntype find = (_: {\n// what to find\nquery: string,\ntop?: number, // default: @size,\n}) => any;\n\n// Time.\ntype now = () => any;\n\n",
    "// Picks.\ntype pick = (_: {\nkind?: \"small\" | \"@brand\", // default: small,\nname?: string | null, // default: \"a, b: @key\",\n}) => any;\n\n",
    "// Lists.\ntype lists = (_: {\ntags?: string[], // default: [\"x,y\", \"@brand\"],\nnums?: number[] | null,\ngrid: number[][],\nrest?: any[],\nflags?: boolean[],\n}) => any;\n\n",
    "// Nested.\ntype deep = (_: {\nbox?: {\nb: \n" + _SPACE + "boolean, a?: \n" + _SPACE + "{\nz?: \n" + _SPACE + "string | null}}, // default: {\"b\": true, \"a\": {\"z\": null}},\n"
    "bag?: object,\nfar?: any[],\nnear?: {\nx?: \n" + _SPACE + "number}[],\n}) => any;\n\n",
    "// Unions.\ntype either = (_: {\none?: string// a name" + " " * 20 + "// default: \"x\" | \nnumber// default: y,\ntwo?: any,\nthree?: string | null,\nfour?: any[],\nfive?: any,\n}) => any;\n\n",
]


def _block_sql() -> str:
    def text(t: str) -> str:
        quoted = " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in t.split("\n"))
        return f"replace(replace(replace({quoted}, '@key', CAST(set_id AS VARCHAR)), '@brand', p_brand), '@size', CAST(p_size AS VARCHAR))"
    cases = " ".join(f"WHEN {i} THEN " + text("## functions\n\nnamespace functions {\n\n" + b + "} // namespace functions") for i, b in enumerate(BLOCKS))
    return f"CASE layout {cases} END"


@register("tools_block", duck_with("fx_tool_lists") + f"SELECT set_id, {_block_sql()} AS tools_block FROM fx_tool_lists")
def q_tools_block(spark, sf):
    return T.with_tools_block(fixture(spark, sf, "fx_tool_lists").select("set_id", "tools")).select("set_id", "tools_block")


def _system_sql(date: str) -> str:
    head = f"{Pr.MODEL_IDENTITY}\nKnowledge cutoff: {Pr.KNOWLEDGE_CUTOFF}\nCurrent date: {date}\n\nReasoning: {Pr.DEFAULT_REASONING_EFFORT}\n\n{Pr.CHANNELS_LINE}"
    quoted = " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in head.split("\n"))
    return (f"'<|start|>system<|message|>' || {quoted} || CASE WHEN b IS NULL THEN '' ELSE chr(10) || 'Calls to these tools must go to the commentary channel: ''functions''.' END || '<|end|>'")


_BOTH = "coalesce(CASE WHEN coalesce(dev, '') <> '' THEN '# Instructions' || chr(10) || chr(10) || dev END, '') || CASE WHEN coalesce(dev, '') <> '' AND b IS NOT NULL THEN chr(10) || chr(10) ELSE '' END || coalesce('# Tools' || chr(10) || chr(10) || b, '')"


@register("render_tool_chats", TOOLS_CTE + f""", {duck_with("fx_tool_lists")[5:].strip()}
, r AS (SELECT conv_id, string_agg({TURN_SQL}, '' ORDER BY turn) AS body,
          max(CASE WHEN role IN ('system', 'developer') AND turn = f THEN text END) AS dev
        FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS f FROM t) GROUP BY conv_id),
c AS (SELECT r.*, {_block_sql()} AS b FROM r LEFT JOIN fx_tool_lists l ON l.set_id = r.conv_id)
SELECT conv_id, {_system_sql("2025-01-01")} || CASE WHEN {_BOTH} = '' THEN '' ELSE '<|start|>developer<|message|>' || {_BOTH} || '<|end|>' END
  || body || '<|start|>assistant' AS rendered FROM c""")
def q_render_tool_chats(spark, sf):
    """Whole conversations with calls, each with the tool list of the part of its number."""
    lists = fixture(spark, sf, "fx_tool_lists").select(F.col("set_id").alias("conv_id"), "tools")
    return Pr.render_tool_chats(Pr.tool_turns(fixture(spark, sf, "fx_tools")), lists)
