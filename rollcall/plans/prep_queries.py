"""Registered queries for dataset preparation over chat records (fx_chat)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..config import LengthLimits, MAX_SEQ_LENGTH, NUM_GENERATIONS
from ..functions import parsing as P
from ..functions.text import py_words
from ..operators import prepare as Pr
from ..operators import tokens as Tk
from ..session import checkpoint_dir
from ..sources import jsonl as J
from ..sources.fixtures import duck_with, fixture
from .registry import dealt, register, rounded
from .text_queries import STRIP

LIM = LengthLimits()
CH = duck_with("fx_chat")
TOKEN_RE_SQL = Pr.TOKEN_RE


def TOK(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{TOKEN_RE_SQL}', 0)) AS INTEGER)"


PM = ("list_transform(list_filter(messages, lambda m: m.role <> 'assistant'), "
      "lambda m: {'role': m.role, 'content': m.content})")
SYSTEM_SQL = ("'<|start|>system<|message|>" + Pr.MODEL_IDENTITY + "' || chr(10) || 'Knowledge cutoff: "
              + Pr.KNOWLEDGE_CUTOFF + "' || chr(10) || 'Current date: 2025-01-01' || chr(10) || chr(10) || "
              "'Reasoning: medium' || chr(10) || chr(10) || '" + Pr.CHANNELS_LINE + "<|end|>'")


def RENDER(m: str, gen: bool = True, thinking: bool = False) -> str:
    is_dev = f"coalesce({m}[1].role IN ('developer', 'system'), false)"
    th = "x.thinking" if thinking else "CAST(NULL AS VARCHAR)"
    analysis = f"'<|start|>assistant<|channel|>analysis<|message|>' || {th} || '<|end|>'"
    final = "'<|start|>assistant<|channel|>final<|message|>' || coalesce(x.content, '') || '<|end|>'"
    last = "false" if gen else f"i = len(CASE WHEN {is_dev} THEN {m}[2:] ELSE {m} END)"
    turn = (f"CASE WHEN x.role = 'user' THEN '<|start|>user<|message|>' || coalesce(x.content, '') || '<|end|>' "
            f"WHEN x.role = 'assistant' THEN (CASE WHEN {last} THEN (CASE WHEN {th} IS NOT NULL THEN {analysis} ELSE '' END) || {final} "
            f"WHEN {th} IS NOT NULL THEN {analysis} ELSE {final} END) ELSE '' END")
    dev = f"CASE WHEN {is_dev} THEN coalesce({m}[1].content, '') ELSE '' END"
    return (f"({SYSTEM_SQL} || CASE WHEN {dev} <> '' THEN '<|start|>developer<|message|># Instructions' || chr(10) || chr(10) "
            f"|| {dev} || '<|end|>' ELSE '' END || coalesce(array_to_string(list_transform(CASE WHEN {is_dev} THEN {m}[2:] ELSE {m} END, "
            f"lambda x, i: {turn}), ''), '') || '{'<|start|>assistant' if gen else ''}')")


def _chat(spark, sf):
    return dealt(fixture(spark, sf, "fx_chat"), "conv_id")


@register("prompt_messages", CH + f"""
SELECT conv_id, array_to_string(list_transform({PM}, lambda m: m.role), ',') AS prompt_roles,
  CAST(len({PM}) AS INTEGER) AS n_prompt_messages FROM fx_chat""")
def q_prompt_messages(spark, sf):
    d = _chat(spark, sf).withColumn("pm", Pr.prompt_messages("messages"))
    return d.select("conv_id", F.array_join(F.transform("pm", lambda m: m["role"]), ",").alias("prompt_roles"),
                    F.size("pm").alias("n_prompt_messages"))


@register("append_scaffold", CH + f"""
SELECT conv_id, CAST(list_sum(list_transform(messages, lambda m: length(CASE WHEN m.role = 'system'
  THEN coalesce(m.content, '') || '{Pr.THINKING_SCAFFOLD.replace(chr(10), "' || chr(10) || '")}' ELSE m.content END))) AS BIGINT) AS total_chars
FROM fx_chat""")
def q_scaffold(spark, sf):
    d = _chat(spark, sf).withColumn("m2", Pr.append_scaffold("messages"))
    return d.select("conv_id", F.aggregate("m2", F.lit(0).cast("bigint"),
                                           lambda acc, m: acc + F.length(m["content"])).alias("total_chars"))


@register("first_by_role", CH + """
SELECT conv_id, coalesce(list_filter(messages, lambda m: m.role = 'user')[1].content, '') AS first_user,
  coalesce(list_filter(messages, lambda m: m.role = 'assistant')[1].content, '') AS first_assistant FROM fx_chat""")
def q_first_by_role(spark, sf):
    d = _chat(spark, sf)
    return d.select("conv_id", F.coalesce(Pr.first_by_role("messages", "user")["content"], F.lit("")).alias("first_user"),
                    F.coalesce(Pr.first_by_role("messages", "assistant")["content"], F.lit("")).alias("first_assistant"))


@register("prompt_text", CH + f"""
, p AS (SELECT conv_id, {PM} AS pm FROM fx_chat)
SELECT conv_id, coalesce(list_filter(pm, lambda m: m.role = 'user')[-1].content, pm[-1].content, '') AS prompt_text FROM p""")
def q_prompt_text(spark, sf):
    d = _chat(spark, sf).withColumn("pm", Pr.prompt_messages("messages"))
    return d.select("conv_id", Pr.prompt_text("pm").alias("prompt_text"))


@register("render_chat", CH + f"""
, p AS (SELECT conv_id, {PM} AS pm FROM fx_chat)
SELECT conv_id, {RENDER('pm')} AS rendered FROM p""")
def q_render(spark, sf):
    d = _chat(spark, sf).withColumn("pm", Pr.prompt_messages("messages"))
    return d.select("conv_id", Pr.render_chat("pm", True, has_thinking=False).alias("rendered"))


@register("render_chat_training", CH + f"""
SELECT conv_id, {RENDER('messages', gen=False, thinking=True)} AS rendered FROM fx_chat""")
def q_render_train(spark, sf):
    d = _chat(spark, sf)
    return d.select("conv_id", Pr.render_chat("messages", False).alias("rendered"))


@register("count_tokens", CH + f"""
, p AS (SELECT conv_id, {RENDER(PM)} AS t FROM fx_chat)
SELECT conv_id, {TOK('t')} AS prompt_tokens FROM p""")
def q_count_tokens(spark, sf):
    d = _chat(spark, sf).withColumn("pm", Pr.prompt_messages("messages"))
    return d.select("conv_id", Pr.count_tokens(Pr.render_chat("pm", True, has_thinking=False)).alias("prompt_tokens"))


PREP_CTE = CH + f"""
, b AS (SELECT conv_id, messages, {PM} AS pm FROM fx_chat),
c AS (SELECT *, coalesce(list_bool_or(list_transform(pm, lambda m: m.role = 'user')), false) AS has_user,
        {RENDER('pm')} AS prompt_text,
        list_filter(messages, lambda m: m.role = 'assistant')[1] AS asst,
        list_filter(messages, lambda m: m.role = 'user')[1] AS usr FROM b),
d AS (SELECT *, {TOK('prompt_text')} AS prompt_tokens, coalesce(asst.content, '') AS gt_raw,
        coalesce(asst.thinking, '') AS gt_thinking FROM c),
e AS (SELECT *, CASE WHEN asst IS NOT NULL THEN {TOK("(CASE WHEN gt_thinking <> '' THEN gt_thinking || chr(10) ELSE '' END) || gt_raw")}
        ELSE 0 END AS gt_completion_tokens, {STRIP('gt_raw')} AS gs FROM d),
f AS (SELECT *, CASE WHEN NOT has_user THEN 'no_user_msg' WHEN prompt_tokens > {LIM.max_prompt_length} THEN 'prompt_too_long'
        WHEN prompt_tokens + {LIM.max_completion_length} > {LIM.max_seq_length} THEN 'total_too_long'
        WHEN asst IS NOT NULL AND gt_completion_tokens > {LIM.max_completion_length} THEN 'completion_too_long' END AS drop_reason,
      CASE WHEN gs = '' THEN ''
        WHEN upper(gs) LIKE 'SELECT%' OR upper(gs) LIKE 'WITH%' THEN {STRIP("regexp_replace(gs, ';+$', '')")}
        WHEN regexp_matches(gs, '(?im)^\\s*(?:SELECT|WITH)') THEN {STRIP("regexp_extract(gs, '(?im)^\\s*((?:SELECT|WITH).*)', 1)")}
        ELSE gs END AS ground_truth_sql,
      coalesce(nullif(regexp_extract(coalesce(usr.content, ''), '(?i)Database:\\s*(\\w+)', 1), ''),
        nullif(regexp_extract(coalesce(usr.content, ''), '(?i)database[:\\s]+[''"]?(\\w+)[''"]?', 1), ''),
        nullif(regexp_extract(coalesce(usr.content, ''), '(?i)DB:\\s*(\\w+)', 1), ''), '') AS database_name
    FROM e)
"""


def _prepared(spark, sf, keep=False):
    return Pr.prepare_examples(_chat(spark, sf), LIM, keep_dropped=keep)


@register("prepare_examples", PREP_CTE + """
SELECT conv_id, prompt_tokens, gt_completion_tokens, ground_truth_sql, database_name, ground_truth_sql = '' AS no_gt_sql
FROM f WHERE drop_reason IS NULL""")
def q_prepare(spark, sf):
    return _prepared(spark, sf).select("conv_id", "prompt_tokens", "gt_completion_tokens", "ground_truth_sql",
                                       "database_name", "no_gt_sql")


@register("drop_no_user", PREP_CTE + "SELECT conv_id FROM f WHERE has_user")
def q_drop_no_user(spark, sf):
    d = _chat(spark, sf)
    return d.where(F.exists(Pr.prompt_messages("messages"), lambda m: m["role"] == "user")).select("conv_id")


@register("filter_report", PREP_CTE + """
SELECT coalesce(drop_reason, 'kept') AS reason, count(*) AS n,
  round(100.0 * count(*) / greatest(sum(count(*)) OVER (), 1), 6) AS pct FROM f GROUP BY 1""")
def q_filter_report(spark, sf):
    return rounded(Pr.filter_report(_prepared(spark, sf, keep=True)))


LEN_CTE = CH + f"""
, b AS (SELECT conv_id, messages, {PM} AS pm, list_filter(messages, lambda m: m.role = 'assistant')[1] AS asst FROM fx_chat),
c AS (SELECT conv_id, asst IS NOT NULL AS has_assistant, {TOK(RENDER('pm'))} AS prompt_tokens,
        CASE WHEN asst IS NOT NULL THEN {TOK("coalesce(asst.content, '')")} ELSE 0 END AS content_tokens,
        CASE WHEN asst IS NOT NULL THEN {TOK("coalesce(asst.thinking, '')")} ELSE 0 END AS thinking_tokens FROM b),
l AS (SELECT *, content_tokens + thinking_tokens AS completion_tokens,
        prompt_tokens + content_tokens + thinking_tokens AS total_tokens FROM c)
"""


def _lengths(spark, sf):
    return Pr.with_lengths(_chat(spark, sf))


@register("truncation_report", LEN_CTE + f"""
SELECT CAST(count_if(prompt_tokens > {LIM.max_prompt_length}) AS BIGINT) AS n_prompt_over,
  round(100.0 * count_if(prompt_tokens > {LIM.max_prompt_length}) / greatest(count(*), 1), 6) AS pct_prompt_over,
  CAST(count_if(has_assistant AND completion_tokens > {LIM.max_completion_length}) AS BIGINT) AS n_completion_over,
  round(100.0 * count_if(has_assistant AND completion_tokens > {LIM.max_completion_length}) / greatest(count(*), 1), 6) AS pct_completion_over
FROM l""")
def q_truncation(spark, sf):
    return rounded(Pr.truncation_report(_lengths(spark, sf), LIM))


def _stats_sql():
    series = [("prompt", "prompt_tokens", None), ("completion", "completion_tokens", "has_assistant"),
              ("thinking", "thinking_tokens", "has_assistant"), ("sql", "content_tokens", "has_assistant"),
              ("total", "total_tokens", None)]
    parts = []
    for name, c, cond in series:
        v = c if cond is None else f"CASE WHEN {cond} THEN {c} END"
        parts.append(f"""SELECT '{name}' AS series, CAST(min({v}) AS BIGINT) AS min, CAST(max({v}) AS BIGINT) AS max,
  round(avg({v}), 6) AS mean, round(quantile_cont({v}, 0.5), 6) AS median, round(stddev_pop({v}), 6) AS std,
  round(quantile_cont({v}, 0.9), 6) AS p90, round(quantile_cont({v}, 0.95), 6) AS p95,
  round(quantile_cont({v}, 0.99), 6) AS p99, count({v}) AS n FROM l""")
    return LEN_CTE + "\nUNION ALL\n".join(parts)


@register("token_stats", _stats_sql())
def q_token_stats(spark, sf):
    return rounded(Pr.token_stats(_lengths(spark, sf)))


@register("length_histogram", LEN_CTE + """
, bins(bin, lo, hi) AS (VALUES (0, 0, 256), (1, 256, 512), (2, 512, 1024), (3, 1024, 1536), (4, 1536, 2048),
      (5, 2048, 3072), (6, 3072, 4096), (7, 4096, NULL))
SELECT bin, lo, hi, count(l.conv_id) AS n FROM bins LEFT JOIN l
  ON l.prompt_tokens >= bins.lo AND (bins.hi IS NULL OR l.prompt_tokens < bins.hi) GROUP BY bin, lo, hi""")
def q_histogram(spark, sf):
    return Pr.length_histogram(_lengths(spark, sf))


@register("length_budget", LEN_CTE + f"""
SELECT max(prompt_tokens) + 1 AS max_prompt_length, {MAX_SEQ_LENGTH} - (max(prompt_tokens) + 1) AS max_completion_length FROM l""")
def q_budget(spark, sf):
    return Pr.length_budget(_lengths(spark, sf), MAX_SEQ_LENGTH)


@register("text_profile", f"""
SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS n_chars,
  CAST(CASE WHEN {STRIP('text')} = '' THEN 0 ELSE len(string_split_regex({STRIP('text')}, '\\s+')) END AS INTEGER) AS n_words,
  replace(substr(text, 1, 100), chr(10), ' ') AS preview FROM conversations""")
def q_text_profile(spark, sf):
    from ..sources.tables import table
    d = Pr.text_profile(table(spark, sf, "conversations"), "text")
    return d.select("conv_id", "turn", "n_chars", "n_words", "preview")


@register("token_head", f"""
SELECT conv_id, turn, CAST(generate_subscripts(toks, 1) - 1 AS INTEGER) AS pos, unnest(toks) AS token FROM (
  SELECT conv_id, turn, regexp_extract_all(text, '{TOKEN_RE_SQL}', 0)[1:50] AS toks FROM conversations)""")
def q_token_head(spark, sf):
    from ..sources.tables import table
    d = Pr.token_head(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "text")
    return d.select("conv_id", "turn", "pos", "token")


@register("replicate_prompt", CH + f"""
SELECT conv_id, CAST(unnest(range(1, {NUM_GENERATIONS} + 1)) AS INTEGER) AS replica FROM fx_chat""")
def q_replicate(spark, sf):
    d = _chat(spark, sf)
    return J.replicate(d, NUM_GENERATIONS).select("conv_id", "replica")


@register("train_val_limit", CH + "SELECT conv_id FROM fx_chat ORDER BY conv_id LIMIT 50")
def q_train_val(spark, sf):
    return J.limit_rows(_chat(spark, sf), 50, "conv_id").select("conv_id")


@register("holdout_split", CH + "SELECT conv_id, conv_id % 100 < 10 AS is_holdout FROM fx_chat")
def q_holdout(spark, sf):
    return J.holdout_flag(_chat(spark, sf), 10, F.col("conv_id")).select("conv_id", "is_holdout")


@register("dataset_sizes", PREP_CTE + """
, v AS (SELECT * FROM f ORDER BY conv_id LIMIT 50)
SELECT 'train' AS split, count(*) AS n_raw, CAST(count_if(drop_reason IS NULL) AS BIGINT) AS n_kept,
  CAST(count_if(drop_reason IS NOT NULL) AS BIGINT) AS n_dropped FROM f
UNION ALL SELECT 'val', count(*), CAST(count_if(drop_reason IS NULL) AS BIGINT), CAST(count_if(drop_reason IS NOT NULL) AS BIGINT) FROM v""")
def q_dataset_sizes(spark, sf):
    allp = _prepared(spark, sf, keep=True)
    return J.dataset_sizes({"train": allp, "val": J.limit_rows(allp, 50, "conv_id")})


def _scratch(spark, name):
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


@register("load_jsonl", CH + "SELECT conv_id, CAST(len(messages) AS INTEGER) AS n_messages FROM fx_chat")
def q_load_jsonl(spark, sf):
    """Round trip: chat records written as JSON lines, read back with an
    explicit schema in FAILFAST mode."""
    path = _scratch(spark, "chat-jsonl")
    fixture(spark, sf, "fx_chat").write.mode("overwrite").json(path)
    d = J.load_jsonl(spark, path, J.CHAT_SCHEMA)
    return d.select("conv_id", F.size("messages").alias("n_messages"))


@register("write_prepared", PREP_CTE + """
SELECT conv_id, ground_truth_sql, database_name FROM f WHERE drop_reason IS NULL""")
def q_write_prepared(spark, sf):
    path = _scratch(spark, "prepared")
    J.write_prepared(_prepared(spark, sf), path)
    return spark.read.parquet(path).select("conv_id", "ground_truth_sql", "database_name")


# ---- token ids by a public vocabulary: no SQL form (byte-pair merges), tested against its library
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@register("token_ids")
def q_token_ids(spark, sf):
    from ..sources.tables import table
    d = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return Tk.token_dump(d, "text", Tk.Vocabulary(spark, VOCABULARY)).select("conv_id", "turn", "pos", "id", "token", "more")


@register("token_id_stats")
def q_token_id_stats(spark, sf):
    """Length statistics with the vocabulary's counts."""
    return rounded(Pr.token_stats(Pr.with_lengths(_chat(spark, sf), count=Tk.Vocabulary(spark, VOCABULARY).count)))
