"""Registered queries: format / thinking-quality rewards, marker scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markers as Mk
from ..functions import parsing as P
from ..operators import rewards as R
from ..sources.fixtures import duck_with, fixture
from .registry import dealt, register, rounded
from .text_queries import CHANNELS_CTE, SQL_CTE, STRIP

# Format score and rule contributions per completion layout (hand-traced).
FORMAT_RULES = """
, fr(template, rule, delta) AS (VALUES
 (0, 'analysis_open', 0.2), (0, 'analysis_closed', 0.1), (0, 'final_open', 0.2), (0, 'final_closed', 0.1),
 (0, 'ordering', 0.2), (0, 'no_duplicates', 0.2), (0, 'schema_indicators', 0.25), (0, 'has_sql', 0.25),
 (0, 'sql_starts_correctly', 0.25),
 (1, 'analysis_open', 0.2), (1, 'analysis_closed', 0.1), (1, 'final_open', 0.2), (1, 'final_closed', 0.1),
 (1, 'ordering', 0.2), (1, 'no_duplicates', 0.2), (1, 'has_sql', 0.25), (1, 'sql_starts_correctly', 0.25),
 (2, 'partial_analysis_section', 0.2), (2, 'partial_final_section', 0.2), (2, 'partial_ordering', 0.2),
 (2, 'partial_single_assistant', 0.2), (2, 'analysis_open', 0.2), (2, 'schema_indicators', 0.25),
 (2, 'has_sql', 0.25), (2, 'sql_starts_correctly', 0.25), (2, 'no_final_but_sql', -1.0),
 (3, 'partial_analysis_section', 0.2), (3, 'analysis_open', 0.2), (3, 'no_format_no_sql', -1.5),
 (4, 'has_sql', 0.25), (4, 'sql_starts_correctly', 0.25), (4, 'no_final_but_sql', -1.0),
 (5, 'has_sql', 0.25), (5, 'sql_starts_correctly', 0.25), (5, 'no_final_but_sql', -1.0),
 (6, 'has_sql', 0.25), (6, 'sql_starts_correctly', 0.25), (6, 'no_final_but_sql', -1.0),
 (7, 'has_sql', 0.25), (7, 'sql_starts_correctly', 0.25), (7, 'no_final_but_sql', -1.0),
 (8, 'no_format_no_sql', -1.5),
 (9, 'has_sql', 0.25), (9, 'sql_starts_correctly', 0.25), (9, 'no_final_but_sql', -1.0),
 (10, 'no_format_no_sql', -1.5),
 (11, 'has_sql', 0.25), (11, 'sql_starts_correctly', 0.25), (11, 'no_final_but_sql', -1.0))
"""
CO = duck_with("fx_completions")


@register("format_reward", CO + FORMAT_RULES + """
, s AS (SELECT template, sum(CAST(delta AS DOUBLE)) AS raw FROM fr GROUP BY template)
SELECT completion_id, round(greatest(-1.5, least(2.0, raw)), 6) AS format_score
FROM fx_completions JOIN s USING (template)""")
def q_format(spark, sf):
    d = dealt(fixture(spark, sf, "fx_completions"), "completion_id")
    return rounded(R.format_reward(d, "completion").select("completion_id", "format_score"))


@register("scoring_reasons", CO + FORMAT_RULES + """
SELECT rule, count(*) AS n, round(count(*) * CAST(any_value(delta) AS DOUBLE), 6) AS total_delta
FROM fx_completions JOIN fr USING (template) GROUP BY rule""")
def q_reasons(spark, sf):
    d = R.format_reward(dealt(fixture(spark, sf, "fx_completions"), "completion_id"), "completion", with_rules=True)
    return rounded(R.scoring_reasons(d))


def _schema_l(prefix: str) -> str:
    from .text_queries import _KW
    return f"""
, ps AS (SELECT prompt_id, prompt,
   CASE WHEN regexp_matches(prompt, '(?is)(?:Schema|CREATE TABLE|Tables?:)(.*?)(?:Question:|Hint:|$)')
        THEN regexp_extract(prompt, '(?is)(?:Schema|CREATE TABLE|Tables?:)(.*?)(?:Question:|Hint:|$)', 1) ELSE prompt END AS st
   FROM fx_prompts),
pl AS (SELECT prompt_id,
   list_distinct(list_transform(list_concat(
     regexp_extract_all(prompt, '(?im)^Table:\\s+(\\w+)', 1),
     regexp_extract_all(st, '(?i)CREATE\\s+TABLE\\s+[`"'']?(\\w+)[`"'']?', 1),
     regexp_extract_all(st, '(?im)^Table:\\s+(\\w+)', 1),
     regexp_extract_all(st, '(\\w+)\\.(\\w+)', 1)), lambda x: lower(x))) AS tables,
   list_distinct(list_concat(
     list_filter(list_transform(list_concat(
       regexp_extract_all(st, '(?im)^\\s+[`"'']?([a-zA-Z_]\\w*)[`"'']?\\s+(?:{P.DDL_TYPES})', 1),
       regexp_extract_all(st, '(?m)(?:^|\\|)\\s*([a-zA-Z_]\\w*)\\s+\\(', 1)), lambda x: lower(x)), lambda x: NOT list_contains([{_KW}], x)),
     list_transform(regexp_extract_all(st, '(\\w+)\\.(\\w+)', 2), lambda x: lower(x)))) AS columns
   FROM ps),
jn AS (SELECT ch.completion_id, ch.thinking, lower(ch.thinking) AS th, x.sql, lower(x.sql) AS sq,
         coalesce(pl.tables, []) AS tables, coalesce(pl.columns, []) AS columns
       FROM ch JOIN x USING (completion_id) LEFT JOIN pl ON pl.prompt_id = x.prompt_id),
k AS (SELECT *, list_filter(tables, lambda v: contains(th, v)) AS tt, list_filter(columns, lambda v: contains(th, v)) AS ct,
        list_filter(tables, lambda v: contains(sq, v)) AS ts, list_filter(columns, lambda v: contains(sq, v)) AS cs,
        CASE WHEN {STRIP('th')} = '' THEN 0 ELSE len(string_split_regex({STRIP('th')}, '\\s+')) END AS wc FROM jn)
"""


def _with_schema(spark, sf):
    """Completions with their prompt and its schema, extracted once a prompt."""
    p = R.with_prompt_schema(fixture(spark, sf, "fx_prompts").select("prompt_id", "prompt"), "prompt")
    d = dealt(fixture(spark, sf, "fx_completions"), "completion_id").join(p, "prompt_id", "left")
    none = F.struct(F.array().cast("array<string>").alias("tables"), F.array().cast("array<string>").alias("columns"))
    return d.withColumns({"prompt": F.coalesce("prompt", F.lit("")), "schema": F.coalesce("schema", none)})


def _tq_cte():
    base = duck_with("fx_completions", "fx_prompts")
    ch = CHANNELS_CTE[CHANNELS_CTE.index(", a AS ("):]
    sx = SQL_CTE[SQL_CTE.index(", x AS ("):]
    return base + ch + sx + _schema_l("")


@register("thinking_quality_reward", _tq_cte() + """
SELECT completion_id, CAST(round(CASE WHEN length(regexp_replace(thinking, '^\\s+|\\s+$', '', 'g')) < 10 THEN 0.0 ELSE
  greatest(0.0, least(2.0,
    (CASE WHEN len(tt) >= 2 THEN 0.4 WHEN len(tt) >= 1 THEN 0.2 ELSE 0.0 END)
  + (CASE WHEN len(ct) >= 3 THEN 0.4 WHEN len(ct) >= 1 THEN 0.2 ELSE 0.0 END)
  + (CASE WHEN wc >= 30 AND wc <= 400 THEN 0.4 WHEN (wc >= 15 AND wc < 30) OR (wc > 400 AND wc <= 600) THEN 0.2 ELSE 0.0 END)
  + (CASE WHEN sql <> '' AND len(tables) > 0 AND len(tt) > 0 THEN
       (CASE WHEN len(list_filter(tt, lambda v: contains(sq, v))) / len(tt) >= 0.5 THEN 0.4
             WHEN len(list_filter(tt, lambda v: contains(sq, v))) / len(tt) >= 0.25 THEN 0.2 ELSE 0.0 END) ELSE 0.0 END)
  + (CASE WHEN sql <> '' AND len(columns) > 0 AND len(ct) > 0 THEN
       (CASE WHEN len(list_filter(ct, lambda v: contains(sq, v))) / len(ct) >= 0.3 THEN 0.4
             WHEN len(list_filter(ct, lambda v: contains(sq, v))) / len(ct) >= 0.15 THEN 0.2 ELSE 0.0 END) ELSE 0.0 END)))
  END, 6) AS DOUBLE) AS thinking_score FROM k""")
def q_thinking(spark, sf):
    return rounded(R.thinking_quality_reward(_with_schema(spark, sf), "completion", "prompt", schema_col="schema")
                   .select("completion_id", "thinking_score"))


@register("schema_mentions", _tq_cte() + """
SELECT completion_id, CAST(len(tt) AS INTEGER) AS n_tables_in_thinking, CAST(len(ct) AS INTEGER) AS n_columns_in_thinking,
  CAST(len(ts) AS INTEGER) AS n_tables_in_sql, CAST(len(cs) AS INTEGER) AS n_columns_in_sql FROM k""")
def q_mentions(spark, sf):
    d = P.add_parsed(_with_schema(spark, sf), "completion")
    d = P.add_sql(d, "completion", "sql", content_col="parsed.content")
    m = R.schema_mentions(d, "parsed.thinking", "sql", "schema")
    return m.select("completion_id", *[F.size(c).alias(f"n_{c}") for c in
                                       ("tables_in_thinking", "columns_in_thinking", "tables_in_sql", "columns_in_sql")])


def _marker_sql():
    parts = []
    for m, desc in Mk.SCAN_MARKERS:
        ms = m.replace("'", "''")
        ds = desc.replace("'", "''")
        parts.append(f"""SELECT completion_id, '{ms}' AS marker, '{ds}' AS description,
  CAST((length(completion) - length(replace(completion, '{ms}', ''))) / {len(m)} AS INTEGER) AS count,
  CAST(instr(completion, '{ms}') - 1 AS INTEGER) AS pos,
  replace(substr(completion, greatest(instr(completion, '{ms}') - 1 - 20, 0) + 1,
     least(length(completion), instr(completion, '{ms}') - 1 + {len(m)} + 20) - greatest(instr(completion, '{ms}') - 1 - 20, 0)),
     chr(10), '\\n') AS context
  FROM fx_completions WHERE instr(completion, '{ms}') > 0""")
    return CO + "\nUNION ALL\n".join(parts)


@register("marker_scan", _marker_sql())
def q_marker_scan(spark, sf):
    return Mk.marker_scan(fixture(spark, sf, "fx_completions"), "completion", "completion_id")


@register("marker_rates", SQL_CTE + """
SELECT count(*) AS n,
  CAST(count_if(instr(completion, '<|start|>assistant<|channel|>analysis<|message|>') > 0) AS BIGINT) AS n_full_analysis,
  CAST(count_if(instr(completion, '<|channel|>analysis<|message|>') > 0) AS BIGINT) AS n_partial_analysis,
  CAST(count_if(instr(completion, '<|start|>assistant<|channel|>final<|message|>') > 0) AS BIGINT) AS n_full_final,
  CAST(count_if(instr(completion, '<|channel|>final<|message|>') > 0) AS BIGINT) AS n_partial_final,
  CAST(count_if(sql <> '') AS BIGINT) AS n_has_sql FROM x""")
def q_marker_rates(spark, sf):
    d = P.add_sql(dealt(fixture(spark, sf, "fx_completions"), "completion_id"), "completion", "sql")
    t = F.col("completion")
    return d.agg(F.count(F.lit(1)).alias("n"),
                 F.count_if(F.instr(t, P.ANALYSIS_OPEN) > 0).alias("n_full_analysis"),
                 F.count_if(F.instr(t, P.PARTIAL_ANALYSIS) > 0).alias("n_partial_analysis"),
                 F.count_if(F.instr(t, P.FINAL_OPEN) > 0).alias("n_full_final"),
                 F.count_if(F.instr(t, P.PARTIAL_FINAL) > 0).alias("n_partial_final"),
                 F.count_if(F.col("sql") != "").alias("n_has_sql"))


def _special_re_duck():
    return "|".join(t.replace("|", "\\|") for _, t in Mk.SPECIAL_TOKENS)


@register("strip_special_tokens", CO + f"""
SELECT completion_id, regexp_replace(completion, '{_special_re_duck()}', '', 'g') AS stripped FROM fx_completions""")
def q_strip_special(spark, sf):
    d = fixture(spark, sf, "fx_completions")
    return d.select("completion_id", Mk.strip_special_tokens("completion").alias("stripped"))
