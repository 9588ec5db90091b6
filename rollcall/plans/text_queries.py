"""Registered queries for response/prompt parsing and SQL text similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions.text import py_strip
from ..sources.fixtures import duck_with, fixture
from .registry import dealt, register, rounded

GT_SQL = "SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = 1"


def STRIP(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


CO = duck_with("fx_completions")
CHANNELS_CTE = CO + f"""
, a AS (SELECT completion_id, template, completion AS t,
  CASE WHEN instr(completion, '<|start|>assistant<|channel|>analysis<|message|>') > 0
         THEN {STRIP("regexp_extract(completion, '(?s)<\\|start\\|>assistant<\\|channel\\|>analysis<\\|message\\|>(.*?)(?:<\\|end\\|>|<\\|return\\|>|<\\|start\\|>|$)', 1)")}
       WHEN instr(completion, '<|channel|>analysis<|message|>') > 0
         THEN {STRIP("regexp_extract(completion, '(?s)<\\|channel\\|>analysis<\\|message\\|>(.*?)(?:<\\|end\\|>|<\\|return\\|>|<\\|channel\\|>|$)', 1)")}
       ELSE '' END AS th1,
  CASE WHEN instr(completion, '<|start|>assistant<|channel|>final<|message|>') > 0
         THEN {STRIP("regexp_extract(completion, '(?s)<\\|start\\|>assistant<\\|channel\\|>final<\\|message\\|>(.*?)(?:<\\|return\\|>|<\\|end\\|>|$)', 1)")}
       WHEN instr(completion, '<|channel|>final<|message|>') > 0
         THEN {STRIP("regexp_extract(completion, '(?s)<\\|channel\\|>final<\\|message\\|>(.*?)(?:<\\|return\\|>|<\\|end\\|>|$)', 1)")}
       ELSE '' END AS co1
  FROM fx_completions),
b AS (SELECT *, th1 = '' AND co1 = '' AND starts_with(t, 'analysis') AS bare, substr(t, 9) AS inner_t,
             instr(substr(t, 9), 'assistantfinal') AS af FROM a),
c AS (SELECT completion_id, template, t,
        CASE WHEN bare THEN (CASE WHEN af > 0 THEN {STRIP("substr(inner_t, 1, af - 1)")} ELSE {STRIP("inner_t")} END) ELSE th1 END AS th2,
        CASE WHEN bare AND af > 0 THEN {STRIP("substr(inner_t, af + 14)")} ELSE co1 END AS co2 FROM b),
ch AS (SELECT completion_id, template, t, th2 AS thinking,
         CASE WHEN th2 = '' AND co2 = '' THEN {STRIP("t")} ELSE co2 END AS content FROM c)
"""


@register("parse_channels", CHANNELS_CTE + "SELECT completion_id, thinking, content FROM ch")
def q_parse_channels(spark, sf):
    d = fixture(spark, sf, "fx_completions")
    return d.select("completion_id", P.parse_channels("completion").alias("p")).select("completion_id", "p.thinking", "p.content")


@register("extract_thinking", CHANNELS_CTE + "SELECT completion_id, thinking FROM ch")
def q_extract_thinking(spark, sf):
    d = fixture(spark, sf, "fx_completions")
    return d.select("completion_id", P.extract_thinking("completion").alias("thinking"))


_T1 = "(?is)\\[THINK\\](.*?)\\[/THINK\\](.*)"
_T2 = "(?is)<think>(.*?)</think>(.*)"


@register("parse_think_tags", CO + f"""
SELECT completion_id,
  CASE WHEN regexp_matches(completion, '{_T1}') THEN {STRIP(f"regexp_extract(completion, '{_T1}', 1)")}
       WHEN regexp_matches(completion, '{_T2}') THEN {STRIP(f"regexp_extract(completion, '{_T2}', 1)")} ELSE '' END AS thinking,
  CASE WHEN regexp_matches(completion, '{_T1}') THEN {STRIP(f"regexp_extract(completion, '{_T1}', 2)")}
       WHEN regexp_matches(completion, '{_T2}') THEN {STRIP(f"regexp_extract(completion, '{_T2}', 2)")} ELSE {STRIP("completion")} END AS content
FROM fx_completions""")
def q_parse_think(spark, sf):
    d = fixture(spark, sf, "fx_completions")
    return d.select("completion_id", P.parse_think_tags("completion").alias("p")).select("completion_id", "p.thinking", "p.content")


# Expected SQL per completion layout (derived by tracing the cascade by hand).
SQL_CTE = CO + """
, x AS (SELECT completion_id, prompt_id, template, database_name, completion, CASE template
   WHEN 0 THEN regexp_extract(completion, 'final<\\|message\\|>(.*)<\\|return\\|>', 1)
   WHEN 1 THEN 'SELECT COUNT(*) FROM customer'
   WHEN 2 THEN 'SELECT c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey'
   WHEN 4 THEN 'SELECT o_orderstatus, COUNT(*) FROM orders GROUP BY o_orderstatus'
   WHEN 5 THEN 'SELECT MAX(o_totalprice) FROM orders'
   WHEN 6 THEN 'WITH t AS (SELECT o_custkey FROM orders) SELECT COUNT(*) FROM t'
   WHEN 7 THEN 'WITH t AS (SELECT o_custkey AS k FROM orders) SELECT k FROM t'
   WHEN 9 THEN 'SELECT o_orderkey FROM orders'
   WHEN 11 THEN completion
   ELSE '' END AS sql FROM fx_completions)
"""


def _with_sql(spark, sf):
    d = P.add_parsed(dealt(fixture(spark, sf, "fx_completions"), "completion_id"), "completion")
    return P.add_sql(d, "completion", "sql", content_col="parsed.content")


@register("extract_sql", SQL_CTE + "SELECT completion_id, sql FROM x")
def q_extract_sql(spark, sf):
    return _with_sql(spark, sf).select("completion_id", "sql")


@register("extract_sql_think_tags", SQL_CTE + """
SELECT completion_id, CASE WHEN template = 0 THEN regexp_extract(completion, '(select from .*)$', 1) ELSE sql END AS sql FROM x""")
def q_extract_sql_m(spark, sf):
    d = P.add_sql(dealt(fixture(spark, sf, "fx_completions"), "completion_id"), "completion", "sql", fmt="think", fence_mode="M")
    return d.select("completion_id", "sql")


@register("is_valid_cte", SQL_CTE + "SELECT completion_id, template IN (6, 7) AS valid_cte FROM x")
def q_valid_cte(spark, sf):
    return _with_sql(spark, sf).select("completion_id", P.is_valid_cte("sql").alias("valid_cte"))


@register("extract_cte_balanced", CO + """
SELECT completion_id, CASE template
  WHEN 6 THEN 'WITH t AS (SELECT o_custkey FROM orders) SELECT COUNT(*) FROM t' || chr(10) || '```'
  WHEN 7 THEN 'WITH t AS (SELECT o_custkey AS k FROM orders) SELECT k FROM t;' END AS cte_sql FROM fx_completions""")
def q_balanced(spark, sf):
    """Quote-aware balanced CTE scan over every response."""
    d = dealt(fixture(spark, sf, "fx_completions"), "completion_id")
    return P.add_cte_balanced(d, "completion", "cte_sql").select("completion_id", "cte_sql")


@register("extract_gt_sql", SQL_CTE + f"""
SELECT completion_id, CASE template WHEN 3 THEN {STRIP("completion")} WHEN 10 THEN {STRIP("completion")}
  WHEN 7 THEN 'WITH t AS (SELECT o_custkey AS k FROM orders) SELECT k FROM t'
  WHEN 8 THEN 'WITH t AS (SELECT o_custkey FROM orders' ELSE sql END AS gt_sql FROM x""")
def q_extract_gt(spark, sf):
    d = P.add_gt_sql(dealt(fixture(spark, sf, "fx_completions"), "completion_id"), "completion", "gt_sql")
    return d.select("completion_id", "gt_sql")


PR = duck_with("fx_prompts")


@register("extract_database_name", PR + """
SELECT prompt_id, coalesce(nullif(regexp_extract(prompt, '(?i)Database:\\s*(\\w+)', 1), ''),
  nullif(regexp_extract(prompt, '(?i)database[:\\s]+[''"]?(\\w+)[''"]?', 1), ''),
  nullif(regexp_extract(prompt, '(?i)DB:\\s*(\\w+)', 1), ''), '') AS db_name FROM fx_prompts""")
def q_db_name(spark, sf):
    d = fixture(spark, sf, "fx_prompts")
    return d.select("prompt_id", P.extract_database_name("prompt").alias("db_name"))


def _qh(pat: str) -> str:
    return f"CASE WHEN regexp_matches(prompt, '{pat}') THEN {STRIP(f'regexp_extract(prompt, {chr(39)}{pat}{chr(39)}, 1)')} END"


@register("extract_question_hint", PR + f"""
SELECT prompt_id,
  coalesce({_qh('(?is)Question:\\s*(.+?)(?:Hint:|Schema:|$)')}, {_qh('(?is)question[:\\s]+(.+?)(?:hint|schema|$)')}, '') AS question,
  coalesce({_qh('(?is)Hint:\\s*(.+?)(?:Schema:|$)')}, {_qh('(?is)hint[:\\s]+(.+?)(?:schema|$)')}, '') AS hint
FROM fx_prompts""")
def q_question_hint(spark, sf):
    d = fixture(spark, sf, "fx_prompts")
    return d.select("prompt_id", P.extract_question_hint("prompt").alias("q")).select("prompt_id", "q.question", "q.hint")


_KW = ", ".join(f"'{k}'" for k in P.PROMPT_SCHEMA_KEYWORDS)


@register("extract_prompt_schema", PR + f"""
, s AS (SELECT prompt_id, prompt,
   CASE WHEN regexp_matches(prompt, '(?is)(?:Schema|CREATE TABLE|Tables?:)(.*?)(?:Question:|Hint:|$)')
        THEN regexp_extract(prompt, '(?is)(?:Schema|CREATE TABLE|Tables?:)(.*?)(?:Question:|Hint:|$)', 1) ELSE prompt END AS st
   FROM fx_prompts),
l AS (SELECT prompt_id,
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
   FROM s)
SELECT prompt_id, array_to_string(list_sort(tables), ',') AS tables, array_to_string(list_sort(columns), ',') AS columns FROM l""")
def q_prompt_schema(spark, sf):
    d = fixture(spark, sf, "fx_prompts")
    s = d.select("prompt_id", P.extract_prompt_schema("prompt").alias("s"))
    return s.select("prompt_id", F.array_join(F.array_sort("s.tables"), ",").alias("tables"),
                    F.array_join(F.array_sort("s.columns"), ",").alias("columns"))


TOKEN_RE = ">=|<=|<>|!=|[a-z_][a-z0-9_]*\\.?[a-z0-9_]*|''[^'']*''|\"[^\"]*\"|\\d+\\.?\\d*|[^\\s]"


def TOKENS(x: str) -> str:
    return f"regexp_extract_all(regexp_replace(lower({STRIP(x)}), '\\s+', ' ', 'g'), '{TOKEN_RE}', 0)"


def NGRAMS(t: str, n: int) -> str:
    return (f"CASE WHEN len({t}) >= {n} THEN list_distinct(list_transform(range(1, len({t}) - {n} + 2), "
            f"lambda i: array_to_string({t}[i:i + {n} - 1], chr(1)))) ELSE [] END")


def JACC(a: str, b: str) -> str:
    return (f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 "
            f"ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END")


TOK_CTE = SQL_CTE + f"""
, tk AS (SELECT completion_id, sql, {TOKENS('sql')} AS tp, {TOKENS(f"'{GT_SQL}'")} AS tg FROM x)
"""


@register("tokenize_sql", TOK_CTE + """
SELECT completion_id, CAST(len(tp) AS INTEGER) AS n_tokens, array_to_string(tp, ' ') AS tokens FROM tk""")
def q_tokenize(spark, sf):
    t = _with_sql(spark, sf).withColumn("tp", P.tokenize_sql("sql"))
    return t.select("completion_id", F.size("tp").alias("n_tokens"), F.array_join("tp", " ").alias("tokens"))


@register("ngram_set", TOK_CTE + f"""
SELECT completion_id, CAST(len({NGRAMS('tp', 1)}) AS INTEGER) AS n1, CAST(len({NGRAMS('tp', 2)}) AS INTEGER) AS n2,
  CAST(len({NGRAMS('tp', 3)}) AS INTEGER) AS n3 FROM tk""")
def q_ngram(spark, sf):
    t = _with_sql(spark, sf).withColumn("tp", P.tokenize_sql("sql"))
    return t.select("completion_id", *[F.size(P.ngram_set("tp", n)).alias(f"n{n}") for n in (1, 2, 3)])


@register("jaccard", TOK_CTE + f"""
SELECT completion_id, round({JACC(NGRAMS('tp', 1), NGRAMS('tg', 1))}, 6) AS jaccard FROM tk""")
def q_jaccard(spark, sf):
    t = _with_sql(spark, sf).withColumn("tp", P.tokenize_sql("sql")).withColumn("tg", P.tokenize_sql(F.lit(GT_SQL)))
    return rounded(t.select("completion_id", P.jaccard(P.ngram_set("tp", 1), P.ngram_set("tg", 1)).alias("jaccard")))


@register("ngram_similarity_reward", TOK_CTE + f"""
SELECT completion_id, round(CASE WHEN sql = '' OR len(tp) = 0 OR len(tg) = 0 THEN 0.0 ELSE
  (({JACC(NGRAMS('tp', 1), NGRAMS('tg', 1))}) + ({JACC(NGRAMS('tp', 2), NGRAMS('tg', 2))})
   + ({JACC(NGRAMS('tp', 3), NGRAMS('tg', 3))})) / 3 * 2.0 END, 6) AS ngram_score FROM tk""")
def q_ngram_reward(spark, sf):
    from ..operators import rewards as R
    d = _with_sql(spark, sf)
    return rounded(R.ngram_similarity_reward(d, "sql", "ground_truth_sql").select("completion_id", "ngram_score"))


# Schema items per layout (lookbehind/lookahead are not available in RE2).
ITEMS_CTE = SQL_CTE + """
, it AS (SELECT completion_id, sql, CASE template
   WHEN 0 THEN 'o,orders,orders.o_custkey,orders.o_orderkey'
   WHEN 1 THEN 'coun,customer'
   WHEN 2 THEN 'c,customer,customer.c_custkey,customer.c_name,orders,orders.o_custkey'
   WHEN 4 THEN 'coun,o_orderstatus,orders'
   WHEN 5 THEN 'ma,o_totalprice,orders'
   WHEN 6 THEN 'o_custkey,orders,t'
   WHEN 7 THEN 'k,o_custkey,orders,t'
   WHEN 9 THEN 'o_orderkey,orders'
   WHEN 11 THEN array_to_string(list_sort(list_concat(['o_orderkey', 'o_orderpriority', 'o_totalprice', 'orders'],
     list_filter(regexp_extract_all(lower(regexp_extract(completion, '''[0-9]-([^'']*)''', 1)), '[a-z_]+', 0),
                 lambda w: w <> 'not'))), ',')
   ELSE '' END AS items FROM x)
"""


@register("schema_items", ITEMS_CTE + "SELECT completion_id, items FROM it")
def q_schema_items(spark, sf):
    d = P.add_schema_items(_with_sql(spark, sf), "sql", "found")
    return d.select("completion_id", F.array_join(F.array_sort("found"), ",").alias("items"))


@register("schema_linking_reward", ITEMS_CTE + f"""
, sp AS (SELECT completion_id, sql, CASE WHEN items = '' THEN [] ELSE string_split(items, ',') END AS a,
           string_split('o,orders,orders.o_custkey,orders.o_orderkey', ',') AS b FROM it)
SELECT completion_id, round(CASE WHEN sql = '' THEN 0.0 ELSE 2.0 * ({JACC('a', 'b')}) END, 6) AS schema_score FROM sp""")
def q_schema_reward(spark, sf):
    from ..operators import rewards as R
    d = _with_sql(spark, sf)
    return rounded(R.schema_linking_reward(d, "sql", "ground_truth_sql").select("completion_id", "schema_score"))
