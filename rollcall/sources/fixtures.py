"""Derived views over the base tables (same SQL text in Spark and DuckDB).

Each view turns a base table into the shape of one reference input:
scored rollouts, completions, result rows, metric series, timing samples,
code answers, prompts, chat records and a matrix. Spark runs the SQL with
DataFrame parameters (no global temp views); the DuckDB oracle inlines the
same text as a CTE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import table

FX_ROLLOUTS = """
SELECT event_id AS rollout_id,
       CAST(floor(event_id / 4) AS BIGINT)  AS prompt_id,
       CAST(event_id % 4 AS INT)            AS gen_idx,
       CAST(floor(event_id / 32) AS BIGINT) AS step,
       CAST(CASE WHEN event_id % 40 < 4 THEN 0.0
                 WHEN event_type = 'error' THEN -2.0
                 WHEN event_type = 'signup' THEN 0.0 ELSE 2.0 END AS DOUBLE) AS syntax_score,
       CAST(CASE WHEN event_id % 40 < 4 THEN 0.0
                 WHEN event_type = 'purchase' THEN 3.0
                 WHEN event_type = 'click' THEN 0.6
                 WHEN event_type = 'signup' THEN 0.0 ELSE -3.0 END AS DOUBLE) AS result_score,
       CAST(CASE WHEN event_id % 40 < 4 THEN 0 ELSE (event_id * 7) % 11 END AS DOUBLE) / 5  AS schema_score,
       CAST(CASE WHEN event_id % 40 < 4 THEN 0 ELSE (event_id * 13) % 21 END AS DOUBLE) / 10 AS ngram_score
FROM events
"""

FX_ROLLOUTS_TS = FX_ROLLOUTS.replace("SELECT event_id AS rollout_id,", "SELECT event_id AS rollout_id, ts,")

FX_COMPLETIONS = """
SELECT o_orderkey AS completion_id,
       CAST(floor(o_orderkey / 4) AS BIGINT) AS prompt_id,
       CAST(o_orderkey % 12 AS INT) AS template,
       concat('db', CAST(o_orderkey % 3 AS VARCHAR(8))) AS database_name,
       CASE CAST(o_orderkey % 12 AS INT)
         WHEN 0 THEN concat('<|start|>assistant<|channel|>analysis<|message|>Need the orders table, select from orders where o_custkey matches<|end|><|start|>assistant<|channel|>final<|message|>SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = ', CAST(o_custkey AS VARCHAR(20)), '<|return|>')
         WHEN 1 THEN concat('<|channel|>analysis<|message|>look at customer<|end|><|start|>assistant<|channel|>final<|message|>SELECT COUNT(*) FROM customer;<|return|>')
         WHEN 2 THEN concat('analysisNeed to join orders and customerassistantfinal```sql', chr(10), 'SELECT c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey', chr(10), '```')
         WHEN 3 THEN 'analysisThinking that was cut off before the answer'
         WHEN 4 THEN concat('[THINK]scan orders[/THINK]```sql', chr(10), 'SELECT o_orderstatus, COUNT(*) FROM orders GROUP BY o_orderstatus', chr(10), '```')
         WHEN 5 THEN concat('<think>scan</think>```', chr(10), 'SELECT MAX(o_totalprice) FROM orders', chr(10), '```')
         WHEN 6 THEN concat('```', chr(10), 'WITH t AS (SELECT o_custkey FROM orders) SELECT COUNT(*) FROM t', chr(10), '```')
         WHEN 7 THEN 'WITH t AS (SELECT o_custkey AS k FROM orders) SELECT k FROM t;'
         WHEN 8 THEN 'WITH t AS (SELECT o_custkey FROM orders'
         WHEN 9 THEN concat('Answer: SELECT o_orderkey FROM orders', chr(10), chr(10), 'That is all.')
         WHEN 10 THEN 'I cannot answer this question.'
         ELSE concat('SELECT o_orderkey FROM orders WHERE o_orderpriority = ', chr(39), o_orderpriority, chr(39), ' ORDER BY o_totalprice DESC LIMIT 5') END AS completion,
       'SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = 1;' AS ground_truth_sql
FROM orders
"""

# Completions with an arrival time, and when their outcome comes, in minutes (some
# after the patience of ten, some never).
FX_ARRIVALS_SPARK = FX_COMPLETIONS.replace("SELECT o_orderkey AS completion_id,", "SELECT o_orderkey AS completion_id, timestamp_seconds(1704067200 + o_orderkey) AS ts,")
FX_ARRIVALS_DUCK = FX_COMPLETIONS.replace("SELECT o_orderkey AS completion_id,", "SELECT o_orderkey AS completion_id, make_timestamp((1704067200 + o_orderkey) * 1000000) AS ts,")
FX_OUTCOMES = """
SELECT o_orderkey AS completion_id, o_orderkey % 13 AS delay, o_custkey % 5 <> 0 AS success FROM orders WHERE o_orderkey % 17 <> 0
"""

# Recorded executions: sixty statements on four databases, one without files, one
# statement never run; their rows come from the line items.
FX_EXEC_ROLLOUTS = """
SELECT o_orderkey AS rollout_id, concat('db', CAST(o_orderkey % 4 AS VARCHAR(4))) AS db,
       CASE WHEN o_orderkey % 19 = 0 THEN '' WHEN o_orderkey % 23 = 0 THEN NULL
            ELSE concat('SELECT a, b FROM t WHERE k = ', CAST(o_orderkey % 60 AS VARCHAR(4))) END AS sql,
       CASE WHEN o_orderkey % 17 = 0 THEN ''
            ELSE concat('SELECT a, b FROM t WHERE k = ', CAST((o_orderkey + o_orderkey % 3) % 60 AS VARCHAR(4))) END AS gt_sql
FROM orders
"""
FX_EXECUTIONS = """
SELECT concat('db', CAST(d AS VARCHAR(4))) AS db, concat('SELECT a, b FROM t WHERE k = ', CAST(s AS VARCHAR(4))) AS sql,
       d <> 3 AND s % 13 <> 0 AS success, CASE WHEN d = 3 THEN 'Database not found' WHEN s % 13 = 0 THEN 'near "FROM": syntax error' END AS error
FROM (SELECT DISTINCT o_orderkey % 60 AS s FROM orders) st, (SELECT 0 AS d UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) dbs
WHERE s <> 59
"""
FX_EXEC_ROWS = """
SELECT concat('db', CAST(d AS VARCHAR(4))) AS db, concat('SELECT a, b FROM t WHERE k = ', CAST(s AS VARCHAR(4))) AS sql,
       CASE WHEN s % 7 = 5 THEN concat(l_linestatus, CAST(l_linenumber AS VARCHAR(4)), CAST(s AS VARCHAR(4))) ELSE concat(l_returnflag, l_linestatus) END AS row_key,
       CASE WHEN s % 10 = 3 THEN 1 ELSE 2 END AS n_cols
FROM (SELECT l_orderkey % 60 AS s, l_returnflag, l_linestatus, l_linenumber FROM lineitem) r, (SELECT 0 AS d UNION ALL SELECT 1 UNION ALL SELECT 2) dbs
WHERE s <> 59 AND s % 13 <> 0 AND s % 12 <> 0
"""

FX_PRED_ROWS = """
SELECT l_orderkey AS candidate_id,
       concat(' ', upper(l_returnflag), ' ') AS c0, lower(l_linestatus) AS c1, CAST(l_quantity AS DOUBLE) AS c2
FROM lineitem WHERE NOT (l_orderkey % 3 = 0 AND l_linenumber = 1) AND l_orderkey % 7 <> 0
"""

FX_GT_ROWS = """
SELECT l_orderkey AS candidate_id,
       lower(l_returnflag) AS c0, concat(upper(l_linestatus), ' ') AS c1, CAST(l_quantity AS DOUBLE) AS c2
FROM lineitem
"""

FX_METRICS = """
SELECT CAST(floor(event_id / 8) AS BIGINT) + 1 AS step,
       AVG(value) AS reward, STDDEV_POP(value) AS reward_std,
       COUNT(*) AS n, MIN(ts) AS ts
FROM events GROUP BY CAST(floor(event_id / 8) AS BIGINT) + 1
"""

FX_RUN_METRICS = """
SELECT CAST(floor(event_id / 1000) AS BIGINT) AS run_id, CAST(floor((event_id % 1000) / 4) AS BIGINT) + 1 AS step,
       AVG(value) AS reward, MIN(ts) AS ts
FROM events GROUP BY CAST(floor(event_id / 1000) AS BIGINT), CAST(floor((event_id % 1000) / 4) AS BIGINT) + 1
"""

FX_TIMING = """
SELECT user_id AS kernel_id, event_id AS trial,
       CAST(floor(value * 1000) AS BIGINT) + 1 AS elapsed_ns,
       CASE event_type WHEN 'error' THEN 'exception' WHEN 'signup' THEN 'timeout' ELSE 'ok' END AS outcome,
       CAST(event_id % 4 AS INT) AS loops,
       CASE WHEN event_type = 'error' AND event_id % 6 <> 0 THEN concat('ValueError: ', CAST(event_id % 5 AS VARCHAR(4))) END AS error
FROM events
"""

# Predicted matrices (two completions a task) against the tasks' matrices: a column
# of quantities; some predictions are off, miss a cell or hold a NULL.
FX_REAL_CELLS = """
SELECT l_orderkey AS task_id, CAST(l_linenumber AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, CAST(l_quantity AS DOUBLE) AS v FROM lineitem
"""
FX_PRED_CELLS = """
SELECT l_orderkey * 2 + r AS completion_id, l_orderkey AS task_id, CAST(l_linenumber AS BIGINT) AS i, CAST(0 AS BIGINT) AS j,
       CASE WHEN l_orderkey % 11 = 0 AND r = 1 AND l_linenumber = 2 THEN NULL
            ELSE CAST(l_quantity AS DOUBLE) + CAST((l_orderkey * 3 + r * l_linenumber) % 5 AS DOUBLE) / 4 - 0.5 END AS v
FROM lineitem, (SELECT 0 AS r UNION ALL SELECT 1) copies WHERE NOT (l_orderkey % 7 = 0 AND r = 0 AND l_linenumber = 1)
"""

FX_CODE = """
SELECT p_partkey AS completion_id, CAST(p_partkey % 8 AS INT) AS template,
       CASE CAST(p_partkey % 8 AS INT)
         WHEN 0 THEN concat('```python', chr(10), 'def matmul(A, B):', chr(10), '    return A', chr(10), '```')
         WHEN 1 THEN concat('```python', chr(10), 'def matmul(A, B):', chr(10), '    import numpy as np', chr(10), '    return np.matmul(A, B)', chr(10), '```')
         WHEN 2 THEN concat('```python', chr(10), 'def matmul(A, B):', chr(10), '    import math, torch.nn', chr(10), '    return A', chr(10), '```')
         WHEN 3 THEN concat('```python', chr(10), 'def matmul(A, B):', chr(10), '    return (A', chr(10), '```')
         WHEN 4 THEN 'def matmul(A, B): return A'
         WHEN 5 THEN concat('```python', chr(10), 'def strategy(board):', chr(10), '    return "W"', chr(10), '```')
         WHEN 6 THEN concat('```', chr(10), '# note', chr(10), 'def matmul(A, B):', chr(10), '    from itertools import chain', chr(10), '    return A', chr(10), '```')
         ELSE concat('text ', p_name) END AS completion
FROM part
"""

FX_PROMPTS = """
SELECT c_custkey AS prompt_id, concat('db', CAST(c_custkey % 3 AS VARCHAR(8))) AS database_name,
 CASE CAST(c_custkey % 3 AS INT)
  WHEN 0 THEN concat('Database: db0', chr(10), 'Schema:', chr(10), 'Table: orders', chr(10), 'o_orderkey (integer, PK) | o_custkey (integer) | o_totalprice (real)', chr(10), 'Question: how many orders?', chr(10), 'Hint: use count')
  WHEN 1 THEN concat('DB: db1', chr(10), 'CREATE TABLE customer (', chr(10), '  c_custkey INTEGER,', chr(10), '  c_name TEXT', chr(10), ')', chr(10), 'Question: list names')
  ELSE concat('Answer from the tables customer.c_name and orders.o_custkey', chr(10), 'Question: who bought?') END AS prompt
FROM customer
"""

FX_CHAT_SPARK = """
SELECT conv_id, transform(array_sort(collect_list(struct(turn, role, text))),
       x -> struct(x.role AS role, x.text AS content, CAST(NULL AS STRING) AS thinking)) AS messages
FROM conversations GROUP BY conv_id
"""
FX_CHAT_DUCK = """
SELECT conv_id, list({'role': role, 'content': text, 'thinking': CAST(NULL AS VARCHAR)} ORDER BY turn) AS messages
FROM conversations GROUP BY conv_id
"""

FX_MATRIX_SPARK = """
SELECT vec_id AS i, CAST(pos AS BIGINT) AS j, CAST(v AS DOUBLE) AS v
FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, v
"""
FX_MATRIX_DUCK = """
SELECT vec_id AS i, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS j,
       CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings
"""

# Chats made of documents: long prompts, long answers, no user, no answer.
_LONG = {
    "spark": ("array({})", "named_struct('role', '{}', 'content', {}, 'thinking', CAST(NULL AS STRING))"),
    "duck": ("[{}]", "{{'role': '{}', 'content': {}, 'thinking': CAST(NULL AS VARCHAR)}}"),
}


def _long_chats(engine: str) -> str:
    many, one = _LONG[engine]
    sql = "concat('SELECT ', CAST(doc_id AS VARCHAR(20)), ' FROM t')"
    ask = "concat('Database: d', CAST(doc_id % 3 AS VARCHAR(4)), ' ', coalesce(text, ''))"
    kinds = [[("user", ask), ("assistant", sql)], [("system", "text"), ("assistant", sql)],
             [("user", "'Database: d0 short'"), ("assistant", "text")], [("user", ask), ("assistant", "''")], [("user", ask)]]
    cases = " ".join(f"WHEN {i} THEN " + many.format(", ".join(one.format(r, c) for r, c in k)) for i, k in enumerate(kinds))
    return f"\nSELECT doc_id AS conv_id, CASE CAST(doc_id % 5 AS INT) {cases} END AS messages\nFROM documents\n"


# Turns with tool calls: every third conversation's assistant calls a tool on its
# first turn (beside content, thinking, both or nothing), the next turn holds the
# result; some of these chats end there, some break the rules.
FX_TOOLS = """
SELECT conv_id, turn, role,
       CASE WHEN tool_name IS NOT NULL AND conv_id % 5 < 3 THEN '' ELSE text END AS text, tool_name,
       CASE WHEN conv_id % 11 = 0 AND turn = 1 THEN '<|channel|>final<|message|>x' WHEN conv_id % 4 = 0 AND turn = 1 THEN 'thought' END AS thinking,
       CASE WHEN tool_name IS NOT NULL THEN concat('{"query": "', CAST(conv_id AS VARCHAR(20)), '"}') END AS arguments,
       CASE WHEN tool_name IS NOT NULL AND conv_id % 9 = 0 THEN 'code' END AS content_type
FROM (SELECT conv_id, turn, text,
       CASE WHEN conv_id % 3 = 0 AND turn = 2 THEN 'tool' WHEN conv_id % 7 = 1 AND turn = 0 THEN 'tool'
            WHEN conv_id % 13 = 2 AND turn = 0 THEN 'system' ELSE role END AS role,
       CASE WHEN conv_id % 3 = 0 AND turn = 1 AND role = 'assistant' THEN concat('search', CAST(conv_id % 2 AS VARCHAR(2))) END AS tool_name
FROM conversations)
"""

# Tool lists as JSON, one a part: eight layouts, with values of the part inside.
def _tool(name: str, about: str, params: str | None) -> str:
    body = f'"name": "{name}", "description": "{about}"' + (f', "parameters": {{"type": "object", {params}}}' if params else "")
    return f'{{"type": "function", "function": {{{body}}}}}'


TOOL_LISTS = [
    [_tool("now", "Time of part @key.", None)],
    [_tool("find", "Finds @brand.", '"properties": {"query": {"type": "string", "description": "what to find"}, "top": {"type": "integer", "default": @size}}, "required": ["query"]'),
     _tool("now", "Time.", '"properties": {}')],
    [_tool("pick", "Picks.", '"properties": {"kind": {"type": "string", "enum": ["small", "@brand"], "default": "small"}, "name": {"type": "string", "nullable": true, "default": "a, b: @key"}}')],
    [_tool("lists", "Lists.", '"properties": {"tags": {"type": "array", "items": {"type": "string"}, "default": ["x,y", "@brand"]}, "nums": {"type": "array", "items": {"type": "integer"}, "nullable": true}, '
           '"grid": {"type": "array", "items": {"type": "array", "items": {"type": "number"}}}, "rest": {"type": "array"}, "flags": {"type": "array", "items": {"type": "boolean"}}}, "required": ["grid"]')],
    [_tool("deep", "Nested.", '"properties": {"box": {"type": "object", "required": ["b"], "properties": {"b": {"type": "boolean"}, "a": {"type": "object", "properties": {"z": {"type": "string", "nullable": true}}}}, '
           '"default": {"b": true, "a": {"z": null}}}, "bag": {"type": "object"}, "far": {"type": "array", "items": {"type": "object", "properties": {"first_long_name": {"type": "string"}, "second_long_name": {"type": "integer"}}}}, '
           '"near": {"type": "array", "items": {"type": "object", "properties": {"x": {"type": "number"}}}}}')],
    [_tool("either", "Unions.", '"properties": {"one": {"oneOf": [{"type": "string", "description": "a name", "default": "x"}, {"type": "integer"}], "default": "y"}, '
           '"two": {"oneOf": [{"type": "object"}, {"type": "integer"}]}, "three": {"type": ["string", "null"]}, "four": {"type": "array", "items": {"type": ["object", "object"]}}, "five": {}}')],
    [],
    None,
]


def _tool_lists_sql() -> str:
    def text(tools: list | None) -> str:
        if tools is None:
            return "NULL"
        quoted = "'" + ("[" + ", ".join(tools) + "]").replace("'", "''") + "'"
        for mark, value in (("@key", "CAST(p_partkey AS VARCHAR(20))"), ("@brand", "p_brand"), ("@size", "CAST(p_size AS VARCHAR(20))")):
            quoted = f"replace({quoted}, '{mark}', {value})"
        return quoted
    cases = " ".join(f"WHEN {i} THEN {text(t)}" for i, t in enumerate(TOOL_LISTS))
    n = len(TOOL_LISTS)
    return f"\nSELECT p_partkey AS set_id, p_brand, p_size, CAST(p_partkey % {n} AS INT) AS layout, CASE CAST(p_partkey % {n} AS INT) {cases} END AS tools\nFROM part\n"


FX_TOOL_LISTS = _tool_lists_sql()

# Recorded outcomes of the distinct statements, and of code answers.
FX_CODE_RUNS = """
SELECT p_partkey AS completion_id, p_partkey % 5 <> 0 AS define_ok,
       CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'success' WHEN 1 THEN 'timeout' WHEN 2 THEN 'exception' ELSE 'ended' END AS outcome,
       CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_size AS DOUBLE) / 10 END AS amax_error,
       CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_size AS DOUBLE) / 100 END AS mse_error,
       CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 97 + 1 END AS median_ns
FROM part
"""

# A projection of the embedding's cells to eight columns: bounded by their number.
FX_WEIGHTS_SPARK = """
SELECT DISTINCT CAST(pos AS BIGINT) AS i, CAST(k AS BIGINT) AS j, CAST((pos * 7 + k * 3) % 11 - 5 AS DOUBLE) / 8 AS v
FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, x LATERAL VIEW explode(sequence(0, 7)) s AS k
"""
FX_WEIGHTS_DUCK = """
SELECT DISTINCT i, k AS j, CAST((i * 7 + k * 3) % 11 - 5 AS DOUBLE) / 8 AS v
FROM (SELECT CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i FROM embeddings), range(0, 8) r(k)
"""

# name -> (spark sql, duckdb sql, base tables)
VIEWS = {
    "fx_rollouts": (FX_ROLLOUTS, FX_ROLLOUTS, ("events",)),
    "fx_rollouts_ts": (FX_ROLLOUTS_TS, FX_ROLLOUTS_TS, ("events",)),
    "fx_completions": (FX_COMPLETIONS, FX_COMPLETIONS, ("orders",)),
    "fx_arrivals": (FX_ARRIVALS_SPARK, FX_ARRIVALS_DUCK, ("orders",)),
    "fx_outcomes": (FX_OUTCOMES, FX_OUTCOMES, ("orders",)),
    "fx_exec_rollouts": (FX_EXEC_ROLLOUTS, FX_EXEC_ROLLOUTS, ("orders",)),
    "fx_executions": (FX_EXECUTIONS, FX_EXECUTIONS, ("orders",)),
    "fx_exec_rows": (FX_EXEC_ROWS, FX_EXEC_ROWS, ("lineitem",)),
    "fx_pred_rows": (FX_PRED_ROWS, FX_PRED_ROWS, ("lineitem",)),
    "fx_gt_rows": (FX_GT_ROWS, FX_GT_ROWS, ("lineitem",)),
    "fx_metrics": (FX_METRICS, FX_METRICS, ("events",)),
    "fx_run_metrics": (FX_RUN_METRICS, FX_RUN_METRICS, ("events",)),
    "fx_timing": (FX_TIMING, FX_TIMING, ("events",)),
    "fx_code": (FX_CODE, FX_CODE, ("part",)),
    "fx_prompts": (FX_PROMPTS, FX_PROMPTS, ("customer",)),
    "fx_chat": (FX_CHAT_SPARK, FX_CHAT_DUCK, ("conversations",)),
    "fx_chat_long": (_long_chats("spark"), _long_chats("duck"), ("documents",)),
    "fx_tools": (FX_TOOLS, FX_TOOLS, ("conversations",)),
    "fx_tool_lists": (FX_TOOL_LISTS, FX_TOOL_LISTS, ("part",)),
    "fx_code_runs": (FX_CODE_RUNS, FX_CODE_RUNS, ("part",)),
    "fx_real_cells": (FX_REAL_CELLS, FX_REAL_CELLS, ("lineitem",)),
    "fx_pred_cells": (FX_PRED_CELLS, FX_PRED_CELLS, ("lineitem",)),
    "fx_weights": (FX_WEIGHTS_SPARK, FX_WEIGHTS_DUCK, ("embeddings",)),
    "fx_matrix": (FX_MATRIX_SPARK, FX_MATRIX_DUCK, ("embeddings",)),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build a derived view as a DataFrame (lazy; no temp view registered)."""
    sql, _, bases = VIEWS[name]
    params = {b: table(spark, sf_dir, b) for b in bases}
    sql = sql.replace("{", "{{").replace("}", "}}")  # spark.sql formats the text
    for b in bases:
        # only the view's own FROM (the last one); string literals may contain "FROM <name>"
        head, sep, tail = sql.rpartition(f"FROM {b}")
        sql = head + f"FROM {{{b}}}" + tail
    return spark.sql(sql, **params)


def duck_with(*names: str) -> str:
    """``WITH`` prefix that defines the given views for a DuckDB oracle."""
    parts = [f"{n} AS ({VIEWS[n][1].strip()})" for n in names]
    return "WITH " + ",\n".join(parts) + "\n"
