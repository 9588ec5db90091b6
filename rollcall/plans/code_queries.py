"""Registered queries for code-task scoring (fx_code, fx_timing, fx_matrix)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import code as C
from ..sources.fixtures import duck_with, fixture
from .registry import dealt, register, rounded
from .text_queries import STRIP

CD = duck_with("fx_code")
CODE_CTE = CD + f"""
, s AS (SELECT completion_id, template, completion, string_split(completion, '```') AS parts FROM fx_code),
b AS (SELECT *, CASE WHEN len(parts) - 1 >= 2 THEN {STRIP('parts[2]')} END AS body0 FROM s),
c AS (SELECT *, CASE WHEN starts_with(body0, 'python' || chr(10)) THEN substr(body0, 8) ELSE body0 END AS body FROM b),
e AS (SELECT *, CASE WHEN instr(body, 'def') > 0 AND starts_with(substr(body, instr(body, 'def')), 'def matmul(A, B):')
                     THEN substr(body, instr(body, 'def')) END AS code FROM c),
-- audit per layout: (syntax ok, import roots)
a AS (SELECT *, CASE template WHEN 3 THEN false WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 6 THEN true END AS syntax_ok,
        CASE template WHEN 1 THEN 'numpy' WHEN 2 THEN 'math,torch' WHEN 6 THEN 'itertools' ELSE '' END AS imports,
        CASE template WHEN 1 THEN 'numpy' WHEN 2 THEN 'torch' ELSE '' END AS non_stdlib FROM e)
"""


def _audited(spark, sf):
    return C.with_audit(dealt(fixture(spark, sf, "fx_code"), "completion_id"), "completion")


@register("extract_code", CODE_CTE + "SELECT completion_id, code FROM e")
def q_extract_code(spark, sf):
    d = fixture(spark, sf, "fx_code")
    return d.select("completion_id", C.extract_code("completion").alias("code"))


@register("import_audit", CODE_CTE + """
SELECT completion_id, coalesce(syntax_ok AND non_stdlib = '', false) AS imports_ok, imports,
  non_stdlib AS non_stdlib_imports FROM a""")
def q_import_audit(spark, sf):
    d = _audited(spark, sf)
    return d.select("completion_id", "imports_ok",
                    F.array_join(F.coalesce("audit.imports", F.array().cast("array<string>")), ",").alias("imports"),
                    F.array_join("non_stdlib_imports", ",").alias("non_stdlib_imports"))


@register("syntax_check", CODE_CTE + "SELECT completion_id, syntax_ok FROM a WHERE code IS NOT NULL")
def q_syntax(spark, sf):
    d = _audited(spark, sf).where(F.col("code").isNotNull())
    return d.select("completion_id", F.col("audit.syntax_ok").alias("syntax_ok"))


@register("stdlib_anti_join", CODE_CTE + """
SELECT completion_id, module FROM (SELECT completion_id, unnest(string_split(non_stdlib, ',')) AS module FROM a
  WHERE non_stdlib <> '')""")
def q_anti(spark, sf):
    return C.non_stdlib_imports(_audited(spark, sf), C.stdlib_frame(spark), "completion_id")


@register("sorted_modules", CODE_CTE + """
SELECT module, count(*) AS n FROM (SELECT unnest(string_split(imports, ',')) AS module FROM a WHERE imports <> '')
GROUP BY module ORDER BY module""")
def q_sorted_modules(spark, sf):
    d = _audited(spark, sf)
    m = d.select(F.explode(F.coalesce("audit.imports", F.array().cast("array<string>"))).alias("module"))
    return m.groupBy("module").agg(F.count(F.lit(1)).alias("n")).orderBy("module")


@register("function_works", CODE_CTE + """
SELECT completion_id, CAST(CASE WHEN code IS NULL OR NOT coalesce(syntax_ok, false) THEN -2.0 ELSE 1.0 END AS DOUBLE) AS works_score FROM a""")
def q_works(spark, sf):
    return C.function_works(_audited(spark, sf)).select("completion_id", "works_score")


@register("no_cheating", CODE_CTE + """
SELECT completion_id, CAST(CASE WHEN code IS NULL THEN -20.0 WHEN coalesce(syntax_ok AND non_stdlib = '', false) THEN 1.0
  ELSE -20.0 END AS DOUBLE) AS cheat_score FROM a""")
def q_cheat(spark, sf):
    return C.no_cheating(_audited(spark, sf)).select("completion_id", "cheat_score")


@register("code_rewards", CODE_CTE + """
SELECT completion_id, CAST(CASE WHEN code IS NULL OR NOT coalesce(syntax_ok, false) THEN -2.0 ELSE 1.0 END
  + CASE WHEN code IS NULL THEN -1.0 WHEN coalesce(syntax_ok AND non_stdlib = '', false) THEN 1.0 ELSE -20.0 END AS DOUBLE) AS total_score
FROM a""")
def q_code_rewards(spark, sf):
    d = C.no_cheating(C.function_works(_audited(spark, sf)), missing_score=-1.0)
    return d.select("completion_id", (F.col("works_score") + F.col("cheat_score")).alias("total_score"))


TM = duck_with("fx_timing")
SUMMARY_CTE = TM + """
, s AS (SELECT kernel_id, CAST(trunc(quantile_cont(elapsed_ns, 0.5)) AS BIGINT) AS median_ns,
          CAST(trunc(avg(elapsed_ns)) AS BIGINT) AS mean_ns,
          CAST(trunc(CASE WHEN count(elapsed_ns) > 1 THEN stddev_pop(elapsed_ns) ELSE 0 END) AS BIGINT) AS stdev_ns,
          CAST(count_if(outcome = 'timeout') AS BIGINT) AS timeouts, CAST(count_if(outcome = 'exception') AS BIGINT) AS exceptions,
          count(*) AS trials FROM fx_timing GROUP BY kernel_id)
"""


@register("timing_summary", SUMMARY_CTE + "SELECT * FROM s")
def q_timing(spark, sf):
    return C.timing_summary(fixture(spark, sf, "fx_timing"))


@register("timing_per_loop", TM + """
, d AS (SELECT kernel_id, outcome, elapsed_ns // greatest(loops, 1) AS ns FROM fx_timing)
SELECT kernel_id, CAST(trunc(quantile_cont(ns, 0.5)) AS BIGINT) AS median_ns, CAST(trunc(avg(ns)) AS BIGINT) AS mean_ns,
  CAST(trunc(CASE WHEN count(ns) > 1 THEN stddev_pop(ns) ELSE 0 END) AS BIGINT) AS stdev_ns,
  CAST(count_if(outcome = 'timeout') AS BIGINT) AS timeouts, CAST(count_if(outcome = 'exception') AS BIGINT) AS exceptions, count(*) AS trials
FROM d GROUP BY kernel_id""")
def q_timing_per_loop(spark, sf):
    return C.timing_summary(fixture(spark, sf, "fx_timing"), loops_col="loops")


@register("timing_exceptions", TM + """
SELECT kernel_id, coalesce(error, '') AS text, count(*) AS n FROM fx_timing WHERE outcome = 'exception' GROUP BY 1, 2""")
def q_timing_exceptions(spark, sf):
    return C.timing_exceptions(fixture(spark, sf, "fx_timing"))


@register("speed_check", SUMMARY_CTE + """
, b AS (SELECT *, first_value(median_ns) OVER (ORDER BY kernel_id) AS base_ns FROM s)
SELECT kernel_id, median_ns, base_ns, round(greatest(-10.0, least(10.0, CASE WHEN median_ns >= base_ns
  THEN -(median_ns / base_ns) / 100 ELSE (base_ns / median_ns) / 100 END)), 6) AS speed_score FROM b""")
def q_speed(spark, sf):
    s = C.speed_score(C.timing_summary(fixture(spark, sf, "fx_timing")))
    return rounded(s.select("kernel_id", "median_ns", "base_ns", "speed_score"))


@register("outcome_reward", TM + """
SELECT kernel_id, trial, CAST(CASE outcome WHEN 'ok' THEN 20.0 WHEN 'timeout' THEN -1.0 WHEN 'exception' THEN -3.0 ELSE 2.0 END
  AS DOUBLE) AS outcome_score FROM fx_timing""")
def q_outcome(spark, sf):
    d = fixture(spark, sf, "fx_timing").withColumn("outcome", F.when(F.col("outcome") == "ok", "success")
                                                   .otherwise(F.col("outcome")))
    return C.outcome_reward(d).select("kernel_id", "trial", "outcome_score")


MX = duck_with("fx_matrix", "fx_weights")
MATMUL_CTE = MX + """
, real AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM fx_matrix a JOIN fx_weights b ON a.j = b.i GROUP BY a.i, b.j),
pred AS (SELECT a.i, b.j, sum(round(a.v, 2) * b.v) AS v FROM fx_matrix a JOIN fx_weights b ON a.j = b.i GROUP BY a.i, b.j),
err AS (SELECT CASE WHEN count_if(p.v IS NULL OR r.v IS NULL) > 0 THEN 5.0 ELSE max(p.v - r.v) END AS amax_error,
          CASE WHEN count_if(p.v IS NULL OR r.v IS NULL) > 0 THEN 5.0 ELSE avg((p.v - r.v) * (p.v - r.v)) END AS mse_error
        FROM pred p FULL OUTER JOIN real r ON p.i = r.i AND p.j = r.j)
"""


def _mats(spark, sf):
    """All embeddings times a matrix of eight columns, exact and from rounded cells."""
    a, w = fixture(spark, sf, "fx_matrix"), fixture(spark, sf, "fx_weights")
    return C.matmul(a, w), C.matmul(a.withColumn("v", F.round("v", 2)), w)


@register("matmul", MATMUL_CTE + "SELECT i, j, round(v, 4) AS v FROM real")
def q_matmul(spark, sf):
    real, _ = _mats(spark, sf)
    return real.select("i", "j", F.round("v", 4).alias("v"))


@register("matrix_error", MATMUL_CTE + "SELECT round(amax_error, 4) AS amax_error, round(mse_error, 4) AS mse_error FROM err")
def q_matrix_error(spark, sf):
    real, pred = _mats(spark, sf)
    e = C.matrix_error(pred, real)
    return e.select(F.round("amax_error", 4).alias("amax_error"), F.round("mse_error", 4).alias("mse_error"))


@register("gram_matrix", duck_with("fx_matrix") + """
SELECT a.j AS i, b.j, round(sum(a.v * b.v), 4) AS v FROM fx_matrix a JOIN fx_matrix b ON a.i = b.i GROUP BY a.j, b.j""")
def q_gram(spark, sf):
    """The embeddings' transpose times the embeddings: two matrices that both
    grow, a result bounded by the width."""
    e = fixture(spark, sf, "fx_matrix")
    return C.matmul_blocks(e.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), e).select("i", "j", F.round("v", 4).alias("v"))


@register("matrix_errors", duck_with("fx_real_cells", "fx_pred_cells") + """
, n AS (SELECT task_id, count(*) AS cells FROM fx_real_cells GROUP BY task_id),
d AS (SELECT completion_id, p.task_id, p.v - r.v AS d FROM fx_pred_cells p LEFT JOIN fx_real_cells r USING (task_id, i, j)),
e AS (SELECT completion_id, task_id, count(*) AS n, count(d) AS both_sides, max(d) AS amax, avg(d * d) AS mse FROM d GROUP BY completion_id, task_id)
SELECT completion_id, CASE WHEN n <> cells OR both_sides <> n THEN 5.0 ELSE amax END AS amax_error,
  round(CASE WHEN n <> cells OR both_sides <> n THEN 5.0 ELSE mse END, 6) AS mse_error FROM e JOIN n USING (task_id)""")
def q_matrix_errors(spark, sf):
    out = C.matrix_errors(fixture(spark, sf, "fx_pred_cells"), fixture(spark, sf, "fx_real_cells"))
    return out.select("completion_id", "amax_error", F.round("mse_error", 6).alias("mse_error"))


def _band_sql(x):
    return (f"CASE WHEN {x} >= 3 THEN -3.0 WHEN {x} >= 2 THEN -2.5 WHEN {x} >= 1 THEN -2.0 WHEN {x} >= 0.5 THEN -1.0 "
            f"WHEN {x} >= {100 * C.BAND_EPS!r} THEN 0.0 WHEN {x} >= {C.BAND_EPS!r} THEN 1.0 ELSE 3.0 END")


@register("correctness_check", MATMUL_CTE + f"""
SELECT CAST({_band_sql('amax_error')} + {_band_sql('mse_error')} AS DOUBLE) AS correctness_score FROM err""")
def q_correctness(spark, sf):
    real, pred = _mats(spark, sf)
    return C.correctness_score(C.matrix_error(pred, real)).select("correctness_score")
