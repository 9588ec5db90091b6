"""Hand-written cases for parsing branches, matching and tracking rules."""

import json
import os
import tempfile

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rollcall.config import RewardConfig
from rollcall.functions import parsing as P
from rollcall.operators import code as C
from rollcall.operators import matching as M
from rollcall.operators import scores as S
from rollcall.operators import tracking as T


def _sql_of(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    return [r.sql for r in P.add_sql(df, "t", **kw).orderBy("id").collect()]


def test_extract_sql_branches(spark):
    texts = [
        "```sql\nSELECT 1\n```",                                     # sql fence
        "```\nSELECT a FROM t\n```",                                 # plain fence, SELECT
        "```\nWITH x AS (SELECT 1) SELECT * FROM x\n```",            # plain fence, WITH
        "WITH x AS (SELECT a FROM t) SELECT a FROM x;\nbye",         # WITH ... ;
        "WITH x AS (SELECT a FROM t) SELECT a FROM x\n\nmore",       # WITH ... blank line
        "WITH x AS (SELECT a FROM t",                                # broken CTE -> ''
        "so: SELECT a FROM t; trailing",                             # SELECT ... ;
        "first\nSELECT*FROM t",                                      # line scan
        "nothing here",                                              # ''
    ]
    assert _sql_of(spark, texts) == [
        "SELECT 1", "SELECT a FROM t", "WITH x AS (SELECT 1) SELECT * FROM x",
        "WITH x AS (SELECT a FROM t) SELECT a FROM x", "WITH x AS (SELECT a FROM t) SELECT a FROM x",
        "", "SELECT a FROM t", "SELECT*FROM t", ""]


def test_balanced_cte_layouts(spark):
    cases = [
        # the scan skips quoted text, but every parenthesis counts at the end
        ("Here: with q AS (SELECT '()' AS p FROM t) SELECT p FROM q; done", "with q AS (SELECT '()' AS p FROM t) SELECT p FROM q;"),
        ("Here: with q AS (SELECT ')' AS p FROM t) SELECT p FROM q; done", None),
        # a semicolon, SELECT and parentheses inside quotes; an escaped quote
        ("WITH a AS (SELECT 'x; SELECT (y' AS v, \"it\\\" ) s\" FROM t) SELECT v FROM a", "WITH a AS (SELECT 'x; SELECT (y' AS v, \"it\\\" ) s\" FROM t) SELECT v FROM a"),
        ("WITH a AS (SELECT 1), b AS (SELECT * FROM (SELECT 2) z) SELECT * FROM a, b\n\nmore (", "WITH a AS (SELECT 1), b AS (SELECT * FROM (SELECT 2) z) SELECT * FROM a, b"),
        ("WITH a AS (SELECT 1) SELECT * FROM a\n-- a comment (", "WITH a AS (SELECT 1) SELECT * FROM a"),
        ("WITH a AS (SELECT 1) SELECT 1 UNION SELECT 2; SELECT 3", "WITH a AS (SELECT 1) SELECT 1 UNION SELECT 2; SELECT 3"),
        ("WITH a AS (SELECT 1", None), ("withdraw SELECT 1", None), ("no statement", None), ("", None), (None, None),
        ("WITH x AS ('unclosed SELECT 1) SELECT 2", None),
        ("WITH " + "x" * 300_000 + " SELECT 1", "WITH " + "x" * 300_000 + " SELECT 1"),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, s string")
    got = {r.i: r.o for r in P.add_cte_balanced(df, "s", "o").collect()}
    quoted = cases[2]
    level = quoted[0].count("(") == quoted[0].count(")")
    for i, (c, want) in enumerate(cases):
        assert got[i] == (want if c is not quoted[0] or level else None), c


def test_is_valid_cte(spark):
    cases = {"WITH a AS (SELECT 1) SELECT * FROM a": True, "WITH a AS (SELECT 1 SELECT": False, "SELECT 1": False,
             "WITH (SELECT x) SELECT y": True, "WITH a AS (SELECT (1)) , b AS (SELECT 2) SELECT 3": True, "": False,
             "WITH SELECT": False}
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    assert {r.s: r.v for r in df.select("s", P.is_valid_cte("s").alias("v")).collect()} == cases


def test_no_python_in_the_sql_cascade(spark):
    df = spark.createDataFrame([("x", "y")], "a string, gt string")
    plan = P.add_sql(df, "a")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_schema_patterns_appear_once_a_side(spark):
    from rollcall.operators import rewards as R
    df = spark.createDataFrame([("select 1 from t", "y")], "sql string, gt string").where("sql != ''")
    plan = R.schema_linking_reward(df, "sql", "gt")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?:from|join)") <= 4


def test_stdlib_holds_test_and_future():
    names = C.stdlib_modules()
    assert {"test", "__future__", "json", "sys"} <= set(names) and "numpy" not in names


def test_schema_items_keeps_backtracking_quirk(spark):
    df = spark.createDataFrame([("select count(*), t.a, sum (b), 'x y' from t",)], "s string")
    items = P.add_schema_items(df, "s", "i").first().i
    assert {"coun", "su", "b", "x", "y"} <= set(items)
    strict = P.add_schema_items(df, "s", "i", strict=True).first().i
    assert "coun" not in strict


def test_multiset_null_cells_and_partial_credit(spark):
    pred = spark.createDataFrame([(1, "A ", None), (1, "b", 2.0), (2, "x", 1.0)] + [(3, "r", float(i)) for i in range(9)]
                                 + [(3, "zz", 0.0)], "cid int, c0 string, c1 double")
    gold = spark.createDataFrame([(1, "a", None), (1, "B", 2.0), (2, "y", 1.0)] + [(3, "r", float(i)) for i in range(10)],
                                 "cid int, c0 string, c1 double")
    m = M.multiset_match(M.canonical_rows(pred, "cid", ["c0", "c1"]), M.canonical_rows(gold, "cid", ["c0", "c1"]),
                         id_col="cid")
    s = {r.cid: r.result_score for r in M.result_score(m).collect()}
    assert s[1] == 3.0 and s[2] == -3.0
    assert abs(s[3] - min(-3 + 4.5 * 0.9, 1.5)) < 1e-9  # F1 = 0.9 -> 1.05


def test_group_diagnostics_incomplete_groups(spark):
    rows = [(0, 0, g, 2.0, 3.0, 1.0, 1.0) for g in range(4)] + [(0, 1, 0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "step long, prompt_id long, gen_idx int, syntax_score double, "
                                     "result_score double, schema_score double, ngram_score double")
    r = S.group_diagnostics(df, RewardConfig()).first()
    assert r.n_prompts == 2 and r.n_incomplete_groups == 1 and r.prompts_all_gens_no_sql == 1
    assert r.prompts_no_reward_variance == 2


def _plateau_loop(rewards):
    hist, best, since, out = [], float("-inf"), 0, []
    for step, r in enumerate(rewards, start=1):
        hist.append(r)
        if step % 25 == 0:
            avg = sum(hist[-50:]) / len(hist[-50:])
            if avg > best:
                best, since = avg, 0
            else:
                since += 25
            out.append((step, since))
    return out


def test_plateau_matches_loop_with_long_stall(spark):
    rewards = [min(i, 300) / 300.0 if i < 400 else 0.5 for i in range(1, 1001)]
    df = spark.createDataFrame([(7, i + 1, r) for i, r in enumerate(rewards)] + [(7, 5000, None)], "run long, step long, reward double")
    got = [(r.step, r.steps_since_improvement) for r in T.plateau(df, ["run"]).orderBy("step").collect()]
    assert got == _plateau_loop(rewards)
    assert max(s for _, s in got) >= 200


def test_load_jsonl_bom_blank_and_limit(spark):
    from rollcall.sources import jsonl as J
    d = tempfile.mkdtemp(prefix="rollcall-jsonl-")
    p = os.path.join(d, "a.jsonl")
    recs = [{"conv_id": i, "messages": [{"role": "user", "content": f"q{i}"}]} for i in range(3)]
    with open(p, "w", encoding="utf-8") as f:
        f.write("﻿" + json.dumps(recs[0]) + "\n\n" + json.dumps(recs[1]) + "\n" + json.dumps(recs[2]) + "\n")
    assert J.load_jsonl(spark, p).count() == 3
    assert J.load_jsonl(spark, p, limit=2).count() == 1   # raw lines: record, blank


def test_speed_formula(spark):
    df = spark.createDataFrame([(0, 1000), (1, 3)], "kernel_id int, median_ns long")
    s = {r.kernel_id: r.speed_score for r in C.speed_score(df).collect()}
    assert abs(s[1] - 1000 / 3 / 100) < 1e-12 and abs(s[0] - (-0.01)) < 1e-12


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=6), st.lists(st.sampled_from("abcde"), max_size=6))
def test_jaccard_symmetric_bounded(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    r = df.select(P.jaccard(F.array_distinct("a"), F.array_distinct("b")).alias("x"),
                  P.jaccard(F.array_distinct("b"), F.array_distinct("a")).alias("y")).first()
    assert r.x == r.y and 0.0 <= r.x <= 1.0


def test_execute_candidates_and_scores(spark):
    from rollcall.operators import execution as X
    from rollcall.sources.tables import table
    dbs = {"db0": {"orders": lambda s: table(s, "/root/testdata/sf0.001", "orders")}}
    gold = "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus"
    roll = spark.createDataFrame([
        (1, "db0", "SELECT o_orderstatus, COUNT(*) FROM orders GROUP BY o_orderstatus", gold),
        (2, "db0", "SELECT nope FROM orders", gold),
        (3, "db0", "", gold),
        (4, "dbX", "SELECT 1", gold),
        (5, "db0", "DROP TABLE orders", gold),
    ], "rollout_id int, db string, sql string, gt_sql string")
    stmts = X.dedupe_executions(roll.unionByName(roll.select("rollout_id", "db", F.col("gt_sql").alias("sql"), "gt_sql")),
                                "db", "sql")
    ex, rows = X.execute_candidates(spark, stmts, dbs, timeout_s=60)
    sc = {r.rollout_id: (r.syntax_score, r.result_score)
          for r in X.execution_scores(roll, ex, rows).collect()}
    assert sc[1] == (2.0, 3.0)
    assert sc[2] == (-2.0, -3.0)
    assert sc[3] == (0.0, -3.0)
    assert sc[4][0] == 0.0 and sc[4][1] == 0.0
    assert sc[5] == (-2.0, -3.0)


def test_cells_keep_big_integers_and_signed_zero(spark):
    from decimal import Decimal
    types = {"i": "id int, v long", "d": "id int, v double", "c": "id int, v decimal(30,4)"}
    rows = {"i": [(1, 9007199254740993), (2, 9007199254740992), (3, 1), (4, 0), (5, None)],
            "d": [(3, 1.0), (4, -0.0), (5, None), (6, 1.5)],
            "c": [(1, Decimal("9007199254740993.0000")), (3, Decimal("1.0000")), (6, Decimal("1.5000"))]}
    key = {(k, r.id): r.row_key for k in types
           for r in M.canonical_rows(spark.createDataFrame(rows[k], types[k]), "id", ["v"]).collect()}
    assert key["i", 1] != key["i", 2] and key["i", 1] == key["c", 1]
    assert key["i", 3] == key["d", 3] == key["c", 3] and key["i", 4] == key["d", 4]
    assert key["i", 5] == key["d", 5] and key["d", 6] == key["c", 6]
    texts = M.canonical_rows(spark.createDataFrame([(1, "a", "b"), (2, "a1:sb", None), (3, None, None), (4, "", "")],
                                                   "id int, x string, y string"), "id", ["x", "y"]).collect()
    assert len({r.row_key for r in texts}) == 4


def test_match_of_an_empty_side(spark):
    shape = "candidate_id int, row_key string, n_cols int"
    a = spark.createDataFrame([(1, "x", 1), (1, "x", 1), (2, "y", 1)], shape)
    m = {r.candidate_id: r for r in M.result_score(M.multiset_match(a.where("candidate_id = 1"), a)).collect()}
    assert m[1].exact_match and m[1].result_score == 3.0
    assert m[2].n_pred == 0 and m[2].n_gt == 1 and m[2].result_score == -3.0


def test_missing_component_column_is_an_error(spark):
    df = spark.createDataFrame([(1, 1, 0, 2.0, 3.0, 1.0)], "step int, prompt_id int, gen_idx int, syntax_score double, result_score double, schema_score double")
    with pytest.raises(ValueError, match="ngram"):
        S.with_composite(df, RewardConfig())


def test_registered_reward_joins_all_reports(spark):
    cfg = RewardConfig().with_reward("brevity", "brevity_score", (0.0, 1.0), 0.5)
    assert "brevity" in cfg.enabled_components() and "brevity" not in cfg.disabled_components()
    assert set(cfg.disabled_components()) == {"format_reward", "thinking_quality_reward", "llm_judge_reward"}
    df = spark.createDataFrame([(1, 1, 0, 2.0, 3.0, 1.0, 1.0, 0.5)], "step int, prompt_id int, gen_idx int, syntax_score double, "
                               "result_score double, schema_score double, ngram_score double, brevity_score double")
    assert abs(S.with_composite(df, cfg).first().composite - (0.4 + 3.0 + 0.3 + 0.3 + 0.25)) < 1e-9
    assert "brevity" in {r.component for r in S.reward_breakdown(df, cfg, ["step"]).collect()}
    assert abs(S.dominance_check(df, cfg).first().max_other_advantage - (0.8 + 0.6 + 0.6 + 0.5)) < 1e-9
    with pytest.raises(ValueError):
        cfg.with_reward("brevity", "x", (0.0, 1.0))


def test_positions_of_a_hot_step(spark):
    import random
    from rollcall.operators import windows as Wn
    ids = random.Random(1).sample(range(10**6), 3000)
    df = spark.createDataFrame([(7 if i % 3 else i % 11, x) for i, x in enumerate(ids)], "step int, rollout_id long").repartition(5)
    got = {r.rollout_id: r.pos_group for r in Wn.positional_groups(df, 4).collect()}
    by = {}
    for r in df.collect():
        by.setdefault(r.step, []).append(r.rollout_id)
    assert got == {x: k // 4 for v in by.values() for k, x in enumerate(sorted(v))}


@pytest.mark.parametrize("nulls", [False, True])
def test_positions_of_a_wide_frame(spark, nulls):
    """Other columns, several coalesced partitions, null steps."""
    from pyspark.sql import Window as W
    from rollcall.operators import windows as Wn
    step = F.when(F.col("id") % 7 != 0, F.col("id") % 3) if nulls else F.col("id") % 3
    df = spark.range(60000).select(step.cast("int").alias("step"), F.xxhash64("id").alias("rollout_id"),
                                   F.concat(*[F.sha2(F.concat_ws("-", F.lit(k), "id"), 256) for k in range(6)]).alias("response"))
    want = df.withColumn("pos_group", F.floor((F.row_number().over(W.partitionBy("step").orderBy("rollout_id")) - 1) / 4).cast("bigint"))
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
             "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k", "spark.sql.shuffle.partitions": "40"}
    old = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        got = Wn.positional_groups(df, 4).select(*want.columns)
        assert got.count() == 60000
        assert want.exceptAll(got).count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_stream_plateau_over_chunks_and_late_steps(spark):
    """One run of many Arrow chunks out of order, then a late step."""
    import random
    from rollcall.session import ship_package
    from rollcall.streaming import streams as St
    ship_package(spark)
    rng = random.Random(3)
    rows = [(run, step, rng.random() + step / 9000) for run in (1, 2) for step in range(1, 12501)]
    shuffled = rng.sample(rows, len(rows))
    src, schema = St.stage_files(spark.createDataFrame(shuffled, "run_id long, step long, reward double").coalesce(1), "units-in")
    out = St.out_path(spark, "units-out")
    St.stream_plateau(spark, src, schema, out)
    got = {(r.run_id, r.step): r.steps_since_improvement for r in spark.read.parquet(out).collect()}
    want = {(run, s): v for run in (1, 2) for s, v in _plateau_loop([r for k, _, r in rows if k == run])}
    assert got == want and len(got) == 1000
    spark.createDataFrame([(1, 40, 5.0), (1, 12501, 1.0)], schema).write.mode("append").parquet(src)
    St.stream_plateau(spark, src, schema, out)
    late = spark.read.parquet(out).where("late").collect()
    assert [(r.run_id, r.step, r.rolling_avg) for r in late] == [(1, 40, None)]


def test_jsonl_limit_goes_file_by_file(spark):
    from rollcall.sources import jsonl as J
    d = tempfile.mkdtemp(prefix="rollcall-jsonl-")
    for name, n in (("a", 2), ("b", 4000)):
        with open(os.path.join(d, f"{name}.jsonl"), "w", encoding="utf-8") as f:
            f.writelines(json.dumps({"conv_id": (0 if name == "a" else 100) + i, "messages": []}) + "\n" + ("\t\n" if name == "a" else "") for i in range(n))
    assert sorted(r.conv_id for r in J.load_jsonl(spark, d, limit=5).collect()) == [0, 1, 100]
