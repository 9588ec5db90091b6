"""Streams over several micro-batches, restarts, late and missing data."""

import datetime as dt
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rollcall.config import RewardConfig
from rollcall.operators import rewards as R
from rollcall.operators import reward_functions as Rf
from rollcall.operators import scores as S
from rollcall.operators import tracking as T
from rollcall.streaming import streams as St

T0 = dt.datetime(2024, 3, 1)
COMPLETIONS = "completion_id long, database_name string, completion string, ground_truth_sql string, ts timestamp"
OUTCOMES = "completion_id long, outcome_ts timestamp, success boolean, n_pred long, n_gt long, n_common long, pred_cols int, gt_cols int"
TEXTS = ["SELECT a FROM t WHERE b = 1", "```sql\nSELECT a, b FROM t\n```", "no statement here", ""]


def minute(m):
    return T0 + dt.timedelta(minutes=m)


def completion(spark, rows):
    return spark.createDataFrame([(i, db, TEXTS[i % 4], "SELECT a FROM t;", minute(m)) for i, db, m in rows], COMPLETIONS).coalesce(1)


def outcome(spark, rows):
    return spark.createDataFrame([(i, minute(m), ok, 3, 4, 2, 1, 1) for i, m, ok in rows], OUTCOMES).coalesce(1)


def test_completions_meet_their_outcomes_once(spark):
    """Three rounds of the stream: outcomes before, with and after the completion's
    round; one after the patience; one never."""
    catalogue = spark.createDataFrame([("d", "sqlite", "d.sqlite")], "name string, kind string, path string")
    gold = spark.createDataFrame([("SELECT a FROM t;",)], "ground_truth_sql string")
    first = [(i, "d" if i % 5 else "none", i) for i in range(8)]
    left, ls = St.stage_files(completion(spark, first), "c")
    right, rs = St.stage_files(outcome(spark, [(0, 1, True), (1, 2, False)]), "o")
    out = St.out_path(spark, "scored")

    def go():
        St.stream_score_completions(spark, left, ls, right, rs, out, gold, catalogue, "10 minutes", "5 minutes")
        return {r.completion_id: r for r in spark.read.parquet(out).collect()}

    assert {i for i, r in go().items() if r.outcome_ts} == {0, 1}
    St.add_files(outcome(spark, [(2, 4, True), (3, 12, True), (4, 30, True)]), right)  # 4: after the patience
    St.add_files(completion(spark, [(8, "d", 30), (-1, "d", 40)]), left)
    St.add_files(outcome(spark, [(8, 31, True), (-1, 40, True)]), right)
    go()
    St.add_files(outcome(spark, [(5, 6, True), (-1, 90, True)]), right)  # 5: its minute is right, but it comes behind the watermark
    St.add_files(completion(spark, [(-1, "d", 90)]), left)
    got = go()
    rows = spark.read.parquet(out).collect()
    assert sorted(r.completion_id for r in rows) == list(range(9))  # each once
    told = {i for i, r in got.items() if r.outcome_ts}
    assert told == {0, 1, 2, 3, 8}
    assert all(got[i].syntax_score == 0 for i in range(9) if i not in told)
    # as a batch over the same rows
    c = spark.read.schema(ls).parquet(left).where("completion_id >= 0")
    o = spark.read.schema(rs).parquet(right).where(F.col("completion_id").isin(*told))
    batch = R.score_with_outcomes(c.join(o, "completion_id", "left"), gold, catalogue)
    keep = ["completion_id", "syntax_score", "result_score", "schema_score", "ngram_score"]
    assert sorted(batch.select(*keep).collect()) == sorted(spark.read.parquet(out).select(*keep).collect())


ASK, TOLD = "completion_id long, db string, sql string", "db string, sql string, success boolean, error string"


def test_each_statement_goes_out_once(spark):
    rng = random.Random(4)
    asks = [(i, f"d{rng.randrange(2)}", f"SELECT {rng.randrange(6)}") for i in range(60)] + [(60, "d0", ""), (61, "d0", "SELECT 0")]
    src, s1 = St.stage_files(spark.createDataFrame(asks[:20], ASK).coalesce(1), "asks")
    back, s2 = St.stage_files(spark.createDataFrame([], TOLD), "told")
    out = St.out_path(spark, "executions")

    def go():
        St.stream_executions(spark, src, s1, back, s2, out)
        return spark.read.parquet(out).collect()

    go()
    St.add_files(spark.createDataFrame(asks[20:40], ASK).coalesce(1), src)  # more asks before any outcome
    rows = go()
    runs = Counter((r.db, r.sql) for r in rows if r.kind == "run")
    assert set(runs.values()) == {1} and not [r for r in rows if r.kind == "answer"]
    told = [(db, sql, sql[-1] != "3", None if sql[-1] != "3" else "no such table") for db, sql in runs]
    St.add_files(spark.createDataFrame(told, TOLD).coalesce(1), back)
    go()
    St.add_files(spark.createDataFrame(told[:2], TOLD).coalesce(1), back)  # told again: no second answers
    St.add_files(spark.createDataFrame(asks[40:], ASK).coalesce(1), src)
    rows = go()
    runs = Counter((r.db, r.sql) for r in rows if r.kind == "run")
    assert set(runs.values()) == {1} and set(runs) == {(d, s) for _, d, s in asks if s}
    answers = {r.completion_id: r for r in rows if r.kind == "answer"}
    assert len(answers) == sum(r.kind == "answer" for r in rows)
    known = {(d, s) for d, s, *_ in told}
    for i, d, s in asks:
        if s and (d, s) in known:
            assert answers[i].cached == (i >= 40) and answers[i].success == (s[-1] != "3")
            assert answers[i].error == (None if s[-1] != "3" else "no such table")
    assert 60 not in answers


def test_an_execution_expires(spark):
    src, s1 = St.stage_files(spark.createDataFrame([(1, "d", "SELECT 1")], ASK), "asks")
    back, s2 = St.stage_files(spark.createDataFrame([], TOLD), "told")
    out = St.out_path(spark, "expiry")
    assert St.stream_executions(spark, src, s1, back, s2, out, keep_ms=1) > 0
    time.sleep(0.1)
    St.add_files(spark.createDataFrame([(2, "e", "SELECT 2")], ASK), src)  # any data lets the timers run
    St.stream_executions(spark, src, s1, back, s2, out, keep_ms=1)
    rows = [(r.kind, r.completion_id, r.success) for r in spark.read.parquet(out).where("db = 'd'").collect()]
    assert sorted(rows, key=str) == [("answer", 1, None), ("run", None, None)]  # who waited is told that nothing came


def runs(spark, rows):
    return spark.createDataFrame(rows, "run_id long, step long, reward double, ended boolean").coalesce(1)


def test_ended_runs_leave_no_state(spark):
    rows = [(r, s, float((s * 7 + r) % 13), s == 100) for r in range(5) for s in range(1, 101)]
    src, schema = St.stage_files(runs(spark, [r for r in rows if r[1] <= 60]), "runs")
    out = St.out_path(spark, "runs-out")
    assert St.stream_plateau(spark, src, schema, out) > 0
    St.add_files(runs(spark, [r for r in rows if r[1] > 60] + [(0, 7, 1.0, False)]), src)
    assert St.stream_plateau(spark, src, schema, out) == 0
    got = spark.read.parquet(out)
    assert [(r.run_id, r.step) for r in got.where("late").collect()] == [(0, 7)]
    expect = T.plateau(spark.createDataFrame([r[:3] for r in rows], "run_id long, step long, reward double"), ["run_id"])
    keep = ["run_id", "step", "rolling_avg", "improved", "best_avg_reward", "steps_since_improvement", "plateau_warning"]
    show = lambda d: sorted((r[0], r[1], round(r[2], 9), r[3], round(r[4], 9), int(r[5]), r[6]) for r in d.select(*keep).collect())
    assert show(got.where("NOT late")) == show(expect)


def test_idle_runs_go_by_timer(spark):
    src, schema = St.stage_files(runs(spark, [(1, s, 1.0, None) for s in range(1, 30)]), "idle")
    out = St.out_path(spark, "idle-out")
    assert St.stream_plateau(spark, src, schema, out, idle_ms=1) > 0
    time.sleep(0.1)
    St.add_files(runs(spark, [(2, 1, 1.0, True)]), src)
    assert St.stream_plateau(spark, src, schema, out, idle_ms=1) == 0


def rollouts(spark, rows):
    """(id, minutes) rows; scores follow from the id."""
    made = [(i, i // 4, i // 16, None if m is None else minute(m), float(i % 3 - 1), float(i % 5 - 2), 0.5, 0.25) for i, m in rows]
    return spark.createDataFrame(made, "rollout_id long, prompt_id long, step long, ts timestamp, syntax_score double, result_score double, "
                                       "schema_score double, ngram_score double").coalesce(1)


@pytest.mark.parametrize("merge_every", [2, 100])
def test_every_row_is_counted_or_late(spark, merge_every):
    cfg, rng = RewardConfig(), random.Random(11)
    batches = [[(b * 40 + k, 300 * b + rng.randrange(-900, 300)) for k in range(40)] for b in range(7)]
    batches[3].append((999, None))
    src, schema = St.stage_files(rollouts(spark, batches[0]), "t2")
    out = St.out_path(spark, "t2-out")
    for k, b in enumerate(batches):
        if k:
            St.add_files(rollouts(spark, b), src)
        if k not in (4, 5):  # two files in one start, one batch each
            St.stream_step_metrics(spark, src, schema, out, cfg, "10 hours", "1 hour", files=1, merge_every=merge_every)
    St.stream_step_metrics(spark, src, schema, out, cfg, "10 hours", "1 hour", files=1, merge_every=merge_every)
    report = {r.batch_id: r for r in St.late_report(spark, out).collect()}
    assert [report[k].rows_in for k in range(7)] == [len(b) for b in batches]
    newest, late = None, set()
    for b in batches:
        late |= {i for i, m in b if m is None or (newest is not None and m < newest - 600)}
        newest = max([newest or -10**9] + [m for _, m in b if m is not None])
    assert late > {999} and {r.rollout_id for r in St.late_rows(spark, out).collect()} == late
    assert sum(r.rows_late for r in report.values()) == len(late)
    assert all(r.rows_in == r.rows_counted + r.rows_late for r in report.values())
    on_time = rollouts(spark, [x for b in batches for x in b if x[0] not in late])
    got = {r.step: r for r in St.read_step_metrics(spark, out, cfg).collect()}
    expect = {r.step: r for r in S.component_means(on_time, cfg, ["step"]).join(on_time.groupBy("step").count(), "step").collect()}
    assert {s: (r.n, r.composite_mean, r.result_reward_mean) for s, r in got.items()} == \
        {s: (r["count"], r.composite_mean, r.result_reward_mean) for s, r in expect.items()}


def test_an_empty_source_reads_as_empty(spark):
    src, schema = St.stage_files(rollouts(spark, [(1, 1)]).limit(0), "t2-empty")
    out = St.out_path(spark, "t2-empty-out")
    St.stream_step_metrics(spark, src, schema, out, RewardConfig())
    assert St.read_step_metrics(spark, out, RewardConfig()).count() == 0


# rewards as functions

def test_function_rewards(spark):
    def brevity(text, gen):
        return [None if t is None else float("nan") if g == 9 else len(t) / 10 for t, g in zip(text, gen)]

    r = Rf.reward_function("brevity", brevity, ["text", "gen"], (0.0, 2.0))
    cfg = Rf.with_function(RewardConfig(), r, 0.5)
    df = spark.createDataFrame([("abcde", 1, 2.0), (None, 2, 2.0), ("abc", 9, -2.0)], "text string, gen int, x double") \
        .select("*", *[F.col("x").alias(c) for c in ("syntax_score", "result_score", "schema_score", "ngram_score")], F.lit(1).alias("step"), F.col("gen").alias("prompt_id"))
    scored = Rf.add_function_scores(df, cfg)
    assert [x.brevity_score for x in scored.orderBy("gen").collect()] == [0.5, 0.0, 0.0]
    whole = {x.gen: x.composite for x in S.with_composite(scored, cfg).collect()}
    assert whole[1] == pytest.approx(1.8 * 2 + 0.25) and whole[2] == pytest.approx(3.6)
    assert {x.component for x in S.reward_breakdown(scored, cfg).collect()} >= {"brevity", "total"}
    assert S.dominance_check(scored, cfg).first().max_other_advantage == pytest.approx(0.2 * 4 + 0.3 * 2 + 0.3 * 2 + 0.5 * 2)
    Rf.register(spark, r)
    assert spark.sql("SELECT brevity(text, gen) AS s FROM {d} WHERE gen = 1", d=df).first().s == 0.5
    off = Rf.with_function(RewardConfig(), r, 0.5, enabled=False)
    assert "brevity_score" not in Rf.add_function_scores(df, off).columns


def test_wrong_function_rewards_fail(spark):
    df = spark.createDataFrame([("a",), ("b",)], "text string")
    short = Rf.reward_function("short", lambda text: [1.0], ["text"], (0.0, 1.0))
    with pytest.raises(Exception, match="gave 1 scores for 2 rows"):
        df.coalesce(1).select(short()).collect()
    with pytest.raises(ValueError, match="columns"):
        Rf.add_function_scores(df.select(F.lit(1).alias("x")), Rf.with_function(RewardConfig(), short))
    with pytest.raises(ValueError):
        Rf.reward_function("not a name", lambda text: [], ["text"], (0.0, 1.0))
    with pytest.raises(ValueError):
        Rf.with_function(Rf.with_function(RewardConfig(), short), short)


def test_points_written_again_are_not_doubled(spark):
    from rollcall.session import checkpoint_dir

    path = f"{checkpoint_dir(spark)}/points-test"
    points = T.metric_points(spark.createDataFrame([(1, 0.5, None), (2, 1.5, 2.0)], "step long, a double, b double"), ["a", "b"])
    for batch in (1, 2, 2):
        T.append_metric_points(points.where(F.col("step") == batch), path, batch)
    assert sorted((r.tag, r.value, r.step) for r in T.read_metric_points(spark, path).collect()) == [("a", 0.5, 1), ("a", 1.5, 2), ("b", 2.0, 2)]


def test_final_that_argues_on_loses(spark):
    """The overlap of final and thinking, without the words of the SQL, exceeds them."""
    text = ("<|start|>assistant<|channel|>analysis<|message|>first we look for every order whose customer lives near the river bank<|end|>"
            "<|start|>assistant<|channel|>final<|message|>first we look for every order whose customer lives near the river bank SELECT a FROM t<|return|>")
    plain = text.replace("lives near the river bank SELECT", "is missing. SELECT")
    rows = R.format_reward(spark.createDataFrame([(1, text), (2, plain.replace("first we look for every order whose customer is missing. ", ""))], "id int, t string"),
                           "t", with_rules=True).collect()
    fired = {r.id: {x.rule for x in r.format_rules} for r in rows}
    assert "final_contains_reasoning" in fired[1] and "final_contains_reasoning" not in fired[2]
