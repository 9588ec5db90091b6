"""Work that must not grow faster than its rows: passes, tasks and calls."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from rollcall.functions import parsing as P
from rollcall.functions import text as Tx
from rollcall.operators import execution as X
from rollcall.operators import ranks
from rollcall.operators import rewards as R
from rollcall.plans import stream_queries as Sq
from rollcall.streaming import stateful as Sf
from rollcall.streaming import streams as St


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_score_completions_reads_the_orders_as_sql_written_once(spark):
    text = plan(E.queries()["score_completions"](spark, SF_SMALL))
    assert "completion#" not in text and "o_custkey" not in text  # the responses are parsed before, not once a reader


def test_strip_takes_the_characters_of_the_regex(spark):
    df = spark.range(0x10000).where("id < 55296 OR id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    df = df.select(F.concat("c", F.lit("a"), "c", F.lit(" b\n"), "c").alias("t"))
    bad = df.where((Tx.py_strip("t") != F.regexp_replace("t", r"(?U)^\s+|\s+\z", "")) | (Tx.py_lstrip("t") != F.regexp_replace("t", r"(?U)^\s+", "")))
    assert bad.count() == 0 and df.count() == 63488


def test_ngrams_equal_joined_slices(spark):
    df = spark.createDataFrame([(list("abcabcd"[:n]),) for n in range(8)] + [(None,)], "t array<string>")
    for n in (1, 2, 3):
        for r in df.select("t", P.ngram_set("t", n).alias("g")).collect():
            grams = [P.NGRAM_SEP.join(r.t[i:i + n]) for i in range(len(r.t) - n + 1)] if r.t else []
            assert r.g == list(dict.fromkeys(grams))


def test_a_frequent_gold_text_is_dealt_over_many_tasks(spark, monkeypatch):
    join = ranks.salted_join
    monkeypatch.setattr(R, "salted_join", lambda *a, **k: join(*a, **k, hot_rows=10))
    gold = spark.createDataFrame([("SELECT a FROM t",)] * 95 + [("SELECT b FROM u",), (None,)], "g string")
    rows = [(i, "SELECT a FROM t", "SELECT a FROM t") for i in range(95)] + [(95, "SELECT b FROM u", "SELECT b FROM u"), (96, "x", None), (97, "x", "unknown")]
    df = spark.createDataFrame(rows, "i int, sql string, g string")
    salted = R.schema_linking_reward(df, "sql", "g", gold=gold)
    assert "_salt" in plan(salted)
    got = {r.i: r.schema_score for r in salted.collect()}
    plain = {r.i: r.schema_score for r in R.schema_linking_reward(df, "sql", "g").collect()}
    assert {i: s for i, s in got.items() if i < 97} == {i: s for i, s in plain.items() if i < 97} and len(got) == 98


def test_the_catalogue_goes_to_every_task(spark):
    catalogue = spark.createDataFrame([("a", "sqlite", "p"), ("a", "db", "q")], "name string, kind string, path string")
    d = X.resolve_database(spark.createDataFrame([("a",), ("z",)], "n string"), "n", catalogue)
    assert "strategy=broadcast" in plan(d) and sorted(r.db_path for r in d.collect()) == ["", "p"]


class Calls:
    """Handle, states and timers that count the calls of a key."""

    def __init__(self):
        self.n, self.value, self.items, self.timers = 0, None, [], []

    def __getattr__(self, name):
        def call(*a):
            self.n += 1
            return getattr(self, "_" + name)(*a)
        return call

    def _get(self):
        return self.value

    def _update(self, v):
        self.value = v

    def _appendList(self, v):
        self.items += v

    def _registerTimer(self, at):
        self.timers.append(at)

    def _getCurrentProcessingTimeInMs(self):
        return 5


def test_a_new_statement_makes_few_calls_to_the_state():
    c, p = Calls(), Sf.ExecutionCache(10)
    p.handle, p.known, p.waiting = c, c, c
    ask = Sf.Row(kind="ask", completion_id=7, success=None, error=None)
    out = list(p.handleInputRows(("d", "SELECT 1"), iter([ask, ask]), c))
    assert [tuple(r) for r in out] == [("run", "d", "SELECT 1", None, None, None, False)]
    assert c.items == [(7,), (7,)] and c.timers == [15] and c.n <= 5


def test_a_backlog_comes_in_the_order_of_its_time(spark, monkeypatch):
    """Small slices give the rows of one slice, from many batches; a batch's rows are
    not all in the state, and no text is."""
    seen, start = [], St.Arrivals.arrive

    def arrive(self, step):
        seen.append(self.slices)
        start(self, step)

    def rows():
        return sorted(map(tuple, E.queries()["stream_score_completions"](spark, SF_SMALL).collect()), key=str)

    monkeypatch.setattr(St.Arrivals, "arrive", arrive)
    whole = rows()
    assert seen == [1, 1] and len(whole) == 1500
    monkeypatch.setattr(Sq, "SLICE_ROWS", 400)
    assert rows() == whole and seen[2:] == [4] * 5


def test_slices_hold_all_rows_once_and_in_order(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 100 != 0, F.timestamp_seconds(F.col("id") * 7 % 1000)).alias("ts")).repartition(5)
    bounds = St.time_bounds(df, "ts", 300)
    assert len(bounds) == 3 and St.time_bounds(df, "ts", 1000) == []
    come = St.Arrivals({"a": (df, "ts"), "b": (df.where("id < 2"), "ts")}, bounds, "slices", files=4)
    come.heartbeat(3, "2100-01-01", "id")
    parts = []
    for step in range(4):
        come.arrive(step)
        parts.append({(r.id, r.ts) for r in spark.read.schema(df.schema).parquet(f"{come.top}/{step}/a").collect()})
    assert sum(map(len, parts)) == 1001 and sorted(i for p in parts for i, _ in p) == [-1, *range(1000)]
    times = [[t for _, t in p if t] for p in parts]
    assert all(max(x) < min(y) for x, y in zip(times, times[1:])) and {i for i, t in parts[0] if t is None} == set(range(0, 1000, 100))


def test_texts_are_scored_before_the_state(spark):
    gold = spark.createDataFrame([("SELECT a FROM t",)], "ground_truth_sql string")
    catalogue = spark.createDataFrame([("d", "sqlite", "p")], "name string, kind string, path string")
    one = "completion_id long, database_name string, completion string, ground_truth_sql string, ts timestamp"
    left, ls = St.stage_files(spark.createDataFrame([], one), "no-completions")
    right, rs = St.stage_files(spark.createDataFrame([], "completion_id long, outcome_ts timestamp, success boolean, n_pred long, n_gt long, "
                                                         "n_common long, pred_cols int, gt_cols int"), "no-outcomes")
    held = St.scored_stream(spark, left, ls, right, rs, gold, catalogue)._jdf.queryExecution().analyzed().toString()
    join = next(x for x in held.split("\n") if "Join LeftOuter" in x and "outcome_ts" in x)
    below = held[held.index(join):].split("Project [", 2)[1]
    assert "schema_score" in below and "completion#" not in below and "ground_truth_sql" not in below
