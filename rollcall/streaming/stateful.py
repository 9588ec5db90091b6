"""Keyed state with typed variables, timers and time to live.

Both processors keep their state in RocksDB, so a key's state need not fit in
memory and a list grows by appends. The session's other streams keep their
settings: these hold only while a query of this module runs to its end.
"""

from __future__ import annotations

from contextlib import contextmanager
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import tracking as T
from ..session import ship_package

#: A drained stream ends with its data: processing time always calls for another empty batch.
NO_EMPTY_BATCHES = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    **NO_EMPTY_BATCHES,
}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Settings for the queries started inside; each keeps them to its end."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rocksdb(spark: SparkSession):
    return settings(spark, _SETTINGS)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")]).astype(object)


def _timer(handle: StatefulProcessorHandle, at: int) -> None:
    """One timer a key: the last one set."""
    for t in list(handle.listTimers()):
        handle.deleteTimer(t)
    handle.registerTimer(at)


PLATEAU_SCHEMA = ("run_id long, step long, rolling_avg double, improved boolean, best_avg_reward double, "
                  "steps_since_improvement long, plateau_warning boolean, late boolean")


class PlateauTracker(StatefulProcessor):
    """Rolling reward and stall counter of a run.

    State: the last rewards of the window (a list), and the last step, the best
    rolling average and the steps since it (a value). A row with ``ended`` closes
    the run after its micro-batch: its state goes. A run that sends nothing for
    ``idle_ms`` goes by timer; the values' time to live removes what a lost
    timer would leave. Steps after a run's end begin it anew."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rewards = handle.getListState("rewards", "reward double", 2 * self.idle_ms)
        self.progress = handle.getValueState("progress", "last long, best double, since long", 2 * self.idle_ms)

    def _clear(self) -> None:
        self.rewards.clear()
        self.progress.clear()

    def handleInputRows(self, key, rows, timerValues):
        """Per run and micro-batch: all chunks are gathered and sorted once. One
        row for each check step; a step at or below the last one of an earlier
        micro-batch can't change what was reported and is put out marked ``late``."""
        last, best, since = self.progress.get() if self.progress.exists() else (None, None, 0)
        window = [r[0] for r in self.rewards.get()] if self.rewards.exists() else []
        seen, out = last, []
        batch = pd.concat(list(rows)).sort_values("step", kind="stable")
        for step, reward in zip(batch["step"].tolist(), batch["reward"].tolist()):
            if seen is not None and step <= seen:
                out.append((key[0], step, None, None, None, None, None, True))
                continue
            last = step
            if reward is None or reward != reward:
                continue  # a step without a reward is no part of the history
            window = [*window, reward][-T.WINDOW:]
            if step > 0 and step % T.CHECK_EVERY == 0:
                avg = sum(window) / len(window)
                improved = best is None or avg > best
                best = avg if improved else best
                since = 0 if improved else since + T.CHECK_EVERY
                out.append((key[0], step, avg, improved, best, since, since >= T.PLATEAU_WARN, False))
        if bool(batch["ended"].any()):
            self._clear()
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        else:
            self.progress.update((last, best, since))
            if window:
                self.rewards.put([(r,) for r in window])
            _timer(self.handle, timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield _frame(out, PLATEAU_SCHEMA)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._clear()
        yield _frame([], PLATEAU_SCHEMA)

    def close(self) -> None:
        pass


def track_plateau(source: DataFrame, idle_ms: int = 6 * 3600 * 1000) -> DataFrame:
    """Stream of (run_id, step, reward[, ended]) to check-step rows."""
    ship_package(source.sparkSession)
    ended = F.coalesce("ended", F.lit(False)) if "ended" in source.columns else F.lit(False)
    return source.select("run_id", "step", "reward", ended.alias("ended")).groupBy("run_id") \
        .transformWithStateInPandas(PlateauTracker(idle_ms), PLATEAU_SCHEMA, "append", "processingTime")


CACHE_SCHEMA = "kind string, db string, sql string, completion_id long, success boolean, error string, cached boolean"
_CACHE_ROW = Row(*[f.split()[0] for f in CACHE_SCHEMA.split(", ")])


class ExecutionCache(StatefulProcessor):
    """A statement's outcome, kept between micro-batches.

    Per (db, sql): the outcome, whether the statement was sent to run, and who
    waits. The first ask sends one ``run`` row; asks before the outcome wait and
    are answered when it comes, later ones from the cache at once. The first
    recorded outcome counts. ``keep_ms`` after the last change the key goes;
    whoever still waits then is answered without an outcome (NULL), so every ask
    gets exactly one answer. The next ask runs the statement again.

    Most keys have a few rows, so a key costs its calls to the state: one value
    holds the outcome, what was sent and the timer, and rows come and go as rows,
    many keys to an Arrow batch."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "told boolean, success boolean, error string, sent boolean, timer long")
        self.waiting = handle.getListState("waiting", "completion_id long")

    def _answers(self, key, success, error, ids, cached: bool) -> Iterator[Row]:
        return (_CACHE_ROW("answer", key[0], key[1], i, success, error, cached) for i in ids)

    def handleInputRows(self, key, rows, timerValues):
        before = self.known.get()
        told, success, error, sent, timer = before or (False, None, None, False, None)
        waited, asks, changed = sent and not told, [], False
        for r in rows:
            if r.kind == "ask":
                asks.append(r.completion_id)
            elif not told:
                told, success, error, changed = True, bool(r.success), r.error, True
        if told and waited:
            yield from self._answers(key, success, error, [w[0] for w in self.waiting.get()], False)
            self.waiting.clear()
        if asks and told:
            yield from self._answers(key, success, error, asks, True)
        elif asks:
            if not sent:
                yield _CACHE_ROW("run", key[0], key[1], None, None, None, False)
                sent = changed = True
            self.waiting.appendList([(i,) for i in asks])
        if changed:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.keep_ms
            self.handle.registerTimer(timer)
            self.known.update((told, success, error, sent, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        told, _, _, sent, _ = self.known.get() or (False, None, None, False, None)
        if sent and not told:
            yield from self._answers(key, None, None, [w[0] for w in self.waiting.get()], False)
        self.known.clear()
        self.waiting.clear()

    def close(self) -> None:
        pass


def cache_executions(asks: DataFrame, outcomes: DataFrame, keep_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Streams of asks (completion_id, db, sql) and of outcomes (db, sql, success,
    error) to ``run`` rows (statements to execute, once each) and ``answer`` rows.
    Empty statements are no asks."""
    ship_package(asks.sparkSession)
    none = F.lit(None)
    both = asks.where("sql <> ''").select(F.lit("ask").alias("kind"), "db", "sql", F.col("completion_id").cast("long"),
                                          none.cast("boolean").alias("success"), none.cast("string").alias("error")) \
        .unionByName(outcomes.select(F.lit("outcome").alias("kind"), "db", "sql", none.cast("long").alias("completion_id"), "success", "error"))
    return both.groupBy("db", "sql").transformWithState(ExecutionCache(keep_ms), CACHE_SCHEMA, "append", "processingTime")
