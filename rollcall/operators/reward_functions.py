"""Rewards given as functions: registered once, used in reports and in SQL.

A reward function takes whole Arrow batches as named lists (one list a column)
and returns one number a row, None where it gives no score::

    def brevity(completion, prompt):
        return [1.0 if len(c.split()) < 50 else 0.0 for c in completion]

    r = reward_function("brevity", brevity, ["completion", "prompt"], span=(0.0, 1.0))
    cfg = with_function(RewardConfig(), r, weight=0.4)
    scored = add_function_scores(df, cfg)      # composite, breakdown, dominance check take cfg
    register(spark, r)                         # SELECT brevity(completion, prompt) FROM ...

Defined results: a None or NaN counts as 0; a function that returns another
number of scores than rows fails the query, and so does an exception in it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from ..config import RewardConfig


@dataclass(frozen=True)
class RewardFunction:
    name: str
    columns: tuple[str, ...]
    span: tuple[float, float]
    udf: Callable[..., Column]

    @property
    def score_col(self) -> str:
        return f"{self.name}_score"

    def __call__(self, *columns) -> Column:
        return F.coalesce(F.nanvl(self.udf(*(columns or self.columns)), F.lit(None).cast("double")), F.lit(0.0))


def reward_function(name: str, fn: Callable[..., list], columns: list[str], span: tuple[float, float]) -> RewardFunction:
    if not name.isidentifier():
        raise ValueError(f"reward {name!r} needs a name that SQL can call")
    if not columns:
        raise ValueError(f"reward {name} needs a column")
    names = tuple(columns)

    def batch(*series: pd.Series) -> pd.Series:
        scores = list(fn(**{c: s.tolist() for c, s in zip(names, series)}))
        if len(scores) != len(series[0]):
            raise ValueError(f"reward {name} gave {len(scores)} scores for {len(series[0])} rows")
        return pd.Series([None if s is None else float(s) for s in scores], dtype="float64")

    return RewardFunction(name, names, span, F.pandas_udf(batch, DoubleType()))


def with_function(cfg: RewardConfig, reward: RewardFunction, weight: float = 1.0, enabled: bool = True) -> RewardConfig:
    """A configuration with one more reward, computed by the function."""
    more = cfg.with_reward(reward.name, reward.score_col, reward.span, weight, enabled)
    return replace(more, functions=(*cfg.functions, reward))


def add_function_scores(df: DataFrame, cfg: RewardConfig) -> DataFrame:
    """Adds the score column of every enabled function of the configuration."""
    on = [r for r in cfg.functions if cfg.on(r.name)]
    missing = sorted({c for r in on for c in r.columns} - set(df.columns))
    if missing:
        raise ValueError(f"reward functions need columns {missing}")
    return df.withColumns({r.score_col: r() for r in on}) if on else df


def register(spark: SparkSession, reward: RewardFunction) -> None:
    """Makes the function callable in SQL by its name."""
    spark.udf.register(reward.name, reward.udf)
