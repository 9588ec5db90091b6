"""All registered queries (import side effect fills the registry)."""

from . import (code_queries, exec_queries, match_queries, prep_queries, reward_queries, score_queries, scoring_queries,  # noqa: F401
               stream_queries, text_queries, track_queries)
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
