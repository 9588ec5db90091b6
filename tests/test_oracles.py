"""Every registered query against its DuckDB oracle (sf0.001)."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_check import compare, duck_conn

#: Queries without SQL (trained models, iterative fits) are tested where their operators are.
NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck_conn(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, SF_SMALL, name, E.queries()[name], E.oracle_sql().get(name), con)
    assert r["ok"], r


def test_only_the_training_data_queries_lack_sql():
    import re

    # byte-pair merges have no SQL form either (tests/test_tokens.py)
    assert all(re.match(r"op\d+_|pipeline$|token_id", n) for n in set(E.queries()) - set(NAMES))


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 32
    assert "prompts_no_reward_variance" in df.columns
