"""Registered queries against their SQL on the smallest tables. ORACLE=all runs every one."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
CORE = ["weekly_base", "weekly_features", "run_all_checks", "fold_rows", "score_ledger_macro", "ledger_validation",
        "hierarchical_mean", "analog_metadata", "was_exact_match", "same_weekday_stats", "seasonal_decomposition",
        "train_vocab_codes", "carry_forward", "stream_weekly_rollup"]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("ORACLE") == "all" else CORE)
def test_query_matches_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) is None


def test_registry_is_complete():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 140


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
