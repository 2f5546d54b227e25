"""Every registered query against its SQL at the smallest scale, sampled by family.

``python -m fieldmark.checks.run`` compares all of them; here one cheap query per family
keeps the suite short, plus contract checks over the whole register.
"""

import pytest

import __spark_entry__
from fieldmark.checks.run import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "a7_harmonised",
    "a11_replaced_partition",
    "b3_declared_columns",
    "b11_game_filter",
    "c1_plays_of_curated_games",
    "c15_reference_errors",
    "d25_calibration",
    "d32_all_checks",
    "d40_quintile_accuracy",
    "e6_rest_days",
    "e11_team_rating",
    "e18_cold_start_features",
    "f5_chronological_page",
    "g2_team_games",
    "g4_full_catalog",
    "k5_resolved_columns",
    "m2_fold_roles",
    "m13_run_comparison",
    "r2_updated_configs",
    "r12_rejected_transitions",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    ok, note = compare(spark, con, name, queries[name], oracles[name], SF)
    assert ok, note


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_register_is_consistent():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 140
