"""The driver contract, and a part of the bound queries against their SQL (all of them: tests/oracle.py)."""

import re

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CHECKED = [
    "rate_wilson", "crosstab_rows", "momentum", "insight_facts", "concentration", "filter_spec", "median_by_year", "clean_table",
    "scan_json_fields", "keyword_flags", "locations_parse", "star_industries", "series_monthly", "backtest_holt", "eval_ranking",
    "model_rows", "cohort_mix_rank",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    own = {name for name in queries if not re.match(r"op\d+_|pipeline$", name)}
    assert own - set(sql) == {"model_comparison", "model_predictions", "perm_importance"}
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF) == ""
