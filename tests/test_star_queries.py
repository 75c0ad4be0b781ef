"""Every query with SQL gives the rows that DuckDB gives."""

import pytest

from histoframe.plans.checks import differences
from histoframe.plans.layer_queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, small, name):
    assert differences(QUERIES[name](spark, small), small, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_known_gating_counts(spark, small):
    found = {r.cell_type: r.n_cells for r in QUERIES["gating_multi"](spark, small).collect()}
    assert found == {"buyer": 5, "noisy": 8, "Unknown": 2}
