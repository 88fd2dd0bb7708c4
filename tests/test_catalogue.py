"""Every registered query against its checking SQL, and the driver contract."""

import pytest

import __spark_entry__ as entry_module
from flowsieve.plans.catalogue import load_catalogue, runnable
from tests.oracle import compare, connect

CATALOGUE = load_catalogue()
CHECKED = sorted(n for n, q in CATALOGUE.items() if q.sql)
# Trained end to end elsewhere in this suite, or by the query that checks their totals.
SLOW = {
    "n4_event_job_results", "j19_learning_curve", "j18_cross_validation", "j4_recursive_elimination", "j5_forest_importance",
    "j10_decision_tree", "j11_random_forest", "j12_linear_svc", "j15_logistic_regression", "n2_registered_method",
}
ROWS_ONLY = sorted(n for n, q in CATALOGUE.items() if not q.sql and n not in SLOW)


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, sf_dir, connection, name):
    query = CATALOGUE[name]
    assert compare(spark, sf_dir, runnable(query), query.sql, connection) is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, sf_dir, name):
    assert runnable(CATALOGUE[name])(spark, sf_dir).count() > 0


def test_contract(spark):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    rows = entry_module.entry(spark)
    assert rows.count() > 0
    assert "label_action" in rows.columns
