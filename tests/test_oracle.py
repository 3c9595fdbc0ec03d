"""Every query equals its SQL on DuckDB.

Queries over the one-minute grid of a month take long on any data, so only some of them run here;
set SLOFLOW_ALL=1 to run all.
"""

import os

import pytest

import __spark_entry__ as driver
from compare import connect, difference

SF_DIR = os.environ.get("SLOFLOW_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = driver.queries(), driver.oracle_sql()
# The training-data queries have tests of their own; SQL cannot express most of them.
for name in driver._training_data()[0]:
    QUERIES.pop(name), SQL.pop(name, None)
HEAVY = {
    "events_over_time", "eot_sparse_4w", "burn_rate", "rate_coefficient", "effective_burn", "error_budget",
    "alert_1h", "alert_6h", "alert_1d", "alert_3d", "alert_missing_all", "alert_health", "alert_rows",
    "budget_alert_rows", "sli_percent", "budget_remaining", "worst_budget", "budget_delta", "max_coefficient",
    "increase_30m", "increase_1h", "increase_2h", "increase_6h", "increase_1d", "increase_3d",
    "counters_domain", "counters_class", "counters_app", "counters_key", "uptime_sli", "query_sli",
}
CHOSEN = [n for n in QUERIES if os.environ.get("SLOFLOW_ALL") or n not in HEAVY]


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, duck, name):
    assert difference(spark, duck, QUERIES[name], SQL[name], SF_DIR) is None


def test_entry(spark):
    assert driver.entry(spark).count() > 0
