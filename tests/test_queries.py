"""A few registered queries against their SQL twins; ``check_oracle.py`` compares all of them."""

import os

import pytest

import __spark_entry__ as contract
import check_oracle
from watchframe.plans.oracle import ORACLE
from watchframe.plans.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


def test_every_query_has_a_twin():
    assert REGISTRY.keys() == ORACLE.keys()
    assert contract.queries().keys() >= contract.oracle_sql().keys() >= ORACLE.keys()


@pytest.mark.parametrize("name", [
    "normalize_accepted", "contract_violations", "log_label_policy", "inventory_violations", "series_latest", "rate5m",
    "alert_events", "metadata_audit", "subject_correlation", "baseline_mad", "stream_latest"])
def test_twin_agrees(spark, name):
    con = check_oracle.connect(SF_DIR)
    assert check_oracle.compare(spark, con, name, SF_DIR).startswith("ok")


def test_entry(spark):
    assert contract.entry(spark).count() > 0
