"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tidemark.plans.compare import differences, oracle_frame
from tidemark.plans.oracles import ORACLES
from tidemark.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    actual = QUERIES[name](spark, FOLDER).toPandas()
    assert len(actual) > 0
    if name in ORACLES:
        assert differences(actual, oracle_frame(ORACLES[name], FOLDER)) is None


def test_contract_has_them_all():
    assert QUERIES.keys() <= contract.queries().keys() and ORACLES.keys() <= contract.oracle_sql().keys()


def test_entry(spark):
    assert contract.entry(spark).columns == ["project_id", "step", "event_type", "users"]
