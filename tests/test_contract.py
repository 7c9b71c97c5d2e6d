"""Every registered query next to its SQL, over the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query_equals_sql(spark, db, name):
    problems, _ = differences(spark, db, SF_DIR, name)
    assert not problems


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    page = contract.entry(spark)
    assert page.count() > 0 and "NO_MUNICIPIO_PROVA" in page.columns
