"""Every registered query against its SQL on the smallest tables."""

import pytest

from suite import REGISTRY
from tools.check import compare, connect


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, db, sf_dir, name):
    ok, message, _, _ = compare(spark, db, sf_dir, name)
    assert ok, message
