"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from chronica.plans import catalog
from tests import harness

SF_DIR = "/root/testdata/sf0.001"
# A thousand boosting rounds take minutes; the harness runs them on demand, and
# test_models.py holds the operator to held-out loss.
SLOW = {"n06_boosted_one_vs_rest"}


@pytest.fixture(scope="module")
def duck():
    return harness.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_twin(spark, duck, name):
    assert harness.compare(spark, duck, SF_DIR, name, catalog.QUERIES[name], catalog.TWINS.get(name)) is None


def test_twins_have_queries():
    assert set(catalog.TWINS) <= set(catalog.QUERIES)
