import pytest
from oracle import connect, same

import asofkit.plans as plans

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_same_as_sql(spark, con, name):
    same(plans.QUERIES[name](spark, SF), con, plans.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_unmet_floors_at_a_larger_size(spark):
    larger = "/root/testdata/sf0.1"  # where no threshold has a precision of 0.21
    same(plans.QUERIES["thresholds_at_floors"](spark, larger), connect(larger), plans.ORACLE["thresholds_at_floors"])
