import pytest

from hopgrid.plans import catalogue
from tests.oracle import duck, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_against_sql(spark, name):
    same(catalogue.queries()[name](spark, SF), duck(SF), catalogue.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
