import pytest

from tests.oracles import duck, same_rows
from weirflow.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    same_rows(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name])
