import pytest

from quarry.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connection, same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    same(spark, connection(), QUERIES[name], ORACLE_SQL[name])


def test_all_ten_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
