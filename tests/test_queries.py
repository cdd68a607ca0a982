import pytest

from quarry.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import SF, connection, same


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, con, name):
    same(spark, con, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())


def test_block_alignment_reads_every_turn(spark, con):
    got = {(r.conv_id, r.turn) for r in QUERIES["block_alignment"](spark, SF).select("conv_id", "turn").collect()}
    want = con.execute("SELECT conv_id, turn FROM conversations c WHERE text IS NOT NULL AND (turn = 0 OR EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1))").fetchall()
    assert got == set(want) and max(turn for _, turn in got) > 0
