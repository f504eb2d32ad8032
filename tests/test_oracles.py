"""Every contest query that SQL can express equals its SQL."""

import pytest

from contestry.oracles import ORACLE_SQL
from contestry.queries import QUERIES

from .oracle import connect, rows_from, rows_of


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf, name):
    assert rows_of(QUERIES[name](spark, sf)) == rows_from(connect(sf), ORACLE_SQL[name])


def test_entry_is_importable_and_registered():
    import __spark_entry__ as entry

    assert set(ORACLE_SQL) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
