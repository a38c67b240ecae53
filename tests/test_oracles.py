"""Every reference-style query against its SQL, and the others for rows."""

from __future__ import annotations

import pytest

from pricewright.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(name, spark, folder):
    rows = QUERIES[name](spark, folder).collect()  # a count would prune the columns
    assert rows and any(value is not None for value in rows[0])


def test_entry_and_registry_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
