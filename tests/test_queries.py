"""Every catalogued query runs, and gives what its DuckDB counterpart gives."""

from __future__ import annotations

import pytest

from newsweft.plans import catalog, compare

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    rows = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert compare.difference(rows, con, ORACLES[name]) == ""
    else:
        # What SQL can't say: the rows are those of the table that they are made of, and a second run gives the same.
        got, again = ([tuple(r) for r in rows.collect()] for _ in range(2))
        assert got and sorted(map(repr, got)) == sorted(map(repr, again))


def test_entry_without_the_llm_folder(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_llm", lambda: None)
    monkeypatch.setattr(entry, "_pipeline", lambda: None)
    assert "news_items" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
