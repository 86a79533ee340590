"""Every registered query of the library against its SQL in DuckDB; those without SQL are compared elsewhere."""

from __future__ import annotations

import os

import pytest

from tests.conftest import oracle_rows, rows_of

from corpusloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


#: Queries that SQL does not express, and where their operators are held against brute force.
WITHOUT_SQL = {
    "agg_rouge_l": "test_datasets",
    "bpe_encode": "test_bpe",
    "bpe_save": "test_bpe",
    "bpe_train": "test_bpe",
    "emb_hash": "test_values",
    "index_search": "test_vector_index",
    "src_docx": "test_values",
    "src_txt": "test_values",
    "st_rate_limit": "test_values",
    "win_quota_greedy": "test_datasets",
}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    found = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql().get(name)
    columns, rows = rows_of(found)
    assert len(set(columns)) == len(columns)
    if sql is None:  # values are compared in the tests named in WITHOUT_SQL
        assert name in WITHOUT_SQL and rows
        return
    expected_columns, expected = oracle_rows(sql, SF)
    assert columns == expected_columns
    assert rows == expected


def test_entry_points_import():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.queries()) <= set(entry.queries())
