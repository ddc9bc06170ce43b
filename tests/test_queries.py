"""Registered queries against their statements.  ALL_QUERIES=1 runs every one of them."""

import os

import duckdb
import pytest

from modelgov.plans import registry
from modelgov.plans.lenses import BASE_TABLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
registry.load_all()
QUICK = [
    "measure_formulas", "semantic_links", "block_ranges", "catalog_columns", "filter_lineage", "visual_fields",
    "field_usage_counts", "column_decisions", "cleanup_text", "layout_fields", "tom_columns", "render_relations_text",
    "visual_matrix", "protect_structure", "token_stream", "restored_text", "stored_catalog", "unmatched_endpoints",
]
NAMES = sorted(registry.ORACLES) if os.environ.get("ALL_QUERIES") else QUICK

needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = registry.run(name, spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_every_query_has_a_statement():
    assert set(registry.ORACLES) == set(registry.QUERIES)
