"""Queries of the training-data problems against SQL on the smallest tables."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from tephra.llm import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["group_id", "field", "file_id"],
    "p3_found": ["file_id", "group_id"],
    "p4_found": ["doc_id", "cut"],
    "p5_found": ["file_id_a", "file_id_b"],
    "p9_found": ["doc_id", "item_id"],
    "p10_found": ["doc_id", "start_pos", "end_pos"],
    "p1_survivors": ["group_id", "copies", "master", "created_us", "modified_us", "thumbnail", "hash", "size", "extension", "wasted_bytes"],
    "p4_kept": ["doc_id", "characters", "over"],
    "p5_groups": ["file_id", "links", "group_id"],
    "p5_weighted": ["file_id_a", "file_id_b", "similarity"],
    "p8_kept": ["source", "texts", "characters", "over"],
}


def test_entry_has_them():
    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    df = entry.queries()[name](spark, DATA)
    assert df.columns == COLUMNS[name]
    got = Counter(tuple(r) for r in df.collect())
    assert max(got.values(), default=1) == 1
    if name in queries.SQL:
        import duckdb

        c = duckdb.connect()
        c.sql("SET TimeZone = 'UTC'")
        for f in os.listdir(DATA):
            c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
        rel = c.sql(queries.SQL[name]).df()[COLUMNS[name]]
        assert got == Counter(tuple(v.item() if hasattr(v, "item") else v for v in r) for r in rel.itertuples(index=False))
