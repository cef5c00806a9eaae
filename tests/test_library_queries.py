"""Library queries against their SQL on tables whose keys are beyond those of the small ones."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NEW = {
    # conversations whose numbers have more digits than a key, and ones that are longer than 1000 turns
    "conversations": "SELECT c.conv_id, c.turn, c.role, c.text FROM c UNION ALL SELECT c.conv_id + k, c.turn + j, c.role, c.text FROM c, (VALUES (10000, 0), (20000, 0), (1, 1000), (123456, 2000)) x(k, j)",
    "pages": "SELECT * FROM c UNION ALL SELECT c.page_id + 10000000, c.url, c.html FROM c",
    "benchmark": "SELECT * FROM c UNION ALL SELECT c.item_id + 10000000, c.text FROM c",
}


@pytest.fixture(scope="module")
def large_keys(tmp_path_factory):
    out = tmp_path_factory.mktemp("large_keys")
    for name in os.listdir(SF):
        new = NEW.get(name.removesuffix(".parquet"))
        if new is None:
            os.symlink(f"{SF}/{name}", out / name)
        else:
            duckdb.sql(f"COPY (WITH c AS (SELECT * FROM '{SF}/{name}') {new}) TO '{out / name}' (FORMAT parquet)")
    return str(out)


@pytest.mark.parametrize("name", ["library_children", "library_key_groups", "library_notes_and_annotations", "library_parents"])
def test_large_keys(spark, large_keys, name):
    con = duckdb.connect()
    for file in os.listdir(large_keys):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{large_keys}/{file}'")
    order = lambda rows: sorted(rows, key=str)
    got = entry.queries()[name](spark, large_keys).collect()
    assert order(tuple(r) for r in got) == order(con.execute(entry.oracle_sql()[name]).fetchall())
