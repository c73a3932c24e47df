"""Editions over larger tables than the tests' own: years past 9999, editions without entries."""

import os

import duckdb
import pytest

from newsloom import catalog, catalog_news  # noqa: F401

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """The smallest tables, with every second order's number 3,000,000 larger: editions some 8,000 years later."""
    folder = tmp_path_factory.mktemp("far")
    for name in os.listdir(DIR):
        os.symlink(f"{DIR}/{name}", folder / name)
    (folder / "orders.parquet").unlink()
    duckdb.execute(f"COPY (SELECT * REPLACE (o_orderkey + o_orderkey % 2 * 3000000 AS o_orderkey) FROM '{DIR}/orders.parquet') TO '{folder}/orders.parquet' (FORMAT parquet)")
    return str(folder)


def _same(spark, folder, name):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    want = con.execute(catalog.SQL[name])
    names = [c[0] for c in want.description]
    got = sorted(map(tuple, catalog.QUERIES[name](spark, folder).select(*names).collect()), key=repr)
    assert got == sorted(want.fetchall(), key=repr)
    return got


@pytest.mark.parametrize("name", ["r01_editions", "r11_edition_summary", "r14_edition_status"])
def test_years_past_9999(spark, far, name):
    assert any("10" == str(v)[:2] and len(v) == 11 for row in _same(spark, far, name) for v in row if isinstance(v, str))


@pytest.fixture(scope="module")
def full(tmp_path_factory):
    """The smallest tables, with documents repeated to 36,000: 1,200 an edition that has any."""
    folder = tmp_path_factory.mktemp("full")
    for name in os.listdir(DIR):
        os.symlink(f"{DIR}/{name}", folder / name)
    (folder / "documents.parquet").unlink()
    duckdb.execute(f"COPY (SELECT * REPLACE (doc_id + 200 * i AS doc_id, substr(text, 1, 80) AS text) FROM '{DIR}/documents.parquet', range(180) t(i)) TO '{folder}/documents.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize(("name", "rows"), [("r05_featured_events", 30), ("r06_all_dynamics", 20), ("r08_search", 20)])
def test_the_newest_edition_with_entries_is_read_whole(spark, full, name, rows):
    assert len(_same(spark, full, name)) == rows
