"""Every query that has SQL gives the same rows as DuckDB over the smallest tables."""

import duckdb
import pytest

from newsloom import catalog, catalog_flow, catalog_news, catalog_rules, catalog_serving  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def _rows(rows, names):
    order = sorted(names)
    at = [names.index(c) for c in order]
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    want = con.execute(catalog.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(want.fetchall(), names)


def test_entry_works_without_the_llm_folders(tmp_path):
    """A copy without the corpus operators, their tests and their pipeline imports, and has all other queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    assert not (copy / "newsloom" / "llm").exists() and not (copy / "tests" / "llm").exists()
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*sorted(e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    names = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert names == sorted(catalog.QUERIES)
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
