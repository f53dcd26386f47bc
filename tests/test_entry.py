import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from inkwell import queries

ROOT = os.path.dirname(os.path.abspath(entry.__file__))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "tolist"):
        return value.tolist()
    return value


def rows(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(repr(tuple(plain(x) for x in r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(queries.ORACLES[name]).df())


def test_every_page_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("kept", [("inkwell", "__spark_entry__.py"), ("inkwell", "__spark_entry__.py", "corpus_pipeline.py")])
def test_entry_works_without_the_llm_folders(tmp_path, kept):
    for name in (n for n in kept if os.path.exists(os.path.join(ROOT, n))):
        path = os.path.join(ROOT, name)
        if os.path.isdir(path):
            shutil.copytree(path, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(path, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'key_terms' in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env).returncode == 0
