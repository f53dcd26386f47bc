"""The queries against their SQL: on the driver's tables, and on rows at the edges of their contracts."""

import os

import pytest

from inkwell.llm import queries

DATA = "/root/testdata/sf0.001"
NAMES = ["documents", "pages"]


def rows(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(repr(tuple(x.item() if hasattr(x, "item") else x for x in r)) for r in frame.itertuples(index=False))


def equal(spark, name, folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in NAMES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' * os.path.isdir(path)}'")
    got = queries.QUERIES[name](spark, folder).toPandas()
    assert rows(got) == rows(con.sql(queries.ORACLES[name]).df())
    return len(got)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    assert equal(spark, name, DATA)


@pytest.mark.parametrize("name", ["op1_jaccard_join", "op6_suffix_dedup"])
def test_edges_equal_the_sql(spark, tmp_path, name):
    words = [f"wörd{i}" for i in range(60)]
    near = [" ".join(words[:k] + ["other"] + words[k + 1 :]) for k in (0, 1, 59)]
    texts = [None, "", " \t\n\x0b\x0c\r", "one", "ONE", "two words", "two words", "a b c", "a b c d", "A  B\tC\nD", "a " * 400, "a " * 500, "x" * 49, "x" * 50, "x" * 51, "x" * 5000, *near, " ".join(words), " ".join(words).upper(), "\x00" * 60, "é" * 40, "zé" * 40]
    docs = [(7 * i % 41, t, "s") for i, t in enumerate(texts * 2)]
    docs = [(i + (100 if k >= 41 else 0), t, s) for k, (i, t, s) in enumerate(docs)]
    assert len({d[0] for d in docs}) == len(docs)
    spark.createDataFrame(docs, "doc_id long, text string, class string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert equal(spark, name, str(tmp_path)) == len(docs)
