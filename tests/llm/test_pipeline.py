import random
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_jaccard_join import brute as jaccard  # noqa: E402
from test_token_files import plain  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    path = tmp_path_factory.mktemp("corpus")
    vocabulary = {"en": "the of and thing with over under river stone".split(), "de": "der und nicht schön über straße zeit".split()}
    text = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "er", "en", "ly"]) for _ in range(n))
    items = [(i, text("en", 25)) for i in range(5)]
    docs = []
    for i in range(200):
        lang = rng.choice(["en", "de"])
        docs.append((i, text(lang, rng.randrange(5, 60)), lang, rng.choice(["a", "a", "a", "b", "c"]), 0))
    docs += [(200 + i, docs[i][1], docs[i][2], "b", 0) for i in range(30)]
    docs += [(300 + i, text("en", 10) + " " + items[i % 5][1], "en", "c", 0) for i in range(20)]
    docs += [(400, None, None, "a", 0), (401, "123 $$", "en", "a", 0), (402, "thing with the river", None, None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "doc_id AS score", "source AS key", "1 AS n", "'x' AS lang_pred", "doc_id AS class", "2 AS size", "3 AS part").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, items


def test_stages_take_effect(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    named = stages["language ID"](spark, docs, path)
    assert named.columns == docs.columns
    assert {r["doc_id"] for r in named.collect()} == {r[0] for r in rows} - {400, 401}
    left = [r for r in rows if r[0] not in (400, 401)]
    single = stages["n-gram Jaccard join"](spark, named, path)
    assert single.columns == docs.columns
    want = {r[0] for r in jaccard([(r[0], r[1]) for r in left], 5, 80) if r[0] == r[2]}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(want)
    clean = stages["benchmark decontamination"](spark, single, path)
    assert {r["doc_id"] for r in clean.collect()} == {i for i in want if not 300 <= i < 320}
    mixed = stages["mixing sources to target weights"](spark, clean, path)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in clean.collect()}
    last = stages["token-ID / binary output"](spark, mixed, path).collect()
    order = sorted((r["doc_id"], r["text"]) for r in mixed.collect())
    ids = plain([t for _, t in order])
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in sorted(last, key=lambda r: r["start"])] == [(d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, _), x in zip(order, ids)]
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).collect())) == sorted(map(tuple, last))


def test_empty_table(spark, folder, tmp_path):
    path, _, _ = folder
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
