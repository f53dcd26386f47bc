import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from inkwell.llm import language_id

SYLLABLES = {"en": "the ing and tion er".split(), "de": "sch ein und keit ü".split(), "ru": "при ост ени ла".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(n=400):
    rng = random.Random(4)
    return [(i, sentence(rng, lang, rng.randrange(3, 40)), lang) for i in range(n) for lang in [rng.choice(list(SYLLABLES))]]


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus()
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "12 $$ 34", None), (None, "the anding", "en"), (1003, "the tioning " * 20000, None), (1004, "漢字", None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in [*rows, *odd]], "doc_id long, text string, lang string, score_ double").repartition(4)
    model = language_id.fit(docs, sample=100)
    assert model.languages == ["de", "en", "ru"]
    got = {r["doc_id"]: r for r in language_id.label(docs, model).withColumn("held", language_id.held_out(F.col("doc_id"))).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert {r[0] for r in held} <= {i for i, r in got.items() if r["held"]}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in held) >= 0.98 * len(held)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_spans_of_mixed_text(spark):
    model = language_id.fit(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    rng = random.Random(8)
    parts = [sentence(rng, "en", 12), sentence(rng, "de", 12), sentence(rng, "ru", 3)]
    text = " ".join(parts)
    spans = model.label([text])[0][2]
    assert [s[2] for s in spans] == ["en", "de", "ru"]
    assert abs(spans[1][0] - len(parts[0])) < 12 and spans[2][:2] == (len(text) - len(parts[2]), len(text))


def test_path_is_the_best_of_all(spark):
    rng = np.random.default_rng(0)
    model = language_id.Model(["a", "b", "c"], np.ones((3, language_id.BUCKETS)), np.ones((3, len(language_id._NAMES))))
    first = np.array([0, 0, 5, 6, 11])
    scores = rng.normal(0, 6, (11, 3)).astype(np.float32)
    path = model.path(scores, first, 4.0)
    for a, b in zip(first[:-1], first[1:]):
        if b > a:
            grid = np.array(np.meshgrid(*[range(3)] * (b - a))).reshape(b - a, -1)
            value = scores[np.arange(a, b)[:, None], grid].sum(0) - 4.0 * (np.diff(grid, axis=0) != 0).sum(0)
            mine = scores[np.arange(a, b), path[a:b]].sum() - 4.0 * (np.diff(path[a:b]) != 0).sum()
            assert abs(value.max() - mine) < 1e-3


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.label(docs, language_id.fit(docs)).collect() == []


def test_pieces_do_not_change_labels(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    model = language_id.Model(["a", "b"], rng.integers(0, 50, (2, language_id.BUCKETS)), np.array([[9, 1] + [0] * (len(language_id._NAMES) - 2)] * 2))
    texts = [" ".join("".join(rng.choice(list("abcdeé")) for _ in range(5)) for _ in range(int(n))) for n in rng.integers(0, 60, 80)] + ["", "12 34"]
    whole = model.label(texts)
    monkeypatch.setattr(language_id._pieces, "__defaults__", (100,))
    assert model.label(texts) == whole


def test_clashing_columns_are_replaced(spark):
    docs = spark.createDataFrame([(1, "the house", "en", 9, "x", None), (2, "the house", "en", 9, "y", None), (2, "the house", "en", 9, "y", None)], "doc_id long, text string, lang string, score int, lang_pred string, s_lang string")
    got = language_id.label(docs, language_id.fit(docs), spans=True).collect()
    assert len(got) == 3 and len({(r["lang_pred"], r["score"]) for r in got}) == 1 and "s_lang" in got[0].__fields__
