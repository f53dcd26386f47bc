import random

import pytest

from inkwell.llm import common, jaccard_join, language_id, mixing, suffix_dedup

WORDS = "the of and thing with over under river stone house garden letter window".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(21)
    text = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "er", "ly", "s"]) for _ in range(n))
    texts = [text(rng.randrange(4, 60)) for _ in range(60)]
    texts += texts[:15] + [t + " more" for t in texts[20:30]]
    rows = [(i, t, "en", rng.choice(["a", "a", "b", None])) for i, t in enumerate(texts)] + [(None, None, None, None), (90, "", "en", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).cache()


RUNS = {
    "jaccard": lambda d: jaccard_join.dedup(d),
    "links": lambda d: jaccard_join.join(d),
    "mix": lambda d: mixing.mix(d),
    "suffix": lambda d: suffix_dedup.report(d),
    "language": lambda d: language_id.label(d, language_id.fit(d)),
}


@pytest.mark.parametrize("name", RUNS)
def test_joins_by_shuffle_give_the_same_rows(docs, monkeypatch, name):
    got = []
    for most in (200_000, -1):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        got.append(sorted(map(str, RUNS[name](docs).collect())))
    assert got[0] == got[1] and got[0]


def test_settings_of_a_session_are_lowered_only(spark, docs):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for now, want in (("100", "100"), ("10000", "1000"), ("0", "1000")):
            spark.conf.set(key, now)
            common.bounded_batches(docs)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)


def test_components_of_pairs(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([((a, "n"), (b, "n")) for a, b in edges if a != b], "a struct<x:long,y:string>, b struct<x:long,y:string>")
    got = {r["node"]["x"]: r["root"]["x"] for r in common.components(df).collect()}
    assert got == {x: find(x) for x in got} and all(find(x) in (x, got.get(x)) for x in root)
