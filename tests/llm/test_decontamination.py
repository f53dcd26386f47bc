import random

import numpy as np
import pytest

from inkwell.llm import decontamination as dc


def brute_score(doc, item):
    best = 0
    table = [[0] * (len(doc) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(doc, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if a == b else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
            best = max(best, table[i][j])
    return best


def test_alignment_matches_the_plain_table():
    rng = np.random.default_rng(1)
    for _ in range(300):
        doc, item = rng.integers(0, 4, rng.integers(0, 25)), rng.integers(0, 4, rng.integers(0, 12))
        score, a, b = dc.aligned_span(doc, item)
        assert score == brute_score(doc.tolist(), item.tolist())
        assert score == brute_score(doc[a:b].tolist(), item.tolist())


@pytest.mark.parametrize("block", [500_000, 60])
def test_planted_copies_are_found(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_WORDS", block)
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(words(rng.randrange(8, 30)))) for i in range(20)] + [(50, None), (51, ""), (52, "uniqueone"), (53, "uniqueone anotherone"), (0, None)]
    docs, want = [], set()
    for i in range(300):
        text = words(rng.randrange(80))
        kind = i % 3
        if kind:
            item = rng.choice(items[:20])
            copy = item[1].split()
            if kind == 2:  # an edited copy
                for _ in range(len(copy) // 7):
                    copy[rng.randrange(len(copy))] = "edit"
            at = rng.randrange(len(text) + 1)
            text[at:at] = copy
            want.add((i, item[0]))
        docs.append((i, " ".join(text).upper() if i % 5 == 0 else " ".join(text)))
    docs += [(900, None), (901, ""), (902, "says uniqueone here"), (903, "uniqueone anotherone"), (None, "nothing"), (904, "word " * 30000)]
    want |= {(902, 52), (903, 52), (903, 53)}
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int").repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.leaks(frame, bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(want - found) <= 2 and not {d for d, _ in found} - {d for d, _ in want} and len(got) == len(found)
    for r in got:
        if r["score"] == 1.0:
            text = dict(docs)[r["doc_id"]].encode()[r["start_byte"] : r["end_byte"]].decode().lower()
            assert text == dict(items[:24])[r["item_id"]]
    kept = dc.clean(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in {x for x, _ in found})


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text here")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "some text here")], "item_id long, text string")
    assert dc.leaks(docs.limit(0), bench).collect() == [] and dc.leaks(docs, bench.limit(0)).collect() == []
    assert dc.clean(docs, bench.limit(0)).count() == 1 and dc.clean(docs, bench).count() == 0


@pytest.mark.parametrize("threshold, parts", [(0.5, 0), (0.5, 3), (0.9, 3)])
def test_every_edited_or_partial_copy_is_found(spark, threshold, parts):
    rng = random.Random(9)
    items = [(i, [f"i{i}w{j}" for j in range(n)]) for i, n in enumerate((12, 20, 25, 30, 40, 41, 60, 20, 20, 30, 40, 30))]
    docs = []
    for i, item in items:
        if i > 6:  # the corpus holds one copy of it, the first words or one with edits
            every = i - 3
            docs.append(item[: len(item) // 2 + 1] if i == 11 else [f"new{j}" if j % every == every - 1 else w for j, w in enumerate(item)])
            continue
        for every in (3, 4, 5, 6, 8, 20):
            docs.append([f"new{j}" if j % every == every - 1 else w for j, w in enumerate(item)])
            docs.append([x for j, w in enumerate(item) for x in ([w, "in"] if j % every == every - 1 else [w])])
            docs.append([w for j, w in enumerate(item) if j % every])
        half = len(item) // 2 + 1
        docs += [item[:half], item[-half:], item[: half - 3], item[: len(item) * 24 // 25], item[:5] + ["in"] * (len(item) // 2) + item[5:]]
        docs += [item[k : k + 4] for k in range(0, len(item), 2) for _ in range(parts)]  # parts of it that are frequent
    docs = [[f"x{rng.randrange(50)}" for _ in range(rng.randrange(9))] + d + [f"x{rng.randrange(50)}" for _ in range(rng.randrange(9))] for d in docs]
    seeds = lambda words: {tuple(words[k : k + 3]) for k in range(len(words) - 2)}
    want = {}
    for k, d in enumerate(docs):
        for i, item in items:
            share = brute_score(d, item) / (2 * len(item)) if seeds(d) & seeds(item) else 0
            if share >= threshold:
                want[k, i] = share
    frame = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string").repartition(3)
    got = dc.leaks(frame, spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string"), threshold).collect()
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in got} == want


def test_leaks_equal_exhaustive_alignment(spark):
    """No misses: a pair leaks just if its best alignment over the whole text reaches the threshold and both share a seed."""
    rng = random.Random(31)
    vocabulary = [f"w{i}" for i in range(500)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, words(rng.randrange(6, 40))) for i in range(25)]
    items += [(100 + i, items[i][1]) for i in range(3)]  # equal items under other ids
    docs = []
    for i in range(160):
        text = words(rng.randrange(60))
        if i % 4:
            copy = list(rng.choice(items)[1])
            for _ in range(rng.randrange(len(copy) // 2)):  # edited a little or past recognition
                k = rng.randrange(len(copy))
                copy[k : k + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"] * rng.randrange(2)
            copy = copy[: rng.randrange(len(copy) // 3, len(copy) + 1)]
            at = rng.randrange(len(text) + 1)
            text[at:at] = copy
        docs.append((i, text))
    docs += [docs[5], docs[6]]  # repeated rows are judged row by row
    grams = lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    number = {}
    code = lambda w: np.array([number.setdefault(x, len(number)) for x in w], np.int64)
    want = sorted((d, i) for d, text in docs for i, item in items if grams(text) & grams(item) and dc.align(code(text), code(item))[0] >= 0.5 * 2 * len(item))
    frame = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string").repartition(3)
    got = dc.leaks(frame, spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == want and len(want) > 60
