import random
import re

import numpy as np
import pytest

from inkwell.llm import jaccard_join


def brute(rows, words=4, percent=85):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set())
    root, degree = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                degree[i] += 1
                degree[j] += 1
                root[find(i)] = find(j)
    big = 1 << 63
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), big), big if doc is None else doc)
    return [(doc, len(sets[i]), None if least[find(i)] == big else least[find(i)], degree[i]) for i, (doc, _) in enumerate(rows)]


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 8, 12, 30, 90, 200]))] for _ in range(40)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    out = []
    for _ in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            k = rng.randrange(len(words))
            words[k : k + rng.randrange(2)] = [rng.choice(vocabulary) for _ in range(rng.randrange(3))]
            if not words:
                words = ["x"]
        if rng.random() < 0.3:
            words += passage
        out.append(" ".join(w.upper() if rng.random() < 0.05 else w for w in words))
    ids = rng.sample(range(1000), n)
    rows = list(zip(ids, out))
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (None, out[0]), (None, "all alone here"), (ids[3], out[5]), (ids[4], out[4]), (3000, "long " * 30000)]


@pytest.mark.parametrize("words,percent,block,part", [(4, 85, 400_000, 512), (5, 80, 400_000, 512), (4, 85, 700, 512), (4, 85, 400_000, 3)])
def test_join_matches_brute_force(spark, monkeypatch, words, percent, block, part):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(jaccard_join, "PART_SETS", part)
    rows = corpus(words * block % 97)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class string").repartition(5)
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r) for r in jaccard_join.join(docs, words, percent).collect()), key=key)
    assert got == sorted(brute(rows, words, percent), key=key)


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_linked_sets_share_an_index_list(percent):
    rng = np.random.default_rng(percent)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        common = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
        extra = [rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 4)), np.uint64) for _ in range(2)]
        a, b = (np.unique(np.concatenate([common, e])) for e in extra)
        if jaccard_join.linked(len(a), len(b), len(np.intersect1d(a, b)), percent) and not np.array_equal(a, b):
            row, sig = jaccard_join.signatures([a, b], percent)
            assert set(sig[row == 0]) & set(sig[row == 1])


def test_dedup_keeps_one_of_each_group(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string")
    kept = jaccard_join.dedup(docs).collect()
    labels = brute(rows, 5, 80)
    # one row for each component; a row without links is one of its own
    want = sorted(str(c) for c, _ in {(label[2], -1 if label[3] else i) for i, label in enumerate(labels)})
    by_row = {(r[0], r[1]): label[2] for r, label in zip(rows, labels)}
    assert sorted(str(by_row[r["doc_id"], r["text"]]) for r in kept) == want
    assert all(r["doc_id"] == by_row[r["doc_id"], r["text"]] for r in kept)


def test_empty_table(spark):
    assert jaccard_join.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def near_copies(clusters, each, words=120, edits=3, seed=1):
    """Shingle sets of random texts with a few words changed, those of all clusters in turn."""
    rng = random.Random(seed)
    bases = [[f"c{c}w{rng.randrange(10**6)}" for _ in range(words)] for c in range(clusters)]
    out = []
    for k in range(clusters * each):
        text = list(bases[k % clusters])
        for _ in range(edits):
            text[rng.randrange(words)] = f"e{rng.randrange(10**9)}"
        out.append(" ".join(text))
    return out


def sets_of(texts, words=4):
    import pyarrow as pa

    from inkwell.llm.common import buffers, shingle_sets

    return [jaccard_join.unpacked(jaccard_join.packed(s)) for s in shingle_sets(*buffers(pa.array(texts)), words)]


def test_near_copies_are_derived_and_blocks_skipped():
    sets = sets_of(near_copies(8, 100))
    group = jaccard_join.Group(sets, 85)
    got = {(max(i, j), min(i, j)) for i, found in group.links() for j in found.tolist()}
    have = [set(s.tolist()) for s in sets]
    assert got == {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(have[i] & have[j]) >= 85 * len(have[i] | have[j])}
    assert group.counted <= 16 and group.derived > 0.9 * len(sets)
    assert group.skipped > group.read  # blocks of other clusters stay unread


def test_sets_of_many_sizes_skip_by_size():
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(0, 1 << 48, 4000, np.uint64))
    sets = [np.sort(rng.choice(pool, int(n), replace=False)) for n in rng.integers(1, 900, 700)]
    sets += [np.sort(rng.choice(s, max(1, int(len(s) * 0.93)), replace=False)) for s in sets[::3]]
    group = jaccard_join.Group(sets, 85)
    got = {frozenset((i, j)) for i, found in group.links() for j in found.tolist()}
    want = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if jaccard_join.linked(len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j], assume_unique=True)), 85)}
    assert got == want and group.skipped > 2 * group.read


def test_pairs_met_before_are_left_out():
    sets = sets_of(near_copies(1, 40))
    rng = random.Random(3)
    before = [np.array(sorted(rng.sample(range(200), rng.randrange(6))), np.int64) for _ in sets]
    _, _, degree = jaccard_join.compared(sets, None, np.ones(40, np.int64), before, 85)
    have, want = [set(s.tolist()) for s in sets], [0] * 40
    for i in range(40):
        for j in range(40):
            if i != j and 100 * len(have[i] & have[j]) >= 85 * len(have[i] | have[j]) and not set(before[i].tolist()) & set(before[j].tolist()):
                want[i] += 1
    assert degree.tolist() == want


def test_sets_sent_grow_with_the_copies(spark, monkeypatch):
    sent = {}
    plain = jaccard_join.stored

    def watched(df, name, *rest):
        out = plain(df, name, *rest)
        if name == "jaccard-places":
            sent["n"] = out.selectExpr("sum(size(to)) AS n").first()["n"]
        return out

    monkeypatch.setattr(jaccard_join, "stored", watched)
    each = []
    for n in (250, 500, 1000):
        docs = spark.createDataFrame(list(enumerate(near_copies(1, n, words=300, edits=2))), "doc_id long, text string")
        rows = jaccard_join.join(docs).collect()
        assert {r["component_id"] for r in rows} == {0}
        each.append(sent["n"] / n)
    assert each[2] < 1.5 * each[0]


def test_very_long_texts_and_a_large_group_of_copies(spark):
    long = near_copies(1, 3, words=40_000, edits=20, seed=9)
    texts = long + near_copies(2, 300, words=150, edits=1, seed=10) + ["the same line again and again"] * 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard_join.join(docs).collect()}
    assert all(got[i] == (0, 2) for i in range(3))
    assert {got[i][0] for i in range(3, 603)} == {3, 4} and all(got[i] == (603, 199) for i in range(603, 803))
    assert jaccard_join.dedup(docs, 4, 85).count() == 4
