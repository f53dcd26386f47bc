import hashlib
import random

from inkwell.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        share = left / max(sum(weight[s] for s in names if s not in capped), 1)
        over = {s for s in names if s not in capped and weight[s] * share > cap * sizes[s] + 1e-9}
        if not over:
            return {s: cap * sizes[s] if s in capped else weight[s] * share for s in names}
        capped |= over


def corpus():
    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(60))), rng.choice(["a", "b", "b", "b", "b", "c", "é", "z9", None])) for i in rng.sample(range(10000), 400)]
    return rows + [(1, None, "a"), (1, "again and again", "a"), (None, "one two", "b"), (None, "one two", "b"), (70000, "", "empty"), (70001, "only one here", "tiny")]


def test_plan_meets_targets_and_order(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = [r.asDict() for r in mixing.plan(docs.repartition(5)).collect()]
    again = [r.asDict() for r in mixing.plan(docs.repartition(2)).collect()]
    key = lambda r: str([r[k] for k in ("doc_id", "source", "size", "taken")])
    assert sorted(map(key, got)) == sorted(map(key, again))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    for s, size in sizes.items():
        mine = sorted((r for r in got if r["source"] == s), key=lambda r: (hashlib.md5(str(r["doc_id"] if r["doc_id"] is not None else "").encode()).hexdigest(), r["doc_id"] or 0, r["size"]))
        assert {r["source_size"] for r in mine} == {size}
        assert all(abs(r["target"] - want[s]) < 1e-6 for r in mine)
        budget = int(mine[0]["target"])
        assert sum(r["taken"] for r in mine) == (budget if size else 0)
        rest, whole = (budget % size, budget // size) if size else (0, 0)
        for r in mine:
            part = min(rest, r["size"])
            assert r["taken"] == whole * r["size"] + part <= 3 * r["size"]
            rest -= part


def test_mix_repeats_rows_and_keeps_columns(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, source string, key string")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    got = out.collect()
    sizes, taken = {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + len((r["text"] or "").split())
    for s, target in brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - target) <= 60
    assert mixing.mix(docs.limit(0)).collect() == []
