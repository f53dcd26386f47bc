import hashlib
import random

import pytest

from inkwell.llm import suffix_dedup


def test_suffix_order_matches_plain_sort():
    rng = random.Random(1)
    for _ in range(1500):
        text = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(40))] * rng.choice([1, 1, 1, 4])
        assert suffix_dedup.suffix_order(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute(rows, length=50):
    least = {}
    for doc, text in rows:
        raw, doc = (text or "").encode(), 1 << 63 if doc is None else doc
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            least[w] = min(least.get(w, doc), doc)
    out = []
    for doc, text in rows:
        raw, key = (text or "").encode(), 1 << 63 if doc is None else doc
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if least[raw[i : i + length]] < key:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 8)))
    passages = [" ".join(word() for _ in range(rng.randrange(5, 40))) for _ in range(12)]
    rows = []
    for i in rng.sample(range(5000), 150):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randrange(20))) for _ in range(rng.randrange(7))]
        text = " ".join(parts)
        if rng.random() < 0.3 and text:
            k = rng.randrange(len(text))
            text = text[:k] + word() + text[k + rng.randrange(4) :]
        rows.append((i, text))
    rows += [(7000 + i, rows[i][1]) for i in range(20)] + [(-3, rows[2][1]), (rows[5][0], rows[6][1]), (rows[7][0], rows[7][1])]
    return rows + [(None, rows[9][1]), (None, None), (9000, None), (9001, ""), (9002, "a" * 3000), (9003, "a" * 49), (9004, "a" * 50), (9005, "ab" * 900), (9006, passages[0] * 60)]


@pytest.mark.parametrize("seed,block", [(1, 60_000), (2, 300)])
def test_report_matches_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, mark string").repartition(4)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in suffix_dedup.report(docs).collect()), key=key) == sorted(brute(rows), key=key)


def test_long_text_is_cut_without_loss(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    raw = rng.integers(97, 101, 5000).astype(np.uint8)
    whole = suffix_dedup.runs(raw)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    cut = suffix_dedup.runs(raw)
    windows = lambda r: {(h, p) for h, a, b in zip(r[0].tolist(), r[2].tolist(), r[3].tolist()) for p in range(a, b - 49)}
    assert windows(whole) == windows(cut)


def test_empty_table(spark):
    assert suffix_dedup.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_lengths_that_a_run_cannot_hold_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for length in (0, 161, 1000):
        with pytest.raises(ValueError, match="length must be"):
            suffix_dedup.spans(docs, length)
