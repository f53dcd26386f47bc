import random
import re

import pytest

from inkwell.llm import sentence_spans

CLAUSES = ".!?,;:"
SCHEMA = "doc_id long, text string, s_hash string"


def brute(rows, least_words=20, least=2):
    """Removed sentences and kept text of each row, from plain dictionaries."""
    cut = []
    for doc, text in rows:
        units, begin, words, k, text = [], None, [], 0, text or ""
        import re

        found = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
        for j, m in enumerate(found):
            if begin is None:
                begin = m.start()
            words.append(re.sub("[A-Z]", lambda x: x[0].lower(), m[0]))
            gap = text[m.end() : found[j + 1].start()] if j + 1 < len(found) else "\n"
            if m[0][-1] in ".!?,;:" or "\n" in gap:
                units.append((begin, found[j + 1].start() if j + 1 < len(found) else len(text), words))
                begin, words = None, []
        spans = []
        for i in range(len(units)):
            for j in range(i + least, len(units) + 1):
                seq = [w for u in units[i:j] for w in u[2]]
                if len(seq) >= least_words:
                    spans.append((i, j, tuple(seq)))
                    break
        cut.append((units, spans))
    low = {}
    for (doc, _), (_, spans) in zip(rows, cut):
        for _, _, seq in spans:
            d = doc if doc is not None else 1 << 62
            low[seq] = min(low.get(seq, d), d)
    out = []
    for (doc, text), (units, spans) in zip(rows, cut):
        seen, gone = set(), set()
        for i, j, seq in spans:
            if seq in seen or low[seq] != (doc if doc is not None else 1 << 62):
                gone |= set(range(i, j))
            seen.add(seq)
        kept, at = "", 0
        for i in sorted(gone):
            kept += text[at : units[i][0]]
            at = units[i][1]
        out.append((doc, len(units), len(gone), None if text is None else kept + text[at:]))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(1, 15))).capitalize() + rng.choice([".", ",", "!\n", "\n", ".  "])
    shared = [" ".join(sentence() for _ in range(6)) for _ in range(5)]
    rows = [(i // 2, " ".join(rng.choice([rng.choice(shared), sentence(), sentence()]) for _ in range(rng.randrange(12)))) for i in range(120)]
    rows += [(None, shared[0]), (900, None), (901, ""), (902, " \n "), (903, "word " * 20000), (904, shared[1] * 300)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(4)
    got = sentence_spans.dedup(docs, least_words=20, least_sentences=2, every_run=False, stops=CLAUSES).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["span_sentences"], r["span_removed"], r["text"]) for r in got), key=key) == sorted(brute(rows), key=key)
    assert docs.columns == got[0].__fields__[:3]


def test_empty_table(spark):
    assert sentence_spans.dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def brute_runs(rows, least_words=20, least=2, marks=CLAUSES):
    """Removed sentences of each row, from all runs of consecutive sentences with least_words words."""
    cut = []
    for doc, text in rows:
        units = [u.split() for u in re.split(rf"(?<=[{marks}\n])\s+", text.strip()) if u.split()]
        ends = [(i, j) for i in range(len(units)) for j in range(i + least, len(units) + 1)]
        cut.append([(i, j, run) for i, j in ends if len(run := tuple(w.lower() for u in units[i:j] for w in u)) >= least_words])
    low = {}
    for (doc, _), runs in zip(rows, cut):
        for _, _, run in runs:
            low[run] = min(low.get(run, doc), doc)
    out = {}
    for (doc, _), runs in zip(rows, cut):
        seen, gone = set(), set()
        for i, j, run in runs:
            if run in seen or low[run] != doc:
                gone |= set(range(i, j))
            seen.add(run)
        out[doc] = len(gone)
    return out


def test_every_repeated_run_is_covered(spark):
    rng = random.Random(5)
    new = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(8)) for _ in range(n)) + rng.choice(".,;")
    shared = [[new(rng.choice([1, 3, 6, 12])) for _ in range(rng.randrange(2, 9))] for _ in range(30)]
    shared.append([new(12), new(12), new(3)])
    rows = [(0, " ".join([new(9), *shared[-1], new(9)])), (1, " ".join([new(30), *shared[-1], new(40)]))]
    for i in range(2, 90):
        units = []
        for _ in range(rng.randrange(6)):
            run = rng.choice(shared)
            a = rng.randrange(len(run))
            units += rng.choice([run, run[a:], run[: a + 1], [new(4)], [new(15), new(2)]])
        rows.append((i, " ".join(units)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["span_removed"] for r in sentence_spans.dedup(docs, least_words=20, least_sentences=2, stops=CLAUSES).collect()}
    want = brute_runs(rows)
    assert got == want and want[1] == 3
    assert sum(r["span_removed"] for r in sentence_spans.dedup(docs, least_words=20, least_sentences=2, every_run=False, stops=CLAUSES).collect()) < sum(want.values())  # spans by start alone miss some


def test_query_covers_every_run(spark, tmp_path):
    from inkwell.llm.queries import op8_sentence_spans

    words = lambda k, n: " ".join(f"{k}w{i}" for i in range(n)) + "."
    run = [words("a", 12), words("b", 12), words("c", 3)]
    rows = [(i, " ".join([words(f"x{i}", 9), *run, words(f"y{i}", 9)])) for i in range(2)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in op8_sentence_spans(spark, str(tmp_path)).collect()}
    assert got == {0: (0, rows[0][1]), 1: (3, words("x1", 9) + " " + words("y1", 9))}


def test_copies_and_passages_without_stops_go(spark):
    rng = random.Random(8)
    words = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    texts, want = [], {}
    for n in (20, 21, 25, 50, 51, 300):  # copies of a text that is a single sentence
        text = " ".join(words(n))
        want[len(texts) + 1] = (n, n)
        texts += [text, text]
    for n in (50, 60, 200):  # passages within one; up to 15 words stay at each edge
        for _ in range(20):
            passage = words(n)
            want[len(texts) + 1] = (n - 30, n)
            texts += [" ".join(words(rng.randrange(40)) + passage + words(rng.randrange(40))) for _ in range(2)]
    texts += [" ".join(words(19))] * 2 + ["word " * 30]
    got = {r["doc_id"]: r for r in sentence_spans.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts[:-1]):
        gone = len(text.split()) - len(got[i]["text"].split())
        low, high = want.get(i, (0, 0))
        assert low <= gone <= high
        other = set(texts[i - 1].split())
        assert not i or i not in want or set(text.split()) - other <= set(got[i]["text"].split())


@pytest.mark.parametrize("least", [2, 3, 4])
def test_all_runs_of_several_sentences(spark, least):
    rng = random.Random(15)
    new = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(8)) for _ in range(n)) + rng.choice([".", "!", ", and so.", "; it is?"])
    shared = [[new(rng.choice([1, 2, 4, 9])) for _ in range(rng.randrange(1, 9))] for _ in range(40)]
    rows = []
    for i in range(120):
        units = []
        for _ in range(rng.randrange(6)):
            run = rng.choice(shared)
            a = rng.randrange(len(run))
            units += rng.choice([run, run[a:], run[: a + 1], [new(4)], [new(15), new(2)]])
        rows.append((i, " ".join(units)))
    got = {r["doc_id"]: r["span_removed"] for r in sentence_spans.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), least_sentences=least).collect()}
    assert got == brute_runs(rows, 0, least, ".!?") and sum(got.values()) > 100


def test_a_short_passage_goes(spark):
    rows = [(1, "My own start here. This is it. We say it twice. Now it ends."), (2, "Another one begins. This is it. We say it twice. Now it ends. And more."), (3, "This is it. Alone, though.")]
    got = {r["doc_id"]: r["text"] for r in sentence_spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "Another one begins. And more.", 3: rows[2][1]}


def test_stops_of_other_scripts(spark):
    rows = [(i, f"{i}x 这是第一句。 第二句在这里！ これは三番目です？ 最後の文です。 {i}y") for i in range(2)]
    got = {r["doc_id"]: r["span_removed"] for r in sentence_spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 3}


def test_clashing_columns_repeated_rows_and_long_texts(spark):
    long = " ".join(f"Word{i} stands here." for i in range(40_000))
    rows = [(1, long, "a", 5, None), (2, long, "b", 6, None), (None, None, "c", 7, None), (3, "One. Two.", "d", 8, None), (3, "One. Two.", "e", 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, span_cuts string, span_removed int, s_hash string")
    got = sentence_spans.dedup(docs).collect()
    assert sorted(got[0].asDict()) == ["doc_id", "s_hash", "span_cuts", "span_removed", "span_sentences", "text"]
    assert sorted((str(r["doc_id"]), r["span_removed"], r["text"] if r["text"] is None else len(r["text"])) for r in got) == [("1", 0, len(long)), ("2", 40_000, 0), ("3", 0, 9), ("3", 0, 9), ("None", 0, None)]
