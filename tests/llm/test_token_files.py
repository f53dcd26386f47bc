import glob
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.orc as orc
from tokenizers import Tokenizer

from inkwell.llm import token_files
from inkwell.llm.common import buffers, fresh_path


def plain(texts):
    t = Tokenizer.from_file(token_files.vocabulary_path())
    t.encode_special_tokens = True
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def texts():
    rng = random.Random(11)
    bits = ["a", "the", " ", "  ", "\n", "\t", "é", "😀", "don't", "42", "$$$", ".", " ", " ", "\x1f", "<|endoftext|>", "ſ", "word" * 30, "'s", "\x85", "\r\n"]
    return ["", " ", "\n ", "one", "x" * 20000, *("".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(30))) for _ in range(600))]


def test_encoder_equals_the_library(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 500)
    enc, data = token_files.Encoder(token_files.vocabulary_path()), texts()
    got = []
    for lo in range(0, len(data), 100):
        ids, ends = enc.encode(*buffers(pa.array(data[lo : lo + 100])))
        got += [x.tolist() for x in np.split(ids, ends[:-1])]
    assert got == plain(data)


def test_files_round_trip(spark):
    rows = [(i // 2 * 7 % 101, t, "x") for i, t in enumerate(texts())] + [(None, "late"), (5000, None)]
    rows = [(*r, "x")[:3] for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(6)
    path = fresh_path(spark, "token-test")
    token_files.write(docs, path)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    ids = plain([r[1] for r in order])
    want, start = [], 0
    for r, x in zip(order, ids):
        want.append((r[0], start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    got = [tuple(r) for r in token_files.report(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    files = sorted(glob.glob(path.removeprefix("file://") + "/*.orc"))
    assert [x for f in files for x in orc.read_table(f)["ids"].to_pylist()] == ids
    found = token_files.read(spark, path).where("doc_id = 5000").collect()
    assert [r["ids"] for r in found] == [[0]]


def test_empty_table(spark):
    assert token_files.write_and_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def rows_read(df):
    """Rows that the file scan of a collected query gave."""
    def scans(plan):
        if plan.nodeName().startswith("Scan"):
            yield plan
        for k in range(plan.children().size()):
            yield from scans(plan.children().apply(k))

    return sum(p.metrics().apply("numOutputRows").value() for p in scans(df._jdf.queryExecution().executedPlan()))


def test_lookup_skips_row_groups(spark):
    path = fresh_path(spark, "token-lookup")
    docs = spark.range(40_000).selectExpr("id * 3 AS doc_id", "concat('text ', id) AS text")
    token_files.write(docs, path)
    some = token_files.lookup(spark, path, [300, 90_000, 7])
    assert sorted(r["doc_id"] for r in some.collect()) == [300, 90_000]
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()
    assert 0 < rows_read(some) <= 4_000  # row groups of 1,000 rows
    inside = token_files.lookup(spark, path, [301])  # between two ids: only the Bloom filters can tell
    assert inside.collect() == [] and rows_read(inside) <= 1_000


def test_many_rows_of_one_id_are_dealt_out(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, f"{i % 97} text {i}") for i in range(4000)], "doc_id long, text string")
    path = fresh_path(spark, "token-hot")
    token_files.write(docs, path)
    parts = [r["count"] for r in token_files.read(spark, path).groupBy("part").count().collect()]
    assert max(parts) < 2000
