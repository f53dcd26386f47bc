import hashlib
import random
import re
import string

import pytest

from inkwell.llm import secret_scan

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def texts():
    rng = random.Random(5)
    words = ["token", "secret:", "Password = ", "api_key='", "APIKEY=", "abc", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "\n", '"', " ", "=", "token=token=abcdef", "tokenabc=xyzzyx1", "ſecret=abcdefgh", "😀"]
    out = ["".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(300)]
    return [None, "", "password: token : abcdefgh", "x" * 5000, "secret=abcdef " * 1500, *out]


def test_base_spans_match_brute_force(spark):
    rows = [(i % 50, t, "x") for i, t in enumerate(texts())]
    got = secret_scan.report(spark.createDataFrame(rows, "doc_id long, text string, base string").repartition(3)).collect()
    want = []
    for i, t, _ in rows:
        spans = brute(t or "")
        digest = hashlib.sha256(",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
        want.append((i, *(sum(s[1] == k for s in spans) for k in range(3)), digest))
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)


def test_method_finds_random_strings_and_leaves_words(spark):
    rng = random.Random(1)
    letters = string.ascii_letters + string.digits + "+/"
    rows = [(i, "the value " + "".join(rng.choice(letters) for _ in range(48)) + " ends here") for i in range(40)]
    rows += [(100 + i, "thewordsofthisareordinaryenoughtokeep " + "under_scores_and_words_in_a_long_name " + "a" * 60) for i in range(40)]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("random:10:58" in got[i] for i in range(40)) >= 36
    assert all("random" not in got[100 + i] for i in range(40))


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_sum(spark, n):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(list(range(1, n + 1)),)], "v array<bigint>")
    want = [sum(range(1, i + 1)) for i in range(n)]
    got = df.select(F.when(F.size("v") > 0, secret_scan.running_sum(F.col("v"))).alias("s")).first()["s"]
    assert (got or []) == want


def test_empty_table(spark):
    assert secret_scan.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
