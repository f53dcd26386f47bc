"""Secret scans: fixed patterns, and runs of characters that a battery of randomness tests singles out.

Everything runs inside the JVM as DataFrame functions. Candidates are maximal runs of base64
characters. For each the encoding is inferred (the smallest alphabet that holds all its characters)
and tested for randomness: chi-squared uniformity over that alphabet, runs above and below the
alphabet's middle, and lag-1 serial correlation. A candidate that no test rejects is set against
ordinary text, by how unlike text its uniformity and its changes of character class are at its
length; those p-values go through Benjamini-Hochberg within classes of length, so that the many
short candidates do not dilute the few long ones. The control needs a histogram of p-values by
length class alone, whose size is fixed.

Defined cases: a null text is empty and has no spans; repeated doc_ids are scanned row by row;
extra columns are left out; an empty table gives an empty result. Positions are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import stored

# The base patterns, with kinds in their order. {24,} and {16,} hold the same matches
# as + with a length limit, as a run of such characters is matched as far as it goes.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST = 6

#: Candidates of the randomness tests have 20 characters or more: of fewer, the tests tell too little.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Alphabets of the inferred encodings, the smallest first.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/"),
    ("base64url", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_"),
    ("mixed", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_"),
)
#: A token is called random only if none of its tests rejects randomness at this level.
REJECT = 0.001
#: Share of false discoveries that is allowed.
FDR = 0.01
#: Of ordinary text: chance that two characters agree, of three, and of a change of character class.
TEXT_PAIR, TEXT_TRIPLE, TEXT_CHANGE = 0.065, 0.0065, 0.02
BLOCK = 256


def running_sum(values: Column) -> Column:
    """Sums of all elements before each one, in two levels, so that long arrays take no quadratic time."""
    zero = F.lit(0).cast("long")
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK))
    )
    add = lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v))
    sums = F.transform(blocks, lambda x: F.aggregate(x, zero, lambda a, v: a + v))
    ahead = F.aggregate(sums, F.array(zero), add)
    inner = F.transform(F.arrays_zip(blocks.alias("x"), ahead.alias("a")), lambda z: F.aggregate(z["x"], F.array(z["a"]), add))
    return F.flatten(F.transform(F.filter(inner, lambda x: x.isNotNull()), lambda x: F.slice(x, 1, F.size(x) - 1)))


def _located(df: DataFrame, pattern: str, name: str) -> DataFrame:
    """Add column name: array of (start, text) of the pattern's matches in column text."""
    df = df.withColumn("_m", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.split("text", pattern, -1)))
    steps = F.transform(F.sequence(F.lit(0), F.size("_m") - 1), lambda i: (F.length(F.get("_p", i)) + F.length(F.get("_m", i))).cast("long"))
    df = df.withColumn("_s", F.when(F.size("_m") > 0, running_sum(steps)))
    at = lambda i: F.struct((F.get("_s", i) + F.length(F.get("_p", i))).cast("long").alias("start"), F.get("_m", i).alias("text"))
    found = F.when(F.size("_m") > 0, F.transform(F.sequence(F.lit(0), F.size("_m") - 1), at))
    none = F.array().cast("array<struct<start:bigint,text:string>>")
    return df.withColumn(name, F.coalesce(found, none)).drop("_m", "_p", "_s")


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (m["start"] + F.length(m["text"])).alias("end")))


def _below(z: Column) -> Column:
    """Normal distribution function, by the logistic approximation."""
    z = F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def tested(df: DataFrame) -> DataFrame:
    """df with a column token, and: encoding, n, p_chi, p_runs, p_serial (against randomness), p_text (against text)."""
    token = F.col("token")
    fits = [F.length(F.translate(token, a, "")) == 0 for _, a in ALPHABETS]
    alphabet, name = F.lit(ALPHABETS[-1][1]), F.lit(ALPHABETS[-1][0])
    for ok, (label, letters) in reversed(list(zip(fits, ALPHABETS))):
        alphabet, name = F.when(ok, F.lit(letters)).otherwise(alphabet), F.when(ok, F.lit(label)).otherwise(name)
    df = df.withColumn("encoding", name).withColumn("_a", alphabet).withColumn("n", F.length(token).cast("double"))
    df = df.withColumn("k", F.length("_a").cast("double"))
    symbols = F.filter(F.split("_a", ""), lambda c: c != "")
    counts = F.transform(symbols, lambda s: F.lit(1.0) * (F.col("n") - F.length(F.replace(token, s, F.lit("")))))
    df = df.withColumn("_sq", F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c))
    df = df.withColumn("_v", F.transform(F.filter(F.split("token", ""), lambda c: c != ""), lambda c: F.position(c, F.col("_a")).cast("double")))
    df = df.withColumn("_mean", F.aggregate("_v", F.lit(0.0), lambda a, v: a + v) / F.col("n"))
    ahead = F.slice("_v", 2, F.size("_v"))
    behind = F.slice("_v", 1, F.size("_v") - 1)
    df = df.withColumn("_var", F.aggregate("_v", F.lit(0.0), lambda a, v: a + (v - F.col("_mean")) * (v - F.col("_mean"))))
    df = df.withColumn("_cov", F.aggregate(F.zip_with(behind, ahead, lambda x, y: (x - F.col("_mean")) * (y - F.col("_mean"))), F.lit(0.0), lambda a, v: a + v))
    half = F.col("k") / 2
    df = df.withColumn("_hi", F.size(F.filter("_v", lambda v: v > half)).cast("double"))
    df = df.withColumn("_runs", 1 + F.aggregate(F.zip_with(behind, ahead, lambda x, y: F.when((x > half) != (y > half), 1.0).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A")
    df = df.withColumn("_changes", (F.length(classes) - 1).cast("double"))
    n, k, hi = F.col("n"), F.col("k"), F.col("_hi")
    chi = F.col("_sq") * k / n - n
    # Wilson and Hilferty: the cube root of chi-squared over its freedom is near normal
    z_chi = (F.pow(chi / (k - 1), F.lit(1 / 3)) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1)))
    mean_runs = 1 + 2 * hi * (n - hi) / n
    var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
    z_runs = F.when(var_runs > 0, F.abs(F.col("_runs") - mean_runs) / F.sqrt(var_runs)).otherwise(F.lit(30.0))
    z_serial = F.when(F.col("_var") > 0, F.abs(F.col("_cov") / F.col("_var") * F.sqrt(n) + 1 / F.sqrt(n))).otherwise(F.lit(30.0))
    text_mean = k - 1 + n * (k * TEXT_PAIR - 1)
    text_dev = F.sqrt(2 * (k - 1) + 4 * n * k * k * (TEXT_TRIPLE - TEXT_PAIR * TEXT_PAIR))
    p_even = F.greatest(_below((chi - text_mean) / text_dev), F.lit(1e-12))
    mu, r = (n - 1) * TEXT_CHANGE, F.col("_changes")
    p_changes = F.when(r > mu, F.exp(-(r * F.log(r / mu) - r + mu))).otherwise(F.lit(1.0))
    both = F.greatest(p_even * F.greatest(p_changes, F.lit(1e-30)), F.lit(1e-40))
    return (
        df.withColumn("p_chi", 1 - _below(z_chi)).withColumn("p_runs", 2 * (1 - _below(z_runs))).withColumn("p_serial", 2 * (1 - _below(z_serial)))
        .withColumn("p_text", F.least(F.lit(1.0), both * (1 - F.log(both))))
    )


def scan(docs: DataFrame, level: float = FDR) -> DataFrame:
    """doc_id, base (array of start, kind number, end), random (the same, of the method) of each row of docs (doc_id, text)."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for pattern, name in ((ASSIGN, "assign"), (ACCESS, "access"), (HEX, "hex"), (CANDIDATE, "candidates")):
        df = _located(df, pattern, name)
    last = F.filter("assign", lambda m: F.length(F.regexp_extract(m["text"], r"\A" + ASSIGN, 2)) >= ASSIGN_LEAST)
    base = F.array_sort(F.concat(_spans(last, "assign"), _spans(F.col("access"), "access"), _spans(F.col("hex"), "hex")))
    df = df.select("doc_id", base.alias("base"), "candidates")
    # one row for each document; its candidates' tests are added to it as an array, so nothing is grouped
    df = stored(df.withColumn("row", F.monotonically_increasing_id()), "secret-candidates")
    each = df.where(F.size("candidates") > 0).select("row", F.explode("candidates").alias("c")).select("row", F.col("c.start").alias("start"), F.col("c.text").alias("token"))
    each = tested(each).select(
        "row", "start", (F.col("start") + F.length("token")).alias("end"), F.floor(F.log2("n")).cast("int").alias("class"),
        F.floor(-10 * F.log10("p_text")).cast("int").alias("strength"), (F.least("p_chi", "p_runs", "p_serial") >= REJECT).alias("random"),
    )
    each = stored(each, "secret-tests")
    tally = each.groupBy("class", "strength").agg(F.count("*").alias("all"), F.count_if("random").alias("n"))
    by_class = Window.partitionBy("class")
    stronger = by_class.orderBy(F.col("strength").desc())
    tally = tally.withColumn("m", F.sum("all").over(by_class)).withColumn("found", F.sum("n").over(stronger))
    limit = tally.where((F.col("found") > 0) & (F.pow(F.lit(10.0), -F.col("strength") / 10) <= level * F.col("found") / F.col("m")))
    limit = limit.groupBy(F.col("class").alias("l_class")).agg(F.min("strength").alias("least"))
    kept = each.where("random").join(F.broadcast(limit), (F.col("class") == F.col("l_class")) & (F.col("strength") >= F.col("least")))
    kept = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(KINDS.index("random")).alias("kind"), "end"))).alias("random"))
    return df.drop("candidates").join(kept, "row", "left").drop("row").withColumn("random", F.coalesce("random", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """The scan's spans as strings kind:start:end, with counts and a digest of the base ones."""
    df = scan(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return df.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "random"))).alias("spans"),
    )
