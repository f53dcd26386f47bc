"""Terms of page texts: extraction, counts, ranks, rolling pages and the context that they make.

Bubbles are rows (page, bubble, text) with page and bubble as ordinals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import exprs, tables
from inkwell.sources.storage import stored

STOP_WORDS = tables.STOP_WORDS_JA + tables.STOP_WORDS_KO + tables.STOP_WORDS_ZH
LEAST_LENGTH = 2


def hits(bubbles: DataFrame, *keep: str) -> DataFrame:
    """One row for each term seen: (page, bubble, phase, pos, term) and the columns in keep.

    Phases 0 to 3 are the name patterns, 4 the words; a term is counted by each that sees it.
    """
    text = F.col("text")
    phases = [
        exprs.named_before(text, tables.HONORIFICS_JA),
        exprs.named_before(text, tables.HONORIFICS_KO),
        exprs.named_before(text, tables.TITLES_ZH),
        exprs.capitalised(text),
        F.filter(exprs.tokens(text), lambda w: ~w.isin(STOP_WORDS)),
    ]
    # names before an ending are looked for only where a text holds such an ending
    for k, endings in enumerate((tables.HONORIFICS_JA, tables.HONORIFICS_KO, tables.TITLES_ZH)):
        phases[k] = F.when(text.rlike("|".join(endings)), phases[k]).otherwise(F.array().cast("array<string>"))
    tagged = lambda k: lambda w, i: F.struct(F.lit(k).alias("phase"), i.alias("pos"), w.alias("term"))
    listed = F.flatten(F.array(*[F.transform(p, tagged(k)) for k, p in enumerate(phases)]))
    rows = bubbles.where("text is not null and text <> ''").select("page", "bubble", *keep, F.explode(listed).alias("h"))
    return rows.select("page", "bubble", *keep, "h.phase", "h.pos", "h.term").where(F.length("term") >= LEAST_LENGTH)


def counts(seen: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """(term, n, first_seen): how often each term was seen; a manual term (term, at) counts five times."""
    place = F.struct(*[F.col(c).cast("long") for c in ("page", "bubble", "phase", "pos")])
    rows = seen.select("term", F.lit(1).alias("weight"), place.alias("at"))
    if manual is not None:
        rows = rows.union(manual.select("term", F.lit(5), F.struct(*[F.col("at").cast("long").alias(c) for c in ("page", "bubble", "phase", "pos")])))
    return rows.groupBy("term").agg(F.sum("weight").alias("n"), F.min("at").alias("first_seen"))


def top(counted: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent terms with their rank; ties by first sight."""
    best = counted.orderBy(F.col("n").desc(), "first_seen").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "first_seen")))


def recent(pages: DataFrame, k: int = 5) -> DataFrame:
    """The last k pages by page."""
    return pages.orderBy(F.col("page").desc()).limit(k)


def summary(translated: DataFrame, pages: int = 3) -> DataFrame:
    """One row: the first three lines of more than ten characters of the last pages, or an empty text."""
    last = recent(translated.select("page").distinct(), pages)
    lines = translated.join(F.broadcast(last), "page").where(F.length("text") > 10)
    first = lines.orderBy("page", "bubble").limit(3)
    ordered = F.array_sort(F.collect_list(F.struct("page", "bubble", "text")))
    joined = F.array_join(F.transform(ordered, lambda x: x["text"]), " | ")
    return first.agg(F.when(F.count("*") > 0, F.concat(joined, F.lit("..."))).otherwise("").alias("summary"))


def context_prompt(ranked: DataFrame, story: DataFrame, known: DataFrame, names: DataFrame) -> DataFrame:
    """One row: the context for the next batch, from ranked terms, the summary, and the tables known (term, translated) and names (term, translated, seq)."""
    line = lambda a, b: F.concat(F.lit("  "), a, F.lit(" → "), b, F.lit("\n"))
    people = names.orderBy("seq").limit(15).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "term", "translated"))), lambda x: line(x["term"], x["translated"])), "").alias("people"))
    known = known.select(F.col("term").alias("k_term"), F.col("translated").alias("k_translated"))
    frequent = ranked.where("n >= 2").orderBy("rank").limit(15).join(known, F.col("term") == F.col("k_term"), "left")
    shown = F.when(F.col("k_term").isNotNull(), line(F.col("term"), F.col("k_translated"))).otherwise(F.concat(F.lit("  "), F.col("term"), F.lit(" (×"), F.col("n").cast("string"), F.lit(")\n")))
    terms = frequent.select("rank", shown.alias("shown")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "shown"))), lambda x: x["shown"]), "").alias("terms"))
    all_ = people.crossJoin(terms).crossJoin(story)  # three tables of one row
    part = lambda title, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(title), body)).otherwise("")
    body = F.concat(
        part(tables.CONTEXT_NAMES, F.col("people")), part(tables.CONTEXT_TERMS, F.col("terms")),
        part(tables.CONTEXT_STORY, F.when(F.col("summary") != "", F.concat("summary", F.lit("\n")))),
    )
    return all_.select(F.when(body == "", "").otherwise(F.concat(F.lit(tables.CONTEXT_OPEN), body, F.lit(tables.CONTEXT_CLOSE))).alias("prompt"))


def extracted(answers: DataFrame) -> DataFrame:
    """Terms that answers (id, raw) list between [TERMS] and [/TERMS]: (id, term, translated); of a term the last line counts."""
    section = F.regexp_extract("raw", r"(?s)\[TERMS\](.*?)\[/TERMS\]", 1)
    lines = answers.select("id", F.posexplode(F.split(exprs.strip(section), "\n")).alias("pos", "line")).where(F.col("line").contains("→"))
    at = F.instr("line", "→")
    rows = lines.select("id", "pos", exprs.strip(F.substring("line", F.lit(1), at - 1)).alias("term"), exprs.strip(F.substring("line", at + 1, F.length("line"))).alias("translated"))
    rows = rows.where("term <> '' and translated <> ''")
    return rows.groupBy("id", "term").agg(F.max_by("translated", "pos").alias("translated"))


def counted_hits(originals: DataFrame, translations: DataFrame) -> DataFrame:
    """hits of the texts that may teach terms: those of pages whose two sides (page, texts) are of equal length, with both texts there."""
    from inkwell.operators.alignment import pairs_for_terms

    return hits(pairs_for_terms(originals, translations))


def batches(pages: DataFrame, size: int = 10) -> DataFrame:
    """pages with their number among pages that have text, and their batch. pages: one row a page.

    The numbers come from counts of ranges, so no task sees all pages. The ranges are written once: each
    use of an exchange by range would draw its own bounds.
    """
    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(pages.repartitionByRange(n, "page").withColumn("_part", F.spark_partition_id()), "page-ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    number = F.col("_ahead") + F.row_number().over(Window.partitionBy("_part").orderBy("page")) - 1
    placed = ranged.join(F.broadcast(ahead), F.col("_part") == F.col("_p")).withColumn("number", number)  # a row for each partition
    return placed.withColumn("batch", F.floor(F.col("number") / size)).drop("_part", "_p", "_ahead")


def carried(seen: DataFrame) -> DataFrame:
    """What each batch's prompt may use, as stretches: (term, n, from_batch, until_batch). seen has a column batch.

    A term has the count n over all batches before, in each batch from from_batch to until_batch (null: all that follow).
    There is one row for each batch that a term occurs in, however many batches there are.
    """
    each = seen.groupBy("batch", "term").agg(F.count("*").alias("m"))
    by_term = Window.partitionBy("term").orderBy("batch")
    return each.select("term", F.sum("m").over(by_term).alias("n"), (F.col("batch") + 1).alias("from_batch"), F.lead("batch").over(by_term).alias("until_batch"))


def state_before(stretches: DataFrame, batches_: DataFrame) -> DataFrame:
    """(batch, term, n) of the batches asked for (a table of few batches), from the stretches that `carried` gives."""
    asked = F.broadcast(batches_.select("batch").distinct())
    held = (F.col("from_batch") <= F.col("batch")) & (F.col("until_batch").isNull() | (F.col("batch") <= F.col("until_batch")))
    return stretches.join(asked, held).select("batch", "term", "n")


def batch_contexts(stretches: DataFrame, batches_: DataFrame, k: int = 20, shown: int = 15) -> DataFrame:
    """(batch, prompt) of the batches asked for: the terms that the batches before had, the most frequent first."""
    rank = F.struct((-F.col("n")).alias("minus_n"), "term")
    best = F.slice(F.array_sort(F.collect_list(rank)), 1, k)
    listed = F.slice(F.filter(best, lambda x: x["minus_n"] <= -2), 1, shown)
    lines = F.array_join(F.transform(listed, lambda x: F.concat(F.lit("  "), x["term"], F.lit(" (×"), (-x["minus_n"]).cast("string"), F.lit(")\n"))), "")
    # only terms that can be among the first k of a batch are gathered: at most k rows a batch
    place = F.row_number().over(Window.partitionBy("batch").orderBy(F.col("n").desc(), "term"))
    few = state_before(stretches, batches_).withColumn("place", place).where(F.col("place") <= k)
    made = few.groupBy("batch").agg(lines.alias("body"))
    text = F.when(F.coalesce("body", F.lit("")) == "", "").otherwise(F.concat(F.lit(tables.CONTEXT_OPEN + tables.CONTEXT_TERMS), "body", F.lit(tables.CONTEXT_CLOSE)))
    return batches_.select("batch").distinct().join(made, "batch", "left").select("batch", text.alias("prompt"))


def recent_before(pages: DataFrame, k: int = 5) -> DataFrame:
    """The rolling view of each batch: the last k pages up to its end, oldest first, as records (page, original, translated).

    pages: (batch, number, page, original, translated) with number dense in page order; a batch of the result gathers k rows.
    """
    ends = pages.groupBy("batch").agg(F.max("number").alias("end"))
    wanted = ends.select(F.col("batch").alias("view"), F.explode(F.sequence(F.greatest(F.col("end") - k + 1, F.lit(0)), F.col("end"))).alias("number"))
    record = F.struct("number", "page", "original", "translated")
    views = wanted.join(pages.drop("batch"), "number").groupBy(F.col("view").alias("batch")).agg(F.array_sort(F.collect_list(record)).alias("records"))
    return views.select("batch", F.transform("records", lambda x: F.struct(x["page"].alias("page"), x["original"].alias("original"), x["translated"].alias("translated"))).alias("recent"))


def session_stats(seen: DataFrame, pages: DataFrame, story: DataFrame, known: int = 0, names: int = 0) -> DataFrame:
    """One row of figures: terms known, names, distinct terms tracked, recent pages, whether there is a summary."""
    a = seen.agg(F.countDistinct("term").alias("tracked_words"))
    b = recent(pages.select("page").distinct()).agg(F.count("*").alias("recent_pages"))
    return a.crossJoin(b).crossJoin(story).select(F.lit(known).alias("terms"), F.lit(names).alias("names"), "tracked_words", "recent_pages", (F.col("summary") != "").alias("has_summary"))


def is_term(word: Column) -> Column:
    return (F.length(word) >= LEAST_LENGTH) & ~word.isin(STOP_WORDS)
