"""Mixing sources to target weights: hash-random keys, a range sort within each source, distributed
prefix sums of sizes, and an exact cut at each source's budget, with repeated epochs.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of its own,
last in order; repeated doc_ids are separate rows, ordered by (key, doc_id, text hash), and equal
rows are interchangeable; an empty table gives an empty result; extra columns are left out of the
report, and `mix` keeps the columns of its input as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import partitions, small_side, stored, word_count

WEIGHTS = (5, 2, 1)
CAP = 3


def random_key(doc_id: Column) -> Column:
    """A key that any engine can compute again: md5 of the id's decimal form."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Target words of each source (columns source, source_size).

    The sources share the total by weight; none passes `cap` times its size, and what is cut off is
    shared again by weight among the others. In order of cap * size / weight the capped sources come
    first, so the share of one weight unit follows from running sums. One row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("long"))
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0))
    weights_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    unit = ranked.withColumn("unit", left / weights_left)
    ranked = unit.withColumn("rank", F.row_number().over(order))
    # the first source whose share by weight is within its cap sets the unit for it and all after it
    fits = F.col("weight") * F.col("unit") <= F.lit(cap) * F.col("source_size")
    ranked = ranked.withColumn("from_rank", F.min(F.when(fits, F.col("rank"))).over(whole))
    ranked = ranked.withColumn("share", F.max(F.when(F.col("rank") == F.col("from_rank"), F.col("unit"))).over(whole))
    return ranked.select(
        "source",
        "source_size",
        F.when(F.col("rank") >= F.col("from_rank"), F.col("weight") * F.col("share")).otherwise((F.lit(cap) * F.col("source_size")).cast("double")).alias("target"),
    )


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per row of docs (doc_id, text, source): size, source_size, target, taken.

    Only sizes and keys are shuffled, never texts. A source is range-sorted by its random key over
    as many partitions as its rows need, so a hot source is no hot task; the prefix sums of each
    partition and source are added to small per-partition totals.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    narrow = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), random_key(F.col("doc_id")).alias("key"))
    narrow = stored(narrow, "mix-sizes")
    by_source = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    target = targets(by_source, weights, cap)
    ranged = narrow.repartitionByRange(n, F.col("source").asc_nulls_last(), "key", "doc_id", "size")
    ranged = stored(ranged.withColumn("part", F.spark_partition_id()), "mix-ranged")
    part_sum = ranged.groupBy("part", "source").agg(F.sum("size").alias("part_size"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part_sum = part_sum.select(F.col("part").alias("p_part"), F.col("source").alias("p_source"), F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("part", "source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(part_sum, (F.col("part") == F.col("p_part")) & placed.source.eqNullSafe(F.col("p_source")), "left")
    target = target.withColumnRenamed("source", "t_source")
    placed = placed.join(target, F.col("source").eqNullSafe(F.col("t_source")), "left")
    budget = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("ahead") - F.col("inside")))
    return placed.select("doc_id", "source", "key", "size", "source_size", "target", (epochs * F.col("size") + cut).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of docs that the mix takes, each as often as the mix takes it, with the columns of docs.

    A document is repeated once for each whole epoch; the one that the budget cuts counts if at
    least half of its words are taken, so that each source stays within half a document of its target.
    """
    taken = plan(docs, weights, cap).where("taken > 0").select(
        F.col("doc_id").alias("__mix_t_doc"), F.col("source").alias("__mix_t_source"), F.col("size").alias("__mix_t_size"),
        F.floor(F.col("taken") / F.col("size") + F.lit(0.5)).cast("int").alias("__mix_t_times"),
    ).where("__mix_t_times > 0")
    # equal (doc_id, source, size) rows are interchangeable: they share one list of counts, by number
    seat = Window.partitionBy("__mix_t_doc", "__mix_t_source", "__mix_t_size").orderBy(F.col("__mix_t_times").desc())
    taken = taken.withColumn("__mix_t_seat", F.row_number().over(seat))
    mine = Window.partitionBy("doc_id", "source", "__mix_w_size").orderBy(F.lit(1))
    sized = docs.withColumn("__mix_w_size", word_count(F.col("text")))
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1)
    sized = sized.withColumn("__mix_w_seat", F.row_number().over(mine)) if not repeated.isEmpty() else sized.withColumn("__mix_w_seat", F.lit(1))
    joined = sized.join(
        small_side(stored(taken, "mix-taken")),
        F.col("doc_id").eqNullSafe(F.col("__mix_t_doc")) & F.col("source").eqNullSafe(F.col("__mix_t_source")) & (F.col("__mix_w_size") == F.col("__mix_t_size")) & (F.col("__mix_w_seat") == F.col("__mix_t_seat")),
        "inner",
    )
    return joined.withColumn("__mix_t_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_t_times")))).select(*[docs[c] for c in docs.columns])
