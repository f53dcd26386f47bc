"""Joining bubbles to recognised and translated texts, with the fallbacks made visible in a status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import exprs


def speaking(bubbles: DataFrame) -> DataFrame:
    """Bubbles that are not blank, with their place among those of their page (pos)."""
    rows = bubbles.where(~exprs.is_blank(F.col("text")))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("page").orderBy("bubble")) - 1)


def overlay(bubbles: DataFrame, answers: DataFrame) -> DataFrame:
    """Lay answers (page, pos, answer) for the speaking bubbles over all bubbles; the others keep their text."""
    placed = speaking(bubbles).select("page", "bubble", "pos").join(answers, ["page", "pos"])
    return bubbles.join(placed.drop("pos"), ["page", "bubble"], "left").select("page", "bubble", "text", F.coalesce("answer", "text").alias("translated"), F.when(F.col("answer").isNotNull(), "answer").otherwise("kept").alias("status"))


def paired(bubbles: DataFrame, answers: DataFrame) -> DataFrame:
    """Inner join by position, as far as both sides go: answers has (page, texts array)."""
    listed = answers.select("page", F.posexplode("texts").alias("bubble", "translated"))
    return bubbles.join(listed, ["page", "bubble"])


def with_fallback(bubbles: DataFrame, answers: DataFrame) -> DataFrame:
    """As paired, but a page without answers keeps its own texts; bubbles past a short answer are missing."""
    pages = answers.select("page", F.lit(True).alias("answered"), "texts")
    rows = bubbles.join(pages, "page", "left")
    rows = rows.withColumn("translated", F.when(F.col("answered"), F.get("texts", F.col("bubble").cast("int"))).otherwise(F.col("text")))
    status = F.when(F.col("answered").isNull(), "fallback").when(F.col("translated").isNull(), "missing").otherwise("answer")
    return rows.select("page", "bubble", "text", "translated", status.alias("status"))


def reconciled(bubbles: DataFrame, answers: DataFrame) -> DataFrame:
    """Short answers are filled from the source's tail, long ones cut: one row for each bubble."""
    rows = bubbles.join(answers, "page", "left")
    got = F.get("texts", F.col("bubble").cast("int"))
    return rows.select("page", "bubble", "text", F.coalesce(got, "text").alias("translated"), F.when(got.isNull(), "padded").otherwise("answer").alias("status"))


def strict(bubbles: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers of another length than their page are refused as a whole."""
    size = bubbles.groupBy("page").agg(F.count("*").alias("n"))
    good = answers.join(size, "page").where(F.size("texts") == F.col("n")).drop("n")
    return with_fallback(bubbles, good)


def pairs_for_terms(originals: DataFrame, translations: DataFrame) -> DataFrame:
    """Pairs of non-empty texts of pages whose two sides are of equal length. Both: (page, texts)."""
    both = originals.join(translations.select("page", F.col("texts").alias("other")), "page").where(F.size("texts") == F.size("other"))
    rows = both.select("page", F.posexplode(F.arrays_zip("texts", "other")).alias("bubble", "p"))
    return rows.select("page", "bubble", F.col("p.texts").alias("text"), F.col("p.other").alias("translated")).where("text <> '' and translated <> ''")


def page_texts(bubbles: DataFrame) -> DataFrame:
    """(page, texts) in bubble order."""
    ordered = F.array_sort(F.collect_list(F.struct("bubble", "text")))
    return bubbles.groupBy("page").agg(F.transform(ordered, lambda x: x["text"]).alias("texts"))


def last_write(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one written last."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("v"))
    return best.select(*keys, *[F.col(f"v.{c}").alias(c) for c in others])


def outcome(results: DataFrame) -> DataFrame:
    """One row: how many recognised texts there are, how many are empty, how many failed (text, error)."""
    return results.agg(
        F.count_if(F.col("error").isNull() & (F.coalesce("text", F.lit("")) != "")).alias("success"),
        F.count_if(F.col("error").isNull() & (F.coalesce("text", F.lit("")) == "")).alias("empty"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def answered(raw: DataFrame) -> DataFrame:
    """Model answers (page, raw, n): the array of texts in them, or a status that says why there is none."""
    texts = F.from_json(exprs.unfenced(F.col("raw")), "array<string>")
    rows = raw.withColumn("texts", texts)
    status = F.when(F.col("texts").isNull(), "not_json").when(F.size("texts") != F.col("n"), "wrong_length").otherwise("answer")
    return rows.select("page", F.when(status == "answer", F.col("texts")).alias("texts"), status.alias("status"))


def answered_pages(raw: DataFrame) -> DataFrame:
    """Model answers for several pages (batch, raw): (batch, page, texts) from a JSON object of arrays by page, null texts where it is none."""
    found = raw.select("batch", F.from_json(exprs.unfenced(F.col("raw")), "map<string,array<string>>").alias("pages"))
    return found.select("batch", F.explode_outer("pages").alias("page", "texts"))


def texts_of(names: DataFrame, pages: DataFrame) -> DataFrame:
    """The texts of each page asked for, an empty list for a page without any. names: (page); pages: (page, texts)."""
    return names.join(pages, "page", "left").select("page", F.coalesce("texts", F.array().cast("array<string>")).alias("texts"))


def first_of_first(boxes: DataFrame) -> DataFrame:
    """The first detection of the first page that has any: one row, or none."""
    return boxes.orderBy("page", "ord").limit(1)


def totals(bubbles: DataFrame, k: int = 5) -> DataFrame:
    """One row: how many pages and bubbles there are, the first k pages, and how many follow them."""
    some = bubbles.select("page").distinct().orderBy("page").limit(k).agg(F.sort_array(F.collect_list("page")).alias("first_files"))
    all_ = bubbles.agg(F.countDistinct("page").alias("images"), F.count("*").alias("bubbles"))
    return all_.crossJoin(some).select("images", "bubbles", "first_files", (F.col("images") - F.size("first_files")).cast("long").alias("more"))


def concatenated(tiles: DataFrame) -> DataFrame:
    """Detections of the tiles of each page (page, tile, ord, ...) in one list a page, numbered anew in order of tile."""
    place = Window.partitionBy("page").orderBy("tile", "ord")
    return tiles.withColumn("ord", F.row_number().over(place) - 1).drop("tile")
