"""Boxes, gutters, cuts and tiles of page images, as expressions over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import exprs

# Limits of the detector and of the cuts.
MIN_AREA, MAX_AREA_SHARE = 1000, 0.4
MIN_ASPECT, MAX_ASPECT = 0.2, 5.0
MIN_FILL, DARK_MEAN, MAX_CONFIDENCE = 0.3, 80, 0.8
WHITE_ROW, BLACK_ROW, GUTTER_ROWS = 245, 15, 10
MIN_CHUNK, TARGET_CHUNK, CUT_SHARE = 800, 1500, 0.7
TILE, TILE_OVERLAP, MIN_TILE = 1500, 200, 50
LONG_PAGE, SPLIT_RATIO = 3.0, 2.0
DARK_BUBBLE = 100
BOX = ("x1", "y1", "x2", "y2")


def dark_boxes(candidates: DataFrame) -> DataFrame:
    """Dark regions (page, ord, x, y, w, h, area, mean, page_w, page_h) that look like bubbles, with box and confidence."""
    c = F.col
    fill = exprs.ratio(c("area"), c("w") * c("h"))
    aspect = exprs.ratio(c("w"), c("h"))
    largest = (c("page_w") * c("page_h") * MAX_AREA_SHARE).cast("long")
    kept = candidates.where(c("area").between(MIN_AREA, largest) & aspect.between(MIN_ASPECT, MAX_ASPECT) & (fill >= MIN_FILL) & (c("mean") <= DARK_MEAN))
    confidence = F.least(F.lit(MAX_CONFIDENCE), fill * (1 - c("mean") / 255))
    return kept.select("page", "ord", c("x").alias("x1"), c("y").alias("y1"), (c("x") + c("w")).alias("x2"), (c("y") + c("h")).alias("y2"), confidence.alias("conf"))


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Detections of two detectors, those of the first (is_dark 0) before the second (1), numbered anew in each page."""
    both = first.select("page", "ord", *BOX, "conf").withColumn("is_dark", F.lit(0)).unionByName(second.select("page", "ord", *BOX, "conf").withColumn("is_dark", F.lit(1)))
    return both.withColumn("ord", F.row_number().over(Window.partitionBy("page").orderBy("is_dark", "ord")) - 1)


def overlapping(boxes: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of a page's boxes that overlap by `least` or more: (page, a, b, iou) with a < b.

    Boxes meet in grid cells as large as a page's widest and highest box, so far-off boxes of a large page do not.
    """
    cell = boxes.groupBy("page").agg(F.greatest(F.max(F.col("x2") - F.col("x1")), F.lit(1)).alias("cw"), F.greatest(F.max(F.col("y2") - F.col("y1")), F.lit(1)).alias("ch"))
    placed = boxes.join(cell, "page").withColumn("cx", F.floor(F.col("x1") / F.col("cw"))).withColumn("cy", F.floor(F.col("y1") / F.col("ch")))
    box = F.struct(*BOX)
    left = placed.select("page", F.col("ord").alias("a"), box.alias("p"), F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)).alias("cx"), "cy")
    left = left.select("page", "a", "p", "cx", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)).alias("cy"))
    right = placed.select("page", F.col("ord").alias("b"), box.alias("q"), "cx", "cy")
    pairs = left.join(right, ["page", "cx", "cy"]).where("a < b").withColumn("iou", exprs.overlap(F.col("p"), F.col("q")))
    return pairs.where(F.col("iou") >= least).select("page", "a", "b", "iou")


def suppressed(boxes: DataFrame, limit: float = 0.5) -> DataFrame:
    """Greedy suppression: of a page's boxes, best first, those that overlap none kept before by `limit` or more, with their rank."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("nc"), "ord", *BOX)))
    keep = F.aggregate(
        "bs", F.filter("bs", lambda x: F.lit(False)),
        lambda acc, b: F.when(F.exists(acc, lambda k: exprs.overlap(k, b) >= limit), acc).otherwise(F.concat(acc, F.array(b))),
    )
    pages = boxes.groupBy("page").agg(ordered.alias("bs")).select("page", F.posexplode(keep).alias("rank", "b"))
    return pages.select("page", "rank", "b.ord", *[f"b.{c}" for c in BOX], (-F.col("b.nc")).alias("conf"))


def suppressed_where(boxes: DataFrame, limit: float = 0.5) -> DataFrame:
    """Boxes (page, ord, x1..y2, conf, is_dark) with overlaps suppressed, and numbered by rank, on pages that have a flagged one; others as they are."""
    item = F.struct((-F.col("conf")).alias("nc"), "ord", *BOX, "is_dark")
    keep = F.aggregate(
        "bs", F.filter("bs", lambda x: F.lit(False)),
        lambda acc, b: F.when(F.exists(acc, lambda k: exprs.overlap(k, b) >= limit), acc).otherwise(F.concat(acc, F.array(b))),
    )
    flagged = F.exists("bs", lambda x: x["is_dark"] == 1)
    pages = boxes.groupBy("page").agg(F.array_sort(F.collect_list(item)).alias("bs")).select("page", flagged.alias("flagged"), F.posexplode(F.when(flagged, keep).otherwise(F.col("bs"))).alias("rank", "b"))
    return pages.select("page", F.when(F.col("flagged"), F.col("rank")).otherwise(F.col("b.ord")).alias("ord"), *[f"b.{c}" for c in BOX], (-F.col("b.nc")).alias("conf"), "b.is_dark")


def gutters(rows: DataFrame, least: int = GUTTER_ROWS) -> DataFrame:
    """Runs of very light or very dark pixel rows (page, y, mean), y dense from 0: start, end (exclusive), centre."""
    flagged = rows.where((F.col("mean") > WHITE_ROW) | (F.col("mean") < BLACK_ROW))
    runs = flagged.withColumn("island", F.col("y") - F.row_number().over(Window.partitionBy("page").orderBy("y")))
    found = runs.groupBy("page", "island").agg(F.min("y").alias("start"), (F.max("y") + 1).alias("end")).where(F.col("end") - F.col("start") >= least)
    return found.select("page", "start", "end", F.floor((F.col("start") + F.col("end")) / 2).alias("center"))


def cuts(found: DataFrame, least: int = MIN_CHUNK, target: int = TARGET_CHUNK) -> DataFrame:
    """Cuts at gutter centres, each far enough from the one before: (page, cuts array)."""
    state = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<bigint>").alias("cuts"))
    far = lambda a, c: (c - a["last"] >= least) & (c - a["last"] >= target * CUT_SHARE)
    step = lambda a, c: F.when(far(a, c), F.struct(c.alias("last"), F.concat(a["cuts"], F.array(c)).alias("cuts"))).otherwise(a)
    pages = found.groupBy("page").agg(F.array_sort(F.collect_list(F.col("center").cast("long"))).alias("centers"))
    return pages.select("page", F.aggregate("centers", state, step, lambda a: a["cuts"]).alias("cuts"))


def chunks(cut_pages: DataFrame, heights: DataFrame) -> DataFrame:
    """Stretches between cuts (page, chunk, y1, y2), without those under MIN_TILE rows. heights: (page, height)."""
    joined = heights.join(cut_pages, "page", "left")
    edges = F.concat(F.array(F.lit(0).cast("long")), F.coalesce("cuts", F.array().cast("array<bigint>")), F.array(F.col("height").cast("long")))
    rows = joined.withColumn("e", edges).select("page", F.posexplode(F.arrays_zip(F.expr("slice(e, 1, size(e) - 1)").alias("y1"), F.expr("slice(e, 2, size(e) - 1)").alias("y2"))).alias("chunk", "p"))
    return rows.select("page", "chunk", "p.y1", "p.y2").where(F.col("y2") - F.col("y1") >= MIN_TILE)


def sliding_tiles(pages: DataFrame) -> DataFrame:
    """Overlapping tiles of tall pages (page, height): (page, y1, y2)."""
    starts = pages.select("page", "height", F.explode(F.sequence(F.lit(0), F.greatest("height", F.lit(0)), F.lit(TILE - TILE_OVERLAP))).alias("y1"))
    rows = starts.where((F.col("y1") == 0) | (F.col("y1") + TILE_OVERLAP < F.col("height"))).withColumn("y2", F.least(F.col("y1") + TILE, "height"))
    return rows.where(F.col("y2") - F.col("y1") >= MIN_TILE).select("page", "y1", "y2")


def tumbling_tiles(pages: DataFrame, share: float = SPLIT_RATIO) -> DataFrame:
    """Pages (page, width, height) in pieces of at most width * share rows, named _partN where there are several."""
    most = (F.col("width") * share).cast("int")
    rows = pages.withColumn("m", most).withColumn("s", F.when(F.col("height") > F.col("m"), F.sequence(F.lit(0), F.col("height") - 1, F.col("m"))).otherwise(F.array(F.lit(0))))
    rows = rows.select("page", "height", "m", F.size("s").alias("parts"), F.posexplode("s").alias("part", "y1"))
    end = F.when(F.col("parts") > 1, F.least(F.col("y1") + F.col("m"), "height")).otherwise(F.col("height"))
    name = F.concat(F.col("page").cast("string"), F.when(F.col("parts") > 1, F.concat(F.lit("_part"), (F.col("part") + 1).cast("string"))).otherwise(""))
    return rows.select("page", "part", "y1", end.alias("y2"), name.alias("name"))


def shifted(boxes: DataFrame) -> DataFrame:
    """Boxes of a tile (with its y_start) in page coordinates."""
    return boxes.withColumn("y1", F.col("y1") + F.col("y_start")).withColumn("y2", F.col("y2") + F.col("y_start")).drop("y_start")


def is_long(width: Column, height: Column) -> Column:
    return exprs.ratio(height, width) > LONG_PAGE


def is_dark(mean: Column, forced: Column | None = None) -> Column:
    dark = mean < DARK_BUBBLE
    return dark if forced is None else forced | dark


def ink(dark: Column) -> Column:
    return F.when(dark, "white").otherwise("black")
