"""The page plan: images to boxes, texts, translations and laid-out lines, as one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import exprs
from inkwell.operators import alignment, geometry, images, layout, terms
from inkwell.plans import providers
from inkwell.sources.storage import stored


def found_boxes(pages: DataFrame, make: Callable[[], providers.Detector], name: str = "detector") -> DataFrame:
    """Boxes (page, ord, x1..y2, conf) that a detector sees on pages (page, height, width, data).

    Long pages are shown in parts: between safe cuts at their gutters if they have any, else in overlapping
    tiles; boxes of the parts are moved to the page and suppressed across it. The detector is made once a worker.
    """
    whole = pages.select("page", "height", "width", "data")
    tall = geometry.is_long(F.col("width"), F.col("height"))
    # long pages are decoded for their profiles; what is kept of those is the cuts
    heights = whole.where(tall).select("page", "height")
    cut = geometry.cuts(geometry.gutters(images.row_profiles(whole.where(tall)))).where(F.size("cuts") > 0)
    parts = geometry.chunks(cut, heights.join(cut.select("page"), "page", "left_semi")).select("page", F.col("y1").cast("int").alias("y1"), F.col("y2").cast("int").alias("y2"))
    tiles = geometry.sliding_tiles(heights.join(cut.select("page"), "page", "left_anti")).select("page", F.col("y1").cast("int").alias("y1"), F.col("y2").cast("int").alias("y2"))
    listed = parts.union(tiles).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("y1", "y2"))).alias("parts"))
    listed = stored(listed, "page-parts")
    shown = whole.join(listed, "page", "left").withColumn("long", tall)

    def seen(frames):
        import pandas as pd

        detector = providers.cached(("detector", name), make)
        for frame in frames:
            rows = []
            for page, height, width, data, long, parts_ in zip(*(frame[c] for c in ("page", "height", "width", "data", "long", "parts"))):
                spans = [(int(p["y1"]), int(p["y2"])) for p in parts_] if parts_ is not None else [] if long else [(0, height)]
                for tile, (y1, y2) in enumerate(spans):
                    part = data[y1 * width * 3 : y2 * width * 3]
                    rows += [(page, long, tile, k, x1, a, x2, b, conf, y1) for k, (x1, a, x2, b, conf, *_) in enumerate(detector(y2 - y1, width, part))]
            yield pd.DataFrame(rows, columns=["page", "long", "tile", "ord", "x1", "y1", "x2", "y2", "conf", "y_start"])

    kind = "page long, long boolean, tile int, ord int, x1 double, y1 double, x2 double, y2 double, conf double, y_start double"
    boxes = alignment.concatenated(geometry.shifted(shown.mapInPandas(seen, kind)))
    return geometry.suppressed_where(boxes.withColumnRenamed("long", "is_dark").withColumn("is_dark", F.col("is_dark").cast("int"))).select("page", "ord", *geometry.BOX, "conf")


def detect(pages: DataFrame, boxes: DataFrame, dark: bool = True) -> DataFrame:
    """Boxes of the pages: those of a detector (page, ord, x1..y2, conf) and, if asked for, dark regions.

    Overlaps are suppressed across both only on pages that have dark boxes. Pages are read once. A detector's
    own flag is_dark is kept where the boxes have it, and counts as 0 where it is null.
    """
    flag = F.coalesce(F.col("is_dark"), F.lit(0)) if "is_dark" in boxes.columns else F.lit(0)
    first = boxes.select("page", F.col("ord").cast("int").alias("ord"), *[F.col(c).cast("double").alias(c) for c in (*geometry.BOX, "conf")], flag.cast("int").alias("is_dark"))
    if not dark:
        return first
    second = geometry.dark_boxes(images.dark_candidates(pages))
    second = second.select("page", "ord", *[F.col(c).cast("double").alias(c) for c in (*geometry.BOX, "conf")], F.lit(1).alias("is_dark"))
    both = first.withColumn("second", F.lit(0)).unionByName(second.withColumn("second", F.lit(1)))
    both = both.withColumn("ord", F.row_number().over(Window.partitionBy("page").orderBy("second", "ord")) - 1)
    return geometry.suppressed_where(both.select("page", "ord", *geometry.BOX, "conf", F.greatest("is_dark", "second").alias("is_dark")))


def recognise(crops: DataFrame, read: providers.Recogniser, at_once: int = 10, wait: bool = False) -> DataFrame:
    """(page, bubble, text, error) of crops (page, bubble, height, width, data); a recogniser that fails gives an empty text and says why.

    Each worker has at most `at_once` calls under way; `wait` is for engines on a network.
    """
    import pandas as pd

    def run(frames):
        for frame in frames:
            how = {} if wait else {"sleep": lambda _: None}
            got = providers.read_texts(read, list(zip(frame["height"], frame["width"], frame["data"])), at_once, **how)
            yield pd.DataFrame({"page": frame["page"], "bubble": frame["bubble"], "text": [t for t, _ in got], "error": [e for _, e in got]})

    return crops.select("page", "bubble", "height", "width", "data").mapInPandas(run, "page long, bubble long, text string, error string")


def translate(bubbles: DataFrame, method: str = "gemini", target: str = "en", pages_per_call: int = 10, wait: bool = True) -> DataFrame:
    """Bubbles with translations and their status, pages_per_call pages with text a call; blank bubbles pass through."""
    providers.translator(method, target)  # an unknown method fails here, not in a task
    spoken = bubbles.where(~exprs.is_blank(F.col("text"))).select("page").distinct()
    numbers = terms.batches(spoken, pages_per_call).select("page", "batch")
    rows = bubbles.join(numbers, "page", "left").withColumn("batch", F.coalesce("batch", -F.col("page") - 1))
    return rows.select("batch", "page", "bubble", "text").groupBy("batch").applyInPandas(providers.translate_groups(method, target, wait=wait), "batch long, page long, bubble long, text string, translated string, status string")


def translate_pages(bubbles: DataFrame, method: str = "gemini", target: str = "en", pages_per_call: int = 10, wait: bool = True) -> DataFrame:
    """As translate, but a call has whole pages, and its prompt the terms that the batches before it hold.

    The terms come from the source texts, so no batch waits for another one's answer.
    """
    providers.translator(method, target)
    spoken = bubbles.where(~exprs.is_blank(F.col("text"))).select("page").distinct()
    numbers = terms.batches(spoken, pages_per_call).select("page", "batch")
    seen = terms.hits(bubbles.join(numbers, "page"), "batch")
    contexts = terms.batch_contexts(terms.carried(seen), numbers)
    rows = bubbles.select("page", "bubble", "text").join(numbers, "page").join(contexts, "batch")
    done = rows.groupBy("batch").applyInPandas(providers.translate_page_groups(method, target, wait=wait), "batch long, page long, bubble long, text string, translated string, status string")
    silent = bubbles.join(numbers, "page", "left_anti").select((-F.col("page") - 1).alias("batch"), F.col("page").cast("long").alias("page"), F.col("bubble").cast("long").alias("bubble"), "text", F.col("text").alias("translated"), F.lit("blank").alias("status"))
    return done.unionByName(silent)


def lettered(translated: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lines to draw in each box: (page, bubble, line, text, x, y, ink)."""
    sized = translated.join(boxes.select("page", F.col("ord").cast("long").alias("bubble"), *geometry.BOX, "is_dark"), ["page", "bubble"]).where(~exprs.is_blank(F.col("translated")))
    rows = sized.select(F.struct("page", "bubble", "x1", "y1", "is_dark").alias("id"), exprs.strip(F.col("translated")).alias("text"), (F.col("x2") - F.col("x1")).cast("int").alias("w"), (F.col("y2") - F.col("y1")).cast("int").alias("h"))
    lines = layout.placed_lines(layout.fitted(rows))
    return lines.select("id.page", "id.bubble", "line", "text", (F.col("id.x1") + F.col("x")).cast("int").alias("x"), (F.col("id.y1") + F.col("y")).cast("int").alias("y"), geometry.ink(F.col("id.is_dark") == 1).alias("ink"))


def page_answers(translated: DataFrame) -> DataFrame:
    """(page, texts) as a translator of whole pages would return them."""
    return alignment.page_texts(translated.select("page", "bubble", F.col("translated").alias("text")))
