"""Text layout inside bubbles: wrapping, font size, line places."""

from __future__ import annotations

import textwrap
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Sizes and paddings of lettering.
MIN_FONT, MAX_FONT = 10, 60
USABLE, LEADING, GLYPH = 0.8, 1.3, 0.6


def wrapped(text: Column, width: Column) -> Column:
    """Text with single white spaces in lines of at most width characters; words are never broken, line breaks count as spaces."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("line"))

    def step(a, w):
        fits = F.length(a["line"]) + 1 + F.length(w) <= width
        return (
            F.when(a["line"].isNull(), F.struct(a["done"].alias("done"), w.alias("line")))
            .when(fits, F.struct(a["done"].alias("done"), F.concat(a["line"], F.lit(" "), w).alias("line")))
            .otherwise(F.struct(F.concat(a["done"], F.array(a["line"])).alias("done"), w.alias("line")))
        )

    return F.aggregate(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), empty, step, lambda a: F.array_join(F.concat(a["done"], F.array(a["line"])), "\n"))


@F.pandas_udf(StringType())
def wrapped_raw(text: pd.Series, width: pd.Series) -> pd.Series:
    """As wrapped, for texts with runs of white space and tabs."""
    fill = lru_cache(4096)(lambda t, n: textwrap.fill(t, n, break_long_words=False, break_on_hyphens=False))
    return pd.Series([None if t is None else fill(t, max(1, int(n))) for t, n in zip(text, width)])


def fitted(boxes: DataFrame) -> DataFrame:
    """Font size, line height and wrapped text of (id, text, w, h): the largest size, in steps of two, that fits.

    A glyph is taken to be GLYPH of the size wide. Where nothing fits the least size comes with the text unwrapped.
    """
    box_w, box_h = (F.col("w") * USABLE).cast("int"), (F.col("h") * USABLE).cast("int")
    rows = boxes.withColumn("uw", box_w).withColumn("uh", box_h)
    guess = F.sqrt(F.col("uw") * F.col("uh") / (F.greatest(F.length("text"), F.lit(1)) * 0.8)).cast("int")
    rows = rows.withColumn("first", F.greatest(F.lit(MIN_FONT), F.least(F.lit(MAX_FONT), guess)))
    tried = F.filter(F.sequence(F.col("first"), F.lit(MIN_FONT - 1), F.lit(-1)), lambda z: (z >= MIN_FONT) & ((F.col("first") - z) % 2 == 0))
    option = lambda z: F.struct(z.alias("size"), wrapped(F.col("text"), F.greatest(F.lit(1), (F.col("uw") / (z * GLYPH)).cast("int"))).alias("lines"))
    high = lambda o: F.size(F.split(o["lines"], "\n")) * (o["size"] * LEADING).cast("int") <= F.col("uh")
    wide = lambda o: F.forall(F.split(o["lines"], "\n"), lambda x: F.length(x) * (o["size"] * GLYPH) <= F.col("uw"))
    good = F.filter(F.transform(tried, option), lambda o: high(o) & wide(o))
    rows = rows.withColumn("best", F.when((F.col("uw") > 0) & (F.col("uh") > 0), F.get(good, F.lit(0))))
    size = F.coalesce("best.size", F.lit(MIN_FONT))
    flat = (F.col("uw") <= 0) | (F.col("uh") <= 0)
    height = F.when(flat, F.lit(MIN_FONT)).otherwise((size * LEADING).cast("int"))
    return rows.select("id", "w", "h", size.alias("font_size"), height.alias("line_height"), F.coalesce("best.lines", "text").alias("lines"))


def placed_lines(laid: DataFrame) -> DataFrame:
    """A row for each line: its number, text, and place in the box, centred both ways (id, w, h, font_size, line_height, lines)."""
    rows = laid.withColumn("l", F.split("lines", "\n"))
    top = F.floor((F.col("h") - F.size("l") * F.col("line_height")) / 2)
    rows = rows.withColumn("top", top).select("id", "w", "font_size", "line_height", "top", F.posexplode("l").alias("line", "text"))
    width = (F.length("text") * F.col("font_size") * GLYPH).cast("int")
    return rows.select("id", "line", "text", F.floor((F.col("w") - width) / 2).cast("int").alias("x"), (F.col("top") + F.col("line") * F.col("line_height")).cast("int").alias("y"))
