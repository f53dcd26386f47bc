"""Image files as rows. Files that cannot be decoded vanish, as the uploads they stand for do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import exprs


def three_channels(data: Column, channels: Column) -> Column:
    """Pixel bytes with three bytes a pixel: a grey byte stands for all three, a fourth (alpha) byte is dropped."""
    digits = F.hex(data)
    grey = F.unhex(F.regexp_replace(digits, "(..)", "$1$1$1"))
    opaque = F.unhex(F.regexp_replace(digits, "(......)..", "$1"))
    return F.when(channels == 1, grey).when(channels == 4, opaque).otherwise(data)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, name, height, width, data) of the images under path, three bytes a pixel, blue first.

    Grey images are widened and alpha is dropped. An empty folder gives an empty table.
    """
    rows = spark.read.format("image").option("dropInvalid", True).load(path)
    name = exprs.stem(F.element_at(F.split("image.origin", "/"), -1))
    rows = rows.where(F.col("image.nChannels").isin(1, 3, 4))
    data = three_channels(F.col("image.data"), F.col("image.nChannels"))
    return rows.select(F.col("image.origin").alias("origin"), name.alias("name"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), data.alias("data"))


def numbered(images: DataFrame) -> DataFrame:
    """Images with page, their place in order of origin, counted by ranges so that no task sees all of them."""
    from inkwell.operators.terms import batches

    keys = batches(images.select(F.col("origin").alias("page")).distinct()).select(F.col("page").alias("k_origin"), F.col("number").cast("long").alias("page"))
    return images.join(keys, F.col("origin") == F.col("k_origin")).drop("k_origin")
