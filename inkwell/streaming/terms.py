"""Running term counts over a stream of bubbles (an extension: the batch counts, kept up to date)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators import terms


def running_counts(bubbles: DataFrame, time: str | None = None, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts of terms in a stream of (page, bubble, text); with a time column, for each window, late rows dropped past the watermark."""
    if time is None:
        return terms.hits(bubbles).groupBy("term").agg(F.count("*").alias("n"))
    seen = terms.hits(bubbles.withWatermark(time, late), time)
    return seen.groupBy(F.window(time, window), "term").agg(F.count("*").alias("n"))
