"""Streaming forms of the news path (an extension: the batch results don't depend on it)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions import text as X


def first_seen(items: DataFrame, late: str = "2 days") -> DataFrame:
    """Items whose address wasn't seen within the watermark; state is dropped behind it."""
    keyed = items.withColumn("url_key", X.url_key("url")).withWatermark("published_timestamp", late)
    return keyed.dropDuplicatesWithinWatermark(["url_key"])


def density(items: DataFrame, width: str = "7 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    """Items and approximate sources per window and source."""
    w = items.withWatermark("published_timestamp", late).groupBy(F.window("published_timestamp", width, slide), "source_id")
    return w.agg(F.count("*").alias("items"), F.max("published_timestamp").alias("latest"))
