"""Event-time operators that run on streams and, unchanged, on tables.

``bounded`` adds the watermark only to a stream; everything else is the same plan, so that a stream read to its end gives the table's result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded(df: DataFrame, at: str, late: str) -> DataFrame:
    """A stream with a watermark of ``late``; a table as it is."""
    return df.withWatermark(at, late) if df.isStreaming else df


def tumbling(df: DataFrame, at: str, size: str, keys: list[str], late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """``start, keys..., n, total``: count and sum of ``value`` in windows of ``size``, sliding if ``slide`` is given."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    g = bounded(df, at, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), *keys, "n", "total")


def debounce(df: DataFrame, at: str, keys: list[str], quiet: str = "500 milliseconds", late: str = "1 hour") -> DataFrame:
    """``keys..., enqueued_at, updated_at, generation``: saves of one target are one work item until it has been quiet for ``quiet``.

    The state of an open item is one row, whatever the number of saves; an item is emitted when the watermark passes its end.
    """
    s = bounded(df, at, late).groupBy(F.session_window(at, quiet).alias("w"), *keys).agg(F.min(at).alias("enqueued_at"), F.max(at).alias("updated_at"), F.count("*").alias("generation"))
    return s.select(*keys, "enqueued_at", "updated_at", "generation")
