"""The detector summary as a stream: hourly windows with a watermark, equal to the batch result once closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WATERMARK = "15 minutes"


def hourly(events: DataFrame, ts: str = "ts", key: str = "detector_id", value: str = "volume", streaming: bool = True) -> DataFrame:
    """Count and mean per key and hour; late rows within the watermark still count."""
    source = events.withWatermark(ts, WATERMARK) if streaming else events
    return source.groupBy(F.window(ts, "1 hour").alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value")).select(F.col("w.start").alias("hour"), key, "n", "mean_value")


def start(events: DataFrame, table: str, **names: str):
    """Write closed windows to a memory table (tests) by processing what is available."""
    return hourly(events, **names).writeStream.outputMode("append").format("memory").queryName(table).trigger(availableNow=True).start()
