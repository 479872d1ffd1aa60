"""Sessions over a stream of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(messages: DataFrame, gap: str = "6 hours", late: str = "1 day", key: str = "chat_id", time: str = "ts") -> DataFrame:
    """Counts of messages by key and session; a gap above `gap` ends a session, as in batch. A session is out once the watermark has passed it. Works on
    batch input too. end_time is that of the last message."""
    s = messages.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n_messages"), F.max(time).alias("end_time"))
    return s.select(key, F.col("w.start").alias("start_time"), "end_time", "n_messages")
