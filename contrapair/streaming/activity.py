"""Job activity on a stream: session windows with a watermark for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def activity_sessions(stream: DataFrame, job: str, ts: str, gap: str, lateness: str) -> DataFrame:
    """One row per job and uninterrupted session; the state of closed sessions is dropped after `lateness`."""
    x = stream.withWatermark(ts, lateness).groupBy(job, F.session_window(ts, gap).alias("w"))
    return x.agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")).drop("w")


def start_activity(sessions: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append sessions as they close."""
    w = sessions.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def start_activity_snapshot(sessions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All sessions so far, open ones included, rewritten after each batch."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    w = sessions.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint)
    return w.trigger(availableNow=True).start()
