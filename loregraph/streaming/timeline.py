"""Day windows over a stream of events, and upserts of a stream into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loregraph.operators.store import last_wins


def daily_counts(events: DataFrame, lateness: str = "2 days", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """day, kind, n per day of event time; rows later than the watermark are left out."""
    timed = events.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", lateness)
    counts = timed.groupBy(F.window("__t", "1 day"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "kind", "n")


def upsert_stream(rows: DataFrame, warehouse, name: str, keys: list[str], checkpoint: str, seq: str) -> StreamingQuery:
    """Every micro-batch is upserted into a table of the warehouse; of the rows of a key in it that of the largest ``seq`` wins."""

    def sink(batch: DataFrame, number: int) -> None:
        warehouse.upsert(name, last_wins(batch, keys, seq), keys, F.current_timestamp())

    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
