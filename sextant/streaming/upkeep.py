"""Keeping the search tables up to date from a stream of documents, and debouncing a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sextant.operators.indexes import IndexStore

#: Numbers of a stream's segments are this far apart, so that compacted ones fit between them.
SEGMENT_STEP = 2


def latest(batch: DataFrame, key: str = "doc_id", order: str | None = None) -> DataFrame:
    """One row for each document of a batch, the one with the largest ``order`` (or text)."""
    best = F.max_by(F.struct("*"), order or "text").alias("r")
    return batch.groupBy(key).agg(best).select("r.*")


def maintain_index(stream: DataFrame, store: IndexStore, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of documents (doc_id, text) becomes one segment of the store; a repeated batch writes the same segment again."""

    def apply(batch: DataFrame, epoch: int) -> None:
        store.index(latest(batch), SEGMENT_STEP * (epoch + 1))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()


def debounced(events: DataFrame, gap: str = "300 milliseconds", key: str = "user_id", time: str = "ts") -> DataFrame:
    """Sessions of a key's events no further apart than ``gap``; the trigger fires at the end of each. Works on streams with a watermark too."""
    out = events.groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("n"), F.max(time).alias("last"))
    return out.select(key, F.col("s.start").alias("start"), F.col("last").alias("last"), "n")
