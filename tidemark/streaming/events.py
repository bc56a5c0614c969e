"""Streaming forms of ingest and of the daily figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.models import Judge
from tidemark.operators.ingest import ingest
from tidemark.sources.store import Store


def daily_counts(stream: DataFrame, id_col: str = "id", event_col: str = "occurred_at", value_col: str = "salience", slack: str = "72 hours") -> DataFrame:
    """Per day of event time, corrected until the watermark passes the day's end plus the slack; later rows are dropped.

    In update mode the values published before that are provisional, in append mode only the final ones come out.
    """
    once = stream.withWatermark(event_col, slack).dropDuplicatesWithinWatermark([id_col])
    return once.groupBy(F.window(event_col, "1 day")).agg(F.count("*").alias("n_events"), F.sum(value_col).alias("value")).select(F.date_format("window.start", "yyyy-MM-dd").alias("period_day"), "n_events", "value")


def sessions(stream: DataFrame, user_col: str = "user_id", time_col: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    s = stream.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap), user_col).agg(F.count("*").alias("n"))
    return s.select(user_col, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def ingest_stream(stream: DataFrame, store: Store, checkpoint: str, judge: Judge | None = None):
    """Starts ingest of an interaction stream; a batch that is replayed adds nothing, as ids follow from content."""

    def each(batch: DataFrame, _: int) -> None:
        ingest(store, batch, judge).count()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
