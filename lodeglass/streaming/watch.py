"""Keeping an index up to date from a stream of file events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENTS = "path string, kind string, ts timestamp, text string"
IGNORED = r"(?:\.db|-wal|-shm)$"


def latest_per_key(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the last row by `order`. One aggregation, combined per task before it moves, so a hot key is no hot task."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*keys, "_last.*").select(*events.columns)


def apply_events(batch: DataFrame, supported: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(files to parse: path, text; paths to delete) from a batch of events, the last of each path counts. Store files and other extensions are ignored."""
    ext = F.regexp_extract("path", r"\.([^./]*)$", 1)
    last = latest_per_key(batch.where(~F.col("path").rlike(IGNORED) & ext.isin(*supported)), ["path"], ["ts", "kind"])
    return last.where("kind in ('create', 'modify')").select("path", "text"), last.where("kind = 'remove'").select("path")


def watch(events: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, DataFrame], None], supported: tuple[str, ...], available_now: bool = False, interval: str = "300 milliseconds"):
    """Starts the stream: `on_batch(to_parse, to_delete)` per micro-batch. Batches take the place of debouncing: several events of a path in one batch
    are one. A batch that is run again after a failure gives the same index, since upserts and deletions are idempotent."""

    def handle(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            on_batch(*apply_events(batch, supported))
        finally:
            batch.unpersist()

    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events per window and kind, for streams with a timestamp `ts`: late rows within the watermark count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")
